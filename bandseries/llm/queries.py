"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import clustering, decontaminate, mixing, neardup, packing, periods, pii, quality, secrets, sharding, tokens, urls, warc

MODULES = (mixing, secrets, warc, neardup, quality, pii, decontaminate, urls, sharding, tokens, periods, clustering, packing)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
