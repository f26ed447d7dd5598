"""Secret scans: assignments, access keys and long hex strings, and random strings that a tokenizer finds hard to pack."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Strings worth tokenizing: 16 or more characters of keys and encodings; what stands after an equals sign is one, too.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: What is known not to be secret: digests by their length, UUIDs, numbers and dates, plain or joined words, paths of words.
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|sha\d+-[A-Za-z0-9+/]+={0,2}"
    r"|[0-9+/_=-]+"
    r"|[/_+=-]*[A-Za-z][a-z]*(?:[/_+=-]+[A-Za-z][a-z]*|[A-Z][a-z]+)*[/_+=-]*\d{0,4}"
    r"|[/_+=-]*[A-Z]+(?:[/_+=-]+[A-Z]+)*[/_+=-]*\d{0,4})"
)

_CODERS: dict[str, object] = {}


def coder(path: str):
    """The tiktoken vocabulary in a file of base64 ranks; one for each worker process."""
    if path not in _CODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


class Efficiency:
    """Whether a string packs badly: fewer than `least` characters a token.  Verdicts of recent strings are kept."""

    def __init__(self, vocabulary: str, least: float, held: int = 100_000) -> None:
        self.coder, self.least, self.held = coder(vocabulary), least, held
        self.seen: OrderedDict[str, bool] = OrderedDict()

    def random(self, text: str) -> bool:
        if text not in self.seen:
            if len(self.seen) >= self.held:
                self.seen.popitem(last=False)
            mixed = re.search(r"\d", text) and re.search(r"[A-Za-z]", text) or re.search(r"[a-z]", text) and re.search(r"[A-Z]", text)
            self.seen[text] = bool(mixed) and not KNOWN.fullmatch(text) and len(text) < self.least * len(self.coder.encode_ordinary(text))
        return self.seen[text]


def spans(text: str, test: Efficiency) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; end is exclusive and a span is the whole match."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    starts, ends = [f[0] for f in found], list(accumulate((f[2] for f in found), max))
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not (before and ends[before - 1] > m.start()) and test.random(m[0]):
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(vocabulary: str, least: float):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = Efficiency(vocabulary, least)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part, rows = b.slice(i, 1000), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    found = spans(text.as_py() if text.is_valid else "", test)
                    says = [f"{k}:{a}:{z}" for k, a, z in found]
                    base = ",".join(s for s, f in zip(says, found, strict=True) if f[0] != "random")
                    counts = {f"n_{k}": sum(f[0] == k for f in found) for k in KINDS}
                    rows.append({"doc_id": doc, **counts, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(says)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def scan_secrets(docs: DataFrame, vocabulary: str, least: float = 1.9) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of each row of docs (doc_id, text).

    Base spans are those of ASSIGN (6 or more characters in group 2), ACCESS (20 or more) and HEX (24 or more), each
    kind leftmost and non-overlapping over the whole text.  `random` spans are CANDIDATEs with letters of both cases
    or letters and digits, not KNOWN, that meet no base span and have under `least` characters a token in the
    tiktoken vocabulary of the file `vocabulary`.  A null text is empty; null or repeated doc_ids are ordinary rows;
    other columns are not read.  One narrow pass, no shuffle.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scan(vocabulary, least), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE: dict[str, str] = {}
