"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and mail addresses."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")

EMAIL = re.compile(r"""[^\s@<>()\[\],;:"'|=]+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}""")
LOCAL_END = set("@<>()[],;:\"'|=")
#: Where an IPv6 address may be, and its form; it must be whole, or have three groups and a digit, so that a::b is none.
COLONS, IPV6 = re.compile(r":[0-9A-Fa-f]{0,4}:"), re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{6,39}(?![\w:]|\.\d)", re.A)
#: Country codes of one and two digits; all others have three.
COUNTRY_CODES = set(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Numbers by kind, in the order in which they are tried: what may stand before one, its form, what may not follow.
NUMBERS = [
    (kind, re.compile(before + form, re.A), re.compile(form, re.A), re.compile(after, re.A))
    for kind, before, form, after in (
        ("iban", r"(?<![A-Za-z0-9])", r"[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"(?![A-Za-z0-9])"),
        ("date", r"(?<![\w.+-])", r"\d{4}-\d{2}-\d{2}", r"(?=[Tt]\d{2})|(?![\w/-]|\.\d)"),
        ("date", r"(?<![\w.+-])", r"\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}", r"(?![\w/-]|\.\d)"),
        ("ssn", r"(?<![\w.+-])", r"\d{3}-\d{2}-\d{4}", r"(?![\w-]|\.\d)"),
        ("ip", r"(?<![\w.-])", r"\d{1,3}(?:\.\d{1,3}){3}", r"(?![\w-]|\.\d)"),
        ("phone", r"(?<!\w)", r"(?:\+\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{2,4}(?:[\x20.-]?\d{2,4}){1,3}|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}|(?:1-)?[2-9]\d{2}-\d{3}-\d{4}|(?:1\.)?[2-9]\d{2}\.\d{3}\.\d{4}", r"(?!\w|-(?!\d)|\.\d)"),
        ("card", r"(?:(?<![\w.-])|(?<=\d-))", r"\d(?:[\x20-]?\d){12,18}", r"(?!\w|-(?!\d)|\.\d)"),
    )
]
#: Most characters of a number with its separators, and where one may end.
LONGEST, BORDER = 48, re.compile(r"(?<=[A-Z0-9])(?:(?![A-Za-z0-9])|(?=[Tt]\d))", re.A)
DIGITS = re.compile("[0-9]+")
#: A number's first digit is at most this far from its start: two letters, or a plus sign or bracket.
LEAD = 2


def number_at(text: str, start: int, stop: int, pseudonym: Callable[[str, str], str | None]) -> tuple[str, int, int, str] | None:
    """The valid number that starts there and ends by `stop`, as (kind, start, end, pseudonym).

    Kinds are tried in order and each at every end that its form has, the longest first: an invalid long match hides
    neither a shorter valid one nor another kind.
    """
    ends = None
    for kind, begins, form, after in NUMBERS:
        if not begins.match(text, start, stop):
            continue
        if ends is None:
            ends = [m.start() for m in BORDER.finditer(text, start + 1, min(start + LONGEST + 1, len(text))) if m.start() <= stop][::-1]
        for end in ends:
            if after.match(text, end) and form.fullmatch(text, start, end):
                new = pseudonym(kind, text[start:end])
                if new is not None:
                    return kind, start, end, new
    return None


def values(text: str, pseudonym: Callable[[str, str], str | None]) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of the values, in order: mail addresses, and valid numbers outside these."""
    fixed, at = [], text.find("@")
    while at >= 0:
        begin, least = at, fixed[-1][2] if fixed else 0
        while begin > least and not (text[begin - 1] in LOCAL_END or text[begin - 1].isspace()):
            begin -= 1
        m = EMAIL.match(text, begin)
        if m:
            fixed.append(("email", m.start(), m.end(), pseudonym("email", m[0])))
        at = text.find("@", m.end() if m else at + 1)
    if "::" in text or COLONS.search(text):
        others = ((m, pseudonym("ip", m[0])) for m in IPV6.finditer(text))
        spans = [(a, z) for _, a, z, _ in fixed]
        fixed += [("ip", m.start(), m.end(), new) for m, new in others if new and not any(a < m.end() and m.start() < z for a, z in spans)]
        fixed.sort(key=lambda f: f[1])
    done, k = 0, 0
    for run in DIGITS.finditer(text):
        while k < len(fixed) and fixed[k][2] <= run.start():
            done = max(done, fixed[k][2])
            yield fixed[k]
            k += 1
        inside = k < len(fixed) and fixed[k][1] < run.end()
        if inside or run.start() < done:
            continue
        for p in range(max(done, run.start() - LEAD), run.start() + 1):
            found = number_at(text, p, fixed[k][1] if k < len(fixed) else len(text), pseudonym)
            if found:
                yield found
                done = found[2]
                break
    yield from fixed[k:]


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0 .. n - 1 without fixed points.

    E is a Feistel network over the next even number of bits, walked until it is inside the range again; the
    permutation is E(x) moved on by one and taken back through E.
    """

    def __init__(self, key: bytes, rounds: int = 8) -> None:
        self.key, self.rounds = hashlib.sha256(key).digest(), rounds

    def _f(self, tweak: bytes, r: int, x: int, bits: int) -> int:
        data = bytes([r]) + x.to_bytes(16, "big") + tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, order = (1 << half) - 1, range(self.rounds)
        while True:
            a, b = x >> half, x & mask
            for r in reversed(order) if back else order:
                if back:
                    a, b = b ^ self._f(tweak, r, a, half), a
                else:
                    a, b = b, a ^ self._f(tweak, r, b, half)
            x = a << half | b
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        t = f"{tweak}/{n}".encode()
        return self._walk((self._walk(x, n, t, False) + 1) % n, n, t, True)


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    doubled = [int(c) * (2 - k % 2) for k, c in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def _refill(text: str, digits: str) -> str:
    """text with its digits exchanged, one by one."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """Pseudonyms under one key: equal values have equal pseudonyms, whatever their separators."""

    def __init__(self, key: str) -> None:
        self.feistel = Feistel(key.encode())
        self.of = lru_cache(50_000)(self._of)

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym; None if the text isn't a valid value."""
        return getattr(self, f"_{kind}")(text)

    def _number(self, digits: str, tweak: str) -> str:
        return str(self.feistel.permute(int(digits), 10 ** len(digits), tweak)).zfill(len(digits))

    def _letters(self, text: str, tweak: str) -> str:
        """ASCII letters and digits, each kept in its class and place."""
        sets = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalnum() else c for c in text]
        x, n = 0, 1
        for c, s in zip(text, sets, strict=True):
            x, n = x * len(s) + s.index(c), n * len(s)
        x, out = self.feistel.permute(x, n, tweak + "".join(s[0] for s in sets)), []
        for s in reversed(sets):
            x, k = divmod(x, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    def _email(self, text: str) -> str:
        """Case stays where it is and decides nothing else."""
        local, _, domain = text.rpartition("@")
        plain = "".join(c.lower() if c.isascii() else c for c in local)
        done = "".join(self._letters(plain[i : i + 24], f"email{i}") for i in range(0, len(plain), 24))
        if done == plain:  # nothing in it to permute
            return f"{hashlib.blake2b(plain.encode(), key=self.feistel.key, digest_size=6).hexdigest()}@{domain}"
        return f"{''.join(n.upper() if c.isascii() and c.isupper() else n for c, n in zip(local, done, strict=True))}@{domain}"

    def _card(self, text: str) -> str | None:
        d = "".join(c for c in text if c.isdigit())
        if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = d[0] + self._number(d[1:-1], f"card{d[0]}")
        return _refill(text, body + str(luhn(body)))

    def _phone(self, text: str) -> str | None:
        d = "".join(c for c in text if c.isdigit())
        if not 8 <= len(d) <= 15:
            return None
        # The digits decide alone: a country code after a plus, or a 1 before ten digits; ten digits without one are as with +1.
        if text[0] == "+":
            keep = next((n for n in (1, 2) if d[:n] in COUNTRY_CODES), 3)
        else:
            keep = int(len(d) == 11 and d[0] == "1")
        code = d[:keep] or ("1" if len(d) == 10 else "")
        return _refill(text, d[:keep] + self._number(d[keep:], f"phone{code}"))

    def _ssn(self, text: str) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = text.replace("-", "")
        if not valid(d):
            return None
        while not valid(d := self._number(d, "ssn")):
            pass
        return _refill(text, d) if d != text.replace("-", "") else None

    def _ip(self, text: str) -> str | None:
        if ":" in text:
            try:
                x = int(ipaddress.IPv6Address(text))
            except ValueError:
                return None
            if sum(map(bool, text.split(":"))) < 3 or not any(c.isdigit() for c in text):
                return None
            return str(ipaddress.IPv6Address(self.feistel.permute(x, 1 << 128, "ip6")))
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self._letters(plain[4:], f"iban{plain[:2]}")
        whole = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(whole) for c in text)

    def _date(self, text: str) -> str | None:
        sep = next(c for c in text if not c.isdigit())
        parts = text.split(sep)
        if sep == "/" and int(parts[0]) > 12:  # no month: the day comes first
            shape = "dmy"
        else:
            shape = {"-": "ymd", "/": "mdy", ".": "dmy"}[sep]
        y, m, d = (parts[shape.index(c)] for c in "ymd")
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + self.feistel.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
        if shape == "dmy" and sep == "/" and new.day <= 12:  # a reader would take the day for the month
            shape, m, d = "mdy", d, m
        shown = {"y": f"{new.year}", "m": f"{new.month:0{len(m)}d}", "d": f"{new.day:0{len(d)}d}"}
        return sep.join(shown[c] for c in shape)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and what was replaced: (kind, start, end) in the text as it was."""
        found, out, last = [], [], 0
        for kind, start, end, new in values(text, self.of):
            found.append((kind, start, end))
            out += [text[last:start], new]
            last = end
        return "".join((*out, text[last:])), found


def _run(key: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                    new, found = names.replace(text.as_py()) if text.is_valid else (None, [])
                    rows.append({"doc_id": doc, "text": new, **{f"n_{k}": sum(f[0] == k for f in found) for k in KINDS}, "spans": ",".join(f"{k}:{a}:{z}" for k, a, z in found)})
                out = pa.RecordBatch.from_pylist(rows, schema)
                yield out.set_column(1, "text", out["text"].cast(pa.string()))

    return run


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, counts by kind, and the replaced spans, of each row of docs (doc_id, text).

    Cards (13 to 19 digits) must pass Luhn and IBANs modulo 97, dates must exist (1900 to 2099), phones have 8 to 15
    digits, IPv4 addresses four octets, IPv6 addresses eight groups (or three beside ::), US social security numbers assignable
    parts; 12/25/2024 and 25/12/2024 are one date.  A value's digits (of mail addresses the letters and digits before the @, case aside) are permuted under `key` within its format: separators, lengths, a
    card's first digit and its check digits, country codes and mail domains stay valid.  No value keeps its own text, and
    equal values get equal pseudonyms in all documents; invalid look-alikes stay, but a valid value inside a longer invalid
    run, between its separators, does not.  A null text stays null; repeated
    rows and null doc_ids are ordinary rows; other columns are not read.  No rows: an empty result.  One narrow pass, no shuffle.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    return docs.select("doc_id", "text").mapInArrow(_run(key), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")


def op6_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a secret of whoever runs it: spark.bandseries.pseudonym.key, with a default for tests only."""
    key = spark.conf.get("spark.bandseries.pseudonym.key", None)
    if key is None:
        warnings.warn("spark.bandseries.pseudonym.key is unset: pseudonyms under the key for tests can be taken back by anyone", stacklevel=2)
        key = "for tests only"
    return pseudonymise(table(spark, sf_dir, "documents"), key)


QUERIES = {"op6_feistel_pii": op6_feistel_pii}
ORACLE: dict[str, str] = {}
