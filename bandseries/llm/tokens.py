"""Token ids in binary: shards of whole documents, each packed by Re-Pair grammar compression."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, small, table
from .textnum import Hasher, U, alike, blocks, gather, trim

END = 0  # the id after each document

#: Unicode's White_Space, as the tokenizer's pattern takes it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The tokenizer's own pieces never cross the borders of these chunks, so chunks can be encoded one by one.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


#: Kinds of bytes: those of a-z and of letters with accents in U+00C0 to U+00FF, digits, ASCII marks; 0 for all others.
LETTER, DIGIT, MARK = 1, 2, 3
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
#: Last bytes of characters that may be white space.
MAYBE_WHITE = np.arange(256) >= 128
MAYBE_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: How many pieces one call of the tokenizer takes as a string.
RUN = 256


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of whole characters."""
    out = KINDS[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        out[lead], out[lead + 1] = LETTER, LETTER
    return out


def changes(data: np.ndarray) -> np.ndarray:
    """Whether a byte is of another kind than the one before: the tokenizer always cuts there, save after an apostrophe (`'s`)."""
    kind = kinds(data)
    out = np.zeros(len(data), bool)
    out[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((data[:-1] == 39) & (kind[1:] == LETTER))
    return out


class Encoder:
    """Ids of whole texts, by the tokenizers library; the ids of chunks seen before are looked up.

    Chunks are found by hashes and then compared byte by byte: one that has another one's hash is encoded by itself.  At
    most `held` chunks, of about 80 bytes each, or 16 times as many ids are remembered in a worker process; then those
    that were not met again are forgotten, or all if that leaves more than half.
    """

    def __init__(self, path: str, held: int = 300_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.whole = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.whole.get_added_tokens_decoder().values()]
        self.pieces = ByteLevel(add_prefix_space=False, use_regex=True)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.bytes = np.zeros(256, "<u2")  # the library's letters for bytes
        self.bytes[shown], self.bytes[hidden] = shown, 256 + np.arange(len(hidden))
        # The model alone, over pieces in these letters; a blank, which is none of them, stands after each piece.
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.size = np.zeros(1 + max(vocabulary.values()), np.int64)  # how many bytes an id stands for
        self.size[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.all_bytes = all(chr(x) in vocabulary for x in self.bytes.tolist())
        self.held = held
        self.clear()
        del vocabulary
        trim()

    def clear(self) -> None:
        self.n, self.slots = 0, np.full(1 << 16, -1, np.int32)  # the number of a chunk, at its hash or after; -1: free
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0  # the bytes of chunks of more than 16
        # By number: hash, place and number of ids, number of bytes, the first and the last 8 of these, place in raw, whether met again.
        kinds = {"key": U, "begin": np.int32, "length": np.int32, "long": np.int32, "head": U, "tail": U, "place": np.int64, "again": bool}
        self.of = {name: np.zeros(1 << 14, kind) for name, kind in kinds.items()}

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keeps the ids of new chunks; the first one's number."""
        first, n = self.n, self.n + len(lengths)
        if n > len(self.of["key"]):
            self.of = {name: np.resize(x, max(n, 3 * len(x) // 2)) for name, x in self.of.items()}
        self.flat, self.used = _added(self.flat, self.used, ids)
        self.of["length"][first:n] = lengths
        self.of["begin"][first:n] = self.used - len(ids) + np.cumsum(lengths) - lengths
        self.of["again"][first:n] = False
        self.n = n
        return first

    def _enter(self, number: np.ndarray) -> None:
        """Makes chunks, no two of one hash and none of a known one, known by their hashes."""
        if 3 * self.n > len(self.slots):
            number = np.concatenate((self.slots[self.slots >= 0], number))
            self.slots = np.full(1 << int(5 * self.n).bit_length(), -1, np.int32)
        last = len(self.slots) - 1
        place = (self.of["key"][number] & U(last)).astype(np.int64)
        while len(number):
            free = self.slots[place] < 0
            self.slots[place[free]] = number[free]
            left = self.slots[place] != number
            number, place = number[left], place[left] + 1 & last

    def _found(self, hashed: np.ndarray) -> np.ndarray:
        """The number of the known chunk of each hash; -1: none."""
        key, last = self.of["key"], len(self.slots) - 1
        place = (hashed & U(last)).astype(np.int64)
        number = self.slots[place]
        going = np.flatnonzero((number >= 0) & (key[number] != hashed))
        while len(going):
            place[going] = place[going] + 1 & last
            number[going] = now = self.slots[place[going]]
            going = going[(now >= 0) & (key[now] != hashed[going])]
        return number

    def _forget(self) -> None:
        """Leaves the chunks that were met again since they were learnt, or since this was last done."""
        known = self.slots[self.slots >= 0]
        old, known = (self.of, self.flat, self.raw), np.sort(known[self.of["again"][known]])
        self.clear()
        of, flat, raw = old
        if not 0 < len(known) <= self.held // 2 or of["length"][known].sum() > 8 * self.held:
            return
        number = np.arange(self._store(gather(flat, of["begin"], of["length"], known), of["length"][known]), self.n)
        for name in ("key", "long", "head", "tail"):
            self.of[name][number] = of[name][known]
        far = of["long"][known] > 16
        self._keep_bytes(number[far], gather(raw, of["place"], of["long"], known[far]))
        self._enter(number)

    def learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes the chunks data[start:end] and keeps their ids; their numbers.

        Plain chunks are one piece, or a line end and a piece: after a space or line end, bytes of one kind.
        """
        n = end - start
        numbers = np.zeros(len(n), np.int32)
        flat = gather(data, start, n, np.arange(len(n)))
        begin = np.cumsum(n) - n
        kind = kinds(flat)
        head = flat[begin]
        led = (head == 32) | (head == 10)
        kind[begin[led & (n == 1)]] = MARK
        two = begin[led & (n > 1)]
        kind[two] = kind[two + 1]
        least = np.minimum.reduceat(kind, begin)
        plain = (least > 0) & (least == np.maximum.reduceat(kind, begin)) & self.all_bytes
        if plain.any():
            own = n[plain]
            ends = np.cumsum(own)
            letters = self.bytes[flat[np.repeat(plain, n)]]
            line = (ends - own)[(head[plain] == 10) & (own > 1)] + 1
            after = np.sort(np.concatenate((ends, line)))
            joined = np.insert(letters, after, 32)
            cut = np.append((after + np.arange(1, len(after) + 1))[RUN - 1 :: RUN], len(joined))
            runs = [joined[a:z].tobytes().decode("utf-16-le") for a, z in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True) if z > a]
            got = self.words.encode_batch_fast(runs, add_special_tokens=False)
            ids = np.concatenate([np.asarray(g.ids, np.uint32) for g in got])
            first = self._store(ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends) + 1, prepend=0))
            numbers[plain] = np.arange(first, first + len(own))
        other = np.flatnonzero(~plain)
        if len(other):
            each = [[t.id for p, _ in self.pieces.pre_tokenize_str(c) for t in self.model.tokenize(p)] for c in self._texts(data, start[other], end[other])]
            first = self._store(np.asarray([i for ids in each for i in ids], np.uint32), np.asarray([len(ids) for ids in each]))
            numbers[other] = np.arange(first, first + len(other))
        return numbers

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the chunks data[start:end]; unknown ones are learnt."""
        length, hasher = end - start, Hasher(data)
        hashed = hasher(start, end)
        number = self._found(hashed)
        if self.n + int((number < 0).sum()) > self.held or self.used > 16 * self.held:
            self._forget()
            number = self._found(hashed)
        fresh = number < 0
        self.of["again"][number[~fresh]] = True
        checked = np.flatnonzero(length > 7)  # chunks of 7 bytes or fewer are told apart by their hashes
        if fresh.any():
            unknown = np.flatnonzero(fresh)
            _, at, which = np.unique(hashed[unknown], return_index=True, return_inverse=True)
            new = unknown[at]
            got = self.learn(data, start[new], end[new])
            of = self.of
            of["key"][got], of["long"][got] = hashed[new], length[new]
            some = np.flatnonzero(length[new] > 7)
            of["head"][got[some]], of["tail"][got[some]] = hasher.read(start[new[some]]), hasher.read(end[new[some]] - 8)
            far = new[length[new] > 16]
            self._keep_bytes(got[length[new] > 16], gather(data, start, length, far))
            self._enter(got)
            number[unknown] = got[which]
            fresh[:] = False
            fresh[new] = True  # these are themselves
            of["again"][number[unknown[~fresh[unknown]]]] = True
            checked = checked[~fresh[checked]]
        of, known = self.of, number[checked]
        right = (of["long"][known] == length[checked]) & (of["head"][known] == hasher.read(start[checked])) & (of["tail"][known] == hasher.read(end[checked] - 8))
        far = np.flatnonzero(right & (length[checked] > 16))
        right[far] = alike((data, start[checked[far]], length[checked[far]]), (self.raw, of["place"][known[far]], of["long"][known[far]]))
        if not right.all():
            wrong = checked[~right]
            number[wrong] = self.learn(data, start[wrong], end[wrong])
        return number

    def _texts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
        return [bytes(data[a:z]).decode() for a, z in zip(start.tolist(), end.tolist(), strict=True)]

    def _keep_bytes(self, number: np.ndarray, new: np.ndarray) -> None:
        size = self.of["long"][number]
        self.of["place"][number] = self.raw_used + np.cumsum(size) - size
        self.raw, self.raw_used = _added(self.raw, self.raw_used, new)

    def encode(self, text: str) -> np.ndarray:
        return next(ids for _, ids in self.encoded(pa.RecordBatch.from_pydict({"doc_id": [0], "text": [text]})))

    def _cuts(self, text: str) -> list[int]:
        """Where the chunks of a text start, in bytes."""
        return [0, *accumulate(len(c.encode()) for c in CHUNK.findall(text))][:-1]

    def encoded(self, batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each row (doc_id, text); null is an empty text."""
        for block in blocks(batch["text"]):
            docs = batch["doc_id"].slice(block.first, block.last - block.first).to_pylist()
            at, data = block.at, block.data
            raw = data.tobytes()
            text = lambda k: raw[at[k] : at[k + 1]]  # noqa: B023, E731
            special = [x for x in self.special if x in raw]
            whole = {k for k in range(len(docs)) if any(x in text(k) for x in special)} if special else set()
            inner, white = changes(data), (data == 32) | (data == 10)
            cut = white | inner
            full = np.flatnonzero(np.diff(at))
            cut[at[full]] = True
            # A space or line end is a chunk's start, save where white space is doubled or at the ends of a text.
            odd = np.searchsorted(at, np.flatnonzero(white[1:] & white[:-1]) + 1, "right") - 1
            odd = np.union1d(odd, full[white[at[full]] | MAYBE_WHITE[data[at[full + 1] - 1]]])
            for k in odd.tolist():
                cut[at[k] : at[k + 1]] = inner[at[k] : at[k + 1]]
                cut[at[k] + np.asarray(self._cuts(text(k).decode()), np.int64)] = True
            if whole:
                data = data.copy()
                for k in whole:  # encoded by itself: one chunk here, which isn't used
                    data[at[k] : at[k + 1]] = 32
                    cut[at[k] : at[k + 1]] = False
                    cut[at[k]] = True
            start = np.flatnonzero(cut)
            number = self.numbers(data, start, np.append(start[1:], len(data))) if len(start) else start
            length = self.of["length"]
            ids = gather(self.flat, self.of["begin"], length, number)
            ends = np.concatenate(([0], np.cumsum(length[number], dtype=np.int64)))[np.searchsorted(start, at)].tolist()
            for k, doc in enumerate(docs):
                own = ids[ends[k] : ends[k + 1]]
                yield doc, np.asarray(self.whole.encode(text(k).decode(), add_special_tokens=False).ids, np.uint32) if k in whole else own


def _added(held: np.ndarray, used: int, new: np.ndarray) -> tuple[np.ndarray, int]:
    """held[:used] and new after it, in an array with room for more."""
    if used + len(new) > len(held):
        held = np.resize(held, max(3 * len(held) // 2, used + len(new)))
    held[used : used + len(new)] = new
    return held, used + len(new)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it has looked up serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Places of a sequence that are looked at together: temporary arrays have this length.
PART = 1 << 18


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]


def re_pair(ids: np.ndarray, least: int = 16, rounds: int = 10, per_round: int = 4096, first: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): each round replaces the most frequent pairs of neighbours by new nonterminals.

    Rule k makes symbol `first` + k of the pair rules[k].  Pairs that occur fewer than `least` times stay.  Pairs are
    counted in 2**20 slots by a hash; of two pairs in one slot one waits for a later round and its other hash.  Where
    replaceable pairs overlap, the more frequent one is replaced, and in a run of one symbol every other pair.  No
    pair has END in it, so no rule reaches over the end of a document.  The rounds and pairs a round bound the work: a pair
    that is still frequent after them stays as it is, which costs bytes and never an id.  Ids must be below `first`.
    """
    if len(ids) and int(ids.max()) >= first:
        raise ValueError(f"id {int(ids.max())}: nonterminals start at {first}")
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    del ids
    symbols = first
    for turn in range(rounds):
        if len(seq) < 2 * least:
            break
        left, right = np.uint32(0x9E3779B1 + 2 * turn * 0x632BE59B & 0xFFFFFFFF), np.uint32(0x85EBCA77 + 2 * turn * 0x27D4EB2F & 0xFFFFFFFF)
        slot = np.empty(len(seq) - 1, np.int32)
        parts = [slice(lo, lo + PART) for lo in range(0, len(slot), PART)]
        for part in parts:
            x = seq[:-1][part] * left
            x ^= x >> np.uint32(15)
            x += seq[1:][part] * right
            x *= np.uint32(0xC2B2AE3D)
            slot[part] = x >> np.uint32(12)
        rough = np.zeros(1 << 20, np.int32)
        for lo in range(0, len(slot), 4 * PART):
            rough += np.bincount(slot[lo : lo + 4 * PART], minlength=1 << 20)
        often = rough[rough >= least]
        cut = int(np.partition(often, -per_round)[-per_round]) if len(often) > per_round else least
        wanted = rough >= cut  # few of the slots; pairs are numbered in their order from here on
        none = int(wanted.sum())
        rank = rough
        rank[wanted] = np.arange(none)
        del rough, often
        dead = np.zeros(len(seq) + 1, bool)
        ends = np.flatnonzero(seq == END)
        dead[ends], dead[ends - 1] = True, True  # entry -1 stands for the place before the first
        held, found = np.zeros(none, np.uint64), []
        for part in parts:
            at = np.flatnonzero(wanted[slot[part]] > dead[:-2][part]) + part.start
            own = rank[slot[at]]
            held[own] = _pairs(seq, at)
            found.append((at.astype(np.int32), own))
        del slot, wanted, dead, rank, at, own
        for k, (at, own) in enumerate(found):
            same = np.flatnonzero(held[own] == _pairs(seq, at))
            found[k] = at[same], own[same]
        if not any(len(at) for at, _ in found):
            break
        count = np.bincount(np.concatenate([own for _, own in found]), minlength=none)
        top = np.flatnonzero(count >= least)
        top = top[np.argsort(-count[top], kind="stable")[:per_round]]
        if not len(top):
            break
        rank = np.full(none, len(top), np.int32)
        rank[top] = np.arange(len(top))
        none, pairs = len(top), held[top]
        order = np.full(len(seq) + 1, none, np.int32)  # order[i + 1]: rank of the pair at i; nothing at both ends
        for at, own in found:
            order[at + 1] = rank[own]
        del found, at, own
        here = order[1:-1]
        at = np.flatnonzero(here < none).astype(np.int32)
        run = np.ones(len(at), bool)  # starts of runs of one pair, which are runs of one symbol
        run[1:] = (at[1:] != at[:-1] + 1) | (here[at[1:]] != here[at[:-1]])
        begin = np.flatnonzero(run).astype(np.int32)
        place = np.arange(len(at), dtype=np.int32)
        place -= np.repeat(begin, np.diff(np.append(begin, len(at))))
        here[at[place & 1 == 1]] = none
        del run, begin, place
        mid = order[at + 1]
        take = at[(mid < none) & (mid < order[at]) & (mid < order[at + 2])]
        if not len(take):
            break
        taken = here[take]
        del order, here, mid, at
        present = np.zeros(none, bool)
        present[taken] = True
        used = np.flatnonzero(present)
        seq[take] = (symbols - 1 + np.cumsum(present)).astype(np.uint32)[taken]
        keep = np.ones(len(seq), bool)
        keep[take + 1] = False
        seq = seq[np.flatnonzero(keep)]
        chosen = pairs[used]
        rules.append(np.stack(((chosen >> np.uint64(32)), chosen & np.uint64(0xFFFFFFFF)), 1).astype(np.uint32))
        symbols += len(used)
    return seq, np.concatenate(rules)


def expansions(rules: np.ndarray, first: int = 1 << 16) -> np.ndarray:
    """How many ids each rule stands for; a rule only uses earlier ones."""
    out = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def _expand(symbols: np.ndarray, rules: np.ndarray, first: int = 1 << 16) -> np.ndarray:
    while len(symbols) and (big := symbols >= first).any():
        n = np.where(big, 2, 1)
        out = np.repeat(symbols, n)
        at = (np.cumsum(n) - n)[big]
        used = rules[symbols[big] - first]
        out[at], out[at + 1] = used[:, 0], used[:, 1]
        symbols = out
    return symbols


def decode(sequence: np.ndarray, rules: np.ndarray, length: np.ndarray, start: int = 0, stop: int | None = None, first: int = 1 << 16) -> np.ndarray:
    """The ids [start, stop) of a shard: only symbols that reach into the range are expanded."""
    n, big = np.ones(len(sequence), np.int32), sequence >= first
    n[big] = length[sequence[big] - first]
    ends = np.cumsum(n, dtype=np.int64)
    stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
    if start >= stop:
        return np.zeros(0, np.uint32)
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right")) + 1
    before = int(ends[lo - 1]) if lo else 0
    # Each rule in use is expanded once; the sequence then takes its runs from these, part by part.
    used = np.zeros(len(rules), bool)
    used[sequence[lo:hi][big[lo:hi]] - first] = True
    used = np.flatnonzero(used)
    flat, begin = _expand((used + first).astype(np.uint32), rules, first), np.zeros(len(rules), np.int64)
    begin[used] = np.cumsum(length[used]) - length[used]
    out = np.empty(int(ends[hi - 1]) - before, np.uint32)
    done = 0
    for k in range(lo, hi, PART // 4):
        part = slice(k, min(hi, k + PART // 4))
        symbols, ruled = sequence[part], big[part]
        own = np.repeat(ruled, n[part])
        ids = out[done : done + len(own)]
        ids[own] = gather(flat, begin, length, symbols[ruled] - first)
        ids[~own] = symbols[~ruled]
        done += len(own)
    return out[start - before : stop - before]


SHARDS = (
    "shard long, n_docs long, n_ids long, doc_ids array<long>, doc_lengths array<int>, "
    "rules binary, expansion_lengths binary, sequence binary"
)
_SHARD_TYPES = pa.schema(
    [("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int32())), ("rules", pa.binary()), ("expansion_lengths", pa.binary()), ("sequence", pa.binary())]
)


def _pack(path: str, shard_ids: int):
    def pack(shard: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        lengths, flat = [len(x) + 1 for x in ids[::2]], [np.concatenate(ids)]  # END follows each document
        ids.clear()
        seq, rules = re_pair(flat.pop())
        row = {
            "shard": shard, "n_docs": len(docs), "n_ids": sum(lengths), "doc_ids": docs, "doc_lengths": lengths,
            "rules": rules.astype("<u4").tobytes(), "expansion_lengths": expansions(rules).astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], _SHARD_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32  # ranges and their tasks are in one order
        coder, docs, ids, held, end = encoder(path), [], [], 0, np.full(1, END, np.uint32)
        for b in batches:
            for doc, own in coder.encoded(b):
                docs.append(doc)
                ids += own, end
                held += len(own) + 1
                if held >= shard_ids:
                    yield pack(shard, docs, ids)
                    shard, docs, ids, held = shard + 1, [], [], 0
        if docs:
            yield pack(shard, docs, ids)
        del docs, ids
        trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, partition_bytes: int = 12 << 20, shard_ids: int = 1 << 21) -> None:
    """Encodes docs (doc_id, text; a null text is empty) and writes SHARDS, as Parquet, in ascending order of doc_id.

    Rows are dealt into ranges of doc_id of about `partition_bytes` of text.  A task encodes its range in order and
    closes a shard each `shard_ids` ids: a shard has whole documents, the grammar's rules, how many ids each rule
    stands for, and the sequence.  Nulls come first; rows with equal doc_ids follow a hash of their text.  No rows: no shards.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // partition_bytes)), "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    dealt.mapInArrow(_pack(tokenizer, shard_ids), SHARDS).write.parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            whole = lambda k: np.frombuffer(row[k][0].as_buffer(), "<u4")  # noqa: B023, E731
            ids = decode(whole("sequence"), whole("rules").reshape(-1, 2), whole("expansion_lengths").astype(np.int64)).astype("<u4", copy=False)
            n = np.asarray(row["doc_lengths"][0].values)
            ends = np.cumsum(n, dtype=np.int64)
            crc = [zlib.crc32(ids[z - k : z].tobytes()) for z, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": row["doc_ids"][0].values, "start": pa.array(ends - n + row["base"][0].as_py()), "n_tokens": pa.array(n.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
            )
    trim()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the shards at `path`, from the decoded ids.

    The ids before a shard are summed over the shards' own counts, one row for each shard; ids are never shuffled.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = shards.join(small(base), "shard")
    return found.select("doc_ids", "doc_lengths", "rules", "expansion_lengths", "sequence", "base").mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(docs: DataFrame) -> DataFrame:
    """docs encoded, written to the shared folder, and read back."""
    import public_tokenizers

    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(docs.sparkSession, path)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs, from the shards written; nulls and repeated rows as in write_tokens."""
    return tokens_of(docs)


def op10_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))


QUERIES = {"op10_repair_tokens": op10_repair_tokens}
ORACLE: dict[str, str] = {}
