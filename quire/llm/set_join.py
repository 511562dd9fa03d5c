"""Exact set-similarity join on Spark: the parts that document and line joins share.

A record is a set of 64-bit token hashes; equal sets are one record, named by a hash of
the set (two unlike sets share a name with a chance of about n*n/2**65).  Tokens are put
in one global order, rare ones first: by the count of the sketch cell that a token falls
in, then by hash.  The sketch has a fixed number of cells and counts every token of the
corpus, so what is sent to all tasks doesn't grow.  Any global order gives exact results;
this one keeps frequent tokens out of the prefixes.

Two sets with Jaccard similarity of at least NUM/DEN share a token of their prefixes.  A
task packs its prefix postings into one array for each bucket of token hashes, so that
Spark moves some thousand arrays and not millions of rows.  Within the rows of one token,
sorted by size, all pairs in the length window pass the signature and positional filters;
each row yields its first ROUND_ZERO partners.  Where more pass, the rows are kept, and
later rounds give out the partners beyond, GROWTH times as many a round, of those rows
that the links so far have left open.  A pair that has been judged isn't judged again.

The rows of a token with many of them are dealt to the cells of a triangle: with s salts,
a row goes to the s cells that its salt is part of, so that any two rows meet and no cell
has more than about 2 * HOT_ROWS rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import trim, written

#: Similarity from which sets link: 80 / 100.
NUM, DEN = 80, 100
SKETCH_BITS = 20
#: Cells travel from tasks in blocks of so many.
SKETCH_BLOCK = 4096
SLICE_BYTES = 1 << 19
#: Sets of more tokens have the wide signature.
WIDE_FROM = 64
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Rows of one token that meet in one cell; a token with more is dealt to several.
HOT_ROWS = 1 << 13
#: Partners of a row that the first round gives out, and how many times more each later one.
ROUND_ZERO, GROWTH = 4, 8
#: Rows of one key up to which brief postings are compared by position, too.
CROWD = 256
#: Pairs that are looked at side by side.
PAIR_BATCH = 1 << 17
#: Postings that a task holds before it gives them out.
HELD_POSTINGS = 1 << 18
#: Buckets of token hashes for each shuffle partition.
BUCKETS = 4
#: Names of sets that are broadcast up to so many (8 bytes each); more are joined.
SENT_NAMES = 1_000_000

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_PLACE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 8, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = raw.lower() + b" " * 8
    space = _SPACE[np.frombuffer(low, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[0::2], edges[1::2]
    size = end - start
    eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))  # eight bytes from each offset
    h = eight[start] & _LOW_BYTES[np.minimum(size, 8)]
    h = (h ^ size.astype(np.uint64) * _B) * _A
    h ^= h >> U(32)
    k, at = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(at):
        x = (h[at] ^ eight[start[at] + k] & _LOW_BYTES[np.minimum(size[at] - k, 8)]) * _A
        h[at] = x ^ (x >> U(29))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : end[i]])
    return start, mix(h)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of a text: runs of bytes other than white
    space, A-Z as a-z.  Long texts go in pieces cut at white space."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        stop = min(at + 2 * SLICE_BYTES, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, stop - at, at)])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                while stop < len(raw):
                    part = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, min(SLICE_BYTES, len(raw) - stop), stop)])
                    if len(part):
                        stop += int(part[0]) + 1
                        break
                    stop = min(stop + SLICE_BYTES, len(raw))
        s, h = _piece_hashes(raw[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def places(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the ascending ``ends`` are at or before each of the ascending ``starts``."""
    return np.cumsum(np.bincount(np.searchsorted(starts, ends), minlength=len(starts) + 1)[: len(starts)])


def shingles(owner: np.ndarray, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words of one owner; the whole sequence where it has fewer.  Owners ascend."""
    n = len(words)
    owners, out = [], []
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += words[k : n - size + 1 + k] * _PLACE[k]
        own = owner[: n - size + 1]
        full = own == owner[size - 1 :]
        owners, out = [own[full]], [mix(h[full])]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(first, append=n)
    for k in range(1, size):
        at = first[count == k]
        if len(at):
            h = np.full(len(at), k, np.uint64) * _PLACE[7]
            for j in range(k):
                h += words[at + j] * _PLACE[j]
            owners.append(owner[at])
            out.append(mix(mix(h)))
    if not out:
        return owner[:0], words[:0]
    owners, out = np.concatenate(owners), np.concatenate(out)
    o = np.argsort(owners, kind="stable")
    return owners[o], out[o]


def cells_of(token: np.ndarray) -> np.ndarray:
    return (token >> U(20)).astype(np.int64) & ((1 << SKETCH_BITS) - 1)


def sketched(tokens_of: Callable[[list[bytes]], np.ndarray], column: int = 0) -> Callable:
    """A mapper from batches of texts to a task's share of the sketch, (cell, tokens): block
    numbers and 32-bit counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << SKETCH_BITS, np.int64), []
        for batch in batches:
            for _, texts in slices(batch[column]):
                held.append(cells_of(tokens_of(texts)))
                if sum(map(len, held)) > 1 << SKETCH_BITS:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held = []
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        blocks = np.minimum(counts, 2**32 - 1).astype("<u4").reshape(-1, SKETCH_BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([blocks[k].tobytes() for k in full], pa.binary())], ["cell", "tokens"])
        trim()

    return run


def sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all cells from rows (cell, tokens) of ``sketched``.  Blocks are summed in
    two steps, so that no task holds more than a share of them; 2**SKETCH_BITS numbers
    reach the driver, whatever the corpus."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SKETCH_BLOCK, np.uint64)
        for b in pdf["tokens"]:
            out += np.frombuffer(b, "<u4" if len(b) == 4 * SKETCH_BLOCK else "<u8")
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "tokens": [out.astype("<u8").tobytes()]})

    part = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    summed = rows.withColumn("part", part).groupBy("cell", "part").applyInPandas(total, "cell int, tokens binary").groupBy("cell").applyInPandas(total, "cell int, tokens binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in summed.collect():
        out[r["cell"] * SKETCH_BLOCK : (r["cell"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["tokens"], "<u8")
    return np.minimum(out, _MOST).astype(np.int32)


#: Counts are told apart up to this one; a rank key is a count and the rest of its bits from the token's hash.
_COUNT_BITS = 28
_MOST = U((1 << _COUNT_BITS) - 1)


def sorted_within(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values in ascending order within each run of equal owners.  Runs of one length are
    sorted side by side."""
    if not len(owner):
        return value.copy()
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(first, append=len(owner))
    out = value.copy()
    o = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[o], prepend=0))
    for a, b in zip(cuts, [*cuts[1:], len(o)], strict=True):
        n = int(size[o[a]])
        if n == 1:
            continue
        if b - a == 1:
            out[first[o[a]] : first[o[a]] + n].sort()
        else:
            at = first[o[a:b], None] + np.arange(n)
            rows = value[at]
            rows.sort(axis=1)
            out[at] = rows
    return out


class Sets:
    """Sets of several owners, which ascend: ``owner`` and ``token`` in order of (owner,
    token) without repeats; ``who``, ``first`` and ``size`` by set; ``name`` is a set's hash."""

    def __init__(self, owner: np.ndarray, token: np.ndarray):
        token = sorted_within(owner, token)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        self.owner, self.token = owner[new], token[new]
        self.first = np.flatnonzero(np.diff(self.owner, prepend=-1))
        self.size = np.diff(self.first, append=len(self.owner))
        self.who = self.owner[self.first]
        self.name = np.zeros(0, np.int64)
        if len(self.first):
            total = np.add.reduceat(mix(self.token ^ _PLACE[5]), self.first)
            self.name = mix(total ^ (self.size.astype(np.uint64) * _PLACE[6])).view(np.int64)

    def signatures(self, wide: bool) -> np.ndarray:
        """Four 64-bit words of parities of token bits per set: sets that differ in d tokens
        differ in at most d bits of the first word, and of the others together.  These are 0
        unless ``wide``, and for sets of up to ``WIDE_FROM`` tokens, for which one will do."""
        out = np.zeros((len(self.first), 4), np.uint64)
        if not len(self.first):
            return out
        out[:, 0] = np.bitwise_xor.reduceat(U(1) << (self.token >> U(40) & U(63)), self.first)
        large = self.size > WIDE_FROM
        if wide and large.any():
            token = self.token[np.repeat(large, self.size)]
            first = np.cumsum(self.size[large]) - self.size[large]
            word, bit = (token >> U(46)) % U(3), U(1) << (token >> U(34) & U(63))
            for k in range(3):
                out[large, k + 1] = np.bitwise_xor.reduceat(np.where(word == U(k), bit, U(0)), first)
        return out

    def prefixes(self, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Set index, key, count and position of the prefix tokens of the sets that ``keep``
        marks.  A key stands for all tokens of one rank; tokens that occur once in the
        corpus are left out, as no other set has them."""
        which = np.repeat(np.arange(len(self.first)), self.size)
        on = keep[which]
        which, token = which[on], self.token[on]
        rank = counts[cells_of(token)].astype(np.uint64) << U(64 - _COUNT_BITS) | token >> U(_COUNT_BITS)
        rank = sorted_within(which, rank)
        first = np.flatnonzero(np.diff(which, prepend=-1))
        pos = np.arange(len(which)) - np.repeat(first, np.diff(first, append=len(which)))
        size, count = self.size[which], (rank >> U(64 - _COUNT_BITS)).astype(np.int64)
        short = (pos < size + (-NUM * size) // DEN + 1) & (count > 1)  # size - ceil(size * NUM / DEN) + 1
        return which[short], mix(rank[short]), count[short], pos[short]

    def rows(self, keep: np.ndarray, parity_bits: int) -> pa.RecordBatch:
        """Rows of ``TOKENS`` of the sets that ``keep`` marks."""
        at = np.flatnonzero(keep)
        on = np.repeat(keep, self.size)
        tokens = self.token[on]
        offsets = np.concatenate([[0], np.cumsum(self.size[at])]) * 8
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
        owner = np.repeat(np.arange(len(at)), self.size[at])
        bits = np.zeros((len(at), parity_bits), np.uint8)
        if len(at):
            place = owner * parity_bits + ((tokens >> U(8)).astype(np.int64) & (parity_bits - 1))
            bits = (np.bincount(place, minlength=len(at) * parity_bits) & 1).astype(np.uint8).reshape(len(at), -1)
        raw = np.packbits(bits, axis=1)
        marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parity_bits // 8), len(at), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(self.name[at]), marks, body], ["name", "parity", "tokens"])


#: Bits of the parity by which pairs are looked at before their tokens are fetched: of documents, and of lines.
DOCUMENT_PARITY, LINE_PARITY = 2048, 512
TOKENS = "name long, parity binary, tokens binary"


def slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about a slice's bytes, with the first one's index."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_buffer()
        held.append(b"" if t is None else t.to_pybytes())
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def owned_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Index of its text, and hash, of every word; the joined texts and their words' starts."""
    raw = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, words = word_hashes(raw)
    return places(ends, starts), words, raw, starts


def fresh(names: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which names this task meets for the first time."""
    out = np.zeros(len(names), bool)
    for k, name in enumerate(names.tolist()):
        if name not in seen:
            seen.add(name)
            out[k] = True
    return out


def required(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Least intersection with which sets of these sizes link."""
    return -(-(NUM * (na + nb)) // (NUM + DEN))


# ---------------------------------------------------------------- packed arrays

DEALT = "bucket int, kind byte, body binary"
#: Kinds of packed arrays: postings, first rows by name, rows of the result to pass on, sets.
POSTINGS, FIRSTS, ITEMS, SETS = 0, 1, 2, 3
#: Lower half of the key, name, order, size, position and the signature's words.
POSTING = ("<u4", "<i8", "<i4", "<i4", "<i4", "<u8", "<u8", "<u8", "<u8")
#: Lower half of the key, name, size and position, both held down to ``BRIEF_MOST``: enough
#: to tell which postings share a key with another that the size and position filters leave.
BRIEF = ("<u4", "<i8", "<u2", "<u2")
BRIEF_MOST = (1 << 16) - 1
#: Name, size and the signature's words of a set.
SET = ("<i8", "<i4", "<u8", "<u8", "<u8", "<u8")


def pack(columns: list[np.ndarray], types: tuple[str, ...]) -> bytes:
    return b"".join(np.ascontiguousarray(c, t).tobytes() for c, t in zip(columns, types, strict=True))


def unpack(bodies: list[bytes], types: tuple[str, ...]) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for body in bodies:
        n, at = len(body) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(body, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]


class Dealer:
    """Collects arrays of a task and gives them out by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, {}, 0

    def add(self, kind: int, types: tuple[str, ...], hashes: np.ndarray, columns: list[np.ndarray]) -> None:
        """``hashes`` choose the buckets, by their upper halves."""
        if len(hashes):
            at = (hashes.view(np.uint64) >> U(32)) % U(self.buckets)
            self.held.setdefault((kind, types), []).append((at, [np.asarray(c).astype(t, copy=False) for c, t in zip(columns, types, strict=True)]))
            self.size += len(hashes)

    def given(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All that is held, if more than ``least`` rows."""
        if self.size <= least:
            return
        for (kind, types), parts in self.held.items():
            at = np.concatenate([p[0] for p in parts])
            columns = [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
            o = np.argsort(at.astype(np.uint16) if self.buckets <= 1 << 16 else at, kind="stable")
            at, columns = at[o], [c[o] for c in columns]
            cuts = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
            bodies = [pack([c[a:b] for c in columns], types) for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int8)), pa.array(bodies, pa.binary())], ["bucket", "kind", "body"])
        self.held, self.size = {}, 0
        del at, columns, bodies
        trim()

    def add_postings(self, sets: Sets, counts: np.ndarray, noise: int, keep: np.ndarray, order: np.ndarray, wide: bool, brief: bool = False) -> None:
        which, key, count, pos = sets.prefixes(counts, keep)
        salts = np.maximum(1, -(-(count - noise) // HOT_ROWS))
        if len(salts) and salts.max() > 1:
            row = np.repeat(np.arange(len(key)), salts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(salts) - salts, salts)
            own = sets.name[which].view(np.uint64)[row] % salts[row].astype(np.uint64)
            low, high = np.minimum(own, other.astype(np.uint64)), np.maximum(own, other.astype(np.uint64))
            cell = mix(key[row] + low * _PLACE[3] + high * _PLACE[4])
            which, pos, key = which[row], pos[row], np.where(salts[row] > 1, cell, key[row])
        if brief:
            self.add(POSTINGS, BRIEF, key, [key & U(0xFFFFFFFF), sets.name[which], np.minimum(sets.size[which], BRIEF_MOST), np.minimum(pos, BRIEF_MOST)])
            return
        self.add(POSTINGS, POSTING, key, [key & U(0xFFFFFFFF), sets.name[which], order[which], sets.size[which], pos, *sets.signatures(wide)[which].T])


def bucket_count(df: DataFrame) -> int:
    return max(1, BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def noise_of(counts: np.ndarray) -> int:
    """What other tokens add to a cell: the median one.  In a small corpus it is 0 or 1."""
    return int(np.median(counts))


def deal(rows: DataFrame) -> DataFrame:
    """Rows of ``DEALT`` with all of a bucket in one task, one after the other."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


# ---------------------------------------------------------------- candidates

_BUDGET = np.array([s - 2 * -(-NUM * s // (NUM + DEN)) for s in range(1 << 16)], np.int64)


def _apart(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """By how many tokens two sets of these sizes may differ and link."""
    s = na + nb
    if len(s) and s.max() >= len(_BUDGET):
        return s - 2 * required(na, nb)
    return _BUDGET[s]


def partners(group: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, low: int, high: int, wanted=None, parity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), j before i, of rows sorted by (group, n) that pass the filters and have
    a rank of ``low`` up to ``high`` among the pairs of i; and which rows are in pairs of
    any row that has more.

    ``wanted`` says of index pairs whether they are given out; ranks count all pairs.
    """
    rows = np.arange(len(group))
    key = group.astype(np.int64) << 32 | n
    since = np.searchsorted(key, group.astype(np.int64) << 32 | -(-(NUM * n) // DEN))
    width = rows - since
    total = np.cumsum(width)
    more = np.zeros(len(group), bool)
    out_i, out_j, a = [], [], 0
    while a < len(group):
        before = int(total[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PAIR_BATCH, "right")))
        w = width[a:b]
        if w.any():
            i = np.repeat(rows[a:b], w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(since[a:b], w)
            budget = _apart(n[i], n[j])
            ok = np.bitwise_count(sig[i, 0] ^ sig[j, 0]) <= budget
            i, j, budget = i[ok], j[ok], budget[ok]
            apart = np.bitwise_count(sig[i, 1:] ^ sig[j, 1:]).sum(1, dtype=np.int64)
            ok = (apart <= budget) | (n[j] <= WIDE_FROM)
            i, j, budget = i[ok], j[ok], budget[ok]
            ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= (n[i] + n[j] - budget) // 2
            i, j, budget = i[ok], j[ok], budget[ok]
            each = np.bincount(i - a, minlength=b - a)
            over = each[i - a] > high
            more[i[over]] = more[j[over]] = True
            rank = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
            take = (rank >= low) & (rank < high)
            if wanted is not None:
                take[take] = wanted(i[take], j[take])
            if parity is not None:  # doesn't change ranks
                at = np.flatnonzero(take)
                for c in range(0, len(at), 1 << 14):
                    p = at[c : c + (1 << 14)]
                    take[p] = np.bitwise_count(parity[i[p]] ^ parity[j[p]]).sum(1) <= budget[p]
            out_i.append(i[take])
            out_j.append(j[take])
        a = b
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j), more) if out_i else (none, none, more)


FOUND = "k byte, a long, b long, c long, n int, body binary"
#: Kinds of what the first round finds: pairs, rows for later rounds, and as in ``DEALT``.
PAIR, LIVE, FIRST, ITEM, SHARING, KNOWN = 0, 1, 2, 3, 4, 5
_FOUND = pa.schema([("k", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
#: What a row for later rounds holds besides key and name.
BODY = np.dtype([("sig", "<u8", (4,)), ("ord", "<i4"), ("n", "<i4"), ("pos", "<i4")])


def found(kind: int, size: int, **columns) -> pa.RecordBatch:
    """A batch of ``FOUND`` with nulls in the columns that aren't given."""
    get = lambda f: columns.get(f.name)
    arrays = [pa.array(np.full(size, kind, np.int8))] + [pa.nulls(size, f.type) if get(f) is None else get(f) if isinstance(get(f), pa.Array) else pa.array(get(f), f.type) for f in list(_FOUND)[1:]]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def packed_rows(sig: np.ndarray, order: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.Array:
    body = np.zeros(len(n), BODY)
    body["sig"], body["ord"], body["n"], body["pos"] = sig, order, n, pos
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(BODY.itemsize), len(body), [None, pa.py_buffer(body.tobytes())]).cast(pa.binary())


def _first_round(bucket: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    h, name, order, n, pos, *words = unpack(bodies, POSTING)
    sig = np.stack(words, 1)
    o = np.argsort(h.astype(np.uint64) << U(32) | name.view(np.uint64) & U(0xFFFFFFFF))
    h, name, sig, order, n, pos = (x[o] for x in (h, name, sig, order, n, pos))
    new = np.ones(len(h), bool)  # copies of a set from several tasks, and tokens of one rank in a set
    new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return
    order, pos = np.minimum.reduceat(order, first), np.minimum.reduceat(pos, first)
    h, name, sig, n = h[first], name[first], sig[first], n[first]
    edge = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1))
    size = np.diff(edge, append=len(h))
    many = np.repeat(size > 1, size)
    if not many.any():
        return
    h, name, sig, order, n, pos = (x[many] for x in (h, name, sig, order, n, pos))
    o = np.lexsort((name, order, n, h))  # as later rounds sort
    h, name, sig, order, n, pos = (x[o] for x in (h, name, sig, order, n, pos))
    group = np.cumsum(np.diff(h.astype(np.int64), prepend=-1) != 0)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    i, j, live = partners(group, n, pos, sig, 0, ROUND_ZERO)
    if len(i):
        pairs = np.unique(np.sort(np.stack([name[i], name[j]], 1), 1), axis=0)
        yield found(PAIR, len(pairs), a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))
    if live.any():
        key = np.int64(bucket) << 32 | h[live].astype(np.int64)
        yield found(LIVE, len(key), a=key, b=name[live], body=packed_rows(sig[live], order[live], n[live], pos[live]))


def _met(group: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows, sorted by (group, n), have another of their group that passes the length
    and positional filters; in groups of more than ``CROWD`` rows, the length filter alone."""
    rows = np.arange(len(group))
    key = group.astype(np.int64) << 32 | n
    since = np.searchsorted(key, group.astype(np.int64) << 32 | -(-(NUM * n) // DEN))
    crowd = np.bincount(group)[group] > CROWD
    width = np.where(crowd, 0, rows - since)
    ok = crowd & (since < rows)
    ok[:-1] |= crowd[:-1] & (since[1:] <= rows[:-1])
    total = np.cumsum(width)
    a = 0
    while a < len(group):
        before = int(total[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + PAIR_BATCH, "right")))
        w = width[a:b]
        if w.any():
            i = np.repeat(rows[a:b], w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(since[a:b], w)
            near = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= required(n[i], n[j])
            near |= (n[i] == BRIEF_MOST) | (n[j] == BRIEF_MOST)
            ok[i[near]] = ok[j[near]] = True
        a = b
    return ok


def _sharing(bucket: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    h, name, n, pos = unpack(bodies, BRIEF)

    def many(h: np.ndarray) -> np.ndarray:
        size = np.diff(np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1)), append=len(h))
        return np.repeat(size > 1, size)

    o = np.argsort(h, kind="stable")
    o = o[many(h[o])]
    o = o[np.lexsort((name[o], h[o]))]
    h, name, n, pos = h[o], name[o], n[o], pos[o]
    new = np.ones(len(h), bool)  # copies of a set from several tasks, and tokens of one rank in a set
    new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return
    pos, h, name, n = np.minimum.reduceat(pos, first), h[first], name[first], n[first]
    on = many(h)
    h, name, n, pos = h[on], name[on], n[on].astype(np.int64), pos[on].astype(np.int64)
    o = np.lexsort((n, h))
    h, name, n, pos = h[o], name[o], n[o], pos[o]
    on = _met(np.cumsum(np.diff(h.astype(np.int64), prepend=-1) != 0), n, pos)
    if on.any():
        yield found(SHARING, int(on.sum()), a=np.int64(bucket) << 32 | h[on].astype(np.int64), b=name[on], n=pos[on].astype(np.int32))


def known_sets(bodies: list[bytes]) -> pa.RecordBatch:
    """Each set of packed arrays of ``SET`` once: its name, size and signature."""
    name, n, *words = unpack(bodies, SET)
    name, first = np.unique(name, return_index=True)
    sig = np.stack(words, 1)[first]
    return found(KNOWN, len(name), a=name, n=n[first], body=pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(name), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()))


def whole_postings(buckets: int) -> Callable:
    """Packed postings, with what the filters need, from rows (name, key, position, size,
    signature) of the postings that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            name, key, pos, n = (batch[k].to_numpy() for k in range(4))
            key, sig = key.view(np.uint64), np.frombuffer(b"".join(batch[4].to_pylist()), np.uint64).reshape(-1, 4)
            dealer.add(POSTINGS, POSTING, key, [key & U(0xFFFFFFFF), name, n, n, pos, *sig.T])
            yield from dealer.given(HELD_POSTINGS)
        yield from dealer.given()

    return run


def first_round(others: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], brief: bool = False) -> Callable:
    """Over ``deal``'s rows: candidate pairs and rows for later rounds, or of ``BRIEF``
    postings the key, name and position of those that share a key with another set; packed
    arrays of the other kinds go through ``others`` (kind, bodies).  It holds one bucket."""
    of_postings = _sharing if brief else _first_round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            for kind, bodies in held.items():
                yield from of_postings(now, bodies) if kind == POSTINGS else others(kind, bodies)

        for batch in batches:
            for bucket, kind, body in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                if bucket != now:
                    yield from out()
                    held, now = {}, bucket
                held.setdefault(kind, []).append(body.as_buffer())
        yield from out()
        held = {}
        trim()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, name, rows, state, parities or None) of each key, from batches (key, name, body,
    state, parity) sorted by key."""
    held = None
    for batch in batches:
        marks = batch[4].to_pylist()
        parity = np.frombuffer(b"".join(marks), np.uint64).reshape(len(marks), -1) if marks and marks[0] is not None else None
        part = [batch[0].to_numpy(), batch[1].to_numpy(), np.frombuffer(b"".join(batch[2].to_pylist()), BODY), batch[3].to_numpy(), parity]
        if held is not None and len(held[0]):
            part = [None if p is None else np.concatenate([h, p]) for h, p in zip(held, part, strict=True)]
        cuts = [0, *(np.flatnonzero(np.diff(part[0])) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(part[0][a]), *(None if p is None else p[a:b] for p in part[1:])
        held = [None if p is None else p[cuts[-1] :] for p in part]
    if held is not None and len(held[0]):
        yield int(held[0][0]), *held[1:]


def _settled(state: np.ndarray, by_root: bool) -> bool:
    return bool((state == state[0]).all()) and (by_root or state[0] == 1)


def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of those keys that hold sets of several components."""
    for key, name, x, state, _ in _by_key(batches):
        if not _settled(state, True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), key)), pa.array(name), packed_rows(x["sig"], x["ord"], x["n"], x["pos"]), pa.array(state)], ["key", "name", "body", "state"])


ROUND = "a long, b long, key long, name long, body binary"


def later_round(low: int, high: int, by_root: bool) -> Callable:
    """Over rows (key, name, body, state, parity) sorted by key: pairs (a, b) of rank
    ``low`` up to ``high`` that are still open, and again the rows (key, name, body) of
    which pairs of higher rank are left.  It holds the rows of one key.

    With ``by_root``, ``state`` is a component and pairs of one component are settled; else
    it is 1 for a set that has gone, and pairs are settled whose later set has gone.
    """

    def group(key, name, x, state, parity) -> Iterator[pa.RecordBatch]:
        o = np.lexsort((name, x["ord"], x["n"]))
        name, x, state = name[o], x[o], state[o]
        marks = None if parity is None else parity[o]
        n, order = x["n"].astype(np.int64), x["ord"]

        def wanted(i, j):
            if by_root:
                return state[i] != state[j]
            lost = np.where(order[i] > order[j], state[i], np.where(order[i] < order[j], state[j], state[i] & state[j]))
            return lost == 0

        i, j, more = partners(np.ones(len(n), np.int64), n, x["pos"].astype(np.int64), x["sig"], low, high, wanted, marks)
        pairs = np.unique(np.sort(np.stack([name[i], name[j]], 1), 1), axis=0)
        p, m = len(pairs), int(more.sum())
        if p:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), *(pa.nulls(p, t) for t in (pa.int64(), pa.int64(), pa.binary()))], ["a", "b", "key", "name", "body"])
        if m:
            x = x[more]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.full(m, key)), pa.array(name[more]), packed_rows(x["sig"], x["ord"], x["n"], x["pos"])], ["a", "b", "key", "name", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, name, x, state, parity in _by_key(batches):
            if not _settled(state, by_root):
                yield from group(key, name, x, state, parity)

    return run


def rounds(live: DataFrame, pairs: DataFrame, sets: DataFrame, judge: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame | None], DataFrame], by_root: bool) -> None:
    """Later rounds over the rows that the first one kept.

    ``judge`` takes new candidate pairs to links, ``settle`` takes all links of a round into
    account and returns the state (name, state) for the next; ``pairs`` have been judged.
    """
    low, high, judged = ROUND_ZERO, ROUND_ZERO * GROWTH, pairs
    if live.isEmpty():
        return
    state = settle(None)
    default = F.col("name") if by_root else F.lit(0).cast("long")
    none = F.lit(None).cast("binary").alias("parity")
    while True:
        few = state.count() <= SENT_NAMES
        rows = live.join(F.broadcast(state) if few else state, "name", "left").select("key", "name", "body", F.coalesce("state", default).alias("state"), none)
        rows = rows.repartition("key").sortWithinPartitions("key")
        if by_root:  # only tokens that have an open row go on, with the large parities of their sets
            rows = written(rows.mapInArrow(still_open, "key long, name long, body binary, state long"), "open")
            rows = rows.join(sets.select("name", "parity"), "name").select("key", "name", "body", "state", "parity")
            rows = rows.repartition("key").sortWithinPartitions("key")
        new = written(rows.mapInArrow(later_round(low, high, by_root), ROUND), "round")
        fresh_pairs = written(new.filter("a is not null").select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), "new-pairs")
        if not fresh_pairs.isEmpty():
            state = settle(judge(fresh_pairs))
            judged = judged.unionByName(fresh_pairs)
        live = new.filter("a is null").select("key", "name", "body")
        if live.isEmpty():
            return
        low, high = high, high * GROWTH


def verify(a: bytes, b: bytes) -> int:
    """Intersection of two sorted sets if they link, else -1.  A suffix filter first: split
    at a middle token, the parts bound the intersection."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    nx, ny = len(x), len(y)
    if DEN * min(nx, ny) < NUM * max(nx, ny):
        return -1
    need = -(-(NUM * (nx + ny)) // (NUM + DEN))
    if nx > 32:
        cuts = x[[nx // 4, nx // 2, 3 * nx // 4]]
        p = np.searchsorted(y, cuts)
        bound, i0, j0 = 0, 0, 0
        for i, j in zip((nx // 4, nx // 2, 3 * nx // 4, nx), (*p, ny)):
            bound += min(i - i0, j - j0)
            i0, j0 = i, j
        if bound < need:
            return -1
    at = np.searchsorted(y, x)
    at[at == ny] = 0
    both = int((y[at] == x).sum()) if ny else 0
    return both if both >= need else -1


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of names that link; ``sets``: a written table of TOKENS, one row a
    name.

    Two sets differ in at least as many tokens as their parities in bits, which settles most
    pairs that don't link; only the tokens of the others are fetched, and sets that are in
    none of them aren't moved.
    """

    @F.pandas_udf("boolean")
    def may(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        na, nb = na.to_numpy(np.int64) // 8, nb.to_numpy(np.int64) // 8
        if not len(na):
            return pd.Series([], dtype=bool)
        apart = np.bitwise_count(np.frombuffer(b"".join(a), np.uint8) ^ np.frombuffer(b"".join(b), np.uint8)).reshape(len(na), -1).sum(1)
        return pd.Series((apart <= na + nb - 2 * required(na, nb)) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)))

    @F.pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([verify(x, y) >= 0 for x, y in zip(a, b, strict=True)])

    marks = sets.select("name", "parity", F.octet_length("tokens").alias("n"))
    side = lambda k: marks.select(F.col("name").alias(k), F.col("parity").alias("p" + k), F.col("n").alias("n" + k))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(may("pa", "na", "pb", "nb")).select("a", "b"), "near-pairs")
    few = pairs.count() <= SENT_NAMES

    def of(side: str) -> DataFrame:
        names = pairs.select(F.col(side).alias("name"))
        own = sets.select("name", "tokens").join(F.broadcast(names) if few else names, "name", "left_semi")
        return own.select(F.col("name").alias(side), F.col("tokens").alias("t" + side))

    got = of("b").join(F.broadcast(pairs) if few else pairs, "b").join(of("a"), "a")
    return got.filter(links("ta", "tb")).select("a", "b")


def wanted_sets(rows: DataFrame, names: DataFrame, repeats: bool = True) -> DataFrame:
    """A written table of those ``rows`` (of ``TOKENS``) that are named, once each.  Without
    ``repeats`` every name is expected once, and rows move only where one is not."""
    n = names.count()
    named = rows.join(F.broadcast(names) if n <= SENT_NAMES else names, "name", "left_semi")
    if not repeats:
        named = written(named, "sets")
        if named.count() == n:  # each name has a row
            return named
    return written(named.dropDuplicates(["name"]), "sets")
