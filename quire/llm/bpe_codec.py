"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of symbols, and many of them are merged side by side in one
list with stops between.  Every adjacent pair that some merge joins is filed in the bucket
of its merge rank; a two-level bitmap over ranks finds the lowest non-empty bucket by
find-first-set.  A bucket yields its leftmost position first, and an entry whose pair has
changed since it was filed is skipped.  A bucket is sorted when its turn comes, once unless
a merge brings up a pair of lower rank, which no merge does where merges reach every token,
as in a trained vocabulary; so a pre-token of a megabyte is no special case.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import bound_batches, worker_state

#: A worker remembers the results of the latest distinct pre-tokens, two halves of so many
#: and those of one group more.
CACHE_PIECES = 200_000
#: Longer pre-tokens are not remembered.
CACHE_CHARS = 64
#: Texts are taken together up to so many pre-tokens, and a longer text in parts of so many.
GROUP_PIECES = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Bits of one word of the rank bitmap: the lower level has a word for so many ranks, and
#: one word of the upper level names the non-zero words below.
WORD = 8


class Merges:
    """The merges of a vocabulary: the rank that two adjacent symbols have together."""

    def __init__(self, ranks: dict[bytes, int]):
        #: The symbol between pre-tokens, which no merge joins.
        self.stop = max(ranks.values(), default=0) + 1
        rows: list[dict[int, int]] = [{} for _ in range(self.stop + 1)]
        rank_of = ranks.get
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                left = rank_of(whole[:cut])
                if left is not None:
                    right = rank_of(whole[cut:])
                    if right is not None:
                        rows[left][right] = rank
        none: dict[int, int] = {}
        #: after[left](right): rank of the merge, or None
        self.after = [(row or none).get for row in rows]
        #: The symbol of each byte.
        self.first = {c: ranks[b] for c in range(256) if (b := bytes([c])) in ranks}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token: the lowest-ranked pair merges first, leftmost among equals.

        ``buckets[rank]`` is a list of positions; ``low[rank >> WORD]`` has a bit for each
        rank with a bucket and ``top`` a bit for each non-zero word of ``low``.  As a merge
        never reaches over a stop, each pre-token sees its own merges in its own order.  The
        queue is written out here, as calls would take most of the time.
        """
        after, stop, first = self.after, self.stop, self.first
        token: list[int | None] = [stop]
        for piece in pieces:
            token += [first[c] for c in piece]
            token.append(stop)
        n, mask = len(token), (1 << WORD) - 1
        places = list(range(n + 1))
        following, before = places[1:], [0, *places]
        pair = [after[a](b) for a, b in zip(token, token[1:])]  # rank of the merge with the next symbol
        pair.append(None)
        top, low, buckets = 0, [0] * ((stop >> WORD) + 1), defaultdict(list)
        for i, r in enumerate(pair):
            if r is not None:
                bucket = buckets[r]
                if not bucket:
                    a = r >> WORD
                    low[a] |= 1 << (r & mask)
                    top |= 1 << a
                bucket.append(i)
        while top:
            a = (top & -top).bit_length() - 1
            lowest = low[a] & -low[a]
            rank = a << WORD | lowest.bit_length() - 1
            bucket, together, under = buckets[rank], after[rank], False
            bucket.sort(reverse=True)
            pop = bucket.pop
            while bucket:
                i = pop()
                if pair[i] != rank:
                    continue  # stale: the pair has changed since
                j, h = following[i], before[i]
                following[i] = k = following[j]
                before[k] = i
                token[i] = rank
                token[j] = pair[j] = None
                pair[i] = r = together(token[k])
                if r is not None:
                    other = buckets[r]
                    if not other:
                        b = r >> WORD
                        low[b] |= 1 << (r & mask)
                        top |= 1 << b
                        under = r < rank
                    other.append(i)
                pair[h] = r = after[token[h]](rank)
                if r is not None:
                    other = buckets[r]
                    if not other:
                        b = r >> WORD
                        low[b] |= 1 << (r & mask)
                        top |= 1 << b
                        under = under or r < rank
                    other.append(h)
                if under:
                    break  # a pair of lower rank goes first
            if not bucket:
                low[a] ^= lowest
                if not low[a]:
                    top ^= 1 << a
        out: list[list[int]] = []
        for t in token:
            if t is not None:
                if t == stop:
                    out.append(ids := [])
                else:
                    ids.append(t)
        out.pop()
        return out


class ByteBpe:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        self.by_id = {i: b for b, i in self.ranks.items()}
        self.decimal = {i: str(i) for i in self.by_id}
        self.find = regex.compile(pattern).findall
        #: piece -> (its ids in decimal, their bytes); the older half is dropped when both are full
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens: one that is a token itself is that token."""
        out, parts = {}, {}
        rank_of = self.ranks.get
        for piece in pieces:
            data = piece.encode("utf-8", "replace")
            whole = rank_of(data)
            if whole is None:
                parts[piece] = data
            else:
                out[piece] = [whole]
        out.update(zip(parts, self.merges.merge(list(parts.values()))))
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        ids = self.encode_pieces(set(pieces))
        return [i for piece in pieces for i in ids[piece]]

    def decode(self, ids) -> bytes:
        by_id = self.by_id
        return b"".join([by_id[i] for i in ids])

    def _learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        """Remembers pre-tokens that aren't known, and returns those too long for that."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, older, decimal, long = self.known, self.older, self.decimal, {}
        new = pieces.difference(known)
        for piece in new.intersection(older):
            known[piece] = older[piece]
        for piece, ids in self.encode_pieces(new.difference(older)).items():
            (known if len(piece) <= CACHE_CHARS else long)[piece] = ",".join([decimal[i] for i in ids]), self.decode(ids)
        return long

    def _joined(self, group: list[list[str]]) -> Iterator[tuple[str, bytes]]:
        """For each list of pre-tokens, their ids in decimal with commas and their bytes."""
        long = self._learn(set(chain.from_iterable(group)))
        known = self.known
        for pieces in group:
            parts = [known.get(p) or long[p] for p in pieces] if long else [known[p] for p in pieces]
            yield ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def encode_decimals(self, texts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """All ids in decimal with commas, and the bytes that decoding them gives, of each
        text.  New pre-tokens of a group of texts, or of a part of a long one, are merged
        together."""
        group: list[list[str]] = []
        n = 0
        for text in texts:
            pieces = self.find(text)
            if n + len(pieces) > GROUP_PIECES:
                yield from self._joined(group)
                group, n = [], 0
            if len(pieces) <= GROUP_PIECES:
                group.append(pieces)
                n += len(pieces)
            else:
                parts = [part for at in range(0, len(pieces), GROUP_PIECES) for part in self._joined([pieces[at : at + GROUP_PIECES]])]
                yield ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
        yield from self._joined(group)

    def encode_decimal(self, text: str) -> tuple[str, bytes]:
        """All ids in decimal with commas, and the bytes that decoding them gives."""
        return next(self.encode_decimals([text]))


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder for these parameters, made once per worker."""
    state = worker_state("byte_bpe")
    key = (path, pattern)
    if key not in state:
        state[key] = ByteBpe(path, pattern)
    return state[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id_col, ids array<int>).  A null text counts as empty and has no
    ids; repeated rows give repeated results; other columns are ignored."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(vocabulary, pattern)
        for batch in texts:
            yield pd.Series([bpe.encode(t or "") for t in batch])

    bound_batches(docs)
    return docs.select(id_col, encode(F.col(text_col)).alias("ids"))


def decode_documents(ids: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id list: (id_col, content binary)."""

    @F.pandas_udf("binary")
    def decode(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(vocabulary, pattern)
        for batch in lists:
            yield pd.Series([bpe.decode([] if x is None else x) for x in batch])

    return ids.select(id_col, decode(F.col(ids_col)).alias("content"))


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass: (id_col, n_tokens, ids_sha256 of the
    decimal ids joined by commas, decoded_sha256 of the decoded bytes).  A null text counts
    as empty; it has 0 tokens and the digests of the empty string."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = codec(vocabulary, pattern)
        for batch in texts:
            rows = []
            for ids, content in bpe.encode_decimals(t or "" for t in batch):
                n = ids.count(",") + 1 if ids else 0
                rows.append((n, hashlib.sha256(ids.encode("ascii")).hexdigest(), hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs)
    return docs.select(id_col, digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
