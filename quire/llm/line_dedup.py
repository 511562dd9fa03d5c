"""Corpus-wide removal of repeated and nearly repeated lines.

A line's set is that of its words, A-Z as a-z.  Lines are in the order of (document id,
null first; text hash; line number).  A line is removed if an earlier line, kept or not,
has the same set or one of Jaccard similarity 0.8 or more; lines without words stay.

The similarity join is described in ``set_join``: rare-first prefixes with length,
positional and signature filters, then an exact verification.  Equal lines are found on
the way: of the lines of one set in a task only the first is dealt out at all, and the
firsts of all tasks meet by name.  A line that has found an earlier match isn't tried again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import set_join as sj
from quire.llm.shared import bound_batches, inner_names, written

#: Packed columns of a removed line, and of a set's first line in a task: id, whether it has one, text hash, line.
GONE = ("<i8", "i1", "<i8", "<i4")
FIRST = ("<i8", *GONE)


def _line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line (numbered through the texts) and hash of every word, and by text the number of its first line."""
    owner, words, raw, starts = sj.owned_words(texts)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    line = sj.places(breaks, starts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, int)
    return owner, line, words, np.searchsorted(breaks, begins)


def _line_sets(texts: list[bytes]) -> tuple[sj.Sets, np.ndarray, np.ndarray]:
    """Sets of the lines that have words, with their texts' indices and line numbers."""
    owner, line, words, begins = _line_words(texts)
    sets = sj.Sets(line, words)
    first = np.flatnonzero(np.diff(line, prepend=-1))  # first word of each line with words
    doc = owner[first]
    return sets, doc, line[first] - begins[doc]


def _postings(counts: np.ndarray, low: int, high: int, buckets: int):
    """Prefix postings of each set that the task meets, its first line, and all its other
    lines as removed.  ``low`` and ``high`` bound the ids; ``ord`` is an id's place between."""
    noise = sj.noise_of(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = sj.Dealer(buckets)
        firsts: dict[int, tuple] = {}  # name -> (has id, id, text hash, line): one for each set of the task
        for batch in batches:
            known = np.array(batch[0].is_valid(), dtype=np.int8)
            ids, hashes = batch[0].fill_null(0).to_numpy().astype(np.int64), batch[1].to_numpy().astype(np.int64)
            place = np.floor(np.where(known, (ids.astype(np.float64) - low) / max(1, high - low), 0) * (2**31 - 2)).astype(np.int64)
            for at, texts in sj.slices(batch[2]):
                sets, doc, line = _line_sets(texts)
                doc = doc + at
                new, lost = np.zeros(len(doc), bool), []
                for k, (name, *mine) in enumerate(zip(sets.name.tolist(), known[doc].tolist(), ids[doc].tolist(), hashes[doc].tolist(), line.tolist(), strict=True)):
                    old = firsts.get(name)
                    if old is None:
                        firsts[name], new[k] = tuple(mine), True
                    elif (mine := tuple(mine)) < old:
                        firsts[name] = mine
                        new[k] = mine[:2] < old[:2]  # its postings have an earlier place
                        lost.append(old)
                    else:
                        lost.append(mine)
                dealer.add_postings(sets, counts, noise, new, place[doc], True)
                if lost:
                    h, i, t, n = (np.array(x) for x in zip(*lost, strict=True))
                    dealer.add(sj.ITEMS, GONE, sj.mix(t.astype(np.int64).view(np.uint64)), [i, h, t, n])
                yield from dealer.given(sj.HELD_POSTINGS)
        if firsts:
            names = np.fromiter(firsts, np.int64, len(firsts))
            h, i, t, n = (np.array(x) for x in zip(*firsts.values(), strict=True))
            dealer.add(sj.FIRSTS, FIRST, sj.mix(names.view(np.uint64)), [names, i, h, t, n])
        yield from dealer.given()

    return run


def _others(kind: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    if kind == sj.ITEMS:
        ids, known, th, line = sj.unpack(bodies, GONE)
        yield sj.found(sj.ITEM, len(ids), b=pa.array(ids, mask=known == 0), c=th, n=line)
        return
    name, ids, known, th, line = sj.unpack(bodies, FIRST)
    o = np.lexsort((line, th, ids, known, name))
    name, ids, known, th, line = (x[o] for x in (name, ids, known, th, line))
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    for kind, on in ((sj.FIRST, first), (sj.ITEM, ~first)):
        more = {"a": name[on]} if kind == sj.FIRST else {}
        yield sj.found(kind, int(on.sum()), **more, b=pa.array(ids[on], mask=known[on] == 0), c=th[on], n=line[on])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for _, texts in sj.slices(batch[0]):
            sets, _, _ = _line_sets(texts)
            yield sets.rows(sj.fresh(sets.name, seen), sj.LINE_PARITY)


def removed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, lines array<int>): numbers of the removed lines by id and text hash."""
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    counts = sj.sketch(rows.select("text").mapInArrow(sj.sketched(lambda texts: sj.owned_words(texts)[1]), "cell int, tokens binary"))
    low, high = rows.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    dealt = sj.deal(rows.mapInArrow(_postings(counts, int(low), int(high), sj.bucket_count(docs)), sj.DEALT))
    found = written(dealt.mapInArrow(sj.first_round(_others), sj.FOUND), "line-found")
    firsts = found.filter(F.col("k") == sj.FIRST).select(F.col("a").alias("name"), F.col("b").alias("doc_id"), F.col("c").alias("th"), F.col("n").alias("line"))
    pairs = written(found.filter(F.col("k") == sj.PAIR).select("a", "b").distinct(), "line-pairs")
    live = found.filter(F.col("k") == sj.LIVE).select(F.col("a").alias("key"), F.col("b").alias("name"), "body")
    names = written(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).union(live.select("name")).distinct(), "line-names")
    sets = sj.wanted_sets(rows.select("text").mapInArrow(_token_rows, sj.TOKENS), names)
    places = written(firsts.join(F.broadcast(names) if names.count() <= sj.SENT_NAMES else names, "name", "left_semi"), "line-places")

    def losers(pairs: DataFrame) -> DataFrame:
        """Names with an earlier match, among candidate pairs (a, b)."""
        at = lambda k: places.select(F.col("name").alias(k), F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "th", "line").alias("f" + k))
        links = sj.verified(pairs, sets).join(at("a"), "a").join(at("b"), "b")
        return links.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("name")).distinct()

    gone = written(losers(pairs), "line-losers")

    def settle(more: DataFrame | None) -> DataFrame:
        nonlocal gone
        if more is not None:
            gone = written(gone.unionByName(more).distinct(), "line-losers")
        return gone.select("name", F.lit(1).cast("long").alias("state"))

    sj.rounds(live, pairs, sets, losers, settle, False)
    lost = places.join(gone, "name", "left_semi").select("doc_id", "th", "line")
    equal = found.filter(F.col("k") == sj.ITEM).select(F.col("b").alias("doc_id"), F.col("c").alias("th"), F.col("n").alias("line"))
    return equal.unionByName(lost).groupBy("doc_id", "th").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str, str] = ("n_lines", "n_removed", "n_worded")) -> DataFrame:
    """``docs`` with the kept lines as their texts, and columns ``added``: the lines, the
    removed ones, and the kept lines that have words.

    Null texts stay null, with 0 lines.  Of rows of the same id and text the first keeps
    its lines and the others lose all that have words.  Other columns are carried along
    whatever their names, but for those that are named like an added one: these give way.
    """
    key, hash_, copy, other_key, other_hash, lines, cut = inner_names(docs, 7)
    gone = removed_lines(docs, id_col, text_col).toDF(other_key, other_hash, lines)
    keyed = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(hash_, F.xxhash64(text_col))
    repeated = keyed.groupBy(key, hash_).agg(F.count("*").alias(copy)).filter(F.col(copy) > 1)
    if not repeated.isEmpty():
        keyed = keyed.withColumn(copy, F.row_number().over(Window.partitionBy(key, hash_).orderBy(F.lit(0))))
    else:
        keyed = keyed.withColumn(copy, F.lit(1))
    joined = keyed.join(gone, F.col(key).eqNullSafe(F.col(other_key)) & (F.col(hash_) == F.col(other_hash)), "left")

    @F.pandas_udf("text string, n_lines int, n_removed int, n_worded int")
    def kept(texts: pd.Series, gone: pd.Series, copies: pd.Series) -> pd.DataFrame:
        out = []
        for text, lines, copy in zip(texts, gone, copies, strict=True):
            if text is None:
                out.append((None, 0, 0, 0))
                continue
            all_lines = text.split("\n")
            worded = [bool(x.strip(" \t\n\x0b\x0c\r")) for x in all_lines]
            drop = {k for k, w in enumerate(worded) if w} if copy > 1 else set() if lines is None else set(lines.tolist())
            text = "\n".join([x for k, x in enumerate(all_lines) if k not in drop]) if drop else text
            out.append((text, len(all_lines), len(drop), sum(worded) - len(drop)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "n_worded"])

    # else a filter on the numbers of lines would run it a second time, in a second worker of the task
    out = joined.withColumn(cut, kept.asNondeterministic()(F.col(text_col), F.col(lines), F.col(copy)))
    columns = [F.col(cut)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return out.select(*columns, *(F.col(cut)[f].alias(c) for f, c in zip(("n_lines", "n_removed", "n_worded"), added, strict=True)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256 of the kept text; null: of nothing)."""
    out = dedup_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
