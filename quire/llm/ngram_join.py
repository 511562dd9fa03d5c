"""Near-duplicate documents by an exact Jaccard join on word n-grams.

A document's set is that of its 5-word shingles.  The join itself is described in
``set_join``: rare-first prefixes, length, positional and signature filters on the prefix
n-grams, a suffix filter and one verification per pair.  A brief exchange of keys, names, sizes
and positions comes first: only postings that meet another under their key are sent with what
the other filters need.  Documents of equal sets are one record throughout, and pairs inside a component that earlier links have joined aren't
looked at again, so large groups of copies cost no more than their members' prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import set_join as sj
from quire.llm.components import components
from quire.llm.shared import bound_batches, inner_names, written

SIZE = 5
#: Packed columns of a document (id, whether it has one, name, size) and of a name's first document.
ITEM = ("<i8", "i1", "<i8", "<i4")
FIRST = ("<i8", "<i8", "i1")


def _tokens(size: int):
    def run(texts: list[bytes]) -> np.ndarray:
        owner, words, _, _ = sj.owned_words(texts)
        return sj.shingles(owner, words, size)[1]

    return run


def _sets(texts: list[bytes], size: int) -> sj.Sets:
    owner, words, _, _ = sj.owned_words(texts)
    return sj.Sets(*sj.shingles(owner, words, size))


def _postings(size: int, counts: np.ndarray, buckets: int):
    """Brief prefix postings, size and signature of each set that the task meets; a row for
    every document; and the least id of every name."""
    noise = sj.noise_of(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = sj.Dealer(buckets), set()
        least: dict[int, int] = {}
        for batch in batches:
            ids = batch[0].to_numpy(zero_copy_only=False) if not batch[0].null_count else batch[0].fill_null(0).to_numpy()
            known = np.array(batch[0].is_valid(), dtype=np.int8)
            for at, texts in sj.slices(batch[1]):
                sets = _sets(texts, size)
                new = sj.fresh(sets.name, seen)
                dealer.add_postings(sets, counts, noise, new, sets.size, False, True)
                dealer.add(sj.SETS, sj.SET, sj.mix(sets.name[new].view(np.uint64)), [sets.name[new], sets.size[new], *sets.signatures(True)[new].T])
                mine, have = ids[at : at + len(texts)].astype(np.int64), known[at : at + len(texts)]
                n, name = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64)
                n[sets.who], name[sets.who] = sets.size, sets.name
                dealer.add(sj.ITEMS, ITEM, sj.mix(mine.view(np.uint64) + np.arange(len(mine), dtype=np.uint64)), [mine, have, name, n])
                for w, i, h in zip(name[n > 0].tolist(), mine[n > 0].tolist(), have[n > 0].tolist(), strict=True):
                    old = least.get(w, ())
                    if old == () or h and (old is None or i < old):
                        least[w] = i if h else None
                yield from dealer.given(sj.HELD_POSTINGS)
        names = np.array(list(least), np.int64)
        first = list(least.values())
        dealer.add(sj.FIRSTS, FIRST, sj.mix(names.view(np.uint64)), [names, np.array([i or 0 for i in first], np.int64), np.array([i is not None for i in first], np.int8)])
        yield from dealer.given()

    return run


def _others(kind: int, bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    if kind == sj.ITEMS:
        ids, known, name, n = sj.unpack(bodies, ITEM)
        yield sj.found(sj.ITEM, len(ids), b=pa.array(ids, mask=known == 0), c=pa.array(name, mask=n == 0), n=n)
    elif kind == sj.SETS:
        yield sj.known_sets(bodies)
    else:
        name, ids, known = sj.unpack(bodies, FIRST)
        o = np.lexsort((ids, known == 0, name))
        name, ids, known = name[o], ids[o], known[o]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
        yield sj.found(sj.FIRST, len(first), a=name[first], b=pa.array(ids[first], mask=known[first] == 0))


def _token_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in sj.slices(batch[1]):
                sets = _sets(texts, size)
                yield sets.rows(sj.fresh(sets.name, seen), sj.DOCUMENT_PARITY)

    return run


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``verified`` pairs, written: a task of ``components`` that checked them, too, would have two workers."""
    return written(sj.verified(pairs, sets), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id), the smallest id that links
    reach.

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer
    words are one shingle.  Rows of equal text link, so repeated rows share a component;
    null ids never name one unless a component has no other.  Extra columns are ignored;
    an empty table gives no rows.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = sj.sketch(rows.mapInArrow(sj.sketched(_tokens(size), 1), "cell int, tokens binary"))
    buckets = sj.bucket_count(docs)
    brief = sj.deal(rows.mapInArrow(_postings(size, counts, buckets), sj.DEALT))
    met = written(brief.mapInArrow(sj.first_round(_others, True), sj.FOUND), "met")
    info = met.filter(F.col("k") == sj.ITEM).select(F.col("b").alias("doc_id"), F.col("c").alias("name"), "n")
    named = met.filter(F.col("k") == sj.FIRST).select(F.col("a").alias("name"), F.col("b").alias("doc_id"))

    # a posting that meets no other under its key is in no pair
    sharing = met.filter(F.col("k") == sj.SHARING).select(F.col("b").alias("name"), F.col("a").alias("key"), F.col("n").alias("pos"))
    known = met.filter(F.col("k") == sj.KNOWN).select(F.col("a").alias("name"), "n", F.col("body").alias("sig"))
    whole = sharing.join(known, "name").select("name", "key", "pos", "n", "sig")
    dealt = sj.deal(whole.mapInArrow(sj.whole_postings(buckets), sj.DEALT))
    found = written(dealt.mapInArrow(sj.first_round(_others), sj.FOUND), "found")
    pairs = written(found.filter(F.col("k") == sj.PAIR).select("a", "b").distinct(), "pairs")
    live = found.filter(F.col("k") == sj.LIVE).select(F.col("a").alias("key"), F.col("b").alias("name"), "body")

    names = written(pairs.select(F.col("a").alias("name")).union(pairs.select("b")).union(live.select("name")).distinct(), "names")
    few = names.count() <= sj.SENT_NAMES  # and so are the ids wanted: each name has one
    wanted = names.join(named, "name").select(F.col("doc_id").alias("_w")).distinct()
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi")
    sets = sj.wanted_sets(texts.mapInArrow(_token_rows(size), sj.TOKENS), names, False)

    links = _links(pairs, sets).select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = components(links)

    def settle(links: DataFrame | None) -> DataFrame:
        nonlocal joined
        if links is not None:
            more = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
            joined = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
        return joined.select(F.col("node").alias("name"), F.col("root").alias("state"))

    sj.rounds(live, pairs, sets, lambda new: _links(new, sets), settle, True)
    linked = joined.select(F.col("node").alias("name"), "root").unionByName(joined.select(F.col("root").alias("name"), "root").distinct())
    inside = written(linked.join(named, "name"), "linked")
    classes = inside.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_name = named.join(inside.select("name", "root").join(classes, "root").select("name", F.col("component_id").alias("_linked")), "name", "left")
    by_name = by_name.select("name", F.coalesce("_linked", "doc_id").alias("component_id"))
    out = info.join(by_name, "name", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id, null ids last, and of
    several rows of that id the one of the least text.

    Every row has a number of its own, so that rows of one id, or of none, are told apart.
    The columns come through as they are, whatever their names.
    """
    row, class_, rank, least, text = inner_names(docs, 5)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = near_duplicates(numbered, row, text_col, size).select(F.col("doc_id").alias(row), F.col("component_id").alias(class_))
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"))
    ranked = written(classes.join(numbered.select(row, place.alias(rank)), row), "ranked")
    best = ranked.groupBy(class_).agg(F.min(rank).alias(least))
    at_best = ranked.join(best, class_).filter(F.col(rank).eqNullSafe(F.col(least)))
    first = written(at_best.groupBy(class_).agg(F.min(row).alias(row), F.count("*").alias("n"), F.first(least).alias(least)), "first")
    tied = ranked.join(first.filter("n > 1").select(class_, least), class_).filter(F.col(rank).eqNullSafe(F.col(least))).select(class_, row)
    texts = tied.join(numbered.select(row, F.col(text_col).alias(text)), row).groupBy(class_).agg(F.min(F.struct(text, row)).alias(rank))
    keep = first.filter("n = 1").select(row).unionByName(texts.select(F.col(rank)[row].alias(row)))
    return numbered.join(keep, row, "left_semi").select(*docs.columns)
