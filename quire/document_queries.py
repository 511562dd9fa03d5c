"""Queries over documents in bytes, ruled tables, samples, markup and streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from quire.operators import markup, raster, tables
from quire.queries import LINES, WORDS, docs, query, table
from quire.sources import relations
from quire.streaming import documents as streaming


def files(spark, sf_dir):
    """Every document's virtual pages as a document in bytes."""
    return relations.written_documents(docs(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, '1.7' AS version, CAST(max(page_no) + 1 AS INT) AS page_count, CAST(1 AS INT) AS revisions, FALSE AS is_repaired FROM lines GROUP BY doc_id")
def document_open(spark, sf_dir):
    return relations.relation(files(spark, sf_dir), "documents").drop("metadata")


@query(f"WITH {LINES} SELECT doc_id, page_no, string_agg(text, '' ORDER BY r) AS text FROM lines WHERE text <> '' GROUP BY doc_id, page_no")
def document_text(spark, sf_dir):
    return relations.relation(files(spark, sf_dir), "texts")


@query(f"WITH {WORDS} SELECT doc_id, page_no, word, round(x0, 3) AS x0, round(y1, 3) AS y1 FROM words")
def document_words(spark, sf_dir):
    w = relations.relation(files(spark, sf_dir), "words")
    return w.select("doc_id", "page_no", "word", F.round("x0", 3).alias("x0"), F.round("y1", 3).alias("y1"))


@query(f"WITH {LINES}, p AS (SELECT doc_id, max(page_no) + 1 AS n FROM lines GROUP BY doc_id), q AS (SELECT doc_id, unnest(generate_series(1, n)) AS k FROM p) SELECT doc_id, CAST(k - 1 AS INT) AS ord, CAST(1 AS INT) AS level, 'Page ' || k AS title, CAST(k - 1 AS INT) AS page FROM q")
def document_toc(spark, sf_dir):
    return relations.relation(files(spark, sf_dir), "toc")


@query(f"WITH {LINES} SELECT doc_id, CAST(max(page_no) + 1 AS INT) AS page_count, TRUE AS is_repaired FROM lines GROUP BY doc_id")
def document_repair(spark, sf_dir):
    """The same documents with their ends cut off."""
    cut = files(spark, sf_dir).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 300)"))
    return relations.relation(cut, "documents").select("doc_id", "page_count", "is_repaired")


@query(f"WITH {LINES}, p AS (SELECT doc_id, max(page_no) + 1 AS n FROM lines GROUP BY doc_id) SELECT doc_id, kind, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, 'Page' AS kind, n FROM p UNION ALL SELECT doc_id, 'Catalog', 1 FROM p UNION ALL SELECT doc_id, 'Font', 1 FROM p)")
def document_objects(spark, sf_dir):
    o = relations.relation(files(spark, sf_dir), "objects")
    return o.filter(F.col("kind").isin("Page", "Catalog", "Font")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


# --- ruled tables: an order is a page, its items the rows of a table ------------------------

ITEMS = "item AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS r, CAST(l_partkey AS VARCHAR) AS a, 'x|' || l_suppkey AS b, l_returnflag || l_linestatus AS c FROM lineitem)"


def ruled(spark, sf_dir):
    """(doc_id, page_no, rects, words): the rules in pieces and the words of the tables."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    box = lambda x0, y0, x1, y1, *more: F.struct(*more, F.lit(float(x0)).alias("x0"), y0.alias("y0"), F.lit(float(x1)).alias("x1"), y1.alias("y1"))

    def pieces(_, r):
        y = F.lit(100.0) + r * 20
        across = [box(100 + 100 * k, y + d - 0.5, 200 + 100 * k, y + d + 0.5) for d in (0, 20) for k in range(3)]
        return F.array(*across, *(box(99.5 + 100 * k, y, 100.5 + 100 * k, y + 20) for k in range(4)))

    def words(s, r):
        y = F.lit(104.0) + r * 20
        texts = s["l_partkey"].cast("string"), F.concat(F.lit("x|"), s["l_suppkey"].cast("string")), F.concat(s["l_returnflag"], s["l_linestatus"])
        return F.array(*(box(105 + 100 * k, y, 145 + 100 * k, y + 11, t.alias("word")) for k, t in enumerate(texts)))

    return rows.select("doc_id", F.lit(0).alias("page_no"), F.flatten(F.transform("rows", pieces)).alias("rects"), F.flatten(F.transform("rows", words)).alias("words"))


def filled(spark, sf_dir):
    return tables.filled(ruled(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT doc_id, CAST(r AS INT) AS row_no, CAST(k AS INT) AS col_no, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS text, CAST(1 AS INT) AS row_span, CAST(1 AS INT) AS col_span FROM item, (VALUES (0), (1), (2)) AS t(k)")
def table_cells(spark, sf_dir):
    return tables.cells(filled(spark, sf_dir)).select("doc_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "text", "row_span", "col_span")


@query(f"WITH {ITEMS}, l AS (SELECT doc_id, r, '|' || a || '|' || replace(b, '|', '\\|') || '|' || c || '|' || chr(10) || CASE WHEN r = 0 THEN '|---|---|---|' || chr(10) ELSE '' END AS t FROM item) SELECT doc_id, string_agg(t, '' ORDER BY r) AS out FROM l GROUP BY doc_id")
def table_markdown(spark, sf_dir):
    return tables.markdown(filled(spark, sf_dir)).select("doc_id", "out")


@query(f"WITH {ITEMS}, l AS (SELECT doc_id, r, '<tr><td>' || a || '</td><td>' || b || '</td><td>' || c || '</td></tr>' || chr(10) AS t FROM item) SELECT doc_id, '<table>' || chr(10) || string_agg(t, '' ORDER BY r) || '</table>' || chr(10) AS out FROM l GROUP BY doc_id")
def table_html(spark, sf_dir):
    return tables.html(filled(spark, sf_dir)).select("doc_id", "out")


@query(f"WITH {ITEMS} SELECT doc_id, CAST(r AS INT) AS row_no, CAST(k AS INT) AS col_no, CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS text FROM item, (VALUES (0), (1), (2)) AS t(k)")
def table_from_html(spark, sf_dir):
    """The cells that parsing the rendered tables gives back."""
    cells = markup.html_table_cells(table_html(spark, sf_dir), "doc_id", "out")
    return cells.select(F.col("id").alias("doc_id"), F.col("row").alias("row_no"), F.col("col").alias("col_no"), "text")


@query(f"WITH {ITEMS}, n AS (SELECT doc_id, max(r) + 1 AS n FROM item GROUP BY doc_id) SELECT doc_id, 'h' AS dir, CAST(100 + 20 * k AS DOUBLE) AS pos, CAST(100 AS DOUBLE) AS lo, CAST(400 AS DOUBLE) AS hi FROM n, generate_series(0, 60) AS t(k) WHERE k <= n UNION ALL SELECT doc_id, 'v', 100 + 100 * k, 100, 100 + 20 * n FROM n, generate_series(0, 3) AS t(k)")
def table_edges(spark, sf_dir):
    return tables.edges(ruled(spark, sf_dir)).select("doc_id", "dir", "pos", "lo", "hi")


# --- samples --------------------------------------------------------------------------------

GREY = "grey AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.5) * 32) * 8)) AS INT)) AS s FROM embeddings)"


def grey(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), (F.floor((v.cast("double") + 0.5) * 32) * 8).cast("int"))).cast("int")).alias("s"))


@query(f"WITH {GREY}, x AS (SELECT vec_id, unnest(s) AS v FROM grey), c AS (SELECT vec_id, v, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT vec_id, sum(255 - v) AS inv FROM x GROUP BY vec_id) SELECT vec_id, CAST(count(*) AS INT) AS colors, max(n) / CAST(64 AS DOUBLE) AS top_usage, count(*) = 1 AS unicolor, CAST(max(inv) AS BIGINT) AS inverted FROM c JOIN t USING (vec_id) GROUP BY vec_id")
def raster_colors(spark, sf_dir):
    s = F.col("s")
    inverted = F.aggregate(raster.invert(s), F.lit(0).cast("long"), lambda a, x: a + x)
    return grey(spark, sf_dir).select("vec_id", raster.color_count(s).alias("colors"), raster.top_usage(s).alias("top_usage"), raster.is_unicolor(s).alias("unicolor"), inverted.alias("inverted"))


@query(f"WITH {GREY}, p AS (SELECT a.vec_id, unnest(a.s) AS x, unnest(b.s) AS y FROM grey a JOIN grey b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(1 - avg(abs(x - y)) / 255, 9) AS mae_similarity, round((2 * avg(x) * avg(y) + 6.5025) * (2 * (avg(x * y) - avg(x) * avg(y)) + 58.5225) / ((avg(x) * avg(x) + avg(y) * avg(y) + 6.5025) * (avg(x * x) - avg(x) * avg(x) + avg(y * y) - avg(y) * avg(y) + 58.5225)), 6) AS ssim FROM p GROUP BY vec_id")
def raster_similarity(spark, sf_dir):
    g = grey(spark, sf_dir)
    j = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t")), "vec_id")
    return j.select("vec_id", F.round(raster.mae_similarity(F.col("s"), F.col("t")), 9).alias("mae_similarity"), F.round(raster.ssim(F.col("s"), F.col("t")), 6).alias("ssim"))


@query(f"WITH {GREY}, q AS (SELECT vec_id, s, unnest(generate_series(0, 15)) AS i FROM grey), z AS (SELECT vec_id, i, (i // 4) * 16 + (i % 4) * 2 + 1 AS o, s FROM q), v AS (SELECT vec_id, i, (s[o] + s[o + 1] + s[o + 8] + s[o + 9]) // 4 AS v FROM z) SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS small FROM v GROUP BY vec_id")
def raster_shrink(spark, sf_dir):
    return grey(spark, sf_dir).select("vec_id", F.array_join(raster.shrink(F.col("s"), 8, 8).cast("array<string>"), ",").alias("small"))


# --- markup and streams ---------------------------------------------------------------------


@query()
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", markup.html_to_text("html").alias("t")).select("page_id", "t.text", F.size("t.links").alias("n_links"))


def streamed(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files: the path is a pattern
    of one name, as a path proper would have to be a folder."""
    plain = re.sub(r"([\\{}\[\]*?])", r"\\\1", sf_dir)
    return streaming.stream(spark, f"{plain}/{name}.parque[t]", table(spark, sf_dir, name).schema, None)


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id")
def stream_words(spark, sf_dir):
    """Words of a stream of documents, counted as they come."""
    source = streamed(spark, sf_dir, "documents")
    counts = streaming.word_stream(source.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n_words"))
    return streaming.drained(counts, f"words_{uuid.uuid4().hex[:8]}", "complete")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    source = streamed(spark, sf_dir, "events")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.drained(streaming.event_counts(source), f"events_{uuid.uuid4().hex[:8]}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
