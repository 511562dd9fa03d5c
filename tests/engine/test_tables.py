"""Ruled tables of random rules against the definitions by hand; one exchange in all."""

import random

import pytest
from pyspark.sql import functions as F

from quire import document_queries, queries  # noqa: F401
from quire.operators import markup, tables


def page(rng):
    """Rules on a grid, some pieces missing, doubled or off by a little, and words about."""
    xs, ys = [50 + 40 * k + rng.choice((0, 0, 1)) for k in range(rng.randint(2, 5))], [60 + 25 * k for k in range(rng.randint(2, 5))]
    rects = [(a, y - 0.5, b, y + 0.5) for y in ys for a, b in zip(xs, xs[1:]) if rng.random() < 0.85]
    rects += [(x - 0.5, a, x + 0.5, b) for x in xs for a, b in zip(ys, ys[1:]) if rng.random() < 0.85]
    rects += [(r[0] + 1, r[1] + 1, r[2] + 1, r[3] + 1) for r in rng.sample(rects, min(2, len(rects)))] + [(10, 10, 13, 13), (0, 0, 90, 90)]
    rng.shuffle(rects)
    words = []
    for k in range(12):
        x, y = rng.choice((rng.uniform(40, 230), rng.choice(xs) - 5)), rng.choice((rng.uniform(50, 160), rng.choice(ys) - 4))
        words += [(f"w{k % 7}|", x, y, x + 10, y + 8)] * rng.choice((1, 1, 2))
    return [tuple(map(float, r)) for r in rects], [(w, *map(float, b)) for w, *b in words]


def edges_by_hand(rects, t=3.0):
    out = []
    for d in "hv":
        raw = []
        for x0, y0, x1, y1 in rects:
            if d == "h" and y1 - y0 <= t and x1 - x0 >= t:
                raw.append(((y0 + y1) / 2, x0, x1))
            if d == "v" and x1 - x0 <= t and y1 - y0 >= t:
                raw.append(((x0 + x1) / 2, y0, y1))
        raw.sort()
        runs = []
        for r in raw:
            if runs and r[0] - runs[-1][-1][0] <= t:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            pos, parts = sum(r[0] for r in run) / len(run), []
            for lo, hi in sorted((r[1], r[2]) for r in run):
                if parts and lo - parts[-1][1] <= t:
                    parts[-1][1] = max(parts[-1][1], hi)
                else:
                    parts.append([lo, hi])
            out += [(d, pos, lo, hi) for lo, hi in parts]
    return out


def cells_by_hand(edges, words, t=3.0):
    hs, vs = [e[1:] for e in edges if e[0] == "h"], [e[1:] for e in edges if e[0] == "v"]
    best = {}
    for tp, tlo, thi in hs:
        for bp, blo, bhi in hs:
            for lp, llo, lhi in vs:
                if bp > tp + t and llo <= tp + t and lhi >= bp - t and max(tlo, blo) <= lp + t and min(thi, bhi) > lp + t:
                    for rp, rlo, rhi in vs:
                        if rp > lp + t and rlo <= tp + t and rhi >= bp - t and min(thi, bhi) >= rp - t:
                            best[lp, tp] = min(best.get((lp, tp), (9e9, 9e9)), (bp, rp))
    boxes = [(x0, y0, x1, y1) for (x0, y0), (y1, x1) in best.items()]
    tops, lefts = sorted({b[1] for b in boxes}), sorted({b[0] for b in boxes})
    out = []
    for x0, y0, x1, y1 in boxes:
        inside = [(cy, wx, w) for w, wx, a, bx, b in words if x0 <= (cx := (wx + bx) / 2) <= x1 and y0 <= (cy := (a + b) / 2) <= y1 and cx]
        span = lambda v, a, b: sum(a <= k < b - 1e-6 for k in v)
        out.append((tops.index(y0), lefts.index(x0), x0, y0, x1, y1, span(tops, y0, y1), span(lefts, x0, x1), " ".join(w for *_, w in sorted(inside)) if inside else None))
    return sorted(out, key=lambda c: c[:2])


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(7)
    made = {i: page(rng) for i in range(100)} | {100: ([], []), 101: ([(0.0, 0.0, 50.0, 1.0)], [])}
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(i, 0, r, w) for i, (r, w) in made.items()], f"doc_id long, page_no int, rects array<{box}>, words array<struct<word:string,{box[7:]}>")
    return made, df.repartition(3).cache()


def near(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_edges_cells_and_texts(pages):
    made, df = pages
    edges = {i: edges_by_hand(r) for i, (r, _) in made.items()}
    assert near(tables.edges(df).drop("page_no").collect()) == near((i, *e) for i, v in edges.items() for e in v)
    cells = {i: cells_by_hand(edges[i], w) for i, (_, w) in made.items()}
    assert near(tables.cells(tables.filled(df)).drop("page_no").collect()) == near((i, *c) for i, v in cells.items() for c in v)
    flat = [c for v in cells.values() for c in v]
    assert len(flat) > 200 and any(c[6] > 1 for c in flat) and any(c[7] > 1 for c in flat) and any(c[8] and " " in c[8] for c in flat) and any(c[8] is None for c in flat)
    rects, words = df.select("doc_id", "page_no", F.explode("rects").alias("b")).select("doc_id", "page_no", "b.*"), df.select("doc_id", "page_no", F.explode("words").alias("b")).select("doc_id", "page_no", "b.*")
    assert near(tables.cells(tables.filled(tables.gathered(rects, words))).collect()) == near(tables.cells(tables.filled(df)).collect())


def test_markdown_and_html(pages):
    made, df = pages
    md, html = ({r.doc_id: r.out for r in f(tables.filled(df)).collect()} for f in (tables.markdown, tables.html))
    for i, (r, w) in made.items():
        rows = {}
        for c in cells_by_hand(edges_by_hand(r), w):
            rows.setdefault(c[0], []).append(c)
        lines, trs = [], []
        for k, row in rows.items():
            lines.append("|" + "|".join((c[8] or "").replace("|", "\\|") for c in row) + "|\n" + ("|---" * len(row) + "|\n" if k == 0 else ""))
            span = lambda c: (f' rowspan="{c[6]}"' if c[6] > 1 else "") + (f' colspan="{c[7]}"' if c[7] > 1 else "")
            trs.append("<tr>" + "".join(f"<td{span(c)}>{c[8] or ''}</td>" for c in row) + "</tr>\n")
        assert md.get(i) == ("".join(lines) or None) and html.get(i) == ("<table>\n" + "".join(trs) + "</table>\n" if trs else None)


def test_plain_tables_are_read_as_by_the_parser():
    for html in ("<table><tr><td>a &amp; b</td><td> x\n y </td></tr>\n<tr></tr><tr><td>&#65;&lt;</td></tr></table>\n", "<table>\n</table>", "<table><tr><td>a > b &am</td></tr></table>"):
        assert markup._PLAIN.fullmatch(html)
        want = markup.table_cells(html.replace("<table>", "<table >"))
        assert not markup._PLAIN.fullmatch(html.replace("<table>", "<table >")) and markup.table_cells(html) == want


@pytest.mark.parametrize("name", ["table_cells", "table_markdown", "table_html", "table_from_html", "table_edges"])
def test_only_items_are_dealt_out(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
