import hashlib
import random
import re

from quire.llm import pii
from tests.llm.cases import odd_documents


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    out = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(tests) for m in re.finditer(p, text) if ok(m[0])]
    return [sum(x[0] == k for x in out) for k in range(4)], hashlib.sha256(",".join(f"{pii.BASE[k]}:{s}:{e}" for k, s, e in sorted(out)).encode()).hexdigest()


def texts():
    random.seed(5)
    parts = ["joe", "@", "mail.com", ".", "_d@e.f", "1.2.3.4", "010.255.0.1", "256", "4111111111111111", "4111 1111 1111 1111", "-", " ", "+1 (555) 555-1234", "+", "12345678", "é🙂", "\n", "(", ")", "5500-0000-0000-0004", "7", "a%b"]
    for _ in range(300):
        yield "".join(random.choice(parts) for _ in range(random.randint(1, 12)))


def test_base_spans_match_brute_force(spark):
    rows = [(100 + k, t, "en", "s") for k, t in enumerate(texts())] + [(90, "1" * 40000, "en", "s"), (91, "a" * 60000 + " x@y.zz", "en", "s"), (92, "1 " * 30000 + "+1" + " " * 30000, "en", "s")]
    docs = odd_documents(spark, rows)
    want = sorted(((r.doc_id, *brute(r.text or "")) for r in docs.collect()), key=repr)
    got = sorted(((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.detect(docs).collect()), key=repr)
    assert got == want
    assert pii.detect(docs.limit(0)).count() == 0


def test_reliabilities_are_found():
    random.seed(1)
    right = (0.95, 0.7, 0.8)
    counts = {}
    for _ in range(20000):
        truth = random.random() < 0.7
        votes = tuple(int(truth == (random.random() < r)) if random.random() < 0.9 else -1 for r in right)
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.fit_votes(counts)
    assert abs(model["share"] - 0.7) < 0.08
    found = [c[1][0] / (c[1][0] + c[0][0]) for c in model["chance"]]
    assert found[0] > found[2] > found[1]
    assert pii.fit_votes({})["share"] == 0.5


def test_more_spans(spark):
    rows = [(400 + k, f"call me: 415-{200 + k}-{1234 + k * 7} or write joe{k} [at] site [dot] com", "en", "s") for k in range(30)]
    got = pii.detect(odd_documents(spark, rows)).filter("doc_id >= 400").collect()
    assert all(r.n_more >= 1 and r.n_phone == 0 for r in got)


def test_very_many_labels_and_matches_in_one_text(spark):
    rows = [(700, "a@b" + ".c" * 100_000, "en", "s"), (701, "1.2.3.4 " * 30_000, "en", "s"), (702, "x@y.zz 415-555-1234 " * 10_000, "en", "s"), (703, "1.2.3.4 " * 257, "en", "s"), (704, "a@b.c " * 256, "en", "s")]
    rows += [(705, "a@" + "b-" * 3_000 + " c@d" + "." * 9, "en", "s")]
    docs = odd_documents(spark, rows).filter("doc_id >= 700")
    got = pii.detect(docs).collect()
    assert sorted((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in got) == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert all(len(r.probabilities) == (r.spans.count(",") + 1 if r.spans else 0) for r in got)
    assert all(0 <= p <= 1 for r in got for p in r.probabilities)


def test_spans_of_other_kinds_keep_off_base_spans(spark):
    rows = [(800, "joe@x.org, 415-555-1234, +1 415-555-1234 415-555-9999", "en", "s")]
    found = odd_documents(spark, rows).filter("doc_id = 800").select(pii.proposals(pii.F.col("text")).alias("p")).first().p
    spans = sorted((s.start, s.end, s.kind) for s in found)
    assert [s[2] for s in spans].count("email") == 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_context_across_chunks(spark):
    rows = [(900 + k, "é" * k + "🙂 call 415-555-1234 or isbn 415-555-1234", "en", "s") for k in (0, 4080, 4085, 4090, 4096, 4100, 8191)]
    got = {r.doc_id: r.probabilities for r in pii.detect(odd_documents(spark, rows), threshold=0.0).filter("doc_id >= 900").collect()}
    assert len({tuple(p) for p in got.values()}) == 1 and len(got[900]) == 2
