import hashlib
import random
import re

from quire.llm import secret_scan as ss
from tests.llm.cases import odd_documents

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = ",".join(f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))
    return [sum(k == x[1] for x in out) for k in range(3)], hashlib.sha256(spans.encode()).hexdigest()


def texts():
    random.seed(3)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " = ", ": ", ":", "=", "abcdefgh1", "short", "AKIA", "ABCDEFGH12345678", "é🙂", " ", "\n", "0123456789abcdef" * 2, "deadbeef", "x.y_z-1", "token=token:abcdefgh12"]
    for _ in range(200):
        yield "".join(random.choice(parts) for _ in range(random.randint(1, 14)))


def test_base_spans_match_brute_force(spark):
    rows = [(100 + k, t, "en", "s") for k, t in enumerate(texts())]
    docs = odd_documents(spark, rows)
    want = sorted(((r.doc_id, *brute(r.text or "")) for r in docs.collect()), key=repr)
    got = sorted(((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in ss.scan(docs).collect()), key=repr)
    assert got == want
    assert ss.scan(docs.limit(0)).count() == 0


def test_ownership_tells_examples_from_live_values(spark):
    live, example, many = "aB3" * 12, "xY7" * 12, "0a1b" * 10
    rows = [(200, f"x {live} y", "en", "a"), (201, f"{live}", "en", "a")] + [(300 + k, f"see {example} or {many}", "en", f"s{k}") for k in range(4)]
    got = {r.doc_id: r for r in ss.scan(odd_documents(spark, rows)).collect()}
    assert got[200].spans == "bare:2:38" and got[200].n_live == 1
    assert got[301].spans == "hex:44:84" and got[301].n_example == 1


def test_two_owners_are_live_and_many_repositories_an_example(spark):
    two, pasted, named = "aB3" * 12, "xY7" * 12, "qR5" * 12
    rows = [(200, f"x {two} y", "en", "a"), (201, two, "en", "b"), (202, f"AZURE={named}", "en", "a"), (203, f"?sig={named}==", "en", "a")]
    rows += [(1000 + k, f"see {pasted} or {'0a1b' * 10}", "en", "a") for k in range(ss.EXAMPLE_REPOSITORIES)]
    got = {r.doc_id: r for r in ss.scan(odd_documents(spark, rows)).collect()}
    assert (got[200].spans, got[201].spans, got[200].n_live) == ("bare:2:38", "bare:0:36", 1)
    assert got[202].spans == "bare:6:42" and got[203].spans == "bare:5:43"
    assert got[1000].spans == "hex:44:84" and (got[1000].n_live, got[1000].n_example) == (0, 1)
