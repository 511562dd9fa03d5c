import base64
import hashlib
import random
import sys

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe_codec as bc
from tests.llm.cases import odd_documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


OWN, REF = bc.ByteBpe(PATH, PATTERN), reference()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abe .,'\n\t\x1c\x85éß日🙂0١"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_match_and_round_trip(text):
    ids = OWN.encode(text)
    assert ids == REF.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()
    assert OWN.encode_decimal(text) == (",".join(map(str, ids)), text.encode())


def test_very_long_pieces():
    for text in ("a" * 50000, "abcab" * 20000, " " * 3000 + "x", "0123456789" * 3000):
        assert OWN.encode(text) == REF.encode_ordinary(text)


def test_query_over_odd_documents(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, bc.round_trip_digests(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = REF.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bc.round_trip_digests(docs.limit(0), PATH, PATTERN).count() == 0
    back = bc.decode_documents(bc.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted(bytes(r.content) for r in back.collect()) == sorted((r.text or "").encode() for r in docs.collect())


def plain_merges(piece, ranks):
    """The lowest-ranked pair merges first, leftmost among equals, by looking at all pairs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_side_by_side_in_any_vocabulary():
    """Ranks in no order of training: a merge may bring up a pair of lower rank."""
    random.seed(3)
    for _ in range(60):
        tokens = [bytes([c]) for c in range(256)]
        tokens += {bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(60)}
        ids = random.sample(range(1000), len(tokens))
        ranks = dict(zip(tokens, ids, strict=True))
        pieces = [bytes(random.choices(b"abcd", k=random.randint(1, 25))) for _ in range(30)]
        assert bc.Merges(ranks).merge(pieces) == [plain_merges(p, ranks) for p in pieces]
    assert bc.Merges(ranks).merge([]) == [] and bc.Merges(ranks).merge([b"", b"a"]) == [[], [ranks[b"a"]]]


def test_groups_parts_and_forgetting(monkeypatch):
    monkeypatch.setattr(bc, "GROUP_PIECES", 16)
    monkeypatch.setattr(bc, "CACHE_PIECES", 20)
    own = bc.ByteBpe(PATH, PATTERN)
    random.seed(5)
    word = lambda: "".join(random.choices("abcdeé日", k=random.randint(1, 9))) * random.choice((1, 1, 1, 1, 12))
    texts = ["", *(" ".join(word() for _ in range(random.choice((0, 3, 15, 16, 17, 100)))) for _ in range(150)), ""]
    assert list(own.encode_decimals(texts)) == [(",".join(map(str, REF.encode_ordinary(t))), t.encode()) for t in texts]
    assert len(own.known) + len(own.older) <= 2 * (20 + 16)


def test_work_of_new_words():
    """Lines of Python run for each byte of words that weren't seen before."""
    random.seed(11)
    text = " ".join("".join(random.choices(("tion", "ré", "eau", "ing", "th", "wh", "ble", "or", "ç"), k=random.randint(2, 5))) for _ in range(2000))
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line" and frame.f_globals["__name__"] == bc.__name__
        return count

    own, was = bc.ByteBpe(PATH, PATTERN), sys.gettrace()
    sys.settrace(count)
    try:
        own.encode_decimal(text)
    finally:
        sys.settrace(was)
    assert lines < 24 * len(text.encode())  # 30 with a queue for each word, 19 with one for many
