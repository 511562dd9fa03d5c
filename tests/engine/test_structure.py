import pytest

from quire.operators import structure as st


def test_columns_are_read_one_after_the_other():
    left = [(0, y, 100, y + 10) for y in range(20, 100, 12)]
    right = [(130, y, 230, y + 10) for y in range(20, 100, 12)]
    heading = (0, 0, 230, 10)
    boxes = [x for pair in zip(left, right, strict=True) for x in pair] + [heading]
    got = [boxes[i] for i in st.reading_order(boxes)]
    assert got == [heading, *left, *right]
    assert st.reading_order([]) == [] and st.reading_order([heading]) == [0]


def test_first_fit():
    assert st.first_fit_baselines([(10, 10), (14, 10), (30, 10), (11, 10), (26, 4)]) == [0, 0, 1, 0, 1]


def test_right_to_left():
    assert st.logical_order("abc def") == "abc def"
    assert st.logical_order("םולש") == "שלום"
    assert st.logical_order("12 םולש") == "שלום 12"


def test_table_scores():
    a = [(r, c, 1, 1, f"{r}{c}") for r in range(3) for c in range(3)]
    assert st.topology_score(a, a) == st.content_score(a, a) == 1.0
    assert st.topology_score(a, a[:6]) == pytest.approx(12 / 15) and st.content_score(a, []) == 0.0
    merged = [(0, 0, 1, 2, "x"), *((r, c, 1, 1, "y") for r, c in ((0, 2), (1, 0), (1, 1), (1, 2)))]
    plain = [(r, c, 1, 1, "y") for r in range(2) for c in range(3)]
    assert st.topology_score(merged, plain) == pytest.approx((4 + 0.5 + 0.5) * 2 / 12)
    assert st.lcs_similarity("abc", "axc") == pytest.approx(4 / 6) and st.lcs_similarity("", "") == 1.0
    assert st.matched([(0, 0, 2, 2), (5, 5, 6, 6)], [(0, 0, 2, 1.9), (0, 0, 2, 2)]) == [(0, 1, 1.0)]
    assert st.cell_f1([["a", "b"]], [["a", "c"]]) == 0.5
