"""Alignment functions against exhaustive search."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import align, stats


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from(["a", "b", "c", None]), max_size=6))
def test_lcs_is_longest_and_passes_over_the_first_stream(a, b):
    got = align.lcs(a, b)
    assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))

    def common(x):
        it = iter(b)
        return all(c in it for c in (a[i] for i in x))

    assert len(got) == max(n for n in range(len(a) + 1) if any(common(x) for x in combinations(range(len(a)), n)))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_monotone_is_best_and_earliest(n, m, data):
    s = np.array([[data.draw(st.integers(0, 3)) for _ in range(m)] for _ in range(n)], dtype=float)
    got = align.monotone(s)
    total = {p: sum(s[i, j] for i, j in enumerate(p)) for p in combinations_with_replacement(range(m), n)}
    assert total[tuple(got)] == max(total.values())
    assert got[-1] == min(p[-1] for p, v in total.items() if v == max(total.values()))


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["q"], r["id"]): r["sim"] for r in stats.neighbours(df, df.where("id % 10 = 0"), "id", "v", 3, rows=7, asked=2).collect()}
    size = np.linalg.norm(m, axis=1)
    for q in range(0, 60, 10):
        if size[q]:
            sims = {i: m[q] @ m[i] / size[q] / size[i] for i in range(60) if i != q and size[i]}
            want = sorted(sims, key=lambda i: (-round(sims[i], 4), i))[:3]
            assert [i for _, i in sorted((-round(v, 4), i) for (x, i), v in got.items() if x == q)] == want


def test_gaps():
    a, b = list("xaybz"), list("xqyrsz")
    anchors = align.lcs(a, b)
    assert align.fill_gaps(a, b, anchors) == [(0, 0), (1, 1), (2, 2), (4, 5)]
    assert align.fill_gaps([], [], []) == [] and align.fill_gaps(["a"], ["b"], []) == [(0, 0)]
    assert align.zip_gaps(list("xaay"), list("xbaay"), [(0, 0), (3, 4)]) == [(0, 0), (1, 2), (2, 3), (3, 4)]
    assert align.zip_gaps(["a", None], ["a", None], []) == [(0, 0)]
    assert align.margins(np.array([[0.5, 0.2], [0.1, 0.4]]), [0, 1]) == [0.3, 0.30000000000000004] and align.margins(np.array([[0.5]]), [0]) == [1.0]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-20, 60), st.one_of(st.none(), st.integers(0, 9))), max_size=25, unique_by=lambda x: (x[0], x[1])))
def test_out_of_order_equals_brute_force(spark, rows):
    from quire.operators import sequence

    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = {(r["g"], r["o"], r["high"]) for r in sequence.out_of_order(df, ["g"], ["o"], "v", width=8).collect()}
    want = set()
    for g, o, v in rows:
        high = max((x for h, p, x in rows if h == g and p < o and x is not None), default=None)
        if v is not None and high is not None and v < high:
            want.add((g, o, high))
    assert got == want
