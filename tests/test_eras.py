"""Era detection against a plain best-first segmenter in exact arithmetic."""

from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conceptstrata.operators import eras, pivotal


def segments(counts, max_eras):
    """[(first, last, mean)] of positions by repeatedly making the cut with the largest gain."""

    def best_cut(low, high):
        n, total = high - low, sum(counts[low:high])
        best = (Fraction(0), None)
        for cut in range(low + 1, high):
            left = sum(counts[low:cut])
            right = total - left
            gain = Fraction(left**2, cut - low) + Fraction(right**2, high - cut) - Fraction(total**2, n)
            if gain > best[0]:
                best = (gain, cut)
        return best

    parts = [(0, len(counts))]
    while len(parts) < max_eras:
        options = [(best_cut(*p), p) for p in parts]
        gain = max(o[0][0] for o in options)
        if gain == 0:
            break
        (_, cut), part = next(o for o in options if o[0][0] == gain)
        i = parts.index(part)
        parts[i : i + 1] = [(part[0], cut), (cut, part[1])]
    return [(a, b - 1, sum(counts[a:b]) / (b - a)) for a, b in parts]


def found(spark, series, max_eras):
    """{label: [(start, end, mean)]} from {label: {year: n}}."""
    rows = [(1, label, year, n) for label, counts in series.items() for year, n in counts.items() if n]
    counts = spark.createDataFrame(rows, "query_id bigint, cluster_label string, year int, n bigint")
    result = defaultdict(list)
    for r in eras.find_eras(counts, max_eras).orderBy("cluster_label", "era_no").collect():
        result[r.cluster_label].append((r.start, r.end, r.avg_count))
    return dict(result)


def test_long_quiet_start(spark):
    counts = [0] * 10 + [1] * 9 + [19, 20, 45, 64, 65]
    expected = [(2000, 2009, 0.0), (2010, 2018, 1.0), (2019, 2020, 19.5), (2021, 2021, 45.0), (2022, 2023, 64.5)]
    assert [(2000 + a, 2000 + b, m) for a, b, m in segments(counts, 5)] == expected
    # The series starts with its first paper, so the years without any before it are no era.
    got = found(spark, {"x": dict(enumerate(counts, 2000))}, 5)["x"]
    assert got == [(2010 + a, 2010 + b, m) for a, b, m in segments(counts[10:], 5)]


def test_edge_series(spark):
    got = found(
        spark,
        {
            "constant": {y: 4 for y in range(2000, 2010)},
            "two years": {2001: 1, 2002: 9},
            "single year": {2005: 7},
            "gap": {1990: 2, 2000: 2},
        },
        5,
    )
    assert got["constant"] == [(2000, 2009, 4.0)]
    assert got["two years"] == [(2001, 2001, 1.0), (2002, 2002, 9.0)]
    assert "single year" not in got
    assert got["gap"] == [(1990, 1990, 2.0), (1991, 1999, 0.0), (2000, 2000, 2.0)]


def test_one_era(spark):
    assert found(spark, {"x": {2000: 1, 2001: 5}}, 1) == {"x": [(2000, 2001, 3.0)]}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=25), min_size=30, max_size=40),
    st.integers(1, 10),
)
def test_equals_exact_segmenter(spark, many, max_eras):
    # Both ends are years with papers; distinct primes make coincidental ties of unequal cuts rare.
    series = {f"s{i}": [1, *counts, 2] for i, counts in enumerate(many)}
    got = found(spark, {k: dict(enumerate(c, 1980)) for k, c in series.items()}, max_eras)
    for label, counts in series.items():
        want = segments(counts, max_eras)
        mine = got[label]
        assert len(mine) == len(want) <= max_eras
        assert mine[0][0] == 1980 and mine[-1][1] == 1979 + len(counts)
        assert all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:]))

        def error(parts):
            return sum((counts[y] - m) ** 2 for a, b, m in parts for y in range(a, b + 1))

        assert error([(a - 1980, b - 1980, m) for a, b, m in mine]) == pytest.approx(error(want))


def test_error_never_rises_with_more_eras(spark):
    counts = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4]
    errors = []
    for n in range(1, 11):
        parts = found(spark, {"x": dict(enumerate(counts, 2000))}, n)["x"]
        errors.append(sum((counts[y - 2000] - m) ** 2 for a, b, m in parts for y in range(a, b + 1)))
    assert errors == sorted(errors, reverse=True)


def test_nested_keeps_empty_eras(spark):
    rows = [(1, "a", 0, y, f"p{y}", f"t{y}", float(y)) for y in (1990, 1990, 2000)]
    clusters = spark.createDataFrame(
        rows, "query_id bigint, cluster_label string, cluster int, year int, arxiv_id string, title string, score double"
    )
    found_eras = eras.find_eras(eras.yearly_counts(clusters), 5)
    papers = pivotal.pivotal_papers(clusters, found_eras, 1)
    nested = pivotal.nested_pivotal(found_eras, papers).first().eras
    assert [(e.period, [p.arxiv_id for p in e.papers]) for e in nested] == [
        ("1990-1990", ["p1990"]),
        ("1991-1999", []),
        ("2000-2000", ["p2000"]),
    ]


def test_equal_labels_merge(spark):
    rows = spark.createDataFrame(
        [(1, "same", 0), (1, "same", 2), (1, "other", 1)], "query_id bigint, cluster_label string, cluster int"
    )
    got = {r.cluster_label: (r.cluster, r.clusters_merged) for r in pivotal.merged_labels(rows).collect()}
    assert got == {"same": (0, 2), "other": (1, 1)}


def test_era_listing(spark):
    e = spark.createDataFrame([(1993, 2005, 1.64)], "start int, end int, avg_count double")
    row = eras.era_listing(e).first()
    assert (row.period, row.activity) == ("1993-2005", "1.6")
    assert e.select(F.lit(1)).count() == 1
