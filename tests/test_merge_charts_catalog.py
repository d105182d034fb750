import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import catalog, charts, merge


def test_null_keys_match_if_asked(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, v string")
    merged = merge.merge_or_left(left, right, ["k"], null_keys_match=True)
    got = sorted((r["k"] or 0, r["v__left"], r["v__right"]) for r in merged.collect())
    assert got == [(0, "b", "y"), (0, "b", "z"), (1, "a", "x")]
    assert merge.merge_or_left(left, right, ["k"]).count() == 1
    sizes = merge.join_sizes(left, right, ["k"], null_keys_match=True).first()
    assert (sizes["inner_rows"], sizes["left_join_rows"]) == (3, 4)
    sizes = merge.join_sizes(left, right, ["k"]).first()
    assert (sizes["inner_rows"], sizes["left_join_rows"]) == (1, 3)


def facts_of_rows(merged, left, right, keys):
    """Row count, null cells and checksum, from the merged rows one by one."""
    def text(value):
        if value is None:
            return "\x1e"
        return str(round(value * 10000)) if isinstance(value, float) else str(value)

    def hashed(cells):
        return int(hashlib.md5("\x1f".join(map(text, cells)).encode()).hexdigest()[:8], 16)

    rows, rest = merged.collect(), [c for c in right.columns if c not in keys]
    name = lambda c, tag: c if c in merged.columns else f"{c}__{tag}"
    total = sum(
        hashed([r[name(c, "a")] for c in sorted(left.columns)])
        + (0 if r["_met"] is None else hashed([r[name(c, "b")] for c in sorted(rest)]))
        for r in rows
    )
    nulls = sum(v is None for r in rows for c, v in r.asDict().items() if c != "_met")
    return len(rows), nulls, total % merge.CHECK_PRIME


@pytest.mark.parametrize("null_keys", [False, True])
@pytest.mark.parametrize("shift", [0, 1000])
def test_facts_equal_those_of_the_merged_rows(spark, null_keys, shift):
    """A hot key, missing keys, missing cells and clashing names; with the shift no key matches."""
    third = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 != 0, F.col("id") % 40)
    left = spark.range(300).select(
        third.alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") / 8).alias("v"), F.col("id").alias("n")
    )
    # Text tells which rows of the right side were met.
    right = spark.range(90).select(
        (third + shift).cast("int").alias("k"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("n"),
        F.concat(F.lit("r"), "id").alias("_met"),
    )
    if shift and null_keys:
        left, right = left.where("k is not null"), right.where("k is not null")
    got = merge.merge_facts(left, right, ["k"], null_keys).first()
    merged = merge.merge_or_left(left, right, ["k"], "a", "b", null_keys)
    rows, nulls, checksum = facts_of_rows(merged, left, right, ["k"])
    if shift:  # a left join without any match: the marker column is null throughout
        nulls += rows
        assert got["inner_rows"] == 0
    assert (got["merged_rows"], got["null_cells"], got["checksum"]) == (rows, nulls, checksum)
    sizes = merge.join_sizes(left, right, ["k"], null_keys).first()
    assert all(got[c] == sizes[c] for c in sizes.asDict())
    quality = merge.key_quality(left, right, ["k"]).first()
    assert all(got[c] == quality[c] for c in ("left_unique_ratio", "right_unique_ratio", "valid"))


def test_facts_of_empty_sides(spark):
    empty = spark.createDataFrame([], "k int, v string")
    got = merge.merge_facts(empty, empty, ["k"]).first()
    assert got["valid"] is False and (got["merged_rows"], got["null_cells"], got["checksum"]) == (0, 0, 0)


def test_one_failing_pair_leaves_the_others(spark):
    good = spark.createDataFrame([(1, "x")], "k int, v string")
    broken = good.select(F.raise_error(F.lit("unreadable")).cast("int").alias("k"), "v")
    other = spark.createDataFrame([("1", "x")], "k string, v string")
    none = spark.createDataFrame([(None, "x")], "k int, v string")
    names = {"a": good, "b": good, "broken": broken, "text": other, "none": none}
    actions = spark.createDataFrame(
        [(f"a <-> {n}", ["k"], [], "test_merge_first") for n in ("b", "broken", "text", "none")],
        "dataset_pair string, shared_columns array<string>, possible_join_keys array<string>, recommended_action string",
    )
    table, merged = merge.merge_all(actions, names)
    got = {r["dataset_pair"]: r for r in table.collect()}
    assert {p: r["status"] for p, r in got.items()} == {
        "a <-> b": "merged", "a <-> broken": "failed", "a <-> text": "failed", "a <-> none": "failed"
    }
    assert got["a <-> b"]["merged_rows"] == 1 and got["a <-> none"]["right_rows"] == 1
    assert list(merged) == ["a <-> b"]


def test_hot_and_missing_keys_make_no_row_pairs(spark):
    left = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id"
    )
    got = merge.merge_facts(left, left, ["k"]).first()
    assert got["inner_rows"] == got["merged_rows"] == 10000**2 + 10000
    assert got["left_join_rows"] == 10000**2 + 20000


def test_sizes_of_a_hot_key_need_no_join(spark):
    left = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    sizes = merge.join_sizes(left, left, ["k"]).first()
    assert sizes["inner_rows"] == 10000**2 + 20000


def test_falls_back_to_the_left_join(spark):
    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(2, "x")], "k int, w string")
    assert [tuple(r) for r in merge.merge_or_left(left, right, ["k"]).collect()] == [(1, "a", None)]


def test_names_and_keys(spark):
    assert merge.standard_names(["a", "b", "c", "d"], {"b": "a", "c": "a"}) == ["a", "a__dup1", "a__dup2", "d"]
    left = spark.createDataFrame([], "person_id int, year int, city string, age int")
    right = spark.createDataFrame([], "person_id int, year int, city string, age int")
    assert merge.join_keys(left, right, shared=["City", "Person Id", "year"]) == ["person_id", "year"]
    assert merge.join_keys(left, right, shared=["city"]) == ["city"]
    assert merge.join_keys(left, right, ["birth_year"], renames={"birth_year": "age"}) == ["age"]


def test_key_quality_without_rows(spark):
    left = spark.createDataFrame([(None,)], "k int")
    right = spark.createDataFrame([(1,), (1,)], "k int")
    assert merge.key_quality(left, right, ["k"]).first()["valid"] is False


def test_merge_all_reports_failures(spark):
    actions = spark.createDataFrame(
        [
            ("a <-> b", ["k"], [], "test_merge_first"),
            ("a <-> gone", ["k"], [], "test_merge_first"),
            ("no pair", ["k"], [], "test_merge_first"),
            ("a <-> c", ["zzz"], [], "evaluate_merge_after_standardization"),
            ("b <-> c", ["k"], [], "hold_for_manual_review"),
        ],
        "dataset_pair string, shared_columns array<string>, possible_join_keys array<string>, recommended_action string",
    )
    frame = spark.createDataFrame([(1, "x")], "k int, v string")
    table, merged = merge.merge_all(actions, {"a": frame, "b": frame, "c": frame})
    got = {r["dataset_pair"]: r["status"] for r in table.collect()}
    assert got == {"a <-> b": "merged", "a <-> gone": "failed", "no pair": "failed", "a <-> c": "failed"}
    assert list(merged) == ["a <-> b"]


@pytest.mark.parametrize("bins", [10, 20, 80])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(bins)
    values = np.concatenate([rng.normal(size=500).round(1), np.arange(0, 3, 0.1), [np.nan]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    want, edges = np.histogram(values[~np.isnan(values)], bins)
    got = charts.histogram(df, "x", bins).orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist()
    assert [r["bin_from"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    got = charts.histogram(df, "x", 10).orderBy("bin").collect()
    want, edges = np.histogram([3.0] * 4, 10)
    assert [r["count"] for r in got] == want.tolist() and got[0]["bin_from"] == 2.5


def test_scatter_needs_five_rows(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(4)], "a int, b string")
    assert charts.scatter_pairs(df, "a", "b").count() == 0
    assert charts.scatter_pairs(df.unionAll(df), "a", "b").count() == 8


def test_missing_chart_variable_does_not_stop_others(spark):
    actions = spark.createDataFrame(
        [("gone", "bar_chart", 2.0), ("x", "histogram_or_boxplot", 1.0)],
        "variable_name string, recommended_graph string, importance_score double",
    )
    status, data = charts.run_charts(actions, {"d": spark.range(50).select(F.col("id").alias("x"))})
    assert {r["variable_name"]: r["status"] for r in status.collect()} == {"gone": "skipped", "x": "created"}
    assert data.agg(F.sum("count")).first()[0] == 50


def test_empty_and_limited_charts_are_reported(spark):
    actions = spark.createDataFrame(
        [("words", "histogram_or_boxplot", 3.0), ("x", "histogram_or_boxplot", 2.0), ("y", "bar_chart", 1.0)],
        "variable_name string, recommended_graph string, importance_score double",
    )
    df = spark.range(9).select(F.col("id").alias("x"), F.lit("none").alias("words"), F.lit("k").alias("y"))
    status, data = charts.run_charts(actions, {"d": df}, limit=2)
    assert {r["variable_name"]: r["status"] for r in status.collect()} == {"words": "skipped", "x": "created", "y": "skipped"}
    assert {r["variable_name"] for r in data.collect()} == {"x"}
    assert {r["variable_name"] for r in charts.run_charts(actions, {"d": df})[1].collect()} == {"x", "y"}


def test_fused_charts_equal_single_ones(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 400
    rows = [
        (round(float(rng.normal()), 1) if i % 7 else None, int(rng.integers(5)), str(rng.integers(30)) if i % 5 else None,
         f"20{i % 23:02d}-{i % 12 + 1:02d}-11" if i % 9 else "n/a", float("nan") if i % 3 else 2.5)
        for i in range(n)
    ]
    spark.createDataFrame(rows, "x double, k int, word string, day string, same double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    asked = [
        charts.Chart("x", "histogram", 10), charts.Chart("x", "histogram", 7), charts.Chart("k", "bars", top=3), charts.Chart("word", "bars"),
        charts.Chart("day", "months"), charts.Chart("same", "histogram", 4), charts.Chart("word", "histogram", 5), charts.Chart("day", "bars", top=2),
        charts.Chart("day", "histogram"),
    ]
    got = charts.fused_charts(df, asked)
    by_chart = {i: [] for i in range(len(asked))}
    for r in got.collect():
        by_chart[r["chart"]].append(r)
    for i, c in enumerate(asked):
        mine = by_chart[i]
        if c.kind == "histogram":
            want = [r for r in charts.histogram(df, c.column, c.bins).orderBy("bin").collect() if r["bin_from"] is not None]
            mine.sort(key=lambda r: r["bin"])
            assert [(r["bin"], r["bin_from"], r["bin_to"], r["count"]) for r in mine] == [tuple(r) for r in want]
        elif c.kind == "months":
            assert sorted((r["label"], r["count"]) for r in mine) == sorted(map(tuple, charts.monthly_counts(df, c.column).collect()))
        else:
            assert sorted((r["label"], r["count"]) for r in mine) == sorted(map(tuple, charts.category_bars(df, c.column, c.top).collect()))
    # Beside the bins the plan has one scan; the other one takes the limits, one subquery used several times.
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert "ReusedSubquery" in got._jdf.queryExecution().executedPlan().toString()
    assert charts.fused_charts(df, []).collect() == []


def test_fused_charts_count_without_lambdas(spark):
    """A lambda is interpreted, and with it every bin and label that it is given."""
    df = spark.range(1000).select(
        (F.col("id") % 7).cast("double").alias("x"), F.date_add(F.lit("1999-11-30").cast("date"), (F.col("id") % 40).cast("int")).alias("day")
    )
    got = charts.fused_charts(df, [charts.Chart("x", "histogram", 7), charts.Chart("day", "months"), charts.Chart("day", "bars", top=1)])
    assert "filter(array(" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    assert sorted((r["label"], r["count"]) for r in rows if r["chart"] == 1) == [("1999-11", 25), ("1999-12", 775), ("2000-01", 200)]
    assert all(r["bin"] is None for r in rows if r["chart"] == 1)
    assert sorted(r["count"] for r in rows if r["chart"] == 0) == [142] + [143] * 6
    assert [(r["label"], r["count"]) for r in rows if r["chart"] == 2] == [("1999-11-30", 25)]


def test_concept_roots(spark):
    names = ["age_group", "employment_status", "unemployed", "social_determinant_score", "Zip_Code", "visit_count", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(catalog.concept_root(F.col("n"))).collect()]
    assert got == ["age", "employment", "employment", "social_determinants", "location", "visit", "other"]


def test_importance_adds_up(spark):
    frames = {
        "a": spark.range(100).select((F.col("id") % 9).alias("shared"), F.when(F.col("id") < 85, "x").alias("word")),
        "b": spark.range(100).select((F.col("id") % 9).alias("shared")),
    }
    found = {
        r["variable"]: r
        for r in catalog.variable_importance(catalog.build_catalog(frames), None, ["word"], "shared", None).collect()
    }
    # Two datasets, numeric in both, one shared pair, target, few missing, several, used.
    assert found["shared"]["importance_score"] == 2 * 1.5 + 1.25 + 4.0 + 1.0 + 2.0 + 0.5
    assert found["shared"]["importance_bucket"] == "high"
    assert found["word"]["importance_score"] == 1.25 + 2.5 + 0.5 + 0.5
    weak = catalog.join_candidates(catalog.build_catalog(frames)).first()
    assert weak["join_strength"] == "weak" and weak["dataset_pair"] == "a <-> b"


def test_scatter_grid_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=400), rng.exponential(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (float("inf"), 2.0)], "x double, y double")
    want, first, second = np.histogram2d(x, y, 8)
    got = charts.scatter_grid(df, "x", "y", 8).collect()
    assert {(r["bin_a"], r["bin_b"]): r["count"] for r in got} == {
        (i, j): int(n) for (i, j), n in np.ndenumerate(want) if n
    }
    assert all(abs(r["a_from"] - first[r["bin_a"]]) < 1e-9 and abs(r["b_from"] - second[r["bin_b"]]) < 1e-9 for r in got)
    same = spark.createDataFrame([(3.0, 4.0)] * 9, "x double, y double")
    assert [(r["bin_a"], r["bin_b"], r["count"]) for r in charts.scatter_grid(same, "x", "y", 4).collect()] == [(2, 2, 9)]
    assert charts.scatter_grid(same.limit(4), "x", "y").isEmpty()
    assert charts.scatter_grid(same.limit(0), "x", "y").isEmpty()


def test_scatter_sample_is_repeatable_and_bounded(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("y"))
    got = charts.scatter_sample(df, "x", "y", ["k"], 40).collect()
    again = charts.scatter_sample(df.repartition(7), "x", "y", ["k"], 40).collect()
    assert sorted(got) == sorted(again) and len(got) == 40 and all(r["y"] is not None for r in got)
    digest = lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()
    assert {r["k"] for r in got} == set(sorted(range(0, 300, 2), key=digest)[:40])
    assert charts.scatter_sample(df.limit(4), "x", "y", ["k"]).isEmpty()
