import datetime as dt

from pyspark.sql import functions as F

from sightline.functions.scalars import as_number, as_timestamp, strict_name
from sightline.operators import profile, roles


def column(df, name="v"):
    return [r[0] for r in df.select(name).collect()]


def test_numbers_held_as_text(spark):
    df = spark.createDataFrame([(x,) for x in ["12", " 12 ", "5d", "nan", "1e3", "abc", "", None, "-.5"]], "x string")
    got = column(df.select(as_number(df, "x").alias("v")))
    assert got == [12.0, 12.0, None, None, 1000.0, None, None, None, -0.5]


def test_date_spellings(spark):
    texts = ["2020-01-02", "2020-13-02", "1/2/2021", "Jan 5, 2020", "12", "Mon", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = column(df.select(as_timestamp(df, "x").alias("v")))
    assert got == [dt.datetime(2020, 1, 2), None, dt.datetime(2021, 1, 2), dt.datetime(2020, 1, 5), None, None, None]


def test_missing_counts_nan_and_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1.0, None), (1.0, None), (float("nan"), "a"), (float("nan"), "a"), (2.0, "b")], "a double, b string"
    )
    missing = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in profile.missing_values(df).collect()}
    assert missing == {"a": (2, 40.0), "b": (2, 40.0)}
    assert tuple(profile.duplicate_rows(df).first()) == (5, 2)


def test_describe_matches_hand_counts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    r = profile.describe_numeric(df).first()
    assert (r["count"], r["mean"], r["p25"], r["p50"], r["p75"]) == (4, 2.5, 1.75, 2.5, 3.25)
    assert abs(r["std"] - 1.2909944487358056) < 1e-12


def test_value_counts_variants(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 2), ("b", 1), ("nan", 1)]
    assert profile.value_counts(df, "x", count_missing=False, max_distinct=1).collect() == []


def test_roles_and_exclusions(spark):
    df = spark.range(200).select(
        F.col("id").alias("person_id"),
        F.col("id").alias("serial"),
        (F.col("id") % 2).alias("flag"),
        (F.col("id") % 7).alias("small"),
        (F.col("id") % 30).alias("big"),
        F.concat(F.lit("w"), F.col("id") % 4).alias("kind"),
        F.concat(F.lit("w"), F.col("id") % 60).alias("words"),
        F.concat(F.lit("w"), F.col("id") % 30).alias("between"),
        F.lit(3).alias("constant"),
        F.when(F.col("id") < 50, F.col("id") % 3).alias("sparse"),
        (2000 + F.col("id") % 9).alias("birth_year"),
        F.when(F.col("id") % 3 == 0, "2021-05-06").otherwise("unknown").alias("opened"),
        F.when(F.col("id") % 5 == 0, "2021-05-06").otherwise("unknown").alias("rarely"),
    )
    got = {r["column"]: (r["role"], r["exclusion_reason"]) for r in roles.column_roles(df).collect()}
    assert got == {
        "person_id": ("identifier", "identifier"), "serial": ("identifier", "identifier"),
        "flag": ("binary", None), "small": ("numeric_discrete", None), "big": ("numeric_continuous", None),
        "kind": ("categorical", None), "words": ("text", "text"), "between": ("text", "text"),
        "constant": ("numeric_discrete", "no_variation"), "sparse": ("numeric_discrete", "too_much_missingness"),
        "birth_year": ("year_like", None), "opened": ("time_like", None), "rarely": ("categorical", None),
    }


def test_nearly_unique_measures_can_be_kept(spark):
    df = spark.range(100).select((F.col("id") * 1.5).alias("amount"))
    assert roles.column_roles(df).first()["role"] == "identifier"
    kept = roles.column_roles(df, unique_ratio_rule="non_float").first()
    assert kept["role"] == "numeric_continuous"


def test_date_share_over_all_values(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 200, "x").otherwise("2020-01-01").alias("v"))
    found = roles.column_roles(df).where("column = 'v'").first()
    assert (found["sampled"], found["parsed"], found["role"]) == (400, 200, "time_like")


def test_strict_names():
    assert strict_name("  Zip Code (5) ") == "zip_code_5"


def test_duplicates_tell_equal_signatures_apart(spark):
    rows = [(i % 4, "x" if i % 3 else None, float(i % 2)) for i in range(60)] + [(9, "one", 0.5)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    want = (len(rows), len(rows) - len(set(rows)))
    assert tuple(profile.duplicate_rows(df).first()) == want
    for weak in (lambda keys: F.lit(1), lambda keys: F.pmod(F.xxhash64(*keys), F.lit(2))):
        assert tuple(profile.duplicate_rows(df, weak).first()) == want
    assert tuple(profile.duplicate_rows(df.distinct()).first()) == (len(set(rows)), 0)
    assert tuple(profile.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_merged_sketches_equal_the_whole(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("w"), F.col("id") % 300)).alias("word"),
        (F.col("id") % 2).alias("flag"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int") % 50).alias("day"),
    )
    parts = [roles.column_sketches(df.where(F.col("id") % 3 == i), "d") for i in range(3)]
    got = roles.merged_catalog(parts[0].union(parts[1]).union(parts[2])).orderBy("position").collect()
    want = roles.column_roles(df, "d").orderBy("position").collect()
    for a, b in zip(got, want, strict=True):
        assert all(a[c] == b[c] for c in ("column", "kind", "rows", "missing", "role", "usable", "exclusion_reason"))
        assert a["distinct"] == a["distinct_estimate"] == b["distinct_estimate"]
    # A column that one file does not have is missing in its rows.
    less = parts[0].where("column != 'k'").union(parts[1])
    row = next(r for r in roles.merged_catalog(less).collect() if r["column"] == "k")
    assert (row["rows"], row["missing"]) == (2000, 1000)
