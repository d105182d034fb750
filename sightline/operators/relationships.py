"""Measures of association between columns, fused into few passes.

Correlations of many pairs share one aggregate. Group means and rates of all
category columns come from one grouping-sets pass whose output has one row per
category value; everything after that works on this small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.quantiles import exact_median
from sightline.functions.scalars import (
    ident,
    number_sql,
    quoted,
    round_even,
    sql_text,
    strength_label,
    timestamp_sql,
)
from sightline.operators.profile import rows_sql, unfold, union_all
from sightline.operators.roles import as_local_table, candidate_pairs, column_roles

PAIRS_PER_PASS = 200
COLUMNS_PER_TILE = 20
GROUP_TYPE = (
    "array<struct<group:string,mean:double,median:double,count:bigint,"
    "positive_cases:bigint,rate:double,percent_rate:double>>"
)
FINDING_FIELDS = [
    ("dataset", "string"), ("comparison_type", "string"), ("column_a", "string"),
    ("column_b", "string"), ("rows_used", "bigint"), ("score", "double"),
    ("effect_size", "double"), ("metric_name", "string"), ("metric_value", "double"),
    ("strength_label", "string"), ("direction", "string"), ("top_group", "string"),
    ("bottom_group", "string"), ("top_group_value", "double"),
    ("bottom_group_value", "double"), ("mean_when_0", "double"),
    ("mean_when_1", "double"), ("groups", GROUP_TYPE), ("narrative", "string"),
]

Pair = tuple[str, str]


def _as_findings(df: DataFrame, dataset: str) -> DataFrame:
    present = set(df.columns) | {"dataset"}
    df = df.withColumn("dataset", F.lit(dataset))
    return df.select(
        *[
            (F.col(n) if n in present else F.lit(None)).cast(t).alias(n)
            for n, t in FINDING_FIELDS
        ]
    )


# ----------------------------------------------------------- correlations


def _tiles(pairs: Sequence[Pair]) -> list[list[Pair]]:
    """Pairs in passes that share columns, so each pass scans few columns."""
    names = sorted({c for p in pairs for c in p})
    block = {c: i // COLUMNS_PER_TILE for i, c in enumerate(names)}
    ordered = sorted(pairs, key=lambda p: (block[p[0]], block[p[1]], p))
    return [ordered[i : i + PAIRS_PER_PASS] for i in range(0, len(ordered), PAIRS_PER_PASS)]


def _correlations(df: DataFrame, pairs: Sequence[Pair], left_sql) -> DataFrame:
    """Rows and Pearson correlation per pair over rows where both sides exist.

    The paired sums of squares are used instead of ``corr``, which fails on a
    constant column in ANSI mode.
    """
    def one_pass(some: list[Pair]) -> DataFrame:
        lefts = sorted({a for a, _ in some})
        rights = sorted({b for _, b in some})
        values = df.selectExpr(
            *[f"{left_sql(df, a)} AS a{i}" for i, a in enumerate(lefts)],
            *[f"{number_sql(df, b)} AS b{i}" for i, b in enumerate(rights)],
        )
        aggs, fields = [], {}
        for k, (a, b) in enumerate(some):
            x, y = f"a{lefts.index(a)}", f"b{rights.index(b)}"
            aggs += [
                f"regr_count({y}, {x}) AS n{k}",
                f"regr_sxx({y}, {x}) AS xx{k}",
                f"regr_syy({y}, {x}) AS yy{k}",
                f"regr_sxy({y}, {x}) AS xy{k}",
            ]
            fields[str(k)] = {
                "column_a": sql_text(a),
                "column_b": sql_text(b),
                "rows_used": f"n{k}",
                "r": f"try_divide(xy{k}, sqrt(xx{k}) * sqrt(yy{k}))",
            }
        return unfold(values.agg(*[F.expr(e) for e in aggs]), fields, "_pair").drop("_pair")

    return union_all([one_pass(t) for t in _tiles(pairs)])


def _correlation_findings(
    measured: DataFrame,
    dataset: str,
    comparison: str,
    metric: str,
    up_down: tuple[str, str],
    narrative,
    min_score: float,
    min_rows: int,
) -> DataFrame:
    strength = F.abs("r")
    kept = measured.where((F.col("rows_used") >= min_rows) & (strength >= min_score)).withColumns(
        {
            "comparison_type": F.lit(comparison),
            "score": round_even(strength, 4),
            "effect_size": round_even(strength, 4),
            "metric_name": F.lit(metric),
            "metric_value": round_even(F.col("r"), 4),
            "strength_label": strength_label(strength),
            "direction": F.when(F.col("r") > 0, up_down[0]).otherwise(up_down[1]),
        }
    )
    return _as_findings(kept.withColumn("narrative", narrative()), dataset)


def numeric_numeric(
    df: DataFrame,
    pairs: Sequence[Pair],
    dataset: str = "data",
    min_score: float = fv.MIN_CORRELATION,
    min_rows: int = fv.MIN_ROWS,
) -> DataFrame:
    """Pearson correlation of two numeric columns."""
    def narrative() -> Column:
        return F.format_string(
            "`%s` and `%s` show a %s %s linear association (correlation = %.3f, n = %d).",
            "column_a", "column_b", "strength_label", "direction", "r", "rows_used",
        )

    return _correlation_findings(
        _correlations(df, pairs, number_sql), dataset, "numeric_vs_numeric",
        "pearson_correlation", ("positive", "negative"), narrative, min_score, min_rows,
    )


def time_sql(df: DataFrame, name: str) -> str:
    """Year number, or days since 1970."""
    if "year" in name.lower():
        return number_sql(df, name)
    return f"CAST(unix_date(CAST({timestamp_sql(df, name)} AS DATE)) AS DOUBLE)"


def time_numeric(
    df: DataFrame,
    pairs: Sequence[Pair],
    dataset: str = "data",
    min_score: float = fv.MIN_CORRELATION,
    min_rows: int = fv.MIN_ROWS,
) -> DataFrame:
    """Correlation of a year or day number with a numeric column; unparsable dates drop."""
    def narrative() -> Column:
        return F.format_string(
            "`%s` shows a %s tendency to %s over `%s` (correlation = %.3f, n = %d).",
            "column_b", "strength_label", "direction", "column_a", "r", "rows_used",
        )

    return _correlation_findings(
        _correlations(df, pairs, time_sql), dataset, "time_vs_numeric",
        "time_correlation", ("increase", "decrease"), narrative, min_score, min_rows,
    )


# ------------------------------------------------------------ group moments


def group_moments(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Count, mean and centred sum of squares of every value column in every group.

    One grouping-sets pass; long result: ``by``, ``group``, ``value``, ``n``,
    ``mean``, ``m2``, ``binary`` (no value but 0 and 1). Rows without a group are left out.
    """
    keys = [F.col(f"g{i}") for i in range(len(by))]
    narrow = df.selectExpr(
        *[f"{ident(c)} AS g{i}" for i, c in enumerate(by)],
        *[f"{number_sql(df, c)} AS v{j}" for j, c in enumerate(values)],
    )
    sums = narrow.groupingSets([[k] for k in keys], *keys).agg(
        *[F.expr(f"grouping(g{i}) AS away{i}") for i in range(len(by))],
        *[
            F.expr(f"{fn}(v{j}) AS {name}{j}")
            for j in range(len(values))
            for name, fn in (("n", "count"), ("a", "avg"), ("p", "var_pop"))
        ],
        *[F.expr(f"bool_and(v{j} IN (0D, 1D)) AS b{j}") for j in range(len(values))],
    )
    which = " ".join(f"WHEN away{i} = 0 THEN {sql_text(c)}" for i, c in enumerate(by))
    group = " ".join(f"WHEN away{i} = 0 THEN CAST(g{i} AS STRING)" for i in range(len(by)))
    rows = [
        {"value": sql_text(c), "n": f"n{j}", "mean": f"a{j}", "m2": f"p{j} * n{j}", "binary": f"b{j}"}
        for j, c in enumerate(values)
    ]
    named = sums.selectExpr(f"CASE {which} END AS by", f"CASE {group} END AS group", "*")
    return (
        named.where("group IS NOT NULL")
        .selectExpr("by", "group", rows_sql(rows))
        .where("n > 0")
    )


def _with_totals(moments: DataFrame) -> DataFrame:
    """Add the row count and standard deviation over all groups of a pair."""
    w = Window.partitionBy("by", "value")
    total = F.sum("n").over(w)
    centre = F.sum(F.col("n") * F.col("mean")).over(w) / total
    both = moments.withColumn("total", total).withColumn("_centre", centre)
    spread = F.sum(
        F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_centre"), F.lit(2.0))
    ).over(w)
    return both.withColumn(
        "std", F.sqrt(F.try_divide(spread, F.col("total") - 1))
    ).drop("_centre")


def _only_pairs(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Keep the asked pairs; the list comes from column names, not from rows."""
    wanted: dict[str, list[str]] = {}
    for a, b in pairs:
        wanted.setdefault(a, []).append(b)
    cond = F.lit(False)
    for a, bs in wanted.items():
        cond = cond | ((F.col("by") == a) & F.col("value").isin(*bs))
    return df.where(cond)


def _best_and_worst(groups: DataFrame) -> DataFrame:
    """Highest and lowest mean per pair; ties go to the first group name."""
    high = F.min(F.struct((-F.col("mean")).alias("neg"), F.col("group")))
    low = F.min(F.struct(F.col("mean").alias("mean"), F.col("group")))
    rows = F.sort_array(F.collect_list(F.struct("group", "mean", "n")))
    return groups.groupBy("by", "value").agg(
        F.count("*").alias("n_groups"),
        F.first("total").alias("rows_used"),
        F.first("std").alias("std"),
        high.alias("high"),
        low.alias("low"),
        rows.alias("rows"),
    ).select(
        F.col("by").alias("column_a"),
        F.col("value").alias("column_b"),
        "n_groups", "rows_used", "std", "rows",
        F.col("high.group").alias("top_group"),
        (-F.col("high.neg")).alias("top_mean"),
        F.col("low.group").alias("bottom_group"),
        F.col("low.mean").alias("bottom_mean"),
    )


def category_numeric_effects(moments: DataFrame, min_group: int = fv.MIN_GROUP_ROWS) -> DataFrame:
    """Normalised mean difference per pair, before thresholds.

    Small groups do not compete but their rows count for the deviation.
    """
    groups = _with_totals(moments).where(F.col("n") >= min_group)
    gap = F.col("top_mean") - F.col("bottom_mean")
    return _best_and_worst(groups).withColumn("effect", F.try_divide(F.abs(gap), F.col("std")))


def categorical_numeric(
    df: DataFrame,
    pairs: Sequence[Pair],
    dataset: str = "data",
    min_score: float = fv.MIN_MEAN_DIFFERENCE,
    min_rows: int = fv.MIN_ROWS,
    moments: DataFrame | None = None,
    medians: bool = True,
) -> DataFrame:
    """Difference of group means in units of the standard deviation.

    Group medians are computed in a second pass, for retained pairs only.
    """
    if moments is None:
        moments = group_moments(df, sorted({a for a, _ in pairs}), sorted({b for _, b in pairs}))
    effects = category_numeric_effects(_only_pairs(moments, pairs))
    kept = effects.where(
        (F.col("rows_used") >= min_rows) & (F.col("n_groups") >= 2) & (F.col("effect") >= min_score)
    )
    if medians:
        kept = _add_medians(df, kept)
    else:
        kept = kept.withColumn("medians", F.lit(None).cast("map<string,double>"))
    found = kept.withColumns(
        {
            "comparison_type": F.lit("categorical_vs_numeric"),
            "score": round_even(F.col("effect"), 4),
            "effect_size": round_even(F.col("effect"), 4),
            "metric_name": F.lit("normalized_mean_difference"),
            "metric_value": round_even(F.col("effect"), 4),
            "top_group_value": round_even(F.col("top_mean"), 4),
            "bottom_group_value": round_even(F.col("bottom_mean"), 4),
            "groups": F.transform(
                "rows",
                lambda g: F.struct(
                    g["group"].alias("group"),
                    g["mean"].alias("mean"),
                    F.col("medians")[g["group"]].alias("median"),
                    g["n"].alias("count"),
                    F.lit(None).cast("bigint").alias("positive_cases"),
                    F.lit(None).cast("double").alias("rate"),
                    F.lit(None).cast("double").alias("percent_rate"),
                ),
            ),
            "narrative": F.format_string(
                "`%s` differs across `%s` groups. The highest average appears in `%s` (%.3f) "
                "and the lowest in `%s` (%.3f), with a normalized difference of %.3f.",
                "column_b", "column_a", "top_group", "top_mean", "bottom_group",
                "bottom_mean", "effect",
            ),
        }
    )
    return _as_findings(found, dataset)


def _add_medians(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Exact group medians as a map, for the pairs in ``kept``.

    ``kept``, at most one row per column pair, is collected first: it says which values are unfolded, so
    that rows are multiplied by the pairs kept and not by all pairs.
    """
    kept = as_local_table(kept)
    numbered = {(r["column_a"], r["column_b"]): i for i, r in enumerate(kept.select("column_a", "column_b").collect())}
    if not numbered:
        return kept.withColumn("medians", F.lit(None).cast("map<string,double>"))
    rows = [
        {"pair": str(i), "group": f"CAST({ident(a)} AS STRING)", "x": number_sql(df, b)}
        for (a, b), i in numbered.items()
    ]
    names = df.sparkSession.createDataFrame([(i, a, b) for (a, b), i in numbered.items()], "pair int, column_a string, column_b string")
    medians = (
        exact_median(df.selectExpr(rows_sql(rows)), "x", ["pair", "group"])
        .groupBy("pair")
        .agg(F.map_from_entries(F.collect_list(F.struct("group", "median"))).alias("medians"))
    )
    return kept.join(names, ["column_a", "column_b"]).join(medians, "pair", "left").drop("pair")


def categorical_binary(
    df: DataFrame,
    pairs: Sequence[Pair],
    dataset: str = "data",
    min_score: float = fv.MIN_RATE_DIFFERENCE,
    min_rows: int = fv.MIN_ROWS,
    moments: DataFrame | None = None,
    min_group: int = fv.MIN_GROUP_ROWS,
) -> DataFrame:
    """Difference between the highest and lowest rate of a 0/1 column; none if it holds other values."""
    if moments is None:
        moments = group_moments(df, sorted({a for a, _ in pairs}), sorted({b for _, b in pairs}))
    binary = F.bool_and("binary").over(Window.partitionBy("by", "value"))
    groups = _with_totals(_only_pairs(moments, pairs)).withColumn("binary", binary)
    groups = groups.where(F.col("binary") & (F.col("n") >= min_group))
    gap = F.col("top_mean") - F.col("bottom_mean")
    kept = _best_and_worst(groups).withColumn("gap", gap).where(
        (F.col("rows_used") >= min_rows) & (F.col("n_groups") >= 2) & (F.col("gap") >= min_score)
    )
    found = kept.withColumns(
        {
            "comparison_type": F.lit("categorical_vs_binary"),
            "score": round_even(F.col("gap"), 4),
            "effect_size": round_even(F.col("gap"), 4),
            "metric_name": F.lit("rate_difference"),
            "metric_value": round_even(F.col("gap"), 4),
            "top_group_value": round_even(F.col("top_mean"), 4),
            "bottom_group_value": round_even(F.col("bottom_mean"), 4),
            "groups": F.transform(
                "rows",
                lambda g: F.struct(
                    g["group"].alias("group"),
                    F.lit(None).cast("double").alias("mean"),
                    F.lit(None).cast("double").alias("median"),
                    g["n"].alias("count"),
                    F.rint(g["mean"] * g["n"]).cast("bigint").alias("positive_cases"),
                    round_even(g["mean"], 4).alias("rate"),
                    round_even(g["mean"] * 100, 2).alias("percent_rate"),
                ),
            ),
            "narrative": F.format_string(
                "The observed rate of `%s` varies across `%s` groups. `%s` has the highest "
                "observed rate (%.2f%%), while `%s` has the lowest (%.2f%%).",
                "column_b", "column_a", "top_group", F.col("top_mean") * 100,
                "bottom_group", F.col("bottom_mean") * 100,
            ),
        }
    )
    return _as_findings(found, dataset)


def binary_numeric(
    df: DataFrame,
    pairs: Sequence[Pair],
    dataset: str = "data",
    min_score: float = fv.MIN_MEAN_DIFFERENCE,
    min_rows: int = fv.MIN_ROWS,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Mean difference between 1 and 0 in units of the standard deviation.

    A boolean column counts as 0/1; one that holds other values gives no finding.
    """
    if moments is None:
        moments = group_moments(df, sorted({a for a, _ in pairs}), sorted({b for _, b in pairs}))
    flags = [c for c, dtype in df.dtypes if dtype == "boolean"]
    side = F.when(F.col("by").isin(flags), (F.col("group") == "true").cast("double")).otherwise(
        F.col("group").try_cast("double")
    )
    sides = _with_totals(_only_pairs(moments, pairs)).withColumn("side", side)

    def mean_of(side: int) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("mean")))

    measured = sides.groupBy(F.col("by").alias("column_a"), F.col("value").alias("column_b")).agg(
        F.first("total").alias("rows_used"),
        F.first("std").alias("std"),
        mean_of(0).alias("mean_0"),
        mean_of(1).alias("mean_1"),
        F.bool_and(F.coalesce(F.col("side").isin(0.0, 1.0), F.lit(False))).alias("binary"),
    )
    effect = F.try_divide(F.abs(F.col("mean_1") - F.col("mean_0")), F.col("std"))
    kept = measured.where("binary").withColumn("effect", effect).where(
        (F.col("rows_used") >= min_rows) & (F.col("effect") >= min_score)
    )
    direction = F.when(F.col("mean_1") > F.col("mean_0"), "higher").otherwise("lower")
    found = kept.withColumns(
        {
            "comparison_type": F.lit("binary_vs_numeric"),
            "score": round_even(F.col("effect"), 4),
            "effect_size": round_even(F.col("effect"), 4),
            "metric_name": F.lit("normalized_mean_difference"),
            "metric_value": round_even(F.col("effect"), 4),
            "mean_when_0": round_even(F.col("mean_0"), 4),
            "mean_when_1": round_even(F.col("mean_1"), 4),
            "direction": direction,
            "narrative": F.format_string(
                "`%s` is %s on average when `%s` = 1 than when `%s` = 0 (means: %.3f vs %.3f).",
                F.col("column_b"), direction, F.col("column_a"), F.col("column_a"),
                F.col("mean_1"), F.col("mean_0"),
            ),
        }
    )
    return _as_findings(found, dataset)


# ---------------------------------------------------------------- discovery


def discover(
    df: DataFrame,
    dataset: str = "data",
    roles: DataFrame | None = None,
    unique_ratio_rule: str = "all",
    medians: bool = True,
) -> DataFrame:
    """All retained relationships of a dataset.

    The role and pair tables are collected: one row per column or column pair.
    ``medians=False`` saves the second pass, which only fills the group medians.
    """
    if roles is None:
        roles = column_roles(df, dataset, unique_ratio_rule=unique_ratio_rule)
    return findings_of(df, dataset, typed_pairs(roles), medians)


def findings_of(
    df: DataFrame, dataset: str, by_method: dict[str, list[Pair]], medians: bool = True
) -> DataFrame:
    grouped = [
        p
        for m in ("categorical_numeric", "categorical_binary", "binary_numeric")
        for p in by_method.get(m, [])
    ]
    moments = (
        group_moments(df, sorted({a for a, _ in grouped}), sorted({b for _, b in grouped}))
        if grouped
        else None
    )
    found = []
    if pairs := by_method.get("numeric_numeric"):
        found.append(numeric_numeric(df, sorted(pairs), dataset))
    if pairs := by_method.get("time_numeric"):
        found.append(time_numeric(df, sorted(pairs), dataset))
    if pairs := by_method.get("categorical_numeric"):
        found.append(
            categorical_numeric(df, sorted(pairs), dataset, moments=moments, medians=medians)
        )
    if pairs := by_method.get("categorical_binary"):
        found.append(categorical_binary(df, sorted(pairs), dataset, moments=moments))
    if pairs := by_method.get("binary_numeric"):
        found.append(binary_numeric(df, sorted(pairs), dataset, moments=moments))
    if not found:
        schema = ", ".join(f"{n} {t}" for n, t in FINDING_FIELDS)
        return df.sparkSession.createDataFrame([], schema)
    return union_all(found)


STATUS_SCHEMA = "dataset string, method string, column_a string, column_b string, status string, reason string"


def _reason(error: PySparkException) -> str:
    return error.getCondition() or type(error).__name__


def faulty_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Columns that cannot be read, with the reason.

    Halves that read without a fault are done with, so f faulty ones of c columns cost about f log c scans.
    """
    missing = {c: "The column is not there." for c in columns if c not in df.columns}
    there = [c for c in columns if c not in missing]
    if not there:
        return missing
    try:
        df.agg(*[F.max(F.xxhash64(quoted(c))).alias(f"_{i}") for i, c in enumerate(there)]).collect()
        return missing
    except PySparkException as error:
        if len(there) == 1:
            return missing | {there[0]: _reason(error)}
    half = len(there) // 2
    return missing | faulty_columns(df, there[:half]) | faulty_columns(df, there[half:])


def findings_with_status(
    df: DataFrame, dataset: str, by_method: dict[str, list[Pair]], medians: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Findings, and one row per pair: ``retained``, ``not_retained`` or ``failed`` with a reason.

    All pairs share the passes of ``findings_of``. Only when these fail are the columns at fault looked for;
    their pairs are set aside and the rest runs again together, halved as long as a pair still fails. Findings
    are collected: one row per pair at most.
    """
    pairs = [(m, a, b) for m, some in sorted(by_method.items()) for a, b in sorted(some)]
    failed: dict[tuple[str, str, str], str] = {}

    def measured(some: list[tuple[str, str, str]]) -> list[DataFrame]:
        grouped: dict[str, list[Pair]] = {}
        for m, a, b in some:
            grouped.setdefault(m, []).append((a, b))
        return [as_local_table(findings_of(df, dataset, grouped, medians))]

    def halved(some: list[tuple[str, str, str]]) -> list[DataFrame]:
        if not some:
            return []
        try:
            return measured(some)
        except PySparkException as error:
            if len(some) == 1:
                failed[some[0]] = _reason(error)
                return []
        half = len(some) // 2
        return halved(some[:half]) + halved(some[half:])

    try:
        parts = measured(pairs)
    except PySparkException:
        bad = faulty_columns(df, sorted({c for _, a, b in pairs for c in (a, b)}))
        failed |= {p: bad.get(p[1], bad.get(p[2])) for p in pairs if p[1] in bad or p[2] in bad}
        parts = halved([p for p in pairs if p not in failed]) or [findings_of(df, dataset, {})]
    findings = union_all(parts)
    kept = {(r[0], r[1], r[2]) for r in findings.select("comparison_type", "column_a", "column_b").collect()}
    rows = [
        (
            dataset, m, a, b,
            "failed" if (m, a, b) in failed
            else "retained" if (m.replace("_", "_vs_"), a, b) in kept
            else "not_retained",
            failed.get((m, a, b)),
        )
        for m, a, b in pairs
    ]
    return findings, df.sparkSession.createDataFrame(rows, STATUS_SCHEMA)


def typed_pairs(roles: DataFrame) -> dict[str, list[Pair]]:
    """The candidate pairs of one dataset by method; collected, one row per pair."""
    by_method: dict[str, list[Pair]] = {}
    for r in candidate_pairs(roles).collect():
        by_method.setdefault(r["method"], []).append((r["column_a"], r["column_b"]))
    return by_method


def _ranking() -> list[Column]:
    return [F.desc("score"), F.col("column_a"), F.col("column_b")]


def top_relationships(findings: DataFrame, n: int = fv.TOP_PER_DATASET) -> DataFrame:
    return findings.orderBy(*_ranking()).limit(n)


def top_overall(findings: DataFrame, n: int = fv.TOP_OVERALL) -> DataFrame:
    return findings.orderBy(F.desc("score"), "dataset", "column_a", "column_b").limit(n)


def top_by_type(findings: DataFrame, n: int = fv.TOP_PER_TYPE) -> DataFrame:
    """The strongest findings of each dataset and type. Input: one row per pair."""
    w = Window.partitionBy("dataset", "comparison_type").orderBy(*_ranking())
    return findings.withColumn("rank_in_type", F.row_number().over(w)).where(
        F.col("rank_in_type") <= n
    )
