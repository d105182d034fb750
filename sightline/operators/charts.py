"""The aggregate tables behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import as_number, as_timestamp, is_missing, quoted, strict_name
from sightline.operators.profile import numeric_columns, union_all, value_counts


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins from minimum to maximum; the last bin is closed.

    A constant column gets the range half a unit to either side.
    """
    values = df.select(as_number(df, column).alias("x")).where(F.col("x").isNotNull())
    limits = (
        values.agg(F.min("x").alias("a"), F.max("x").alias("b"))
        .withColumn("pad", F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0))
        .select(F.struct((F.col("a") - F.col("pad")).alias("lo"), (F.col("b") + F.col("pad")).alias("hi")))
        .scalar()
    )

    def edge(i: str) -> str:
        return f"CASE WHEN {i} >= {bins} THEN r.hi ELSE r.lo + ({i}) * ((r.hi - r.lo) / {bins}) END"

    # A value that rounding put next to its bin is moved by comparing the edges.
    placed = (
        values.withColumn("r", limits)
        .selectExpr(
            "x", "r", f"least(floor((x - r.lo) / (r.hi - r.lo) * {bins}), {bins - 1}L) AS g"
        )
        .selectExpr(
            f"g - CAST(x < {edge('g')} AS INT) "
            f"+ CAST(x >= {edge('g + 1')} AND g < {bins - 1} AS INT) AS bin"
        )
    )
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("r", limits)
    return frame.join(counts, "bin", "left").selectExpr(
        "bin",
        f"{edge('bin')} AS bin_from",
        f"{edge('bin + 1')} AS bin_to",
        "coalesce(count, 0L) AS count",
    )


@dataclass(frozen=True)
class Chart:
    """A chart of one column: ``histogram`` (equal bins), ``months`` or ``bars`` (the top values)."""

    column: str
    kind: str
    bins: int = 20
    top: int = 10


#: Parts that the values of a chart are ranked in first.
PARTS = 64


def fused_charts(df: DataFrame, charts: Sequence[Chart]) -> DataFrame:
    """Any number of charts of one dataset from two scans of it, or one without histograms.

    The first scan takes the limits of all histogram columns, which reach the second as one array; the
    second turns every row into a value per chart (a bin, a month or a text), counted by chart and value
    before anything is shuffled. Returns (chart, bin, label, bin_from, bin_to, count) with chart the place
    in ``charts``: all bins of a histogram whose column has numbers, the months present, and the most
    frequent texts, missing ones as 'nan'.
    """
    spark = df.sparkSession
    if not charts:
        return spark.createDataFrame([], "chart int, bin bigint, label string, bin_from double, bin_to double, count bigint")
    numbers = {c.column: f"_x{i}" for i, c in enumerate(charts) if c.kind == "histogram"}
    limits = None
    if numbers:
        bounds = [
            F.struct(F.min(as_number(df, c)).alias("a"), F.max(as_number(df, c)).alias("b")) for c in numbers
        ]
        pad = lambda r: F.when(r["a"] == r["b"], 0.5).otherwise(0.0)
        limits = df.agg(F.array(*bounds).alias("r")).select(
            F.transform("r", lambda r: F.struct((r["a"] - pad(r)).alias("lo"), (r["b"] + pad(r)).alias("hi"))).alias("r")
        )
    place = {column: i for i, column in enumerate(numbers)}

    # Values, then bins, then one cell per chart: each in a projection of its own and without lambdas, so that
    # all of it is compiled and nothing is worked out twice. Months are counted as numbers and spelled after.
    values = []
    for i, chart in enumerate(charts):
        if chart.kind == "histogram":
            value = as_number(df, chart.column)
        elif chart.kind == "months":
            value = F.unix_date(F.trunc(as_timestamp(df, chart.column).cast("date"), "MM")).cast("bigint")
        else:
            value = F.when(is_missing(df, chart.column), F.lit("nan")).otherwise(quoted(chart.column).cast("string"))
        values.append(value.alias(f"_v{i}"))
    wide = df.select(*values)
    if limits is not None:
        wide = wide.withColumn("_r", limits.scalar())
        places = {i: F.col("_r")[place[c.column]] for i, c in enumerate(charts) if c.kind == "histogram"}
        wide = wide.select("*", *[_bin_near(F.col(f"_v{i}"), r, charts[i].bins).alias(f"_g{i}") for i, r in places.items()])
        bins = [_bin_of(F.col(f"_v{i}"), F.col(f"_g{i}"), r, charts[i].bins).alias(f"_b{i}") for i, r in places.items()]
        wide = wide.select(*[f"_v{i}" for i in range(len(charts))], *bins)
    cells = []
    for i, chart in enumerate(charts):
        value = F.col(f"_v{i}")
        bin_ = F.col(f"_b{i}") if chart.kind == "histogram" else value if chart.kind == "months" else F.lit(None)
        label = value if chart.kind == "bars" else F.lit(None)
        cell = F.struct(F.lit(i).alias("chart"), bin_.cast("bigint").alias("bin"), label.cast("string").alias("label"))
        cells.append(F.when(value.isNotNull(), cell))
    counts = (
        wide.select(F.explode(F.array(*cells)).alias("v")).where("v IS NOT NULL")
        .groupBy("v.chart", "v.bin", "v.label").agg(F.count("*").alias("count"))
    )
    if months := [i for i, c in enumerate(charts) if c.kind == "months"]:
        monthly = F.col("chart").isin(months)
        month = F.date_format(F.date_from_unix_date(F.col("bin").cast("int")), "yyyy-MM")
        counts = counts.select(
            "chart", F.when(~monthly, F.col("bin")).alias("bin"), F.when(monthly, month).otherwise(F.col("label")).alias("label"), "count"
        )
    # The most frequent texts of a chart: first within parts of its values, so that no task sees them all.
    most = F.element_at(F.lit([c.top if c.kind == "bars" else 2**31 - 1 for c in charts]), F.col("chart") + 1)
    for keys in (["chart", "_part"], ["chart"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("count"), "label", "bin")
        counts = counts.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(PARTS)))
        counts = counts.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most).drop("_rank", "_part")
    none = F.lit(None).cast("double")
    if limits is None:
        return counts.select("chart", "bin", "label", none.alias("bin_from"), none.alias("bin_to"), "count")
    # A row per bin of every histogram whose column has numbers.
    kinds = spark.createDataFrame(
        [(i, c.bins, place[c.column]) for i, c in enumerate(charts) if c.kind == "histogram"], "chart int, bins int, place int"
    )
    frame = (
        kinds.withColumn("_r", limits.scalar()).withColumn("r", F.col("_r")[F.col("place")]).where(F.col("r.lo").isNotNull())
        .select("chart", "bins", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("bins") - 1).cast("bigint"))).alias("bin"))
    )
    edge = lambda at: F.when(at >= F.col("bins"), F.col("r.hi")).otherwise(
        F.col("r.lo") + at * ((F.col("r.hi") - F.col("r.lo")) / F.col("bins"))
    )
    return counts.join(frame, ["chart", "bin"], "full_outer").select(
        "chart", "bin", F.coalesce("label", F.lpad(F.col("bin").cast("string"), 2, "0")).alias("label"),
        edge(F.col("bin")).alias("bin_from"), edge(F.col("bin") + 1).alias("bin_to"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def _bin_near(x: Column, r: Column, bins: int) -> Column:
    """The bin of x, or one that rounding put next to it."""
    return F.least(F.floor((x - r["lo"]) / (r["hi"] - r["lo"]) * bins), F.lit(bins - 1).cast("bigint"))


def _bin_of(x: Column, guess: Column, r: Column, bins: int) -> Column:
    """The bin of x; a value that rounding put next to its bin is moved by comparing the edges."""
    step = (r["hi"] - r["lo"]) / bins
    edge = lambda i: F.when(i >= bins, r["hi"]).otherwise(r["lo"] + i * step)
    return (
        guess - F.when(x < edge(guess), 1).otherwise(0) + F.when((x >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    ).cast("bigint")


def default_histograms(df: DataFrame, max_columns: int | None = None, bins: int = 10) -> DataFrame:
    """Histograms of all numeric columns, or the first ``max_columns``, in one long table from two scans."""
    columns = numeric_columns(df)[:max_columns]
    data = fused_charts(df, [Chart(c, "histogram", bins) for c in columns])
    names = F.element_at(F.lit(columns or [""]), F.col("chart") + 1)
    return data.select(names.alias("column"), "bin", "bin_from", "bin_to", "count")


def category_bars(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column, n, count_missing=True)


def monthly_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per month present; missing and unparsable dates are left out."""
    month = F.date_format(as_timestamp(df, column), "yyyy-MM")
    return (
        df.select(month.alias("period"))
        .where(F.col("period").isNotNull())
        .groupBy("period")
        .agg(F.count("*").alias("count"))
        .orderBy("period")
    )


def scatter_pairs(
    df: DataFrame,
    a: str,
    b: str,
    keep: Sequence[str] = (),
    min_rows: int = 5,
) -> DataFrame:
    """Complete numeric pairs; nothing when there are fewer than ``min_rows``."""
    pairs = df.select(*keep, as_number(df, a).alias(a), as_number(df, b).alias(b)).dropna(
        subset=[a, b]
    )
    enough = pairs.agg(F.count("*")).scalar() >= min_rows
    return pairs.where(enough)


def scatter_sample(
    df: DataFrame, a: str, b: str, key: Sequence[str], n: int = 1000, seed: int = 42, min_rows: int = 5
) -> DataFrame:
    """A repeatable sample of ``n`` complete pairs: those with the smallest MD5 of seed and key.

    Each task keeps its ``n`` smallest and the driver side merges these, so nothing larger moves. A missing key
    counts as empty text; of equal hashes the smaller values come first. Fewer than ``min_rows`` pairs give
    nothing.
    """
    parts = [F.lit(str(seed)), *[F.coalesce(quoted(k).cast("string"), F.lit("")) for k in key]]
    pairs = scatter_pairs(df, a, b, key, min_rows).withColumn("_order", F.md5(F.concat_ws(":", *parts)))
    return pairs.orderBy("_order", quoted(a), quoted(b)).limit(n).drop("_order")


def scatter_grid(df: DataFrame, a: str, b: str, bins: int = 20, min_rows: int = 5) -> DataFrame:
    """Counts of complete pairs in ``bins`` x ``bins`` equal cells; empty cells are left out.

    Two scans: limits, then counts, of which at most ``bins`` squared leave a task. A constant column gets
    the range half a unit to either side. Fewer than ``min_rows`` pairs give nothing; infinite values count as missing.
    """
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    pairs = df.select(
        finite(as_number(df, a).cast("double")).alias("x"), finite(as_number(df, b).cast("double")).alias("y")
    ).dropna()
    limits = pairs.agg(
        *[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))], F.count("*").alias("n")
    )
    sides = [
        F.struct((F.col(f"{c}0") - pad).alias("lo"), (F.col(f"{c}1") + pad).alias("hi")).alias(c)
        for c in "xy"
        for pad in [F.when(F.col(f"{c}0") == F.col(f"{c}1"), 0.5).otherwise(0.0)]
    ]
    placed = pairs.withColumn("r", limits.select(F.struct(*sides, "n")).scalar()).where(F.col("r.n") >= min_rows)
    cell = {
        c: F.least(F.floor((F.col(c) - F.col(f"r.{c}.lo")) / (F.col(f"r.{c}.hi") - F.col(f"r.{c}.lo")) * bins), F.lit(bins - 1))
        for c in "xy"
    }
    edge = lambda c, i: F.col(f"r.{c}.lo") + i * ((F.col(f"r.{c}.hi") - F.col(f"r.{c}.lo")) / bins)
    return (
        placed.select("r", cell["x"].cast("int").alias("bin_a"), cell["y"].cast("int").alias("bin_b"))
        .groupBy("bin_a", "bin_b")
        .agg(F.count("*").alias("count"), F.first("r").alias("r"))
        .select("bin_a", "bin_b", edge("x", F.col("bin_a")).alias("a_from"), edge("y", F.col("bin_b")).alias("b_from"), "count")
    )


def chart_of(df: DataFrame, column: str, graph: str) -> Chart:
    """The chart that an action's graph type stands for; fails if the column cannot be drawn."""
    if graph == "time_series_line_chart":
        df.select(as_timestamp(df, column))
        return Chart(column, "months")
    if graph == "histogram_or_boxplot" or (graph == "relationship_plot" and column in numeric_columns(df)):
        df.select(as_number(df, column))
        return Chart(column, "histogram")
    df.select(quoted(column).cast("string"))
    return Chart(column, "bars")


def run_charts(
    actions: DataFrame,
    datasets: dict[str, DataFrame],
    preferred: dict[str, Sequence[str]] | None = None,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A status table and the long chart data for the chart actions.

    Actions are one row per variable and are collected. All charts of a dataset come from one pass of
    ``fused_charts``; both tables stay lazy, and the status reads the data. A ``limit`` leaves out the
    charts of the least important variables, with a status row each. A variable that is in no dataset, or
    whose column gives no data, is skipped with a reason and does not stop the others.
    """
    spark = actions.sparkSession
    status: list[tuple] = []
    by_dataset: dict[str, list[tuple[str, str, Chart]]] = {}
    rows = actions.orderBy(F.desc("importance_score"), "variable_name").collect()
    for place, r in enumerate(rows):
        variable, graph = r["variable_name"], r["recommended_graph"]
        if limit is not None and place >= limit:
            status.append((variable, None, graph, "skipped", f"The limit of {limit} charts was reached."))
            continue
        name = dataset_for(variable, datasets, (preferred or {}).get(variable, ()))
        if name is None:
            status.append((variable, None, graph, "skipped", "No dataset has a column of this name."))
            continue
        try:
            chart = chart_of(datasets[name], strict_name(variable), graph)
        except Exception as error:  # noqa: BLE001 - reported, the other charts go on
            status.append((variable, name, graph, "skipped", f"The column cannot be drawn: {error}"))
            continue
        status.append((variable, name, graph, "created", None))
        by_dataset.setdefault(name, []).append((variable, graph, chart))
    text = "variable_name string, dataset_name string, graph_type string"
    parts = [spark.createDataFrame([], text + ", label string, count bigint")]
    for name, wanted in by_dataset.items():
        made = spark.createDataFrame([(i, v, name, g) for i, (v, g, _) in enumerate(wanted)], "chart int, " + text)
        data = fused_charts(datasets[name], [c for _, _, c in wanted])
        parts.append(data.join(F.broadcast(made), "chart").select(*parts[0].columns))  # a row per chart
    charted = union_all(parts)
    table = spark.createDataFrame(status, text + ", status string, reason string")
    made = ["variable_name", "dataset_name", "graph_type"]
    drawn = charted.groupBy(*made).agg(F.sum("count").alias("_drawn"))
    empty = (F.col("status") == "created") & (F.coalesce("_drawn", F.lit(0)) == 0)
    table = table.join(drawn, made, "left").select(
        *made,
        F.when(empty, "skipped").otherwise(F.col("status")).alias("status"),
        F.when(empty, "The column has no values to draw.").otherwise(F.col("reason")).alias("reason"),
    )
    return table, charted


def dataset_for(
    variable: str, datasets: dict[str, DataFrame], preferred: Sequence[str] = ()
) -> str | None:
    """The dataset that holds a variable, preferred ones first."""
    column = strict_name(variable)
    for name in [*preferred, *datasets]:
        if name in datasets and column in datasets[name].columns:
            return name
    return None
