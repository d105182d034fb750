"""Standard column names, join keys, key quality and merges of dataset pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import fixed_values as fv
from sightline.functions.scalars import quoted, round_even, strict_name
from sightline.operators.profile import union_all

#: What is told of a merged pair: sizes of both joins, key quality, and facts of the merged rows.
FACTS = {
    "left_rows": "bigint", "right_rows": "bigint", "inner_rows": "bigint", "left_join_rows": "bigint",
    "left_unique_ratio": "double", "right_unique_ratio": "double",
    "merged_rows": "bigint", "null_cells": "bigint", "checksum": "bigint",
}
RESULT_SCHEMA = "dataset_pair string, status string, reason string, keys_used array<string>, " + ", ".join(
    f"{name} {kind}" for name, kind in FACTS.items()
)
#: The largest prime below 2^32: checksums are sums modulo this number.
CHECK_PRIME = 4294967291


def rename_table(clusters: DataFrame) -> DataFrame:
    """(variable, canonical) rows from concept clusters with a ``variables`` array."""
    return clusters.select(
        F.explode("variables").alias("variable"), F.col("concept_root").alias("canonical")
    )


def rename_map(rows: DataFrame) -> dict[str, str]:
    """The rename table as a mapping of normalised names; one entry per column name."""
    return {
        strict_name(r["variable"]): strict_name(r["canonical"])
        for r in rows.orderBy("canonical", "variable").collect()
    }


def standard_names(columns: Sequence[str], renames: dict[str, str]) -> list[str]:
    """New names; a name used before gets ``__dup1``, ``__dup2`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        name = renames.get(c, c)
        if name in seen:
            seen[name] += 1
            out.append(f"{name}__dup{seen[name]}")
        else:
            seen[name] = 0
            out.append(name)
    return out


def standardize(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    strict = [strict_name(c) for c in df.columns]
    return df.toDF(*standard_names(strict, renames))


def join_keys(
    left: DataFrame,
    right: DataFrame,
    declared: Sequence[str] = (),
    shared: Sequence[str] = (),
    renames: dict[str, str] | None = None,
    max_keys: int | None = None,
) -> list[str]:
    """Declared keys, else shared columns that look like keys, else shared columns.

    Names given before standardisation are mapped through ``renames``. Of shared
    columns all count, or the first ``max_keys``.
    """
    renames = renames or {}

    def usable(names: Sequence[str]) -> list[str]:
        mapped = [renames.get(strict_name(n), strict_name(n)) for n in names]
        return [n for n in dict.fromkeys(mapped) if n in left.columns and n in right.columns]

    if keys := usable(declared):
        return keys
    found = usable(shared)
    preferred = [k for k in found if k.endswith("_id") or k in fv.PREFERRED_KEYS]
    return (preferred or found)[:max_keys]


# ------------------------------------------------------------- key quality


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key value. A key that fills a third of the table is one row."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias(name))


def _null_free(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & quoted(k).isNotNull()
    return cond


def key_quality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null rows and share of distinct keys on each side; invalid if a side is empty."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return (
            key_counts(df, keys)
            .where(_null_free(keys))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_non_null_rows"),
                F.count("*").alias("_d"),
            )
            .select(
                f"{name}_non_null_rows",
                round_even(
                    F.col("_d") / F.greatest(f"{name}_non_null_rows", F.lit(1)), 4
                ).alias(f"{name}_unique_ratio"),
            )
        )

    a, b = side(left, "left"), side(right, "right")
    return a.select(
        "*",
        b.select("right_non_null_rows").scalar().alias("right_non_null_rows"),
        b.select("right_unique_ratio").scalar().alias("right_unique_ratio"),
    ).withColumn(
        "valid", (F.col("left_non_null_rows") > 0) & (F.col("right_non_null_rows") > 0)
    )


def _cell_text(df: DataFrame, name: str) -> Column:
    """Text of a cell; fractions in whole ten-thousandths, so that engines agree."""
    kind, cell = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        scaled = F.rint(cell.cast("double") * 10_000).try_cast("bigint").cast("string")
        return F.coalesce(scaled, cell.cast("string"))
    return cell.cast("string")


def _row_hash(df: DataFrame, names: Sequence[str]) -> Column:
    """32 bits of the MD5 of a row's cells in the order of their names."""
    cells = [F.coalesce(_cell_text(df, c), F.lit("\x1e")) for c in sorted(names)]
    digest = F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 8)
    return F.conv(digest, 16, 10).cast("decimal(10,0)")


def merge_facts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys_match: bool = False
) -> DataFrame:
    """One row of what merging gives, without merging: sizes, key quality, null cells and a checksum.

    Each side adds up its rows, null cells and row hashes per key, in one shuffle for both sides; what a key
    adds to the merged table follows from these sums, so a key that fills a third of both tables is one row.
    The facts are those of the inner join, or of the left join where no key matches. ``checksum`` is the sum
    of the hashes of both parts of every merged row, modulo ``CHECK_PRIME``. Empty sides give zeros and ratios
    of zero; ``valid`` tells whether both sides have a row without a missing key.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(0).cast("decimal(10,0)")
    rest = [c for c in right.columns if c not in keys]

    def side(df: DataFrame, names: Sequence[str], is_left: bool) -> DataFrame:
        nulls = sum((quoted(c).isNull().cast("bigint") for c in names), zero)
        own = [F.lit(1).cast("bigint"), nulls, _row_hash(df, names) if names else none]
        values = own + [zero, zero, none] if is_left else [zero, zero, none] + own
        fields = ("n", "z", "h", "m", "y", "g")
        keyed = [quoted(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
        return df.select(*keyed, *[v.alias(f) for v, f in zip(values, fields)])

    names = [f"_key_{i}" for i in range(len(keys))]
    both = side(left, left.columns, True).unionAll(side(right, rest, False))
    prime = F.lit(CHECK_PRIME).cast("decimal(10,0)")
    folded = lambda c: (c % prime).cast("decimal(10,0)")
    per_key = both.groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in ("n", "z", "m", "y")], *[folded(F.sum(c)).alias(c) for c in ("h", "g")]
    )
    there = _null_free(names)
    n, m, z = F.col("n"), F.col("partners"), F.col("z")
    met = m > 0
    times = lambda hashes, rows: hashes * folded(rows.cast("decimal(20,0)"))
    inner_hash = F.when(met, folded(times(F.col("h"), m) + times(F.col("g"), n))).otherwise(none)
    total = lambda c: F.coalesce(F.sum(c), zero)
    sums = per_key.withColumn("there", there).withColumn(
        "partners", F.col("m") if null_keys_match else F.when(F.col("there"), F.col("m")).otherwise(zero)
    ).agg(
        total("n").alias("left_rows"),
        total("m").alias("right_rows"),
        total(n * m).alias("inner_rows"),
        total(n * F.greatest(m, F.lit(1))).alias("left_join_rows"),
        total(F.when(met, z * m + F.col("y") * n)).alias("inner_nulls"),
        total(z).alias("left_nulls"),
        F.coalesce(F.sum(inner_hash), none).alias("inner_hash"),
        F.coalesce(F.sum("h"), none).alias("left_hash"),
        *[
            x.alias(f"{name}_{what}")
            for name, rows in (("left", n), ("right", F.col("m")))
            for what, x in (
                ("non_null", total(F.when(F.col("there"), rows))),
                ("keys", F.count_if(F.col("there") & (rows > 0))),
            )
        ],
    )
    inner = F.col("inner_rows") > 0
    ratio = lambda name: round_even(
        F.col(f"{name}_keys") / F.greatest(f"{name}_non_null", F.lit(1)), 4
    ).alias(f"{name}_unique_ratio")
    # Without a match the left join adds one null for every other column of the right side.
    padded = F.col("left_nulls") + F.col("left_rows") * len(rest)
    return sums.select(
        "left_rows", "right_rows", "inner_rows", "left_join_rows", ratio("left"), ratio("right"),
        F.when(inner, F.col("inner_rows")).otherwise(F.col("left_join_rows")).alias("merged_rows"),
        F.when(inner, F.col("inner_nulls")).otherwise(padded).alias("null_cells"),
        (F.when(inner, F.col("inner_hash")).otherwise(F.col("left_hash")) % prime).cast("bigint").alias("checksum"),
        ((F.col("left_non_null") > 0) & (F.col("right_non_null") > 0)).alias("valid"),
    )


def comparable(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every key has one type on both sides, or is a number or a time on both."""
    def family(kind: T.DataType) -> object:
        if isinstance(kind, T.NumericType):
            return "number"
        return "time" if isinstance(kind, (T.DateType, T.TimestampType)) else kind

    return all(family(left.schema[k].dataType) == family(right.schema[k].dataType) for k in keys)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys_match: bool) -> Column:
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(right[k]) if null_keys_match else left[k] == right[k]
        cond = one if cond is None else cond & one
    return cond


def join_sizes(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys_match: bool = False
) -> DataFrame:
    """Row counts of the inner and left join, from key counts and without joining rows."""
    a, b = key_counts(left, keys, "_l").alias("a"), key_counts(right, keys, "_r").alias("b")
    cond = None
    for k in keys:
        x, y = F.col(f"a.`{k}`"), F.col(f"b.`{k}`")
        one = x.eqNullSafe(y) if null_keys_match else x == y
        cond = one if cond is None else cond & one
    both = a.join(b, cond, "full")
    n_left, n_right = F.coalesce("_l", F.lit(0)), F.coalesce("_r", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        total(n_left).alias("left_rows"),
        total(n_right).alias("right_rows"),
        total(n_left * n_right).alias("inner_rows"),
        total(n_left * F.greatest(n_right, F.lit(1))).alias("left_join_rows"),
    )


# ------------------------------------------------------------------- merge


def merge_pair(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_name: str,
    right_name: str,
    how: str = "inner",
    null_keys_match: bool = False,
) -> DataFrame:
    """Join on all keys; other columns with the same name get ``__<dataset>``."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    tags = [strict_name(n.rsplit(".", 1)[0]) for n in (left_name, right_name)]
    a = left.withColumnsRenamed({c: f"{c}__{tags[0]}" for c in shared})
    b = right.withColumnsRenamed(
        {c: f"{c}__{tags[1]}" for c in shared} | {k: f"_key_{i}" for i, k in enumerate(keys)}
    )
    cond = None
    for i, k in enumerate(keys):
        x, y = quoted(k), F.col(f"_key_{i}")
        one = x.eqNullSafe(y) if null_keys_match else x == y
        cond = one if cond is None else cond & one
    return a.join(b, cond, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def merge_or_left(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_name: str = "left",
    right_name: str = "right",
    null_keys_match: bool = False,
) -> DataFrame:
    """Inner join, or the left join when no key matches.

    Whether a key matches is asked of the key columns alone, before any row joins.
    """
    a, b = key_counts(left, keys).drop("n"), key_counts(right, keys).drop("n")
    none = a.join(b, _same(a, b, keys, null_keys_match), "left_semi").isEmpty()
    how = "left" if none else "inner"
    return merge_pair(left, right, keys, left_name, right_name, how, null_keys_match)


def split_pair(pair: str) -> tuple[str, str] | None:
    parts = [p.strip() for p in str(pair).split("<->")]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def merge_readiness(actions: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Mark each merge action ready or for review: both datasets exist, action allows it."""
    sides = F.split("dataset_pair", " <-> ")
    known = F.get(sides, 0).isin(list(datasets)) & F.get(sides, 1).isin(list(datasets))
    return actions.withColumn(
        "readiness",
        F.when(
            known & F.col("recommended_action").isin(fv.MERGE_ACTIONS), "ready_to_test"
        ).otherwise("needs_review"),
    )


def merge_all(
    actions: DataFrame,
    datasets: dict[str, DataFrame],
    renames: dict[str, str] | None = None,
    null_keys_match: bool = False,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Run every ready merge action: a result table and the merged DataFrames.

    The action table has one row per dataset pair and is collected. The facts of all pairs come from one job,
    a row per pair; the merged tables stay lazy. A pair that cannot be merged gives a row with a reason and no
    table. If the job fails, the pairs are asked one by one, so that only the pair at fault is lost.
    """
    spark = actions.sparkSession
    results: list[tuple] = []
    ready: dict[str, tuple] = {}

    def failed(pair: str, reason: str, keys: list[str] | None = None) -> None:
        results.append((pair, "failed", reason, keys) + (None,) * len(FACTS))

    for action in actions.orderBy("dataset_pair").collect():
        pair = action["dataset_pair"]
        if action["recommended_action"] not in fv.MERGE_ACTIONS:
            continue
        names = split_pair(pair)
        if names is None:
            failed(pair, "The pair does not name two datasets.")
            continue
        left, right = (datasets.get(n) for n in names)
        if left is None or right is None:
            failed(pair, "A dataset of the pair is not there.")
            continue
        keys = join_keys(
            left, right, action["possible_join_keys"] or [], action["shared_columns"] or [], renames
        )
        if not keys:
            failed(pair, "The datasets share no key.")
        elif not comparable(left, right, keys):
            failed(pair, "A key has another type on the other side.", keys)
        else:
            ready[pair] = (left, right, keys, names)

    def ask(pairs: Sequence[str]) -> dict:
        facts = [
            merge_facts(*ready[p][:3], null_keys_match).select(F.lit(p).alias("dataset_pair"), "*") for p in pairs
        ]
        return {r["dataset_pair"]: r for r in union_all(facts).collect()}

    found: dict = {}
    try:
        found = ask(list(ready)) if ready else {}
    except PySparkException:
        for pair in ready:
            try:
                found |= ask([pair])
            except PySparkException as error:
                failed(pair, f"The merge stopped: {error.getCondition() or type(error).__name__}", ready[pair][2])
    merged: dict[str, DataFrame] = {}
    for pair, facts in found.items():
        left, right, keys, names = ready[pair]
        if not facts["valid"]:
            sizes = [facts[f] if f in ("left_rows", "right_rows") else None for f in FACTS]
            results.append((pair, "failed", "A side has no row with all keys.", keys, *sizes))
            continue
        results.append((pair, "merged", None, keys, *[facts[f] for f in FACTS]))
        how = "inner" if facts["inner_rows"] else "left"
        merged[pair] = merge_pair(left, right, keys, *names, how, null_keys_match)
    return spark.createDataFrame(results, RESULT_SCHEMA), merged
