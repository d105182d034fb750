"""Analysis of a column catalogue: importance, concepts, join and action advice.

The catalogue has one row per (dataset, column) and comes from ``column_roles``
over each dataset; findings come from relationship discovery. Both are small
next to the data, and every step here is a join or aggregation over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.scalars import round_even
from sightline.operators.profile import shared_columns, union_all
from sightline.operators.roles import catalog_roles


def build_catalog(datasets: dict[str, DataFrame], exact_distinct: bool = False) -> DataFrame:
    """Column catalogue of all datasets: one aggregation pass over each, side by side."""
    return catalog_roles(datasets, exact_distinct=exact_distinct)


def name_catalog(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, column) of all datasets: what join candidates need, without reading any data."""
    spark = next(iter(datasets.values())).sparkSession
    rows = [(name, column) for name, df in datasets.items() for column in df.columns]
    return spark.createDataFrame(rows, "dataset string, column string")


def name_clusters(names: DataFrame) -> DataFrame:
    """Columns of different names that share a concept, two or more; needs names only."""
    named = names.select(F.col("column").alias("variable"), concept_root(F.col("column")).alias("concept_root"))
    # One entry per column name of the collection.
    return (
        named.distinct().groupBy("concept_root")
        .agg(F.sort_array(F.collect_list("variable")).alias("variables"))
        .where(F.size("variables") >= 2)
    )


def concept_root(name: Column) -> Column:
    """Name without its suffix tokens, then the alias of what is left."""
    out = F.lower(F.trim(name))
    for token in fv.CONCEPT_SUFFIXES:
        out = F.replace(out, F.lit(token), F.lit(""))
    entries = [F.lit(x) for pair in fv.CONCEPT_ALIASES.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[out], out)


def importance_bucket(score: Column) -> Column:
    out = None
    for cutoff, label in fv.IMPORTANCE_BUCKETS:
        out = F.when(score >= cutoff, label) if out is None else out.when(score >= cutoff, label)
    return out.otherwise("low")


def _events(
    catalog: DataFrame,
    findings: DataFrame | None,
    features: Sequence[str],
    target: str | None,
    group: str | None,
) -> DataFrame:
    """Weighted mentions of variables: (variable, weight, what)."""
    number = F.col("kind") == "number"
    date = F.col("role").isin("time_like", "year_like")

    def event(what: str, weight: float, cond: Column | None = None) -> DataFrame:
        rows = catalog if cond is None else catalog.where(cond)
        return rows.select(
            F.col("column").alias("variable"),
            F.lit(float(weight)).alias("weight"),
            F.lit(what).alias("what"),
        )

    parts = [
        event("present", fv.WEIGHT_PRESENT),
        event("numeric", fv.WEIGHT_NUMERIC, number),
        event("categorical", fv.WEIGHT_CATEGORICAL, ~number),
        event("time", fv.WEIGHT_DATE, date),
    ]
    # A name that k datasets have is shared by k (k - 1) / 2 pairs.
    k = F.countDistinct("dataset")
    shared = catalog.groupBy(F.col("column").alias("variable")).agg((k * (k - 1) / 2).alias("pairs")).where("pairs > 0")
    parts.append(
        shared.select("variable", (F.col("pairs") * fv.WEIGHT_SHARED).alias("weight"), F.lit("shared").alias("what"))
    )
    if findings is not None:
        weight = F.lit(fv.WEIGHT_RELATIONSHIP) + F.least("score", F.lit(fv.RELATIONSHIP_SCORE_CAP))
        for side in ("column_a", "column_b"):
            parts.append(
                findings.select(
                    F.col(side).alias("variable"), weight.alias("weight"), F.lit("related").alias("what")
                )
            )
    named = [(f, fv.WEIGHT_FEATURE, "feature") for f in features]
    named += [(target, fv.WEIGHT_TARGET, "target")] if target else []
    named += [(group, fv.WEIGHT_GROUP, "group")] if group else []
    if named:
        parts.append(
            catalog.sparkSession.createDataFrame(named, "variable string, weight double, what string")
        )
    return union_all(parts)


def variable_importance(
    catalog: DataFrame,
    findings: DataFrame | None = None,
    features: Sequence[str] = (),
    target: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """Importance score, bucket, datasets, roles and uses of every variable."""
    has = lambda what: F.max(F.when(F.col("what") == what, True)).isNotNull()
    mentions = (
        _events(catalog, findings, features, target, group)
        .groupBy("variable")
        .agg(
            F.sum("weight").alias("_weight"),
            has("related").alias("in_relationships"),
            has("feature").alias("in_model_features"),
            has("target").alias("is_model_target"),
            has("group").alias("group_comparison_column"),
            has("shared").alias("is_shared"),
            has("time").alias("is_time_candidate"),
        )
    )
    role = F.when(F.col("kind") == "number", "numeric").otherwise("categorical")
    places = catalog.groupBy(F.col("column").alias("variable")).agg(
        F.sort_array(F.collect_set("dataset")).alias("datasets"),
        F.sort_array(F.collect_set(role)).alias("roles"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("dataset", "missing_percent")))
        ).alias("missing_by_dataset"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("dataset", "distinct_estimate")))
        ).alias("unique_estimate_by_dataset"),
        F.min("missing_percent").alias("min_missing"),
    )
    bonus = None
    for limit, weight in fv.WEIGHT_MISSING:
        cond = F.col("min_missing") <= limit
        bonus = F.when(cond, weight) if bonus is None else bonus.when(cond, weight)
    several = F.when(F.coalesce(F.size("datasets"), F.lit(0)) >= 2, fv.WEIGHT_SEVERAL_DATASETS)
    used = F.when(
        F.col("in_model_features") | F.col("is_model_target") | F.col("in_relationships"),
        fv.WEIGHT_USED,
    )
    score = F.col("_weight") + bonus.otherwise(0.0) + several.otherwise(0.0) + used.otherwise(0.0)
    out = (
        mentions.join(places, "variable", "left")
        .withColumn("importance_score", round_even(score, 2))
        .withColumn("importance_bucket", importance_bucket(F.col("importance_score")))
        .withColumn("concept_root", concept_root(F.col("variable")))
    )
    if findings is not None:
        out = out.join(_partners(findings), "variable", "left")
    return out.drop("_weight")


def _partners(findings: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.col("column_a").alias("variable"), F.col("column_b").alias("partner"), "comparison_type"),
        F.struct(F.col("column_b").alias("variable"), F.col("column_a").alias("partner"), "comparison_type"),
    )
    return (
        findings.select(F.inline(both))
        .groupBy("variable")
        .agg(
            F.sort_array(F.collect_set("partner")).alias("relationship_partners"),
            F.sort_array(F.collect_set("comparison_type")).alias("relationship_types"),
        )
    )


def concept_clusters(variables: DataFrame) -> DataFrame:
    """Variables that share a concept, most important first; two or more only."""
    entry = F.struct(
        (-F.col("importance_score")).alias("neg"),
        F.col("variable").alias("variable_name"),
        "importance_score",
        "datasets",
    )
    return (
        variables.groupBy("concept_root")
        .agg(F.sort_array(F.collect_list(entry)).alias("_members"))
        .withColumn("n_variables", F.size("_members"))
        .where(F.col("n_variables") >= 2)
        .select(
            "concept_root",
            "n_variables",
            F.transform("_members", lambda m: m["variable_name"]).alias("variables"),
            F.transform(
                "_members",
                lambda m: F.struct(m["variable_name"], m["importance_score"], m["datasets"]),
            ).alias("members"),
            F.format_string(
                fv.CLUSTER_ADVICE, "concept_root"
            ).alias("recommendation"),
        )
        .orderBy(F.desc("n_variables"), "concept_root")
    )


def join_candidates(catalog: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Dataset pairs with shared columns and how strong a join on them looks.

    ``declared`` may give ``possible_join_keys`` per (dataset_a, dataset_b).
    """
    pairs = shared_columns(catalog)
    if declared is not None:
        pairs = pairs.join(declared, ["dataset_a", "dataset_b"], "left")
    else:
        pairs = pairs.withColumn("possible_join_keys", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    pairs = pairs.withColumn("possible_join_keys", F.coalesce("possible_join_keys", none))
    strength = (
        F.when(F.size("possible_join_keys") > 0, "strong")
        .when(F.col("n_shared") >= 2, "moderate")
        .otherwise("weak")
    )
    rank = F.when(F.col("join_strength") == "strong", 2).when(
        F.col("join_strength") == "moderate", 1
    ).otherwise(0)
    columns = F.when(F.size("possible_join_keys") > 0, F.col("possible_join_keys")).otherwise(
        F.slice("shared_columns", 1, 3)
    )
    return (
        pairs.withColumn("join_strength", strength)
        .withColumn("dataset_pair", F.concat_ws(" <-> ", "dataset_a", "dataset_b"))
        .withColumn(
            "recommendation",
            F.format_string(
                fv.MERGE_ADVICE, "dataset_pair", F.array_join(columns, ", ")
            ),
        )
        .orderBy(rank.desc(), "dataset_pair")
    )


def _by_importance() -> list[Column]:
    return [F.desc("importance_score"), F.col("variable")]


def why_it_matters() -> Column:
    reasons = F.array_compact(
        F.array(
            F.when(F.col("is_model_target"), "it is the modeled outcome"),
            F.when(F.col("in_model_features"), "it is used in the likelihood model"),
            F.when(F.col("group_comparison_column"), "it is used in group comparisons"),
            F.when(F.col("in_relationships"), "it appears in strong discovered relationships"),
            F.when(F.size("datasets") >= 2, "it appears across multiple datasets"),
            F.when(F.col("is_shared"), "it may help connect files"),
        )
    )
    return F.when(
        F.size(reasons) == 0, "it appears repeatedly in the generated outputs"
    ).otherwise(F.array_join(reasons, "; "))


def top_variables(variables: DataFrame, n: int = fv.TOP_VARIABLES) -> DataFrame:
    return (
        variables.orderBy(*_by_importance())
        .limit(n)
        .withColumn("why_it_matters", why_it_matters())
    )


def priority_by_dataset(
    variables: DataFrame, n: int = fv.TOP_VARIABLES, per_dataset: int = fv.PRIORITY_PER_DATASET
) -> DataFrame:
    """The top variables that each dataset holds, ranked."""
    w = Window.partitionBy("dataset").orderBy(*_by_importance())
    return (
        top_variables(variables, n)
        .select("variable", "importance_score", F.explode("datasets").alias("dataset"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= per_dataset)
    )


# ----------------------------------------------------------------- actions


def feature_actions(variables: DataFrame, n: int = fv.TOP_FEATURE_ACTIONS) -> DataFrame:
    reasons = F.array_compact(
        F.array(
            F.when(F.col("in_model_features"), "already useful in modeling"),
            F.when(F.col("in_relationships"), "appears in strong discovered relationships"),
            F.when(F.size("datasets") >= 2, "appears in multiple datasets"),
            F.when(F.col("is_shared"), "may help connect files"),
        )
    )
    why = F.when(F.size(reasons) == 0, F.array(F.lit("high overall synthesis score"))).otherwise(
        reasons
    )
    return (
        variables.orderBy(*_by_importance())
        .limit(n)
        .select(
            F.col("variable").alias("variable_name"),
            "concept_root",
            F.col("importance_bucket").alias("priority"),
            "importance_score",
            F.lit("prioritize_for_feature_engineering").alias("recommended_action"),
            why.alias("why"),
        )
    )


def merge_actions(candidates: DataFrame) -> DataFrame:
    action = (
        F.when(F.col("join_strength") == "strong", "test_merge_first")
        .when(F.col("join_strength") == "moderate", "evaluate_merge_after_standardization")
        .otherwise("hold_for_manual_review")
    )
    return candidates.select(
        "dataset_pair", "shared_columns", "possible_join_keys", "join_strength",
        action.alias("recommended_action"),
    )


def standardization_actions(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "concept_root",
        "variables",
        F.lit("standardize_variable_names_and_meaning").alias("recommended_action"),
        F.lit(fv.CLUSTER_REASON).alias("reason"),
    )


def chart_actions(variables: DataFrame, n: int = fv.TOP_CHART_ACTIONS) -> DataFrame:
    graph = (
        F.when(F.col("is_time_candidate"), "time_series_line_chart")
        .when(F.array_contains("roles", "numeric"), "histogram_or_boxplot")
        .when(F.array_contains("roles", "categorical"), "bar_chart")
        .otherwise("relationship_plot")
    )
    return (
        variables.orderBy(*_by_importance())
        .limit(n)
        .select(
            F.col("variable").alias("variable_name"),
            "concept_root",
            graph.alias("recommended_graph"),
            F.col("importance_bucket").alias("priority"),
            "importance_score",
            "datasets",
        )
    )


def model_roles(
    variables: DataFrame,
    max_targets: int = fv.MAX_TARGET_ROLES,
    max_features: int = fv.MAX_FEATURE_ROLES,
) -> DataFrame:
    """Targets and features for the next model: (variable_name, model_role, rank).

    Without a modelled target, names that hold "target" or "outcome" stand in.
    The input has one row per variable name.
    """
    name = F.lower("variable")
    modelled = F.col("is_model_target")
    any_target = variables.agg(F.max(modelled)).scalar()
    target = F.when(any_target, modelled).otherwise(
        name.contains("target") | name.contains("outcome")
    )
    feature = ~modelled & (F.col("in_model_features") | F.col("in_relationships"))
    roles = F.array_compact(F.array(F.when(target, "target"), F.when(feature, "feature")))
    w = Window.partitionBy("model_role").orderBy(*_by_importance())
    limit = F.when(F.col("model_role") == "target", max_targets).otherwise(max_features)
    return (
        variables.select("variable", "importance_score", F.explode(roles).alias("model_role"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
        .select(F.col("variable").alias("variable_name"), "model_role", "rank")
    )


def action_rows(variables: DataFrame, candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """All actions in one long table: (action_type, subject, recommended_action)."""
    return union_all(
        [
            feature_actions(variables).select(
                F.lit("feature").alias("action_type"),
                F.col("variable_name").alias("subject"),
                "recommended_action",
            ),
            merge_actions(candidates).select(
                F.lit("merge").alias("action_type"),
                F.col("dataset_pair").alias("subject"),
                "recommended_action",
            ),
            standardization_actions(clusters).select(
                F.lit("standardize").alias("action_type"),
                F.col("concept_root").alias("subject"),
                "recommended_action",
            ),
            chart_actions(variables).select(
                F.lit("chart").alias("action_type"),
                F.col("variable_name").alias("subject"),
                F.col("recommended_graph").alias("recommended_action"),
            ),
            model_roles(variables).select(
                F.concat(F.lit("model_"), "model_role").alias("action_type"),
                F.col("variable_name").alias("subject"),
                F.lit("use_for_next_model_iteration").alias("recommended_action"),
            ),
        ]
    )


def run_summary(catalog: DataFrame, findings: DataFrame, model_facts: DataFrame | None = None) -> DataFrame:
    """One row of counts: datasets, columns, dataset pairs with shared names, findings.

    With ``model_facts`` (one row) its columns follow, named ``model_...``.
    """
    pairs = shared_columns(catalog).agg(F.count("*")).scalar()
    facts = []
    if model_facts is not None:
        row = model_facts.first()
        facts = [F.lit(row[f.name]).cast(f.dataType).alias(f"model_{f.name}") for f in model_facts.schema.fields]
    return catalog.agg(
        F.count_distinct("dataset").alias("datasets"),
        F.count("*").alias("columns"),
        pairs.alias("shared_pairs"),
        findings.agg(F.count("*")).scalar().alias("relationships"),
    ).select("*", *facts)
