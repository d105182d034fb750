"""From a column catalogue to advice, standard names, merges and chart tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sightline.operators import catalog, charts, merge
from sightline.operators.roles import as_local_table


@dataclass(frozen=True)
class Synthesis:
    variables: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    top: DataFrame
    priorities: DataFrame
    actions: DataFrame
    merge_actions: DataFrame
    chart_actions: DataFrame


def synthesize(
    table: DataFrame,
    findings: DataFrame | None = None,
    features: Sequence[str] = (),
    target: str | None = None,
    group: str | None = None,
    declared: DataFrame | None = None,
) -> Synthesis:
    """Importance and advice. ``table`` and ``findings`` are metadata tables.

    The variable table, one row per column name, is collected once.
    """
    variables = as_local_table(
        catalog.variable_importance(table, findings, features, target, group)
    )
    clusters = catalog.concept_clusters(variables)
    candidates = catalog.join_candidates(table, declared)
    return Synthesis(
        variables=variables,
        clusters=clusters,
        candidates=candidates,
        top=catalog.top_variables(variables),
        priorities=catalog.priority_by_dataset(variables),
        actions=catalog.action_rows(variables, candidates, clusters),
        merge_actions=catalog.merge_actions(candidates),
        chart_actions=catalog.chart_actions(variables),
    )


@dataclass(frozen=True)
class Execution:
    standardized: dict[str, DataFrame]
    merge_results: DataFrame
    merged: dict[str, DataFrame]
    chart_status: DataFrame
    chart_data: DataFrame


def execute(plan: Synthesis, datasets: dict[str, DataFrame]) -> Execution:
    """Apply the advice: standard names, then merges on the renamed keys, then charts."""
    renames = merge.rename_map(merge.rename_table(plan.clusters))
    standard = {name: merge.standardize(df, renames) for name, df in datasets.items()}
    results, merged = merge.merge_all(plan.merge_actions, standard, renames)
    status, data = charts.run_charts(plan.chart_actions, standard)
    return Execution(standard, results, merged, status, data)
