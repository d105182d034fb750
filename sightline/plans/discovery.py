"""Profile, describe, relate and model a collection of datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import catalog, likelihood, profile, relationships


@dataclass(frozen=True)
class Discovery:
    shape: DataFrame
    shared: DataFrame
    missing: DataFrame
    statistics: DataFrame
    catalog: DataFrame
    findings: DataFrame
    pair_status: DataFrame
    top: DataFrame
    summary: DataFrame
    model: dict


def related_columns(findings: DataFrame, dataset: str) -> list[str]:
    """Columns of the strongest findings of a dataset, strongest first."""
    rows = relationships.top_relationships(findings.where(F.col("dataset") == dataset)).collect()
    return list(dict.fromkeys(c for r in rows for c in (r["column_a"], r["column_b"])))


def discover_collection(
    datasets: dict[str, DataFrame], keys: dict[str, Sequence[str]] | None = None
) -> Discovery:
    """All discovery tables of a collection; the model needs a row key per dataset.

    A column pair that fails gives a row in ``pair_status``; the others go on.
    """
    def per_dataset(fn) -> DataFrame:
        return profile.union_all(
            [
                fn(df).select(F.lit(name).alias("dataset"), "*")
                for name, df in datasets.items()
            ]
        )

    spark = next(iter(datasets.values())).sparkSession
    table = catalog.build_catalog(datasets)
    # Measured once: top, summary and model read the collected findings.
    measured = [
        relationships.findings_with_status(
            df, name, relationships.typed_pairs(table.where(F.col("dataset") == name))
        )
        for name, df in datasets.items()
    ]
    findings = profile.union_all([found for found, _ in measured])
    numeric = {n: df for n, df in datasets.items() if profile.numeric_columns(df)}
    statistics = profile.union_all(
        [
            profile.describe_numeric(df).select(F.lit(name).alias("dataset"), "*")
            for name, df in numeric.items()
        ]
    )
    model: dict = {}
    if keys:
        primary = profile.largest_dataset(datasets).first()["dataset"]
        model = likelihood.model_likelihood(
            datasets, keys, {primary: related_columns(findings, primary)}
        )
    return Discovery(
        shape=profile.dataset_shape(datasets),
        shared=profile.shared_columns(profile.column_list(datasets)),
        missing=per_dataset(profile.missing_values),
        statistics=statistics,
        catalog=table,
        findings=findings,
        pair_status=profile.union_all([status for _, status in measured]),
        top=relationships.top_overall(findings),
        summary=catalog.run_summary(table, findings, likelihood.model_facts(spark, model) if model else None),
        model=model,
    )
