from pyspark.sql import functions as F

from sightline.plans.discovery import discover_collection
from sightline.sources import tables as t


def test_discovery_measures_pairs_and_sums_up_the_model(spark, tiny):
    datasets = {"graded": t.graded(spark, tiny), "nation": t.table(spark, tiny, "nation")}
    found = discover_collection(datasets, {"graded": ["doc_id"]})
    status = found.pair_status.collect()
    assert {r["status"] for r in status} <= {"retained", "not_retained"}
    assert sum(r["status"] == "retained" for r in status) == found.findings.count()
    summary = found.summary.first()
    assert (summary["datasets"], summary["relationships"]) == (2, found.findings.count())
    assert (summary["model_dataset"], summary["model_target"], summary["model_status"]) == ("graded", "target", "fitted")
    assert summary["model_train_rows"] + summary["model_test_rows"] == datasets["graded"].count()
    assert 0 <= summary["model_accuracy"] <= 1
    assert found.findings.where(F.col("score").isNull()).isEmpty()


def test_discovery_without_a_model(spark, tiny):
    found = discover_collection({"nation": t.table(spark, tiny, "nation")})
    assert found.model == {} and found.summary.columns == ["datasets", "columns", "shared_pairs", "relationships"]
    assert found.summary.first()["datasets"] == 1
