"""Parquet tables and the cohort views built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in TABLES}


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    first_line = lines.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk")
    )
    priority = F.col("o_orderpriority")
    return orders.join(first_line, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.col("o_custkey").alias("patientdurablekey"),
        F.col("o_orderkey").alias("encounterkey"),
        (priority == "1-URGENT").cast("int").alias("isedvisit"),
        (F.col("o_orderstatus") == "F").cast("int").alias("ishospitaladmission"),
        (priority == "2-HIGH").cast("int").alias("isinpatientadmission"),
        (priority == "3-MEDIUM").cast("int").alias("isobservation"),
        F.coalesce("pk", F.lit(-1)).alias("primarydiagnosiskey"),
        F.col("sk").alias("departmentkey"),
        F.year("o_orderdate").alias("admityear"),
    )


def screenings(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    part = table(spark, folder, "part")
    return (
        lines.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("o_custkey").alias("patientdurablekey"),
            F.col("p_type").alias("domain"),
            F.col("l_linestatus").alias("answertext"),
            F.col("l_orderkey").alias("encounterkey"),
        )
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("diagnosiskey"), F.col("p_brand").alias("groupname")
    )


def departments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("departmentkey"),
        F.col("s_nationkey").cast("double").alias("censustract"),
        F.when(F.col("s_acctbal") > 5000, "A").otherwise("B").alias("departmenttype"),
    )


def area_codes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "nation")
        .where(F.col("n_nationkey") != 7)
        .select(
            F.col("n_nationkey").cast("string").alias("geoid"),
            (F.col("n_nationkey") * 2).cast("double").alias("centlat"),
            (F.col("n_regionkey") * 30).cast("double").alias("centlon"),
        )
    )


def people(spark: SparkSession, folder: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        key.alias("person_id"),
        (F.lit(1930) + key % 80).alias("birth_year"),
        F.when(key % 11 != 0, F.col("c_acctbal")).alias("income"),
        F.when(segment == "BUILDING", " Unemployed")
        .when(segment == "FURNITURE", "jobless")
        .otherwise("employed")
        .alias("employment_status"),
        F.when(segment == "MACHINERY", "Uninsured").otherwise("private").alias("insurance_status"),
        F.when(key % 3 == 0, "Yes").otherwise("no").alias("housing_instability"),
    )


def graded(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return labels.join(documents, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", F.col("quality").alias("target")
    )


def orders_nulled(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key,
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """One known relationship of every pair type, with missing values."""
    qty, line, key = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        qty.alias("qty"),
        F.when(key % 9 != 0, qty * 2 + line).alias("load_units"),
        F.when(key % 13 != 0, F.when(qty < 17, "low").when(qty < 34, "mid").otherwise("high")).alias(
            "tier"
        ),
        (qty + line > 28).cast("int").alias("is_bulk"),
        F.year("l_shipdate").alias("ship_year"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
        ((F.year("l_shipdate") - 1990) * 3 + line).alias("drift"),
        "l_tax",
        "l_linestatus",
    )
