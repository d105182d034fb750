import pytest
from pyspark.sql import functions as F

from sightline.operators import cohort
from sightline.plans.questions import cohort_questions
from sightline.sources import tables as t

ENC = (
    "patientdurablekey long, encounterkey long, isedvisit string, ishospitaladmission int, "
    "isinpatientadmission int, isobservation int, primarydiagnosiskey double, departmentkey long, "
    "admityear string"
)
SDOH = "patientdurablekey long, domain string, answertext string, encounterkey long"


@pytest.fixture(scope="module")
def enc(spark):
    rows = [
        (1, 10, "1", 0, 0, 0, 5.0, 100, "2020"),
        (1, 11, "0", 1, 0, 0, 5.0, 100, "2021"),
        (1, None, "x", 0, 0, 0, 6.0, None, "2021"),
        (2, 12, "1", 0, 1, 0, -1.0, 101, "2021"),
        (2, 13, None, 0, 0, 0, float("nan"), 101, "2019"),
        (None, 14, "1", 0, 0, 0, 6.0, 102, "bad"),
        (3, None, "1", 0, 0, 0, 6.0, 101, "2022"),
    ]
    return cohort.cast_flags(spark.createDataFrame(rows, ENC))


@pytest.fixture(scope="module")
def sdoh(spark):
    rows = [
        (1, " Food ", "y", 10), (1, "Food", "y", 10), (1, "Housing Need", "y", None),
        (2, None, "y", 12), (2, "food", "y", None), (None, "Food", "y", 14), (9, "Food", "y", 99),
    ]
    return spark.createDataFrame(rows, SDOH)


@pytest.fixture(scope="module")
def diag(spark):
    return spark.createDataFrame([("5", "Heart"), ("6", "Lung"), ("7", None)], "diagnosiskey string, groupname string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patient_rollup_drops_null_patients_and_counts_keys(enc):
    got = {r["patientdurablekey"]: r for r in cohort.patient_rollup(enc).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["total_encounters"], got[1]["ed_visits"], got[1]["any_ed"]) == (2, 1, 1)
    assert (got[3]["total_encounters"], got[3]["ed_visits"]) == (0, 1)


def test_domain_pairs_trim_and_fold_case(sdoh):
    assert rows(cohort.patient_domains(sdoh)) == [(1, "food"), (1, "housing_need"), (2, "food"), (9, "food")]


def test_matrix_is_zero_or_one(sdoh):
    got = rows(cohort.domain_matrix(sdoh, ["food", "housing_need"]))
    assert got == [(1, 1, 1), (2, 1, 0), (9, 1, 0)]


def test_sides_need_enough_patients_and_empty_result_keeps_its_schema(enc, sdoh):
    empty = cohort.screened_rates_tested(enc, sdoh)
    assert empty.columns[0] == "domain" and empty.collect() == []
    kept = {r["domain"]: r for r in cohort.screened_rates_tested(enc, sdoh, min_side=1).collect()}
    assert set(kept) == {"Housing Need"}
    assert kept["Housing Need"]["n_screened"] == 1 and kept["Housing Need"]["n_not_screened"] == 1


def test_untrimmed_domains_per_patient(sdoh):
    got = {r["patientdurablekey"]: r["n_sdoh_domains"] for r in cohort.domains_per_patient(sdoh).collect()}
    assert got == {1: 3, 2: 1, 9: 1}


def test_cooccurrence_counts_pairs_and_null_keys_match(enc, sdoh, diag):
    got = {(r["groupname"], r["domain"]): r["count"] for r in cohort.cooccurrence(enc, sdoh, diag).collect()}
    # Two null-key encounters with diagnosis 6 meet two null-key screenings.
    assert got == {("Heart", "Food"): 2, ("Lung", "Housing Need"): 2, ("Lung", "food"): 2, ("Lung", "Food"): 1}
    plain = cohort.cooccurrence(enc, sdoh, diag, null_keys_match=False)
    assert {(r["groupname"], r["domain"]) for r in plain.collect()} == {("Heart", "Food"), ("Lung", "Food")}


def test_years_are_inclusive_and_unreadable_years_drop(enc, sdoh):
    got = {r["admityear"]: (r["total"], r["screened"]) for r in cohort.yearly_rate(enc, sdoh, (2020, 2022)).collect()}
    assert got == {2020: (1, 1), 2021: (2, 2), 2022: (0, 1)}
    trend = cohort.yearly_domains(enc, sdoh, (2020, 2022))
    assert ("Food" in {r["domain"] for r in trend.where("admityear = 2020").collect()})


def test_growth_follows_the_previous_present_year(spark):
    trend = spark.createDataFrame(
        [(2020, "a", 10), (2022, "a", 15), (2021, "b", 4)], "admityear int, domain string, count long"
    )
    got = {(r["domain"], r["admityear"]): r["yoy_growth_pct"] for r in cohort.yearly_growth(trend).collect()}
    assert got == {("a", 2020): None, ("a", 2022): 50.0, ("b", 2021): None}


def test_area_keys_lose_the_decimal_and_never_use_exponents(spark, enc, sdoh):
    dept = spark.createDataFrame(
        [(100, 36061000100.0, "A"), (101, 7.0, "B"), (102, None, "C"), (None, 8.0, "D")],
        "departmentkey long, censustract double, departmenttype string",
    )
    got = {r["censustract"]: r for r in cohort.area_summary(enc, sdoh, dept).collect()}
    assert set(got) == {"36061000100", "7", "8"}
    assert got["36061000100"]["total_encounters"] == 2
    assert got["8"]["total_encounters"] == 0 and got["8"]["sdoh_screen_rate"] is None


def test_ties_at_the_cut_go_to_the_first_name(spark):
    cells = spark.createDataFrame([("b", "x", 5), ("a", "x", 5), ("c", "x", 9)], "groupname string, domain string, count long")
    assert {r["groupname"] for r in cohort.top_groups(cells, 2).collect()} == {"a", "c"}
    share = spark.createDataFrame([("g", "z", 50.0), ("g", "m", 50.0)], "groupname string, domain string, pct double")
    assert cohort.top_domain(share).first()["top_sdoh_domain"] == "m"


def test_crosstab_rows_sum_to_one_hundred(spark, tiny):
    cells = cohort.cooccurrence(t.encounters(spark, tiny), t.screenings(spark, tiny), t.diagnoses(spark, tiny))
    share = cohort.row_percent(cohort.top_groups(cells))
    for r in share.groupBy("groupname").agg(F.sum("pct").alias("s"), F.count("*").alias("n")).collect():
        assert r["s"] == pytest.approx(100) and r["n"] == 6


def test_hot_patient_key(spark):
    """One patient holds a third of all rows; counts match a plain aggregation."""
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("patientdurablekey"),
        F.col("id").alias("encounterkey"),
        (F.col("id") % 5 == 0).cast("int").alias("isedvisit"),
        F.lit(0).alias("ishospitaladmission"), F.lit(0).alias("isinpatientadmission"),
        (F.col("id") % 4).cast("double").alias("primarydiagnosiskey"),
    )
    dims = spark.createDataFrame([(0.0, "A"), (1.0, "B"), (2.0, "C"), (3.0, "D")], "diagnosiskey double, groupname string")
    assert cohort.patient_rollup(facts).where("patientdurablekey = 0").first()["total_encounters"] == 1000
    got = {r["diagnosis_group"]: r["count"] for r in cohort.top_diagnoses(facts, dims, quantile=1.0).collect()}
    assert got == {"A": 250, "B": 250, "C": 250, "D": 250}


def test_only_chosen_questions_are_built(spark, tiny):
    frames = [f(spark, tiny) for f in (t.encounters, t.screenings, t.diagnoses, t.departments, t.area_codes)]
    names = set(cohort_questions(*frames, which=("2",)))
    assert names == {"q2_utilizer_summary", "q2_top_diagnoses", "q2_encounter_histogram"}


def test_neighbouring_large_keys_stay_apart(spark):
    large = 2**53
    facts = spark.range(4).select(
        F.col("id").alias("patientdurablekey"), F.col("id").alias("encounterkey"),
        (F.lit(large) + F.col("id") % 2).alias("primarydiagnosiskey"),
    )
    screens = spark.range(4).select(F.col("id").alias("encounterkey"), F.lit("Food").alias("domain"))
    want = {"A": 2, "B": 2}
    for kind in ("bigint", "string", "decimal(20,0)"):
        dims = spark.createDataFrame([(large, "A"), (large + 1, "B")], "diagnosiskey long, groupname string")
        dims = dims.withColumn("diagnosiskey", F.col("diagnosiskey").cast(kind))
        got = cohort.cooccurrence(facts, screens, dims).collect()
        assert {r["groupname"]: r["count"] for r in got} == want
        top = cohort.top_diagnoses(facts, dims, quantile=0.0).collect()
        assert {r["diagnosis_group"]: r["count"] for r in top} == want


def test_wide_crosstab_takes_its_domains_from_the_cells(spark):
    cells = spark.createDataFrame([("g", "ECO", 3), ("g", "Food", 1)], "groupname string, domain string, count long")
    wide = cohort.row_percent_wide(cohort.row_percent(cells))
    assert wide.columns == ["groupname", "ECO", "Food"] and tuple(wide.first()) == ("g", 75.0, 25.0)
