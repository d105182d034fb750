"""Named queries over the test tables, one per operator. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.scalars import as_flag, as_key_text, as_number, round_even
from sightline.operators import (
    catalog,
    charts,
    cohort,
    features,
    likelihood,
    merge,
    profile,
    relationships,
    roles,
)
from sightline.plans.questions import cohort_questions
from sightline.plans.synthesis import synthesize
from sightline.session import shared_folder
from sightline.sources import csv, results
from sightline.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
YEARS = (1995, 2001)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded half to even, so that two engines agree."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: round_even(F.col(c), digits) for c in doubles}) if doubles else df


# ------------------------------------------------------------------ cohort


@query
def rq1_patient_rollup(spark, d):
    return cohort.patient_rollup(cohort.cast_flags(t.encounters(spark, d)))


@query
def rq1_domain_pairs(spark, d):
    return cohort.patient_domains(t.screenings(spark, d))


@query
def rq1_domain_matrix(spark, d):
    sdoh = t.screenings(spark, d)
    # The domain vocabulary names the columns.
    names = cohort.patient_domains(sdoh).select("domain").distinct().orderBy("domain").collect()
    return cohort.domain_matrix(sdoh, [r["domain"] for r in names])


@query
def rq1_rates(spark, d):
    return cohort.screened_rates(t.encounters(spark, d), t.screenings(spark, d))


@query
def rq1_rates_fisher(spark, d):
    return cohort.screened_rates_tested(t.encounters(spark, d), t.screenings(spark, d))


@query
def rq1_odds(spark, d):
    tested = cohort.screened_rates_tested(t.encounters(spark, d), t.screenings(spark, d))
    return cohort.odds_ratios(tested).select("domain", "odds_ratio")


@query
def rq2_threshold(spark, d):
    return rounded(cohort.utilizer_threshold(cohort.encounter_counts(t.encounters(spark, d))))


@query
def rq2_high_utilizers(spark, d):
    return cohort.high_utilizers(t.encounters(spark, d))


@query
def rq2_patient_domains(spark, d):
    found = cohort.domains_per_patient(t.screenings(spark, d))
    return found.withColumn("sdoh_domains", F.array_join("sdoh_domains", ","))


@query
def rq2_tier_summary(spark, d):
    return rounded(cohort.utilizer_summary(t.encounters(spark, d), t.screenings(spark, d)))


@query
def rq2_top_diagnoses(spark, d):
    return cohort.top_diagnoses(t.encounters(spark, d), t.diagnoses(spark, d))


@query
def rq2_capped_hist(spark, d):
    capped = cohort.capped_counts(t.encounters(spark, d))
    return rounded(charts.histogram(capped, "encounter_count", fv.ENCOUNTER_BINS))


def _areas(spark, d):
    return cohort.area_summary(
        t.encounters(spark, d), t.screenings(spark, d), t.departments(spark, d)
    )


def _placed_areas(spark, d):
    return cohort.area_geography(_areas(spark, d), t.area_codes(spark, d))


@query
def rq3_area_summary(spark, d):
    return _areas(spark, d)


@query
def rq3_geo(spark, d):
    return _placed_areas(spark, d)


@query
def rq3_volume_and_rate(spark, d):
    return cohort.busy_areas(_areas(spark, d))


@query
def rq3_area_medians(spark, d):
    return rounded(cohort.area_medians(_areas(spark, d)))


@query
def rq3_underscreened(spark, d):
    return cohort.underscreened_areas(_areas(spark, d))


@query
def rq3_map_layer(spark, d):
    return rounded(cohort.map_layer(_placed_areas(spark, d)))


def _cells(spark, d):
    return cohort.cooccurrence(
        t.encounters(spark, d), t.screenings(spark, d), t.diagnoses(spark, d)
    )


@query
def rq4_cooccurrence(spark, d):
    return _cells(spark, d)


@query
def rq4_top_groups(spark, d):
    return cohort.top_groups(_cells(spark, d))


@query
def rq4_row_pct(spark, d):
    return rounded(cohort.row_percent(cohort.top_groups(_cells(spark, d))))


@query
def rq4_row_pct_wide(spark, d):
    share = cohort.row_percent(cohort.top_groups(_cells(spark, d)))
    return rounded(cohort.row_percent_wide(share))


@query
def rq4_top_domain(spark, d):
    return cohort.top_domain(cohort.row_percent(cohort.top_groups(_cells(spark, d))))


def _trend(spark, d):
    return cohort.yearly_domains(t.encounters(spark, d), t.screenings(spark, d), YEARS)


@query
def rq5_trend(spark, d):
    return _trend(spark, d)


@query
def rq5_top_domains(spark, d):
    return cohort.top_domains(_trend(spark, d), 4)


@query
def rq5_rate_by_year(spark, d):
    return cohort.yearly_rate(t.encounters(spark, d), t.screenings(spark, d), YEARS)


@query
def rq5_yoy(spark, d):
    return cohort.yearly_growth(cohort.top_domains(_trend(spark, d)))


@query
def chosen_questions(spark, d):
    """Rows of every result table of questions 1, 3 and 5."""
    chosen = cohort_questions(
        t.encounters(spark, d), t.screenings(spark, d), t.diagnoses(spark, d),
        t.departments(spark, d), t.area_codes(spark, d), which=("1", "3", "5"), years=YEARS,
    )
    return profile.union_all(
        [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("result"), "rows")
         for n, df in chosen.items()]
    )


# ----------------------------------------------------------------- profile


@query
def profile_shape(spark, d):
    return profile.dataset_shape(t.tables(spark, d))


@query
def largest_dataset(spark, d):
    return profile.largest_dataset(t.tables(spark, d))


@query
def profile_missing(spark, d):
    return rounded(profile.missing_values(t.orders_nulled(spark, d)))


@query
def profile_duplicates(spark, d):
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return profile.duplicate_rows(lines)


@query
def profile_duplicates_full_rows(spark, d):
    return profile.duplicate_rows(t.table(spark, d, "documents").drop("doc_id"))


@query
def sample_rows(spark, d):
    return profile.sample_rows(t.table(spark, d, "orders"), ["o_orderkey"])


@query
def shared_columns(spark, d):
    """Shared names of all tables, with the rows of the smaller side."""
    frames = t.tables(spark, d)
    shared = profile.shared_columns(profile.column_list(frames))
    rows = profile.dataset_shape(frames)
    return (
        shared.join(rows.select(F.col("dataset").alias("dataset_a"), F.col("rows").alias("rows_a")), "dataset_a")
        .join(rows.select(F.col("dataset").alias("dataset_b"), F.col("rows").alias("rows_b")), "dataset_b")
        .withColumn("shared_columns", F.array_join("shared_columns", ","))
        .withColumn("n_shared", F.col("n_shared").cast("bigint"))
    )


@query
def numeric_split(spark, d):
    """Numeric and other columns of each table, next to the rows they describe."""
    frames = t.tables(spark, d)
    split = (
        profile.column_list(frames)
        .groupBy("dataset")
        .agg(
            F.count_if("is_numeric").alias("numeric_columns"),
            F.count_if(~F.col("is_numeric")).alias("other_columns"),
        )
    )
    return split.join(profile.dataset_shape(frames).select("dataset", "rows"), "dataset")


@query
def describe_numeric(spark, d):
    return rounded(profile.describe_numeric(t.table(spark, d, "lineitem")))


@query
def describe_with_missing(spark, d):
    return rounded(profile.describe_numeric(t.orders_nulled(spark, d)))


@query
def distinct_counts(spark, d):
    return profile.distinct_counts(t.table(spark, d, "lineitem"))


@query
def value_counts_top(spark, d):
    return profile.value_counts(t.orders_nulled(spark, d), "o_orderstatus")


@query
def value_counts_limited(spark, d):
    return profile.value_counts(
        t.orders_nulled(spark, d), "o_orderstatus", count_missing=False, max_distinct=50
    )


@query
def value_counts_too_many(spark, d):
    return profile.value_counts(
        t.table(spark, d, "customer"), "c_name", count_missing=False, max_distinct=50
    )


# ------------------------------------------------------------------- roles

ROLE_COLUMNS = [
    "dataset", "column", "kind", "rows", "missing", "missing_percent", "role", "usable",
    "exclusion_reason",
]


@query
def column_roles(spark, d):
    found = roles.column_roles(t.orders_nulled(spark, d), "orders_nulled")
    return rounded(found.select(*ROLE_COLUMNS))


@query
def column_roles_planted(spark, d):
    found = roles.column_roles(t.planted(spark, d), "planted", exact_distinct=True)
    return rounded(found.select(*ROLE_COLUMNS, "distinct"))


@query
def usable_columns(spark, d):
    found = roles.column_roles(t.table(spark, d, "documents"), "documents")
    return found.select("column", "role", "usable", "exclusion_reason")


@query
def candidate_pairs(spark, d):
    return roles.candidate_pairs(roles.column_roles(t.planted(spark, d), "planted"))


# ----------------------------------------------------------- relationships

NUMERIC = ["qty", "load_units", "drift", "l_tax"]
NUMERIC_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
GROUP_PAIRS = [(a, b) for a in ("tier", "l_linestatus") for b in NUMERIC]
CORE = ["column_a", "column_b", "rows_used", "score", "metric_value"]


@query
def rel_num_num(spark, d):
    found = relationships.numeric_numeric(t.planted(spark, d), NUMERIC_PAIRS)
    return found.select(*CORE, "strength_label", "direction")


@query
def rel_num_num_unfiltered(spark, d):
    """Raw numeric columns are nearly unrelated, so this shows what is turned away."""
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = relationships.numeric_numeric(t.table(spark, d, "lineitem"), pairs, min_score=0.0)
    return found.select(*CORE, "strength_label", "direction")


@query
def rel_cat_num(spark, d):
    found = relationships.categorical_numeric(t.planted(spark, d), GROUP_PAIRS)
    return found.select(
        *CORE, "top_group", "bottom_group", "top_group_value", "bottom_group_value"
    )


@query
def rel_cat_num_groups(spark, d):
    found = relationships.categorical_numeric(t.planted(spark, d), GROUP_PAIRS)
    groups = found.select("column_a", "column_b", F.inline("groups"))
    return rounded(groups.select("column_a", "column_b", "group", "mean", "median", "count"))


@query
def rel_cat_bin(spark, d):
    pairs = [("tier", "is_bulk"), ("l_linestatus", "is_bulk")]
    found = relationships.categorical_binary(t.planted(spark, d), pairs)
    return found.select(
        *CORE, "top_group", "bottom_group", "top_group_value", "bottom_group_value"
    )


@query
def rel_cat_bin_groups(spark, d):
    found = relationships.categorical_binary(t.planted(spark, d), [("tier", "is_bulk")])
    return found.select("column_a", "column_b", F.inline("groups")).select(
        "column_a", "column_b", "group", "count", "positive_cases", "rate", "percent_rate"
    )


@query
def rel_bin_num(spark, d):
    found = relationships.binary_numeric(t.planted(spark, d), [("is_bulk", n) for n in NUMERIC])
    return found.select(*CORE, "direction", "mean_when_0", "mean_when_1")


@query
def rel_time_num(spark, d):
    pairs = [(a, b) for a in ("ship_year", "ship_date") for b in NUMERIC]
    found = relationships.time_numeric(t.planted(spark, d), pairs)
    return found.select(*CORE, "strength_label", "direction")


def _found(spark, d, medians=True):
    return relationships.discover(t.planted(spark, d), "planted", medians=medians)


@query
def rel_all_ranked(spark, d):
    top = relationships.top_relationships(_found(spark, d))
    return top.select("comparison_type", *CORE, "metric_name")


@query
def rel_status(spark, d):
    """What became of every pair; one column cannot be read and one does not exist."""
    frame = t.planted(spark, d)
    pairs = relationships.typed_pairs(roles.column_roles(frame, "planted"))
    pairs["numeric_numeric"] = [*pairs["numeric_numeric"], ("broken", "qty"), ("drift", "not_there")]
    broken = frame.withColumn("broken", F.when(F.col("qty") > 0, F.raise_error(F.lit("unreadable")).cast("int")))
    _, status = relationships.findings_with_status(broken, "planted", pairs)
    return status


@query
def rel_top_by_type(spark, d):
    best = relationships.top_by_type(_found(spark, d), 1)
    return best.select("dataset", "comparison_type", "column_a", "column_b", "score")


@query
def rel_top_overall(spark, d):
    graded = relationships.discover(t.graded(spark, d), "graded")
    both = profile.union_all([_found(spark, d), graded])
    return relationships.top_overall(both).select("dataset", "comparison_type", *CORE)


@query
def rel_narratives(spark, d):
    return _found(spark, d).select("comparison_type", "column_a", "column_b", "narrative")


# ---------------------------------------------------------------- features


@query
def feat_boolean(spark, d):
    converted = features.convert_boolean_like(t.people(spark, d))
    return converted.select("person_id", "housing_instability", "employment_status")


@query
def feat_age_group(spark, d):
    made = features.create_features(t.people(spark, d))
    return made.select("person_id", "age", "age_group")


@query
def feat_low_income(spark, d):
    made = features.create_features(t.people(spark, d))
    return made.select("person_id", "low_income")


@query
def feat_status_flags(spark, d):
    made = features.create_features(t.people(spark, d))
    return made.select("person_id", "unemployed", "no_health_insurance")


@query
def feat_score(spark, d):
    made = features.create_features(t.people(spark, d))
    return made.select(
        "person_id", "social_determinant_score", "high_social_determinant_burden"
    )


@query
def feat_text_target(spark, d):
    orders = t.table(spark, d, "orders")
    words = F.when(F.col("o_orderstatus") == "F", " Food Insecure").when(
        F.col("o_orderstatus") == "O", "negative"
    ).otherwise("unknown")
    framed = orders.select("o_orderkey", words.alias("outcome"))
    return features.create_features(framed)


@query
def feat_choices(spark, d):
    """Target, features and group column chosen for the people table, by rank."""
    found = roles.column_roles(features.create_features(t.people(spark, d)), "people")
    target = features.detect_target(found)
    names = features.detect_features(found, target)
    group = features.detect_group(found, target)
    rows = [("target", 1, target), ("group", 1, group)]
    rows += [("feature", i + 1, n) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "choice string, rank int, column string")


# -------------------------------------------------------------- likelihood


@query
def group_rates(spark, d):
    return rounded(likelihood.group_rates(t.graded(spark, d), "source", "target"))


@query
def rate_gap(spark, d):
    rates = likelihood.group_rates(t.graded(spark, d), "source", "target")
    return rounded(likelihood.rate_gap(rates, "source"))


@query
def impute(spark, d):
    filled = likelihood.impute_values(
        t.orders_nulled(spark, d), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]
    )
    return rounded(filled)


@query
def split_shares(spark, d):
    split = likelihood.stratified_split(
        t.table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"], 0.2
    )
    return split.groupBy("o_orderstatus", "is_test").agg(F.count("*").alias("rows"))


def _logit(spark, d):
    return likelihood.fit_logistic(
        t.graded(spark, d), ["n_chars", "toxic", "lang", "source"], "target", ["doc_id"]
    )


@query
def logit_report(spark, d):
    return rounded(_logit(spark, d).report)


@query
def logit_scores(spark, d):
    return rounded(_logit(spark, d).sample)


@query
def logit_certificate(spark, d):
    """That the fit is the optimum: a gradient of zero, and mean p equal to mean y, per coefficient."""
    found = _logit(spark, d).certificate
    # Adding zero turns -0.0 into 0.0.
    return rounded(found.select("feature", "feature_sum", "gradient")).withColumn("gradient", F.col("gradient") + F.lit(0.0))


@query
def split_rows(spark, d):
    """Which rows the split takes as test rows; any engine can repeat it."""
    split = likelihood.stratified_split(t.graded(spark, d), "target", ["doc_id"], 0.2)
    return split.select("doc_id", "target", "is_test")


@query
def classification_report(spark, d):
    """The report of a fixed rule, so that every number can be checked."""
    graded = t.graded(spark, d).withColumn("guess", (F.col("n_chars") > 2000).cast("int"))
    return rounded(likelihood.classification_report(graded, "target", "guess"))


@query
def model_refusals(spark, d):
    graded = t.graded(spark, d)
    cases = {
        "one_class": likelihood.fit_logistic(
            graded.where("target = 1"), ["n_chars"], "target", ["doc_id"]
        ),
        "no_target_values": likelihood.fit_logistic(
            graded.withColumn("target", F.lit(None).cast("int")), ["n_chars"], "target", ["doc_id"]
        ),
        "no_features": likelihood.fit_logistic(graded, [], "target", ["doc_id"]),
    }
    rows = [(name, m.status, m.reason) for name, m in cases.items()]
    return spark.createDataFrame(rows, "case string, status string, reason string")


@query
def model_workflow(spark, d):
    out = likelihood.model_likelihood(
        {"graded": t.graded(spark, d), "nation": t.table(spark, d, "nation")}, {"graded": ["doc_id"]}
    )
    return rounded(out["group_rates"])


@query
def model_facts(spark, d):
    """Choices, rows and group gap of the model workflow, for the run summary."""
    out = likelihood.model_likelihood(
        {"graded": t.graded(spark, d), "nation": t.table(spark, d, "nation")}, {"graded": ["doc_id"]}
    )
    return rounded(likelihood.model_facts(spark, out).drop("accuracy"))


@query
def coerced_values(spark, d):
    """Numbers, flags and keys out of text that is a number, nearly one, or none."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, F.concat(F.lit(" "), key, F.lit(" "))).when(key % 5 == 1, F.concat(key, F.lit(".50")))
        .when(key % 5 == 2, "n/a").when(key % 5 == 3, F.concat(key, F.lit("d")))
    )
    df = t.table(spark, d, "orders").select(key, text.alias("text"), (key / 2).alias("half"))
    return df.select(
        key, as_number(df, "text").alias("number"), as_flag(df, "text").alias("flag"), as_key_text(df, "half").alias("key_text")
    )


# ------------------------------------------------------------------- merge


@query
def place_names(spark, d):
    """Two columns that share a standard name, told apart as city and county."""
    dept = t.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("departmentkey"), F.col("s_name").alias("Town"), F.col("s_nationkey").alias("District")
    )
    return cohort.disambiguate_places(merge.standardize(dept, {"town": "location", "district": "location"}))


@query
def key_quality(spark, d):
    customer = t.table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    orders = t.table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    return merge.key_quality(customer, orders, ["key"])


@query
def join_sizes(spark, d):
    left = t.orders_nulled(spark, d).select(F.col("o_orderstatus").alias("key"), "o_orderkey")
    right = t.table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 4 == 0, "F").when(F.col("c_custkey") % 4 == 1, "O").alias("key")
    )
    return merge.join_sizes(left, right, ["key"], null_keys_match=True)


@query
def merge_inner(spark, d):
    customer = t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount")
    )
    orders = t.table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount")
    )
    return merge.merge_or_left(orders, customer, ["key"], "orders.csv", "customer.csv")


@query
def merge_left_when_empty(spark, d):
    left = t.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    right = t.table(spark, d, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("key"), "s_name"
    )
    return merge.merge_or_left(left, right, ["key"])


@query
def standardize_columns(spark, d):
    renames = {"birth_year": "age", "age_group": "age", "employment_status": "employment"}
    people = features.create_features(t.people(spark, d)).select(
        "person_id", "birth_year", "age_group", "employment_status"
    )
    return merge.standardize(people, renames)


# ------------------------------------------------------------------ charts


@query
def hist_10(spark, d):
    return rounded(charts.histogram(t.table(spark, d, "lineitem"), "l_extendedprice", 10))


@query
def hist_20(spark, d):
    return rounded(charts.histogram(t.table(spark, d, "events"), "value", 20))


@query
def hist_first_columns(spark, d):
    return rounded(charts.default_histograms(t.table(spark, d, "part")))


@query
def top_categories(spark, d):
    return charts.category_bars(t.table(spark, d, "part"), "p_brand")


@query
def monthly_counts(spark, d):
    return charts.monthly_counts(t.table(spark, d, "lineitem"), "l_shipdate")


@query
def monthly_counts_text(spark, d):
    """Dates held as text, some of them unreadable."""
    orders = t.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 10 == 0, "unknown").when(
        F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss"))
    return charts.monthly_counts(orders.select(text.alias("ordered")), "ordered")


@query
def scatter_pairs(spark, d):
    return charts.scatter_pairs(t.orders_nulled(spark, d), "o_totalprice", "o_orderkey")


@query
def scatter_sample(spark, d):
    return charts.scatter_sample(t.table(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"], 500)


@query
def scatter_grid(spark, d):
    return rounded(charts.scatter_grid(t.table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 20))


# --------------------------------------------------------------- catalogue


def collection(spark, d) -> dict[str, DataFrame]:
    return {
        "encounters": t.encounters(spark, d),
        "screenings": t.screenings(spark, d),
        "diagnoses": t.diagnoses(spark, d),
        "departments": t.departments(spark, d),
        "area_codes": t.area_codes(spark, d),
        "people": features.create_features(t.people(spark, d)),
        "graded": t.graded(spark, d),
        "planted": t.planted(spark, d),
    }


def _catalog(spark, d):
    return catalog.build_catalog(collection(spark, d))


@query
def catalog_merge(spark, d):
    """The catalogue of datasets in two files each, merged from a kept table of sketches per file."""
    frames = {n: df for n, df in collection(spark, d).items() if n in ("encounters", "graded", "planted")}
    folder = shared_folder(spark)
    for name, df in frames.items():
        half = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(2))
        for i in range(2):
            roles.column_sketches(df.where(half == i), name).write.parquet(f"{folder}/file={name}-{i}")
    found = roles.merged_catalog(spark.read.parquet(folder).drop("file"))
    return rounded(found.select("dataset", "column", "kind", "rows", "missing", "role", "missing_percent", "usable"))


def _declared(spark):
    return spark.createDataFrame(
        [("departments", "encounters", ["departmentkey"])],
        "dataset_a string, dataset_b string, possible_join_keys array<string>",
    )


def _synthesis(spark, d):
    return synthesize(
        _catalog(spark, d),
        # Importance takes scores only, so the pass for group medians is left out.
        roles.as_local_table(relationships.top_relationships(_found(spark, d, medians=False))),
        ["n_chars", "source"], "target", "lang", _declared(spark),
    )


@query
def var_importance(spark, d):
    found = _synthesis(spark, d).variables
    return rounded(
        found.select(
            "variable", "concept_root", "importance_score", "importance_bucket",
            F.array_join("datasets", ",").alias("datasets"),
            F.array_join("roles", ",").alias("roles"),
            "min_missing",
        )
    )


@query
def concept_clusters(spark, d):
    found = _synthesis(spark, d).clusters
    return found.select(
        "concept_root",
        F.col("n_variables").cast("bigint").alias("n_variables"),
        F.array_join("variables", ",").alias("variables"),
    )


@query
def join_candidates(spark, d):
    found = catalog.join_candidates(catalog.name_catalog(collection(spark, d)), _declared(spark))
    return found.select(
        "dataset_pair", F.array_join("shared_columns", ",").alias("shared_columns"),
        "join_strength", "recommendation",
    )


@query
def top_variables(spark, d):
    return _synthesis(spark, d).top.select(
        "variable", "importance_score", "importance_bucket", "why_it_matters"
    )


@query
def priority_by_dataset(spark, d):
    return _synthesis(spark, d).priorities.select(
        "dataset", "variable", "importance_score", F.col("rank").cast("bigint").alias("rank")
    )


@query
def action_rows(spark, d):
    return _synthesis(spark, d).actions


@query
def model_roles(spark, d):
    return catalog.model_roles(_synthesis(spark, d).variables).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@query
def run_summary(spark, d):
    return catalog.run_summary(_catalog(spark, d), _found(spark, d))


@query
def merge_all(spark, d):
    """Every ready merge of the collection, after standard names are applied."""
    frames = collection(spark, d)
    names = catalog.name_catalog(frames)
    renames = merge.rename_map(merge.rename_table(catalog.name_clusters(names)))
    standard = {name: merge.standardize(df, renames) for name, df in frames.items()}
    actions = catalog.merge_actions(catalog.join_candidates(names, _declared(spark)))
    found, _ = merge.merge_all(actions, standard, renames)
    return rounded(found.withColumn("keys_used", F.array_join("keys_used", ",")))


@query
def merge_readiness(spark, d):
    found = merge.merge_readiness(
        catalog.merge_actions(catalog.join_candidates(catalog.name_catalog(collection(spark, d)), _declared(spark))),
        list(collection(spark, d)),
    )
    return found.select("dataset_pair", "join_strength", "recommended_action", "readiness")


def _charts(spark, d):
    frames = {n: merge.standardize(df, {}) for n, df in collection(spark, d).items()}
    # One row per variable, read several times.
    found = roles.as_local_table(
        _synthesis(spark, d).chart_actions.select("variable_name", "importance_score", "recommended_graph", "datasets")
    )
    places = {r["variable_name"]: r["datasets"] for r in found.collect()}
    # A column that no dataset has, to show that it stops nothing.
    absent = spark.createDataFrame([("not_there", 0.0, "bar_chart")], "variable_name string, importance_score double, recommended_graph string")
    return charts.run_charts(found.drop("datasets").unionByName(absent), frames, places)


@query
def chart_dispatch(spark, d):
    """Chart tables of the most important variables, picked by their action rows."""
    return _charts(spark, d)[1]


@query
def chart_status(spark, d):
    """Which of these charts were made, and why others were not."""
    return _charts(spark, d)[0]


# ----------------------------------------------------------------- sources


@query
def csv_roundtrip(spark, d):
    """Orders with several missing tokens, written and read back with inferred types."""
    key = F.col("o_orderkey")
    token = F.when(key % 3 == 0, "NA").when(key % 3 == 1, "null").otherwise("N/A")
    orders = t.orders_nulled(spark, d)
    text = orders.select(
        key,
        F.coalesce("o_orderstatus", token).alias("o_orderstatus"),
        F.coalesce(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), token).alias(
            "o_totalprice"
        ),
        "o_orderpriority",
    )
    folder = shared_folder(spark) + "/orders.csv"
    results.save_csv(text, folder)
    return csv.read_csv(spark, folder)


@query
def infer_types(spark, d):
    folder = shared_folder(spark) + "/customer.csv"
    customer = t.table(spark, d, "customer").withColumn("active", F.col("c_custkey") % 2 == 0)
    results.save_csv(customer, folder)
    found = csv.infer_types(csv.read_csv_text(spark, folder))
    rows = csv.read_csv_text(spark, folder).agg(F.count("*")).scalar()
    return spark.createDataFrame(list(found.items()), "column string, type string").withColumn(
        "rows", rows
    )


@query
def csv_latin1(spark, d):
    """Names with accents in a file that is not UTF-8."""
    folder = shared_folder(spark) + "/accents.csv"
    named = t.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("Café "), F.col("c_name")).alias("label")
    )
    named.write.option("header", "true").option("encoding", "ISO-8859-1").csv(folder)
    return csv.read_csv(spark, folder)


@query
def csv_malformed(spark, d):
    """Lines with too many fields are dropped, short ones are padded."""
    key = F.col("s_suppkey")
    line = F.when(key % 7 == 0, F.concat_ws(",", key, "s_name", F.lit("1"), F.lit("2"))).when(
        key % 5 == 0, key.cast("string")
    ).otherwise(F.concat_ws(",", key, "s_name", "s_nationkey"))
    folder = shared_folder(spark) + "/ragged.csv"
    # One unquoted column whose name is the header line.
    lines = t.table(spark, d, "supplier").select(line.alias("key,name,nation"))
    lines.write.option("header", "true").option("quote", "").option("sep", "|").csv(folder)
    return csv.read_csv(spark, folder)


@query
def csv_required(spark, d):
    """Wanted columns in any case from the first path that exists."""
    folder = shared_folder(spark)
    results.save_csv(
        t.encounters(spark, d).select(
            F.col("patientdurablekey").alias(" PatientDurableKey"),
            F.col("encounterkey").alias("EncounterKey"),
            "isedvisit",
            "admityear",
        ),
        folder + "/encounters.csv",
    )
    return csv.read_required(
        spark,
        [folder + "/absent.csv", folder + "/encounters.csv"],
        ["patientdurablekey", "encounterkey", "admityear", "departmentkey"],
    )


@query
def csv_folder(spark, d):
    """Rows and columns of every CSV in a folder."""
    folder = shared_folder(spark)
    for name in ("region", "nation", "supplier"):
        results.save_csv(t.table(spark, d, name), f"{folder}/{name}.csv")
    return profile.dataset_shape(csv.read_folder(spark, folder, "strict"))


@query
def csv_folder_staged(spark, d):
    """Types and rows of the CSVs of a folder, read together and kept as typed Parquet."""
    folder = shared_folder(spark)
    for name in ("nation", "supplier", "customer"):
        results.save_csv(t.table(spark, d, name), f"{folder}/{name}.csv")
    found = csv.read_folder(spark, folder, "strict", stage=True)
    return profile.union_all(
        [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("dataset"), "rows", F.lit(",".join(f"{c}:{k}" for c, k in df.dtypes)).alias("types")
            )
            for name, df in found.items()
        ]
    )


@query
def json_roundtrip(spark, d):
    folder = shared_folder(spark) + "/areas.json"
    results.save_json(_areas(spark, d), folder)
    return results.load_json(
        spark, folder, "censustract string, total_encounters bigint, ed_rate double"
    )
