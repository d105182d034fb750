"""Cohort questions over an encounter fact table and its dimensions.

Every function takes and returns lazy DataFrames. Column names default to the
usual ones and can be changed with ``CohortColumns``. Where both sides of a join
can hold many rows per key, both are counted per key first: the join then meets
one row per key and group, so a hot or missing key never multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import fixed_values as fv
from sightline.functions.scalars import (
    as_flag,
    as_key_text,
    as_number,
    as_number_key,
    clean_key,
    domain_key,
    round_even,
    strip,
    title_label,
)
from sightline.operators.exact_test import fisher_exact


@dataclass(frozen=True)
class CohortColumns:
    # Default column names of the five tables.
    patient: str = "patientdurablekey"
    encounter: str = "encounterkey"
    flag: str = "isedvisit"
    admission: str = "ishospitaladmission"
    inpatient: str = "isinpatientadmission"
    observation: str = "isobservation"
    diagnosis: str = "primarydiagnosiskey"
    department: str = "departmentkey"
    year: str = "admityear"
    domain: str = "domain"
    answer: str = "answertext"
    diagnosis_key: str = "diagnosiskey"
    group: str = "groupname"
    area: str = "censustract"
    area_type: str = "departmenttype"
    geo: str = "geoid"
    lat: str = "centlat"
    lon: str = "centlon"


DEFAULT = CohortColumns()


def same_key(left: Column, right: Column, null_keys_match: bool) -> Column:
    return left.eqNullSafe(right) if null_keys_match else left == right


def cast_flags(enc: DataFrame, cols: CohortColumns = DEFAULT) -> DataFrame:
    """Flag columns as 0/1 integers; missing and unreadable values become 0."""
    names = [cols.flag, cols.admission, cols.inpatient, cols.observation]
    return enc.withColumns({n: as_flag(enc, n) for n in names if n in enc.columns})


# ---------------------------------------------------------------- question 1


def patient_domains(sdoh: DataFrame, cols: CohortColumns = DEFAULT) -> DataFrame:
    """Distinct (patient, domain key) pairs: the long form of the presence matrix."""
    return (
        sdoh.where(F.col(cols.patient).isNotNull() & F.col(cols.domain).isNotNull())
        .select(cols.patient, domain_key(F.col(cols.domain)).alias("domain"))
        .distinct()
    )


def domain_matrix(
    sdoh: DataFrame, domains: list[str], cols: CohortColumns = DEFAULT
) -> DataFrame:
    """One row per patient and a 0/1 column ``screened_<domain>`` for each domain key."""
    key = domain_key(F.col(cols.domain))
    return (
        sdoh.where(F.col(cols.patient).isNotNull() & F.col(cols.domain).isNotNull())
        .groupBy(cols.patient)
        .agg(
            *[F.max((key == F.lit(d)).cast("int")).alias(f"screened_{d}") for d in domains]
        )
    )


def patient_rollup(enc: DataFrame, cols: CohortColumns = DEFAULT) -> DataFrame:
    """Encounters, flagged visits and admissions per patient."""

    def ones(name: str) -> Column:
        return F.count_if(as_number(enc, name) == 1)

    return (
        enc.where(F.col(cols.patient).isNotNull())
        .groupBy(cols.patient)
        .agg(
            F.count(cols.encounter).alias("total_encounters"),
            ones(cols.flag).alias("ed_visits"),
            ones(cols.admission).alias("hospital_admissions"),
            ones(cols.inpatient).alias("inpatient_admissions"),
        )
        .withColumn("any_ed", (F.col("ed_visits") > 0).cast("int"))
    )


def _screened_counts(enc: DataFrame, sdoh: DataFrame, cols: CohortColumns) -> DataFrame:
    """Per domain: patients and flagged patients on the screened and the other side.

    The other side is the total of all patients minus the screened side, so no
    patient x domain table is built. A patient's set of domains is no larger than
    the domain vocabulary, however many screenings the patient has.
    """
    domains = (
        sdoh.where(F.col(cols.patient).isNotNull() & F.col(cols.domain).isNotNull())
        .groupBy(cols.patient)
        .agg(F.collect_set(domain_key(F.col(cols.domain))).alias("_domains"))
    )
    patients = patient_rollup(enc, cols).select(cols.patient, "any_ed")
    counted = (
        patients.join(domains, cols.patient)
        # The null entry makes each patient count once in a row of totals.
        .select("any_ed", F.explode(F.array_append("_domains", F.lit(None))).alias("domain"))
        .groupBy("domain")
        .agg(F.count("*").alias("n_screened"), F.sum("any_ed").alias("ed_screened"))
    )
    # One row per domain from here on.
    everything = Window.partitionBy(F.lit(0))

    def total(name: str) -> Column:
        return F.max(F.when(F.col("domain").isNull(), F.col(name))).over(everything)

    return (
        counted.withColumn("n_not_screened", total("n_screened") - F.col("n_screened"))
        .withColumn("ed_not_screened", total("ed_screened") - F.col("ed_screened"))
        .where(F.col("domain").isNotNull())
    )


def screened_rates(
    enc: DataFrame,
    sdoh: DataFrame,
    cols: CohortColumns = DEFAULT,
    min_side: int = fv.MIN_SIDE_PATIENTS,
) -> DataFrame:
    """Share of patients with a flagged visit, screened against not screened."""
    counts = _screened_counts(enc, sdoh, cols).where(
        (F.col("n_screened") >= min_side) & (F.col("n_not_screened") >= min_side)
    )
    return counts.select(
        title_label(F.col("domain")).alias("domain"),
        round_even(F.col("ed_screened") / F.col("n_screened") * 100, 2).alias("ed_rate_screened"),
        round_even(F.col("ed_not_screened") / F.col("n_not_screened") * 100, 2).alias(
            "ed_rate_not_screened"
        ),
        "n_screened",
        "n_not_screened",
        "ed_screened",
        "ed_not_screened",
    )


def screened_rates_tested(
    enc: DataFrame,
    sdoh: DataFrame,
    cols: CohortColumns = DEFAULT,
    min_side: int = fv.MIN_SIDE_PATIENTS,
    alpha: float = fv.SIGNIFICANCE,
) -> DataFrame:
    """``screened_rates`` with Fisher's exact p-value; ``significant`` uses it unrounded."""
    rates = screened_rates(enc, sdoh, cols, min_side)
    table = rates.withColumns(
        {
            "_no": F.col("n_screened") - F.col("ed_screened"),
            "_not_no": F.col("n_not_screened") - F.col("ed_not_screened"),
        }
    )
    tested = fisher_exact(table, "ed_screened", "_no", "ed_not_screened", "_not_no", ["domain"])
    return tested.select(
        "domain",
        "ed_rate_screened",
        "ed_rate_not_screened",
        "n_screened",
        "n_not_screened",
        round_even(F.col("p_value"), 4).alias("p_value"),
        (F.col("p_value") < alpha).alias("significant"),
    )


def odds_ratios(tested: DataFrame) -> DataFrame:
    """Odds ratio of the rounded rates; null when the other side has no odds."""

    def odds(name: str) -> Column:
        rate = F.col(name) / 100
        return rate / (1 - rate + F.lit(1e-9))

    ratio = F.try_divide(odds("ed_rate_screened"), odds("ed_rate_not_screened"))
    return tested.withColumn("odds_ratio", round_even(ratio, 3))


# ---------------------------------------------------------------- question 2


def encounter_counts(enc: DataFrame, cols: CohortColumns = DEFAULT) -> DataFrame:
    return (
        enc.where(F.col(cols.patient).isNotNull())
        .groupBy(cols.patient)
        .agg(F.count(cols.encounter).alias("encounter_count"))
    )


def utilizer_threshold(
    counts: DataFrame, quantile: float = fv.UTILIZER_QUANTILE
) -> DataFrame:
    """One row: the interpolated quantile of encounters per patient.

    Patients are first counted per encounter count. N encounters have fewer than
    sqrt(2N) + 1 different counts, so what ``percentile`` holds is small.
    """
    sizes = counts.groupBy("encounter_count").agg(F.count("*").alias("_n"))
    return sizes.agg(
        F.percentile("encounter_count", F.lit(quantile), F.col("_n")).alias("threshold")
    )


def high_utilizers(
    enc: DataFrame, cols: CohortColumns = DEFAULT, quantile: float = fv.UTILIZER_QUANTILE
) -> DataFrame:
    """Encounter count per patient and ``is_high_utilizer`` (threshold included)."""
    counts = encounter_counts(enc, cols)
    threshold = utilizer_threshold(counts, quantile).scalar()
    return counts.withColumn(
        "is_high_utilizer", (F.col("encounter_count") >= threshold).cast("int")
    )


def domains_per_patient(sdoh: DataFrame, cols: CohortColumns = DEFAULT) -> DataFrame:
    """Sorted array of the distinct domains of each patient, as spelled, and its size."""
    return (
        sdoh.where(F.col(cols.patient).isNotNull())
        .groupBy(cols.patient)
        .agg(F.sort_array(F.collect_set(cols.domain)).alias("sdoh_domains"))
        .withColumn("n_sdoh_domains", F.size("sdoh_domains"))
    )


def utilizer_profile(
    enc: DataFrame,
    sdoh: DataFrame,
    cols: CohortColumns = DEFAULT,
    quantile: float = fv.UTILIZER_QUANTILE,
) -> DataFrame:
    patients = high_utilizers(enc, cols, quantile)
    domains = domains_per_patient(sdoh, cols)
    return (
        patients.join(domains, cols.patient, "left")
        .withColumn("n_sdoh_domains", F.coalesce("n_sdoh_domains", F.lit(0)))
        .withColumn("any_sdoh", (F.col("n_sdoh_domains") > 0).cast("int"))
    )


def tier_label(flag: Column) -> Column:
    return F.when(flag == 1, "High utilizer").otherwise("Regular")


def utilizer_summary(
    enc: DataFrame,
    sdoh: DataFrame,
    cols: CohortColumns = DEFAULT,
    quantile: float = fv.UTILIZER_QUANTILE,
) -> DataFrame:
    """Patients, mean encounters, mean domains and share screened for both tiers."""
    return (
        utilizer_profile(enc, sdoh, cols, quantile)
        .groupBy(tier_label(F.col("is_high_utilizer")).alias("is_high_utilizer"))
        .agg(
            F.count(cols.patient).alias("n_patients"),
            F.avg("encounter_count").alias("mean_encounters"),
            F.avg("n_sdoh_domains").alias("mean_sdoh_domains"),
            F.avg("any_sdoh").alias("pct_any_sdoh"),
        )
    )


def top_diagnoses(
    enc: DataFrame,
    diag: DataFrame,
    cols: CohortColumns = DEFAULT,
    quantile: float = fv.UTILIZER_QUANTILE,
    top_n: int = fv.TOP_DIAGNOSES,
) -> DataFrame:
    """Most frequent diagnosis groups among high utilizers.

    Encounters are counted per patient and diagnosis once; the patient totals
    and the diagnosis volumes both come from that smaller table.
    """
    per_patient = (
        enc.where(F.col(cols.patient).isNotNull())
        .groupBy(cols.patient, clean_key(enc, cols.diagnosis).alias("_diagnosis"))
        .agg(F.count("*").alias("_rows"), F.count(cols.encounter).alias("_encounters"))
    )
    counts = per_patient.groupBy(cols.patient).agg(
        F.sum("_encounters").alias("encounter_count")
    )
    threshold = utilizer_threshold(counts, quantile).scalar()
    high = counts.where(F.col("encounter_count") >= threshold).select(cols.patient)
    volumes = (
        per_patient.where(F.col("_diagnosis").isNotNull())
        .join(high, cols.patient, "left_semi")
        .groupBy("_diagnosis")
        .agg(F.sum("_rows").alias("_rows"))
    )
    groups = diag.select(
        as_number_key(diag, cols.diagnosis_key).alias("_diagnosis"), F.col(cols.group).alias("_group")
    ).where(F.col("_group").isNotNull())
    return (
        volumes.join(groups, "_diagnosis")
        .groupBy(F.col("_group").alias("diagnosis_group"))
        .agg(F.sum("_rows").alias("count"))
        .orderBy(F.desc("count"), "diagnosis_group")
        .limit(top_n)
    )


def capped_counts(
    enc: DataFrame, cols: CohortColumns = DEFAULT, cap: int = fv.ENCOUNTER_CAP
) -> DataFrame:
    return encounter_counts(enc, cols).select(
        F.least("encounter_count", F.lit(cap)).alias("encounter_count")
    )


# ---------------------------------------------------------------- question 3


def disambiguate_places(dept: DataFrame) -> DataFrame:
    """Name the two columns that a doubled ``location`` header leaves behind."""
    if "location__dup1" not in dept.columns:
        return dept
    return dept.withColumnsRenamed({"location": "city", "location__dup1": "county"})


def _screened_keys(sdoh: DataFrame, cols: CohortColumns) -> DataFrame:
    return sdoh.select(F.col(cols.encounter).alias("_key")).distinct().withColumn("_has", F.lit(1))


def area_summary(
    enc: DataFrame,
    sdoh: DataFrame,
    dept: DataFrame,
    cols: CohortColumns = DEFAULT,
    null_keys_match: bool = True,
) -> DataFrame:
    """Encounters, screened encounters and flagged visits per area, with rates.

    Encounters are summed per department before they meet the departments, so a
    department with a third of all encounters is one row in that join.
    """
    facts = enc.select(
        F.col(cols.encounter).alias("_encounter"),
        F.col(cols.department).alias("_department"),
        (as_number(enc, cols.flag) == 1).cast("int").alias("_flag"),
    )
    marked = facts.join(
        _screened_keys(sdoh, cols),
        same_key(F.col("_encounter"), F.col("_key"), null_keys_match),
        "left",
    )
    per_department = marked.groupBy("_department").agg(
        F.count("_encounter").alias("total_encounters"),
        F.count("_has").alias("sdoh_screened"),
        F.sum(F.coalesce("_flag", F.lit(0))).alias("ed_visits"),
    )
    dept = disambiguate_places(dept)
    areas = dept.where(F.col(cols.area).isNotNull()).select(
        F.col(cols.department).alias("_dept"), as_area(dept, cols).alias(cols.area)
    )
    totals = (
        per_department.join(
            areas, same_key(F.col("_department"), F.col("_dept"), null_keys_match)
        )
        .groupBy(cols.area)
        .agg(
            *[
                F.sum(n).cast("bigint").alias(n)
                for n in ("total_encounters", "sdoh_screened", "ed_visits")
            ]
        )
    )

    def rate(name: str) -> Column:
        return round_even(F.try_divide(F.col(name), F.col("total_encounters")) * 100, 2)

    return totals.withColumns(
        {"sdoh_screen_rate": rate("sdoh_screened"), "ed_rate": rate("ed_visits")}
    )


def as_area(dept: DataFrame, cols: CohortColumns) -> Column:
    return as_key_text(dept, cols.area)


def area_geography(
    areas: DataFrame, geo: DataFrame, cols: CohortColumns = DEFAULT
) -> DataFrame:
    """Coordinates for each area; areas without any stay."""
    places = geo.select(
        strip(F.col(cols.geo).cast("string")).alias(cols.geo), cols.lat, cols.lon
    )
    return areas.join(places, F.col(cols.area) == F.col(cols.geo), "left")


def busy_areas(areas: DataFrame, min_volume: int = fv.MIN_AREA_VOLUME) -> DataFrame:
    return areas.where(F.col("total_encounters") >= min_volume)


def area_medians(areas: DataFrame, min_volume: int = fv.MIN_AREA_VOLUME) -> DataFrame:
    """One row with the median rate and volume of the busy areas.

    Its input has one row per area, so what the two medians hold is small.
    """
    half = F.lit(0.5)
    return busy_areas(areas, min_volume).agg(
        F.percentile("sdoh_screen_rate", half).alias("median_sdoh_screen_rate"),
        F.percentile("total_encounters", half).alias("median_total_encounters"),
    )


def _medians_value(areas: DataFrame, min_volume: int) -> Column:
    return area_medians(areas, min_volume).select(F.struct("*")).scalar()


def underscreened_areas(
    areas: DataFrame, min_volume: int = fv.MIN_AREA_VOLUME
) -> DataFrame:
    """Busy areas below the median rate and above the median volume, both strictly."""
    medians = _medians_value(areas, min_volume)
    return (
        busy_areas(areas, min_volume)
        .where(
            (F.col("sdoh_screen_rate") < medians["median_sdoh_screen_rate"])
            & (F.col("total_encounters") > medians["median_total_encounters"])
        )
        .orderBy(F.desc("total_encounters"), areas.columns[0])
    )


def map_layer(
    areas: DataFrame, cols: CohortColumns = DEFAULT, min_volume: int = fv.MIN_AREA_VOLUME
) -> DataFrame:
    """Marker position, size and colour for each area with coordinates."""
    median = _medians_value(areas, min_volume)["median_sdoh_screen_rate"]
    return areas.dropna(subset=[cols.lat, cols.lon]).withColumns(
        {
            "radius": F.greatest(
                F.lit(3.0), F.least(F.lit(12.0), F.col("total_encounters") / 500)
            ),
            "color": F.when(F.col("sdoh_screen_rate") < median, "red").otherwise("blue"),
        }
    )


# ---------------------------------------------------------------- question 4


def cooccurrence(
    enc: DataFrame,
    sdoh: DataFrame,
    diag: DataFrame,
    cols: CohortColumns = DEFAULT,
    null_keys_match: bool = True,
) -> DataFrame:
    """Row pairs of diagnosis group and domain that share an encounter.

    Both sides are counted per encounter key before the join and the counts are
    multiplied, which gives the number of pairs without making them.
    """
    coded = enc.select(
        F.col(cols.encounter).alias("_encounter"),
        clean_key(enc, cols.diagnosis).alias("_diagnosis"),
    ).where(F.col("_diagnosis").isNotNull())
    coded = coded.groupBy("_encounter", "_diagnosis").agg(F.count("*").alias("_n"))
    groups = (
        diag.select(
            as_number_key(diag, cols.diagnosis_key).alias("_diagnosis"),
            F.col(cols.group).alias("groupname"),
        )
        .where(F.col("groupname").isNotNull() & F.col("_diagnosis").isNotNull())
        .groupBy("_diagnosis", "groupname")
        .agg(F.count("*").alias("_copies"))
    )
    left = coded.join(groups, "_diagnosis").select(
        "_encounter", "groupname", (F.col("_n") * F.col("_copies")).alias("_n")
    )
    right = (
        sdoh.where(F.col(cols.domain).isNotNull())
        .groupBy(
            F.col(cols.encounter).alias("_key"), strip(F.col(cols.domain)).alias("domain")
        )
        .agg(F.count("*").alias("_m"))
    )
    return (
        left.join(right, same_key(F.col("_encounter"), F.col("_key"), null_keys_match))
        .groupBy("groupname", "domain")
        .agg(F.sum(F.col("_n") * F.col("_m")).alias("count"))
    )


def top_groups(cells: DataFrame, top_n: int = fv.TOP_DIAGNOSES) -> DataFrame:
    return _keep_top(cells, "groupname", top_n)


def _keep_top(cells: DataFrame, key: str, top_n: int) -> DataFrame:
    best = (
        cells.groupBy(key)
        .agg(F.sum("count").alias("_total"))
        .orderBy(F.desc("_total"), key)
        .limit(top_n)
        .select(key)
    )
    return cells.join(best, key, "left_semi")


def row_percent(cells: DataFrame) -> DataFrame:
    """Share of each domain within its group, in long form with zero cells.

    Input is the cell table: a group's map holds one entry per domain.
    """
    vocabulary = cells.agg(F.sort_array(F.collect_set("domain"))).scalar()
    per_group = cells.groupBy("groupname").agg(
        F.sum("count").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("domain", "count"))).alias("_cells"),
    )
    return per_group.select(
        "groupname", "_total", "_cells", F.explode(vocabulary).alias("domain")
    ).select(
        "groupname",
        "domain",
        (F.coalesce(F.col("_cells")[F.col("domain")], F.lit(0)) / F.col("_total") * 100).alias(
            "pct"
        ),
    )


def row_percent_wide(long: DataFrame) -> DataFrame:
    """One column per domain of the long form; the vocabulary is collected."""
    domains = [r["domain"] for r in long.select("domain").distinct().orderBy("domain").collect()]
    return long.groupBy("groupname").pivot("domain", domains).agg(F.first("pct"))


def top_domain(long: DataFrame) -> DataFrame:
    """The domain with the largest share per group; ties go to the first name."""
    best = F.min(F.struct((-F.col("pct")).alias("neg"), F.col("domain")))
    return (
        long.groupBy(F.col("groupname").alias("diagnosis_group"))
        .agg(best.alias("_best"))
        .select(
            "diagnosis_group",
            F.col("_best.domain").alias("top_sdoh_domain"),
            round_even(-F.col("_best.neg"), 2).alias("top_sdoh_pct"),
        )
        .orderBy(F.desc("top_sdoh_pct"), "diagnosis_group")
    )


# ---------------------------------------------------------------- question 5


def in_years(
    enc: DataFrame, years: tuple[int, int] = fv.YEAR_WINDOW, cols: CohortColumns = DEFAULT
) -> DataFrame:
    """Encounter keys with a year inside the window, both ends included."""
    year = as_number(enc, cols.year)
    return enc.where(year.between(*years)).select(
        F.col(cols.encounter).alias("_encounter"), year.cast("int").alias("admityear")
    )


def yearly_domains(
    enc: DataFrame,
    sdoh: DataFrame,
    years: tuple[int, int] = fv.YEAR_WINDOW,
    cols: CohortColumns = DEFAULT,
    null_keys_match: bool = True,
) -> DataFrame:
    """Screenings by year and domain; counted per encounter key on both sides first."""
    left = in_years(enc, years, cols).groupBy("_encounter", "admityear").agg(
        F.count("*").alias("_n")
    )
    right = (
        sdoh.where(F.col(cols.domain).isNotNull())
        .groupBy(F.col(cols.encounter).alias("_key"), strip(F.col(cols.domain)).alias("domain"))
        .agg(F.count("*").alias("_m"))
    )
    return (
        right.join(left, same_key(F.col("_encounter"), F.col("_key"), null_keys_match))
        .groupBy("admityear", "domain")
        .agg(F.sum(F.col("_n") * F.col("_m")).alias("count"))
    )


def top_domains(trend: DataFrame, top_n: int = fv.TOP_DOMAINS) -> DataFrame:
    return _keep_top(trend, "domain", top_n)


def yearly_rate(
    enc: DataFrame,
    sdoh: DataFrame,
    years: tuple[int, int] = fv.YEAR_WINDOW,
    cols: CohortColumns = DEFAULT,
    null_keys_match: bool = True,
) -> DataFrame:
    """Share of encounters with a screening, by year."""
    marked = in_years(enc, years, cols).join(
        _screened_keys(sdoh, cols),
        same_key(F.col("_encounter"), F.col("_key"), null_keys_match),
        "left",
    )
    counted = marked.groupBy("admityear").agg(
        F.count("_encounter").alias("total"), F.count("_has").alias("screened")
    )
    return counted.withColumn(
        "screen_rate_pct",
        round_even(F.try_divide(F.col("screened"), F.col("total")) * 100, 2),
    )


def yearly_growth(trend: DataFrame) -> DataFrame:
    """Growth over the previous year present for the domain; null for the first."""
    w = Window.partitionBy("domain").orderBy("admityear")
    before = F.lag("count").over(w)
    growth = F.try_divide(F.col("count") - before, before) * 100
    return trend.withColumn("yoy_growth_pct", round_even(growth, 1))
