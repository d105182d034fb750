"""SQL that gives the same rows as each registered query, for an independent engine.

The texts use only the raw tables. Doubles are rounded half to even as in the
registry. Queries without an entry have no SQL form (fitted models, hash splits).
"""

from __future__ import annotations

VIEWS = {
    "enc": """
SELECT o_custkey AS patientdurablekey, o_orderkey AS encounterkey,
       CAST(o_orderpriority = '1-URGENT' AS INT) AS isedvisit,
       CAST(o_orderstatus = 'F' AS INT) AS ishospitaladmission,
       CAST(o_orderpriority = '2-HIGH' AS INT) AS isinpatientadmission,
       CAST(o_orderpriority = '3-MEDIUM' AS INT) AS isobservation,
       coalesce(k.pk, -1) AS primarydiagnosiskey, k.sk AS departmentkey,
       year(o_orderdate) AS admityear
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) pk, min(l_suppkey) sk
                       FROM lineitem GROUP BY l_orderkey) k ON k.l_orderkey = o_orderkey""",
    "sdoh": """
SELECT o_custkey AS patientdurablekey, p_type AS domain, l_linestatus AS answertext,
       l_orderkey AS encounterkey
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "diag": "SELECT p_partkey AS diagnosiskey, p_brand AS groupname FROM part",
    "dept": """
SELECT s_suppkey AS departmentkey, CAST(s_nationkey AS DOUBLE) AS censustract,
       CASE WHEN s_acctbal > 5000 THEN 'A' ELSE 'B' END AS departmenttype FROM supplier""",
    "tiger": """
SELECT CAST(n_nationkey AS VARCHAR) AS geoid, CAST(n_nationkey * 2 AS DOUBLE) AS centlat,
       CAST(n_regionkey * 30 AS DOUBLE) AS centlon FROM nation WHERE n_nationkey <> 7""",
    "people": """
SELECT c_custkey AS person_id, 1930 + c_custkey % 80 AS birth_year,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS income,
       CASE c_mktsegment WHEN 'BUILDING' THEN ' Unemployed' WHEN 'FURNITURE' THEN 'jobless'
            ELSE 'employed' END AS employment_status,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'Uninsured' ELSE 'private' END AS insurance_status,
       CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS housing_instability FROM customer""",
    "featured": """
SELECT person_id, CAST(birth_year AS DOUBLE) AS birth_year, income, employment_status,
       insurance_status, CAST(housing_instability = 'Yes' AS INT) AS housing_instability,
       2026.0 - birth_year AS age,
       CASE WHEN 2026 - birth_year BETWEEN 0 AND 18 THEN '0-18'
            WHEN 2026 - birth_year <= 25 THEN '19-25' WHEN 2026 - birth_year <= 35 THEN '26-35'
            WHEN 2026 - birth_year <= 50 THEN '36-50' WHEN 2026 - birth_year <= 65 THEN '51-65'
            WHEN 2026 - birth_year <= 120 THEN '66+' END AS age_group,
       CAST(coalesce(income < (SELECT quantile_cont(income, 0.5) FROM people), false) AS INT)
           AS low_income,
       CAST(lower(trim(employment_status))
            IN ('unemployed', 'not employed', 'jobless', 'none') AS INT) AS unemployed,
       CAST(lower(trim(insurance_status))
            IN ('none', 'no', 'uninsured', 'no insurance') AS INT) AS no_health_insurance
FROM people""",
    "scored": """
SELECT *, CAST(low_income + housing_instability + unemployed + no_health_insurance AS DOUBLE)
           AS social_determinant_score,
       CAST(low_income + housing_instability + unemployed + no_health_insurance >= 2 AS INT)
           AS high_social_determinant_burden
FROM featured""",
    "graded": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality AS target
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "orders_nulled": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders""",
    "rel": """
SELECT l_quantity AS qty,
       CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_quantity * 2 + l_linenumber END AS load_units,
       CASE WHEN l_orderkey % 13 = 0 THEN NULL WHEN l_quantity < 17 THEN 'low'
            WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS tier,
       CASE WHEN l_quantity + l_linenumber > 28 THEN 1 ELSE 0 END AS is_bulk,
       year(l_shipdate) AS ship_year, CAST(l_shipdate AS DATE) AS ship_date,
       (year(l_shipdate) - 1990) * 3 + l_linenumber AS drift, l_tax, l_linestatus
FROM lineitem""",
}
NEEDS = {"featured": ["people"], "scored": ["people", "featured"]}


def r(x: str, digits: int = 4) -> str:
    # Adding zero turns -0.0 into 0.0.
    return f"(round_even(CAST({x} AS DOUBLE), {digits}) + 0.0e0)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def sql(body: str, *views: str, **steps: str) -> str:
    """A SELECT with the needed views and further named steps in front."""
    names: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in steps.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ cohort

PATIENTS = """
SELECT patientdurablekey, count(encounterkey) AS total_encounters,
       count(*) FILTER (isedvisit = 1) AS ed_visits,
       count(*) FILTER (ishospitaladmission = 1) AS hospital_admissions,
       count(*) FILTER (isinpatientadmission = 1) AS inpatient_admissions,
       CAST(count(*) FILTER (isedvisit = 1) > 0 AS INT) AS any_ed
FROM enc WHERE patientdurablekey IS NOT NULL GROUP BY 1"""
PAIRS = """
SELECT DISTINCT patientdurablekey, lower(replace(trim(domain), ' ', '_')) AS domain
FROM sdoh WHERE patientdurablekey IS NOT NULL AND domain IS NOT NULL"""
SIDES = """
SELECT domain, count(*) AS n_screened, CAST(sum(any_ed) AS BIGINT) AS ed_screened,
       (SELECT count(*) FROM patients WHERE patientdurablekey IN (SELECT patientdurablekey FROM pairs))
           - count(*) AS n_not_screened,
       CAST((SELECT sum(any_ed) FROM patients
             WHERE patientdurablekey IN (SELECT patientdurablekey FROM pairs)) - sum(any_ed) AS BIGINT)
           AS ed_not_screened
FROM pairs JOIN patients USING (patientdurablekey) GROUP BY domain"""
RATES = f"""
SELECT upper(domain[1]) || lower(domain[2:]) AS domain,
       {r('ed_screened * 1.0e0 / n_screened * 100', 2)} AS ed_rate_screened,
       {r('ed_not_screened * 1.0e0 / n_not_screened * 100', 2)} AS ed_rate_not_screened,
       n_screened, n_not_screened, ed_screened, ed_not_screened
FROM sides WHERE n_screened >= 30 AND n_not_screened >= 30"""
TERMS = """
SELECT domain, x, lgamma(n_screened + 1) + lgamma(n_not_screened + 1)
       + lgamma(ed_screened + ed_not_screened + 1)
       + lgamma(n_screened + n_not_screened - ed_screened - ed_not_screened + 1)
       - lgamma(n_screened + n_not_screened + 1)
       - lgamma(x + 1) - lgamma(n_screened - x + 1)
       - lgamma(ed_screened + ed_not_screened - x + 1)
       - lgamma(n_not_screened - (ed_screened + ed_not_screened) + x + 1) AS ln, ed_screened
FROM (SELECT *, unnest(range(greatest(0, ed_screened + ed_not_screened - n_not_screened),
                             least(n_screened, ed_screened + ed_not_screened) + 1)) AS x FROM rates)"""
PVALUES = """
SELECT domain, least(1.0, sum(exp(ln)) FILTER (ln <= obs + ln(1 + 1e-7))) AS p
FROM (SELECT *, max(ln) FILTER (x = ed_screened) OVER (PARTITION BY domain) AS obs FROM terms)
GROUP BY domain"""
TESTED = f"""
SELECT domain, ed_rate_screened, ed_rate_not_screened, n_screened, n_not_screened,
       {r('p')} AS p_value, p < 0.05 AS significant
FROM rates JOIN pvalues USING (domain)"""
ORACLES["rq1_patient_rollup"] = sql(PATIENTS, "enc")
ORACLES["rq1_domain_pairs"] = sql(PAIRS, "sdoh")
ORACLES["rq1_domain_matrix"] = sql(
    "SELECT patientdurablekey, "
    + ", ".join(
        f"CAST(max(CASE WHEN lower(trim(domain)) = '{n}' THEN 1 ELSE 0 END) AS INT) AS screened_{n}"
        for n in ("economy", "large", "medium", "promo", "small", "standard")
    )
    + " FROM sdoh GROUP BY 1",
    "sdoh",
)
_rq1 = {"patients": PATIENTS, "pairs": PAIRS, "sides": SIDES, "rates": RATES}
ORACLES["rq1_rates"] = sql("SELECT * FROM rates", "enc", "sdoh", **_rq1)
_rq1t = {**_rq1, "terms": TERMS, "pvalues": PVALUES, "tested": TESTED}
ORACLES["rq1_rates_fisher"] = sql("SELECT * FROM tested", "enc", "sdoh", **_rq1t)
ORACLES["rq1_odds"] = sql(
    f"""SELECT domain, {r('''(ed_rate_screened / 100 / (1 - ed_rate_screened / 100 + 1e-9))
        / nullif(ed_rate_not_screened / 100 / (1 - ed_rate_not_screened / 100 + 1e-9), 0)''', 3)}
        AS odds_ratio FROM tested""",
    "enc", "sdoh", **_rq1t,
)

COUNTS = """
SELECT patientdurablekey, count(encounterkey) AS encounter_count FROM enc
WHERE patientdurablekey IS NOT NULL GROUP BY 1"""
HIGH = """
SELECT *, CAST(encounter_count >= (SELECT quantile_cont(encounter_count, 0.9) FROM counts) AS INT)
       AS is_high_utilizer FROM counts"""
OWN = """
SELECT patientdurablekey, string_agg(DISTINCT domain, ',' ORDER BY domain) AS sdoh_domains,
       CAST(count(DISTINCT domain) AS INT) AS n_sdoh_domains
FROM sdoh WHERE patientdurablekey IS NOT NULL GROUP BY 1"""
ORACLES["rq2_threshold"] = sql(
    f"SELECT {r('quantile_cont(encounter_count, 0.9)')} AS threshold FROM counts", "enc", counts=COUNTS
)
ORACLES["rq2_high_utilizers"] = sql(HIGH, "enc", counts=COUNTS)
ORACLES["rq2_patient_domains"] = sql(OWN, "sdoh")
ORACLES["rq2_tier_summary"] = sql(
    f"""SELECT CASE is_high_utilizer WHEN 1 THEN 'High utilizer' ELSE 'Regular' END AS is_high_utilizer,
       count(*) AS n_patients, {r('avg(encounter_count)')} AS mean_encounters,
       {r('avg(coalesce(n_sdoh_domains, 0))')} AS mean_sdoh_domains,
       {r('avg(CAST(coalesce(n_sdoh_domains, 0) > 0 AS INT))')} AS pct_any_sdoh
    FROM high LEFT JOIN own USING (patientdurablekey) GROUP BY 1""",
    "enc", "sdoh", counts=COUNTS, high=HIGH, own=OWN,
)
ORACLES["rq2_top_diagnoses"] = sql(
    """SELECT groupname AS diagnosis_group, count(*) AS count
    FROM enc JOIN diag ON primarydiagnosiskey = diagnosiskey
    WHERE primarydiagnosiskey <> -1 AND groupname IS NOT NULL
      AND patientdurablekey IN (SELECT patientdurablekey FROM high WHERE is_high_utilizer = 1)
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    "enc", "diag", counts=COUNTS, high=HIGH,
)


def histogram(source: str, column: str, bins: int, label: str | None = None) -> str:
    """Bins by edge comparison: a value is in the last bin whose lower edge it reaches."""
    named = f"'{label}' AS \"column\", " if label else ""
    return f"""SELECT {named}b AS bin, {r('lo + b * step')} AS bin_from,
       {r(f'CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * step END')} AS bin_to,
       (SELECT count(*) FROM {source} WHERE "{column}" IS NOT NULL
          AND (b = 0 OR "{column}" >= lo + b * step)
          AND (b = {bins - 1} OR "{column}" < lo + (b + 1) * step)) AS count
    FROM (SELECT lo, hi, (hi - lo) / {bins} AS step FROM
            (SELECT CASE WHEN a = z THEN a - 0.5e0 ELSE a END AS lo,
                    CASE WHEN a = z THEN z + 0.5e0 ELSE z END AS hi
             FROM (SELECT CAST(min("{column}") AS DOUBLE) AS a, CAST(max("{column}") AS DOUBLE) AS z
                   FROM {source}))),
         (SELECT unnest(range({bins})) AS b)"""


ORACLES["rq2_capped_hist"] = sql(
    histogram("capped", "n", 80), "enc", counts=COUNTS,
    capped="SELECT least(encounter_count, 200) AS n FROM counts",
)

AREAS = f"""
SELECT CAST(CAST(censustract AS BIGINT) AS VARCHAR) AS censustract,
       count(e.encounterkey) AS total_encounters, {big('sum(has)')} AS sdoh_screened,
       count(*) FILTER (isedvisit = 1) AS ed_visits,
       {r('sum(has) * 1.0e0 / count(e.encounterkey) * 100', 2)} AS sdoh_screen_rate,
       {r('count(*) FILTER (isedvisit = 1) * 1.0e0 / count(e.encounterkey) * 100', 2)} AS ed_rate
FROM (SELECT e.*, CASE WHEN s.k IS NULL THEN 0 ELSE 1 END AS has
      FROM enc e LEFT JOIN (SELECT DISTINCT encounterkey AS k FROM sdoh) s
      ON e.encounterkey IS NOT DISTINCT FROM s.k) e
JOIN dept d ON e.departmentkey IS NOT DISTINCT FROM d.departmentkey
WHERE censustract IS NOT NULL GROUP BY 1"""
GEO = "SELECT * FROM areas LEFT JOIN tiger ON geoid = censustract"
MEDIANS = """
SELECT quantile_cont(sdoh_screen_rate, 0.5) AS r, quantile_cont(total_encounters, 0.5) AS v
FROM areas WHERE total_encounters >= 50"""
_rq3 = {"areas": AREAS}
ORACLES["rq3_area_summary"] = sql("SELECT * FROM areas", "enc", "sdoh", "dept", **_rq3)
ORACLES["rq3_geo"] = sql(GEO, "enc", "sdoh", "dept", "tiger", **_rq3)
ORACLES["rq3_volume_and_rate"] = sql(
    "SELECT * FROM areas WHERE total_encounters >= 50", "enc", "sdoh", "dept", **_rq3
)
ORACLES["rq3_area_medians"] = sql(
    f"SELECT {r('r')} AS median_sdoh_screen_rate, {r('v')} AS median_total_encounters FROM m",
    "enc", "sdoh", "dept", **_rq3, m=MEDIANS,
)
ORACLES["rq3_underscreened"] = sql(
    """SELECT areas.* FROM areas, m
    WHERE total_encounters >= 50 AND sdoh_screen_rate < r AND total_encounters > v""",
    "enc", "sdoh", "dept", **_rq3, m=MEDIANS,
)
ORACLES["rq3_map_layer"] = sql(
    f"""SELECT geo.*, {r('greatest(3.0e0, least(12.0e0, total_encounters / 500.0e0))')} AS radius,
       CASE WHEN sdoh_screen_rate < r THEN 'red' ELSE 'blue' END AS color
    FROM geo, m WHERE centlat IS NOT NULL AND centlon IS NOT NULL""",
    "enc", "sdoh", "dept", "tiger", **_rq3, geo=GEO, m=MEDIANS,
)

CELLS = """
SELECT groupname, trim(domain) AS domain, count(*) AS count
FROM enc JOIN diag ON primarydiagnosiskey = diagnosiskey
JOIN sdoh ON sdoh.encounterkey IS NOT DISTINCT FROM enc.encounterkey
WHERE primarydiagnosiskey <> -1 AND groupname IS NOT NULL AND domain IS NOT NULL GROUP BY 1, 2"""
KEPT = """
SELECT * FROM cells WHERE groupname IN
  (SELECT groupname FROM cells GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 15)"""
SHARE = """
SELECT g.groupname, d.domain, coalesce(k.count, 0) * 1.0e0 / g.total * 100 AS pct
FROM (SELECT groupname, sum(count) AS total FROM kept GROUP BY 1) g
CROSS JOIN (SELECT DISTINCT domain FROM kept) d LEFT JOIN kept k USING (groupname, domain)"""
_rq4 = {"cells": CELLS, "kept": KEPT, "share": SHARE}
ORACLES["rq4_cooccurrence"] = sql("SELECT * FROM cells", "enc", "sdoh", "diag", **_rq4)
ORACLES["rq4_top_groups"] = sql("SELECT * FROM kept", "enc", "sdoh", "diag", **_rq4)
ORACLES["rq4_row_pct"] = sql(
    f"SELECT groupname, domain, {r('pct')} AS pct FROM share", "enc", "sdoh", "diag", **_rq4
)
ORACLES["rq4_row_pct_wide"] = sql(
    "SELECT groupname, "
    + ", ".join(
        f"{r(f'''max(pct) FILTER (domain = '{n}')''')} AS \"{n}\""
        for n in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    + " FROM share GROUP BY 1",
    "enc", "sdoh", "diag", **_rq4,
)
ORACLES["rq4_top_domain"] = sql(
    f"""SELECT groupname AS diagnosis_group, domain AS top_sdoh_domain, {r('pct', 2)} AS top_sdoh_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY groupname ORDER BY pct DESC, domain) AS k FROM share)
    WHERE k = 1""",
    "enc", "sdoh", "diag", **_rq4,
)

TREND = """
SELECT admityear, trim(domain) AS domain, count(*) AS count
FROM sdoh JOIN enc ON sdoh.encounterkey IS NOT DISTINCT FROM enc.encounterkey
WHERE admityear BETWEEN 1995 AND 2001 AND domain IS NOT NULL GROUP BY 1, 2"""


def top_trend(n: int) -> str:
    return f"""SELECT * FROM trend WHERE domain IN
      (SELECT domain FROM trend GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT {n})"""


ORACLES["rq5_trend"] = sql(
    "SELECT CAST(admityear AS INT) AS admityear, domain, count FROM trend", "enc", "sdoh", trend=TREND
)
ORACLES["rq5_top_domains"] = sql(
    "SELECT CAST(admityear AS INT) AS admityear, domain, count FROM kept",
    "enc", "sdoh", trend=TREND, kept=top_trend(4),
)
ORACLES["rq5_rate_by_year"] = sql(
    f"""SELECT CAST(admityear AS INT) AS admityear, count(e.encounterkey) AS total, count(s.one) AS screened,
       {r('count(s.one) * 1.0e0 / count(e.encounterkey) * 100', 2)} AS screen_rate_pct
    FROM enc e LEFT JOIN (SELECT DISTINCT encounterkey AS k, 1 AS one FROM sdoh) s
      ON e.encounterkey IS NOT DISTINCT FROM s.k
    WHERE admityear BETWEEN 1995 AND 2001 GROUP BY 1""",
    "enc", "sdoh",
)
ORACLES["rq5_yoy"] = sql(
    f"""SELECT CAST(admityear AS INT) AS admityear, domain, count,
       {r('(count - before) * 1.0e0 / before * 100', 1)} AS yoy_growth_pct
    FROM (SELECT *, lag(count) OVER (PARTITION BY domain ORDER BY admityear) AS before FROM kept)""",
    "enc", "sdoh", trend=TREND, kept=top_trend(8),
)
ORACLES["chosen_questions"] = sql(
    """SELECT 'q1_ed_rate_by_domain' AS result, (SELECT count(*) FROM rates) AS rows
    UNION ALL SELECT 'q1_ed_odds_by_domain', (SELECT count(*) FROM rates)
    UNION ALL SELECT 'q3_areas', (SELECT count(*) FROM geo)
    UNION ALL SELECT 'q3_volume_and_rate', (SELECT count(*) FROM geo WHERE total_encounters >= 50)
    UNION ALL SELECT 'q3_underscreened', (SELECT count(*) FROM geo, m WHERE total_encounters >= 50
                                          AND sdoh_screen_rate < r AND total_encounters > v)
    UNION ALL SELECT 'q3_map_layer', (SELECT count(*) FROM geo WHERE centlat IS NOT NULL)
    UNION ALL SELECT 'q5_rate_by_year', (SELECT count(DISTINCT admityear) FROM enc
                                         WHERE admityear BETWEEN 1995 AND 2001)
    UNION ALL SELECT 'q5_growth_by_domain', (SELECT count(*) FROM kept)""",
    "enc", "sdoh", "dept", "tiger", **_rq1, **_rq3, geo=GEO, m=MEDIANS, trend=TREND, kept=top_trend(8),
)

# ----------------------------------------------------------------- profile

# Column names of the raw tables; N marks a numeric column.
RAW = {
    "region": "r_regionkey:N r_name",
    "nation": "n_nationkey:N n_name n_regionkey:N",
    "customer": "c_custkey:N c_name c_nationkey:N c_acctbal:N c_mktsegment",
    "supplier": "s_suppkey:N s_name s_nationkey:N s_acctbal:N",
    "part": "p_partkey:N p_name p_brand p_type p_size:N p_retailprice:N",
    "orders": "o_orderkey:N o_custkey:N o_orderstatus o_totalprice:N o_orderdate o_orderpriority",
    "lineitem": "l_orderkey:N l_partkey:N l_suppkey:N l_linenumber:N l_quantity:N "
    "l_extendedprice:N l_discount:N l_tax:N l_returnflag l_linestatus l_shipdate",
    "events": "event_id:N ts user_id:N event_type value:N props",
    "documents": "doc_id:N text lang source n_chars:N",
    "embeddings": "vec_id:N embedding label:N",
    "pages": "page_id:N url html",
    "benchmark": "item_id:N text",
    "labels": "doc_id:N quality:N toxic:N",
    "conversations": "conv_id:N turn:N role text",
}


def names(table: str) -> list[tuple[str, bool]]:
    return [(c.split(":")[0], c.endswith(":N")) for c in RAW[table].split()]


SHAPE = " UNION ALL ".join(
    f"SELECT '{x}' AS dataset, count(*) AS rows, {big(len(names(x)))} AS columns FROM {x}" for x in RAW
)
ORACLES["profile_shape"] = SHAPE
ORACLES["largest_dataset"] = f"SELECT * FROM ({SHAPE}) ORDER BY rows DESC, dataset LIMIT 1"
ORACLES["profile_missing"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        f"{r(f'(count(*) - count({c})) * 100.0e0 / count(*)')} AS missing_percent FROM orders_nulled"
        for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
    "orders_nulled",
)
ORACLES["profile_duplicates"] = f"""
SELECT {big('sum(n)')} AS rows, {big('sum(n - 1)')} AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
ORACLES["profile_duplicates_full_rows"] = f"""
SELECT {big('sum(n)')} AS rows, {big('sum(n - 1)')} AS duplicate_rows
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)"""
ORACLES["sample_rows"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"
_owners: dict[str, list[str]] = {}
for _t in RAW:
    for _c, _ in names(_t):
        _owners.setdefault(_c, []).append(_t)
_shared: dict[tuple[str, str], list[str]] = {}
for _c, _ts in _owners.items():
    for _a in _ts:
        for _b in _ts:
            if _a < _b:
                _shared.setdefault((_a, _b), []).append(_c)
ORACLES["shared_columns"] = " UNION ALL ".join(
    f"SELECT '{a}' AS dataset_a, '{b}' AS dataset_b, '{','.join(sorted(c))}' AS shared_columns, "
    f"{big(len(c))} AS n_shared, (SELECT count(*) FROM {a}) AS rows_a, (SELECT count(*) FROM {b}) AS rows_b"
    for (a, b), c in _shared.items()
)
ORACLES["numeric_split"] = " UNION ALL ".join(
    f"SELECT '{x}' AS dataset, {big(sum(n for _, n in names(x)))} AS numeric_columns, "
    f"{big(sum(not n for _, n in names(x)))} AS other_columns, count(*) AS rows FROM {x}"
    for x in RAW
)


def describe(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean,
        {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS p25,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)')} AS p50,
        {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS p75, {r(f'max({c})')} AS max FROM {source}"""
        for c in columns
    )


ORACLES["describe_numeric"] = describe("lineitem", [c for c, n in names("lineitem") if n])
ORACLES["describe_with_missing"] = sql(
    describe("orders_nulled", ["o_orderkey", "o_totalprice"]), "orders_nulled"
)
ORACLES["distinct_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem"
    for c, _ in names("lineitem")
)
ORACLES["value_counts_top"] = sql(
    """SELECT coalesce(o_orderstatus, 'nan') AS value, count(*) AS count FROM orders_nulled
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "orders_nulled",
)
ORACLES["value_counts_limited"] = sql(
    """SELECT o_orderstatus AS value, count(*) AS count FROM orders_nulled
    WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "orders_nulled",
)
ORACLES["value_counts_too_many"] = """
SELECT c_name AS value, count(*) AS count FROM customer
WHERE (SELECT count(DISTINCT c_name) FROM customer) <= 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""

# ------------------------------------------------------------------- roles


def stats(source: str, dataset: str, columns: dict[str, str]) -> str:
    """One row per column with what the role rules need."""
    rows = []
    for i, (c, kind) in enumerate(columns.items()):
        beyond = f"count(*) FILTER ({c} NOT IN (0, 1))" if kind == "number" else "0"
        rows.append(
            f"SELECT '{dataset}' AS dataset, '{c}' AS \"column\", {i} AS position, '{kind}' AS kind, "
            f"count(*) AS rows, count(*) - count({c}) AS missing, count({c}) AS present, "
            f"count(DISTINCT {c}) AS distinct_n, {beyond} AS beyond FROM {source}"
        )
    return " UNION ALL ".join(rows)


ROLES = """
SELECT *, CASE WHEN missing_percent > 60 THEN 'too_much_missingness'
               WHEN distinct_n <= 1 THEN 'no_variation'
               WHEN role IN ('identifier', 'text') THEN role END AS exclusion_reason
FROM (SELECT *, missing * 100.0e0 / rows AS missing_percent,
        CASE WHEN "column" = 'id' OR "column" LIKE '%\\_id' ESCAPE '\\' OR "column" LIKE '%identifier%'
               OR (present > 0 AND distinct_n * 1.0e0 / present > 0.95 AND distinct_n > 20)
               THEN 'identifier'
             WHEN "column" LIKE '%year%' THEN 'year_like'
             WHEN "column" LIKE '%date%' OR "column" LIKE '%time%' OR "column" LIKE '%month%'
               OR kind = 'time' THEN 'time_like'
             WHEN kind = 'number' AND present > 0 AND beyond = 0 THEN 'binary'
             WHEN kind = 'number' AND distinct_n <= 10 THEN 'numeric_discrete'
             WHEN kind = 'number' THEN 'numeric_continuous'
             WHEN distinct_n > 50 THEN 'text' WHEN distinct_n <= 20 THEN 'categorical'
             ELSE 'text' END AS role
      FROM stats)"""
ORDERS_COLUMNS = {
    "o_orderkey": "number", "o_orderstatus": "text", "o_totalprice": "number",
    "o_orderdate": "time", "o_orderpriority": "text",
}
REL_COLUMNS = {
    "qty": "number", "load_units": "number", "tier": "text", "is_bulk": "number",
    "ship_year": "number", "ship_date": "time", "drift": "number", "l_tax": "number",
    "l_linestatus": "text",
}
DOCUMENT_COLUMNS = {
    "doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"
}
ROLE_FIELDS = f"""dataset, "column", kind, rows, missing, {r('missing_percent')} AS missing_percent,
    role, exclusion_reason IS NULL AS usable, exclusion_reason"""
ORACLES["column_roles"] = sql(
    f"SELECT {ROLE_FIELDS} FROM roles", "orders_nulled",
    stats=stats("orders_nulled", "orders_nulled", ORDERS_COLUMNS), roles=ROLES,
)
_planted = {"stats": stats("rel", "planted", REL_COLUMNS), "roles": ROLES}
ORACLES["column_roles_planted"] = sql(
    f'SELECT {ROLE_FIELDS}, distinct_n AS "distinct" FROM roles', "rel", **_planted
)
ORACLES["usable_columns"] = sql(
    'SELECT "column", role, exclusion_reason IS NULL AS usable, exclusion_reason FROM roles',
    stats=stats("documents", "documents", DOCUMENT_COLUMNS), roles=ROLES,
)
PAIR_METHOD = """CASE
    WHEN a.role LIKE 'numeric%' AND b.role LIKE 'numeric%' AND a.position < b.position THEN 'numeric_numeric'
    WHEN a.role = 'categorical' AND b.role = 'binary' THEN 'categorical_binary'
    WHEN a.role = 'binary' AND b.role LIKE 'numeric%' THEN 'binary_numeric'
    WHEN a.role = 'categorical' AND b.role LIKE 'numeric%' THEN 'categorical_numeric'
    WHEN a.role IN ('year_like', 'time_like') AND b.role LIKE 'numeric%' THEN 'time_numeric' END"""
ORACLES["candidate_pairs"] = sql(
    f"""SELECT * FROM (SELECT a.dataset, {PAIR_METHOD} AS method, a."column" AS column_a,
        b."column" AS column_b FROM roles a JOIN roles b ON a.dataset = b.dataset
        WHERE a.exclusion_reason IS NULL AND b.exclusion_reason IS NULL) WHERE method IS NOT NULL""",
    "rel", **_planted,
)

# ----------------------------------------------------------- relationships

NUMERIC = ["qty", "load_units", "drift", "l_tax"]
STRENGTH = """CASE WHEN abs(c) >= 0.7 THEN 'very strong' WHEN abs(c) >= 0.5 THEN 'strong'
    WHEN abs(c) >= 0.3 THEN 'moderate' WHEN abs(c) >= 0.15 THEN 'weak' ELSE 'very weak' END"""


def correlations(source: str, pairs: list[tuple[str, str, str]]) -> str:
    """(left name, left expression, right name) pairs: rows and correlation."""
    if not pairs:
        return "SELECT '' AS column_a, '' AS column_b, 0 AS rows_used, 0.0e0 AS c WHERE false"
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
        count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS rows_used,
        corr(CAST({x} AS DOUBLE), CAST({b} AS DOUBLE)) AS c FROM {source}"""
        for a, x, b in pairs
    )


def correlation_findings(up: str, down: str, low: float = 0.15) -> str:
    return f"""SELECT column_a, column_b, rows_used, {r('abs(c)')} AS score, {r('c')} AS metric_value,
       {STRENGTH} AS strength_label, CASE WHEN c > 0 THEN '{up}' ELSE '{down}' END AS direction
    FROM m WHERE rows_used >= 15 AND NOT isnan(c) AND abs(c) >= {low}"""


NUM_PAIRS = [(a, a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]
TIME_PAIRS = [("ship_year", "ship_year", b) for b in NUMERIC] + [
    ("ship_date", "datediff('day', DATE '1970-01-01', ship_date)", b) for b in NUMERIC
]
_raw = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
RAW_PAIRS = [(a, a, b) for i, a in enumerate(_raw) for b in _raw[i + 1 :]]
ORACLES["rel_num_num"] = sql(
    correlation_findings("positive", "negative"), "rel", m=correlations("rel", NUM_PAIRS)
)
ORACLES["rel_num_num_unfiltered"] = sql(
    correlation_findings("positive", "negative", 0.0), m=correlations("lineitem", RAW_PAIRS)
)
ORACLES["rel_time_num"] = sql(
    correlation_findings("increase", "decrease"), "rel", m=correlations("rel", TIME_PAIRS)
)


def grouped(source: str, pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, CAST({a} AS VARCHAR) AS g, count({b}) AS n,
        avg({b}) AS mean, quantile_cont(CAST({b} AS DOUBLE), 0.5) AS median, {big(f'sum({b})')} AS positive,
        (SELECT stddev_samp({b}) FROM {source} WHERE {a} IS NOT NULL) AS std,
        (SELECT count({b}) FROM {source} WHERE {a} IS NOT NULL) AS total
        FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}"""
        for a, b in pairs
    )


ENDS = """
SELECT column_a, column_b, any_value(total) AS rows_used, any_value(std) AS std, count(*) AS k,
       arg_min(g, (-mean, g)) AS top_group, max(mean) AS top, arg_min(g, (mean, g)) AS bottom_group,
       min(mean) AS bottom
FROM gs WHERE n >= 3 GROUP BY 1, 2"""
CAT_PAIRS = [(a, b) for a in ("tier", "l_linestatus") for b in NUMERIC]
BIN_PAIRS = [("is_bulk", b) for b in NUMERIC]
CAT_KEPT = """SELECT *, (top - bottom) / nullif(std, 0) AS effect FROM ends
    WHERE k >= 2 AND rows_used >= 15 AND (top - bottom) / nullif(std, 0) >= 0.10"""
RATE_KEPT = """SELECT *, top - bottom AS effect FROM ends
    WHERE k >= 2 AND rows_used >= 15 AND top - bottom >= 0.05"""
END_FIELDS = f"""column_a, column_b, rows_used, {r('effect')} AS score, {r('effect')} AS metric_value,
    top_group, bottom_group, {r('top')} AS top_group_value, {r('bottom')} AS bottom_group_value"""
_cat = {"gs": grouped("rel", CAT_PAIRS), "ends": ENDS, "kept": CAT_KEPT}
_rate = {"gs": grouped("rel", [("tier", "is_bulk"), ("l_linestatus", "is_bulk")]), "ends": ENDS, "kept": RATE_KEPT}
ORACLES["rel_cat_num"] = sql(f"SELECT {END_FIELDS} FROM kept", "rel", **_cat)
ORACLES["rel_cat_num_groups"] = sql(
    f"""SELECT column_a, column_b, g AS "group", {r('mean')} AS mean, {r('median')} AS median, n AS count
    FROM gs JOIN kept USING (column_a, column_b) WHERE n >= 3""",
    "rel", **_cat,
)
ORACLES["rel_cat_bin"] = sql(f"SELECT {END_FIELDS} FROM kept", "rel", **_rate)
ORACLES["rel_cat_bin_groups"] = sql(
    f"""SELECT column_a, column_b, g AS "group", n AS count, positive AS positive_cases,
       {r('mean')} AS rate, {r('mean * 100', 2)} AS percent_rate
    FROM gs JOIN kept USING (column_a, column_b) WHERE n >= 3""",
    "rel", **_rate,
)
BIN_KEPT = """
SELECT *, abs(m1 - m0) / nullif(std, 0) AS effect FROM
  (SELECT column_a, column_b, any_value(total) AS rows_used, any_value(std) AS std,
          max(mean) FILTER (g = '0') AS m0, max(mean) FILTER (g = '1') AS m1
   FROM bs GROUP BY 1, 2)
WHERE rows_used >= 15 AND abs(m1 - m0) / nullif(std, 0) >= 0.10"""
ORACLES["rel_bin_num"] = sql(
    f"""SELECT column_a, column_b, rows_used, {r('effect')} AS score, {r('effect')} AS metric_value,
       CASE WHEN m1 > m0 THEN 'higher' ELSE 'lower' END AS direction,
       {r('m0')} AS mean_when_0, {r('m1')} AS mean_when_1 FROM kept""",
    "rel", bs=grouped("rel", BIN_PAIRS), kept=BIN_KEPT,
)


def findings(source: str, num, time, cat, rate, binary, tag: str = "") -> dict[str, str]:
    """All five kinds of findings of one dataset as named steps; the last is ``found``."""
    nn, tt, gs, ends, ck, gs2, ends2, rk, bs, bk = (
        f"{tag}{n}" for n in ("nn", "tt", "gs", "ends", "ck", "gs2", "ends2", "rk", "bs", "bk")
    )
    steps = {
        nn: correlations(source, num), tt: correlations(source, time),
        gs: grouped(source, cat), ends: ENDS.replace("FROM gs", f"FROM {gs}"),
        ck: CAT_KEPT.replace("FROM ends", f"FROM {ends}"),
        gs2: grouped(source, rate), ends2: ENDS.replace("FROM gs", f"FROM {gs2}"),
        rk: RATE_KEPT.replace("FROM ends", f"FROM {ends2}"),
        bs: grouped(source, binary), bk: BIN_KEPT.replace("FROM bs", f"FROM {bs}"),
    }
    one = "SELECT '{t}' AS comparison_type, column_a, column_b, rows_used, {s} AS score, {v} AS metric_value, '{m}' AS metric_name, {n} AS narrative FROM {f}"
    corr_where = " WHERE rows_used >= 15 AND NOT isnan(c) AND abs(c) >= 0.15"
    strength = STRENGTH
    num_text = f"""printf('`%s` and `%s` show a %s %s linear association (correlation = %.3f, n = %d).',
        column_a, column_b, {strength}, CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END, c, rows_used)"""
    time_text = f"""printf('`%s` shows a %s tendency to %s over `%s` (correlation = %.3f, n = %d).',
        column_b, {strength}, CASE WHEN c > 0 THEN 'increase' ELSE 'decrease' END, column_a, c, rows_used)"""
    cat_text = """printf('`%s` differs across `%s` groups. The highest average appears in `%s` (%.3f) and the lowest in `%s` (%.3f), with a normalized difference of %.3f.',
        column_b, column_a, top_group, top, bottom_group, bottom, effect)"""
    rate_text = """printf('The observed rate of `%s` varies across `%s` groups. `%s` has the highest observed rate (%.2f%%), while `%s` has the lowest (%.2f%%).',
        column_b, column_a, top_group, top * 100, bottom_group, bottom * 100)"""
    bin_text = """printf('`%s` is %s on average when `%s` = 1 than when `%s` = 0 (means: %.3f vs %.3f).',
        column_b, CASE WHEN m1 > m0 THEN 'higher' ELSE 'lower' END, column_a, column_a, m1, m0)"""
    steps[f"{tag}found"] = " UNION ALL ".join(
        [
            one.format(t="numeric_vs_numeric", s=r("abs(c)"), v=r("c"), m="pearson_correlation", n=num_text, f=nn) + corr_where,
            one.format(t="time_vs_numeric", s=r("abs(c)"), v=r("c"), m="time_correlation", n=time_text, f=tt) + corr_where,
            one.format(t="categorical_vs_numeric", s=r("effect"), v=r("effect"), m="normalized_mean_difference", n=cat_text, f=ck),
            one.format(t="categorical_vs_binary", s=r("effect"), v=r("effect"), m="rate_difference", n=rate_text, f=rk),
            one.format(t="binary_vs_numeric", s=r("effect"), v=r("effect"), m="normalized_mean_difference", n=bin_text, f=bk),
        ]
    )
    return steps


_found = findings(
    "rel", NUM_PAIRS, TIME_PAIRS, CAT_PAIRS, [("tier", "is_bulk"), ("l_linestatus", "is_bulk")], BIN_PAIRS
)
ORACLES["rel_all_ranked"] = sql(
    """SELECT comparison_type, column_a, column_b, rows_used, score, metric_value, metric_name FROM found
    ORDER BY score DESC, column_a, column_b LIMIT 12""",
    "rel", **_found,
)
ORACLES["rel_top_by_type"] = sql(
    """SELECT 'planted' AS dataset, comparison_type, column_a, column_b, score FROM
      (SELECT *, row_number() OVER (PARTITION BY comparison_type
              ORDER BY score DESC, column_a, column_b) AS k FROM found) WHERE k = 1""",
    "rel", **_found,
)
_graded = findings(
    "graded", [], [], [(a, "n_chars") for a in ("lang", "source")],
    [(a, b) for a in ("lang", "source") for b in ("toxic", "target")],
    [(a, "n_chars") for a in ("toxic", "target")], "g_",
)
ORACLES["rel_status"] = sql(
    f"""SELECT p.*, CASE WHEN f.column_a IS NULL THEN 'not_retained' ELSE 'retained' END AS status,
       CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT a.dataset, {PAIR_METHOD} AS method, a."column" AS column_a, b."column" AS column_b
          FROM roles a JOIN roles b ON a.dataset = b.dataset
          WHERE a.exclusion_reason IS NULL AND b.exclusion_reason IS NULL) p
    LEFT JOIN found f ON f.comparison_type = replace(p.method, '_', '_vs_')
         AND f.column_a = p.column_a AND f.column_b = p.column_b
    WHERE p.method IS NOT NULL
    UNION ALL SELECT 'planted', 'numeric_numeric', 'broken', 'qty', 'failed', 'USER_RAISED_EXCEPTION'
    UNION ALL SELECT 'planted', 'numeric_numeric', 'drift', 'not_there', 'failed', 'The column is not there.'""",
    "rel", **_planted, **_found,
)
ORACLES["rel_top_overall"] = sql(
    """SELECT * FROM (SELECT 'planted' AS dataset, comparison_type, column_a, column_b, rows_used, score,
              metric_value FROM found
       UNION ALL SELECT 'graded', comparison_type, column_a, column_b, rows_used, score, metric_value
       FROM g_found WHERE column_b <> 'n_chars'
         OR (SELECT count(DISTINCT n_chars) * 1.0e0 / count(*) FROM graded) <= 0.95)
    ORDER BY score DESC, dataset, column_a, column_b LIMIT 25""",
    "rel", "graded", **_found, **_graded,
)
ORACLES["rel_narratives"] = sql(
    "SELECT comparison_type, column_a, column_b, narrative FROM found", "rel", **_found
)

# ---------------------------------------------------------------- features

ORACLES["feat_boolean"] = sql(
    """SELECT person_id, CAST(housing_instability = 'Yes' AS INT) AS housing_instability,
       employment_status FROM people""",
    "people",
)
ORACLES["feat_age_group"] = sql(
    "SELECT person_id, CAST(age AS DOUBLE) AS age, age_group FROM featured", "featured"
)
ORACLES["feat_low_income"] = sql("SELECT person_id, low_income FROM featured", "featured")
ORACLES["feat_status_flags"] = sql(
    "SELECT person_id, unemployed, no_health_insurance FROM featured", "featured"
)
ORACLES["feat_score"] = sql(
    "SELECT person_id, social_determinant_score, high_social_determinant_burden FROM scored", "scored"
)
ORACLES["feat_text_target"] = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome FROM orders"""

CHOSEN = ["birth_year", "age", "age_group", "income", "employment_status", "housing_instability",
          "insurance_status", "social_determinant_score", "low_income", "unemployed"]
ORACLES["feat_choices"] = sql(
    """SELECT 'target' AS choice, CAST(1 AS INT) AS rank, 'high_social_determinant_burden' AS "column"
    UNION ALL SELECT 'group', 1, CASE WHEN (SELECT count(DISTINCT age_group) FROM scored) BETWEEN 2 AND 20
                                 THEN 'age_group' ELSE 'employment_status' END
    UNION ALL SELECT 'feature', CAST(row_number() OVER (ORDER BY i) AS INT), c FROM ("""
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS c FROM scored HAVING count(DISTINCT {c}) > 1 "
        f"AND (count(*) - count({c})) * 1.0e0 / count(*) < 0.8"
        for i, c in enumerate(CHOSEN)
    )
    + ")",
    "scored",
)

# -------------------------------------------------------------- likelihood

GROUP_RATES = """
SELECT source, avg(target) AS mean, count(*) AS count, CAST(sum(target) AS DOUBLE) AS sum,
       avg(target) * 100 AS percent_rate
FROM graded WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"""
ORACLES["group_rates"] = sql(
    f"""SELECT source, {r('mean')} AS mean, count, sum, {r('percent_rate')} AS percent_rate FROM rates""",
    "graded", rates=GROUP_RATES,
)
ORACLES["rate_gap"] = sql(
    f"""SELECT arg_min(source, (-percent_rate, source)) AS top_group, {r('max(percent_rate)')} AS top_rate,
       arg_max(source, (-percent_rate, source)) AS bottom_group, {r('min(percent_rate)')} AS bottom_rate,
       {r('max(percent_rate) - min(percent_rate)')} AS difference_points
    FROM rates HAVING count(*) >= 2""",
    "graded", rates=GROUP_RATES,
)
ORACLES["impute"] = sql(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT {c} FROM orders_nulled WHERE {c} IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS text_fill, CAST(NULL AS DOUBLE) AS number_fill"""
        for c in ("o_orderstatus", "o_orderpriority")
    )
    + f""" UNION ALL SELECT 'o_totalprice', NULL, {r('quantile_cont(o_totalprice, 0.5)')} FROM orders_nulled""",
    "orders_nulled",
)
ORACLES["split_shares"] = """
SELECT o_orderstatus, true AS is_test, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT) AS rows
FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, false, count(*) - CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT)
FROM orders GROUP BY 1"""
SPLIT = """
SELECT *, row_number() OVER (PARTITION BY target ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT))
       <= round_even(count(*) OVER (PARTITION BY target) * 0.2e0, 0) AS is_test
FROM graded WHERE target IS NOT NULL"""
ORACLES["split_rows"] = sql("SELECT doc_id, target, is_test FROM split", "graded", split=SPLIT)
_train = {
    "split": SPLIT,
    "train": "SELECT * FROM split WHERE NOT is_test",
    "filled": "SELECT "
    + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}"
        for c in ("lang", "source")
    )
    + ", "
    + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM train)) AS {c}" for c in ("n_chars", "toxic")
    )
    + " FROM train",
}
# The optimum is where every gradient is zero; sums of features come from the rows, apart from any fit.
ORACLES["logit_certificate"] = sql(
    "SELECT '(intercept)' AS feature, CAST(count(*) AS DOUBLE) AS feature_sum, 0.0e0 AS gradient FROM filled "
    + "".join(
        f"UNION ALL SELECT '{c}=' || {c}, CAST(count(*) AS DOUBLE), 0.0e0 FROM filled GROUP BY {c} "
        for c in ("lang", "source")
    )
    + "".join(
        f"UNION ALL SELECT '{c}', {r(f'sum({c})')}, 0.0e0 FROM filled " for c in ("n_chars", "toxic")
    ),
    "graded", **_train,
)
ORACLES["classification_report"] = sql(
    f"""SELECT c AS label, {r('p')} AS precision, {r('q')} AS recall, {r('f')} AS f1_score, s AS support FROM k
    UNION ALL SELECT 'accuracy', {r('sum(h) * 1.0e0 / sum(s)')}, {r('sum(h) * 1.0e0 / sum(s)')},
      {r('sum(h) * 1.0e0 / sum(s)')}, {big('sum(s)')} FROM k
    UNION ALL SELECT 'macro avg', {r('avg(p)')}, {r('avg(q)')}, {r('avg(f)')}, {big('sum(s)')} FROM k
    UNION ALL SELECT 'weighted avg', {r('sum(p * s) / sum(s)')}, {r('sum(q * s) / sum(s)')},
      {r('sum(f * s) / sum(s)')}, {big('sum(s)')} FROM k""",
    "graded",
    g="SELECT target AS y, CAST(n_chars > 2000 AS INT) AS z FROM graded",
    h="""SELECT c, count(*) FILTER (y = c AND z = c) AS h, count(*) FILTER (z = c) AS said,
         count(*) FILTER (y = c) AS s FROM g, (SELECT unnest([0, 1]) AS c) GROUP BY c""",
    b="""SELECT CAST(c AS VARCHAR) AS c, h, s, coalesce(h * 1.0e0 / nullif(said, 0), 0) AS p,
         coalesce(h * 1.0e0 / nullif(s, 0), 0) AS q FROM h""",
    k="SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f FROM b",
)
ORACLES["model_workflow"] = sql(
    f"""SELECT lang, {r('avg(target)')} AS mean, count(*) AS count, CAST(sum(target) AS DOUBLE) AS sum,
       {r('avg(target) * 100')} AS percent_rate FROM graded GROUP BY 1 HAVING count(*) >= 3""",
    "graded",
)
ORACLES["model_facts"] = sql(
    f"""SELECT 'graded' AS dataset, 'target' AS target, 'lang,n_chars,toxic' AS features, 'lang' AS "group",
       'fitted' AS status, CAST(NULL AS VARCHAR) AS reason, train_rows, test_rows,
       arg_min(lang, (-percent_rate, lang)) AS top_group, arg_max(lang, (-percent_rate, lang)) AS bottom_group,
       {r('max(percent_rate) - min(percent_rate)')} AS difference_points
    FROM (SELECT lang, avg(target) * 100 AS percent_rate FROM graded GROUP BY 1 HAVING count(*) >= 3),
         (SELECT count(*) FILTER (NOT is_test) AS train_rows, count(*) FILTER (is_test) AS test_rows FROM split)
    GROUP BY train_rows, test_rows""",
    "graded", split=SPLIT,
)

ORACLES["model_refusals"] = """
SELECT 'one_class' AS "case", 'refused' AS status,
       'Target column does not have at least two classes.' AS reason
UNION ALL SELECT 'no_target_values', 'refused', 'No rows available after dropping missing target values.'
UNION ALL SELECT 'no_features', 'refused', 'No usable feature columns were available for modeling.'"""

ORACLES["coerced_values"] = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey * 1.0e0 WHEN 1 THEN o_orderkey + 0.5e0 END AS number,
       CASE WHEN o_orderkey % 5 <= 1 THEN CAST(o_orderkey AS INT) ELSE 0 END AS flag,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey // 2 AS VARCHAR)
            ELSE CAST(o_orderkey // 2 AS VARCHAR) || '.5' END AS key_text
FROM orders"""

# ------------------------------------------------------------------- merge

ORACLES["place_names"] = """
SELECT s_suppkey AS departmentkey, s_name AS city, s_nationkey AS county FROM supplier"""
ORACLES["key_quality"] = f"""
SELECT l.n AS left_non_null_rows, {r('l.d * 1.0e0 / l.n')} AS left_unique_ratio,
       q.n AS right_non_null_rows, {r('q.d * 1.0e0 / q.n')} AS right_unique_ratio,
       l.n > 0 AND q.n > 0 AS valid
FROM (SELECT count(c_custkey) AS n, count(DISTINCT c_custkey) AS d FROM customer) l,
     (SELECT count(o_custkey) AS n, count(DISTINCT o_custkey) AS d FROM orders) q"""
ORACLES["join_sizes"] = sql(
    f"""SELECT (SELECT count(*) FROM orders_nulled) AS left_rows, (SELECT count(*) FROM customer) AS right_rows,
       {big('sum(n * coalesce(m, 0))')} AS inner_rows, {big('sum(n * greatest(coalesce(m, 0), 1))')} AS left_join_rows
    FROM (SELECT o_orderstatus AS k, count(*) AS n FROM orders_nulled GROUP BY 1) a
    LEFT JOIN (SELECT CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' END AS k, count(*) AS m
               FROM customer GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""",
    "orders_nulled",
)
ORACLES["merge_inner"] = """
SELECT o_custkey AS key, o_totalprice AS amount__orders, c_acctbal AS amount__customer
FROM orders JOIN customer ON o_custkey = c_custkey"""
ORACLES["merge_left_when_empty"] = """
SELECT c_custkey AS key, c_name, CAST(NULL AS VARCHAR) AS s_name FROM customer"""
ORACLES["standardize_columns"] = sql(
    """SELECT person_id, birth_year AS age, age_group AS age__dup1, employment_status AS employment
    FROM featured""",
    "featured",
)

# ------------------------------------------------------------------ charts

ORACLES["hist_10"] = histogram("lineitem", "l_extendedprice", 10)
ORACLES["hist_20"] = histogram("events", "value", 20)
ORACLES["hist_first_columns"] = " UNION ALL ".join(
    histogram("part", c, 10, c) for c in ("p_partkey", "p_size", "p_retailprice")
)
ORACLES["top_categories"] = """
SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
ORACLES["monthly_counts"] = """
SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS count FROM lineitem GROUP BY 1"""
ORACLES["monthly_counts_text"] = """
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS count FROM orders
WHERE o_orderkey % 10 <> 0 GROUP BY 1"""
ORACLES["scatter_pairs"] = sql(
    """SELECT o_totalprice, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders_nulled
    WHERE o_totalprice IS NOT NULL""",
    "orders_nulled",
)

ORACLES["scatter_sample"] = """
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey
FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
ORDER BY md5('42:' || o_orderkey) LIMIT 500"""
ORACLES["scatter_grid"] = sql(
    f"""SELECT i AS bin_a, j AS bin_b, {r('any_value(x0 + i * ((x1 - x0) / 20))')} AS a_from,
       {r('any_value(y0 + j * ((y1 - y0) / 20))')} AS b_from, count(*) AS count
    FROM (SELECT *, CAST(least(floor((x - x0) / (x1 - x0) * 20), 19) AS INT) AS i,
                 CAST(least(floor((y - y0) / (y1 - y0) * 20), 19) AS INT) AS j FROM xy, edges) GROUP BY 1, 2""",
    xy="""SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem
          WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""",
    edges="SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy",
)

# --------------------------------------------------------------- catalogue

COLLECTION = {
    "encounters": ("enc", {
        "patientdurablekey": "number", "encounterkey": "number", "isedvisit": "number",
        "ishospitaladmission": "number", "isinpatientadmission": "number", "isobservation": "number",
        "primarydiagnosiskey": "number", "departmentkey": "number", "admityear": "number"}),
    "screenings": ("sdoh", {
        "patientdurablekey": "number", "domain": "text", "answertext": "text", "encounterkey": "number"}),
    "diagnoses": ("diag", {"diagnosiskey": "number", "groupname": "text"}),
    "departments": ("dept", {"departmentkey": "number", "censustract": "number", "departmenttype": "text"}),
    "area_codes": ("tiger", {"geoid": "text", "centlat": "number", "centlon": "number"}),
    "people": ("scored", {
        "person_id": "number", "birth_year": "number", "income": "number", "employment_status": "text",
        "insurance_status": "text", "housing_instability": "number", "age": "number", "age_group": "text",
        "low_income": "number", "unemployed": "number", "no_health_insurance": "number",
        "social_determinant_score": "number", "high_social_determinant_burden": "number"}),
    "graded": ("graded", {
        "doc_id": "number", "lang": "text", "source": "text", "n_chars": "number", "toxic": "number",
        "target": "number"}),
    "planted": ("rel", REL_COLUMNS),
}
_views = ["enc", "sdoh", "diag", "dept", "tiger", "scored", "graded", "rel"]
CONCEPTS = {
    "age": ["age", "birth_year", "age_group"], "income": ["income", "low_income"],
    "employment": ["unemployed", "employment_status"],
    "insurance": ["no_health_insurance", "insurance_status"],
    "social_determinants": ["high_social_determinant_burden", "social_determinant_score"],
    "housing": ["housing_instability"],
}
ROOT = (
    "CASE "
    + " ".join(f"WHEN variable = '{v}' THEN '{c}'" for c, vs in CONCEPTS.items() for v in vs)
    + " ELSE variable END"
)
_kcat = {
    "stats": " UNION ALL ".join(stats(v, n, c) for n, (v, c) in COLLECTION.items()),
    "roles": ROLES,
    "pairs": """SELECT a.dataset AS dataset_a, b.dataset AS dataset_b, a."column" AS variable
        FROM roles a JOIN roles b ON a."column" = b."column" AND a.dataset < b.dataset""",
}
_k = {
    **_kcat, **_found,
    "strong": """SELECT * FROM found ORDER BY score DESC, column_a, column_b LIMIT 12""",
    "events": """
        SELECT "column" AS variable, 1.0e0 AS w FROM roles
        UNION ALL SELECT "column", CASE kind WHEN 'number' THEN 0.5e0 ELSE 0.25e0 END FROM roles
        UNION ALL SELECT "column", 0.5e0 FROM roles WHERE role IN ('time_like', 'year_like')
        UNION ALL SELECT variable, 1.25e0 FROM pairs
        UNION ALL SELECT column_a, 1.5e0 + least(score, 2.0e0) FROM strong
        UNION ALL SELECT column_b, 1.5e0 + least(score, 2.0e0) FROM strong
        UNION ALL SELECT unnest(['n_chars', 'source']), 2.5e0
        UNION ALL SELECT 'target', 4.0e0 UNION ALL SELECT 'lang', 1.5e0""",
    "used": """
        SELECT column_a AS variable FROM strong UNION SELECT column_b FROM strong
        UNION SELECT unnest(['n_chars', 'source', 'target'])""",
    "places": """
        SELECT "column" AS variable, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets,
               count(DISTINCT dataset) AS n_datasets,
               string_agg(DISTINCT CASE kind WHEN 'number' THEN 'numeric' ELSE 'categorical' END, ','
                          ORDER BY CASE kind WHEN 'number' THEN 'numeric' ELSE 'categorical' END) AS roles,
               min(missing_percent) AS min_missing,
               max(CASE WHEN role IN ('time_like', 'year_like') THEN 1 ELSE 0 END) AS is_time
        FROM roles GROUP BY 1""",
    "vars": f"""
        SELECT p.*, {ROOT} AS concept_root, {r('''e.w
            + CASE WHEN min_missing <= 10 THEN 1.0e0 WHEN min_missing <= 25 THEN 0.5e0 ELSE 0 END
            + CASE WHEN n_datasets >= 2 THEN 2.0e0 ELSE 0 END
            + CASE WHEN variable IN (SELECT variable FROM used) THEN 0.5e0 ELSE 0 END''', 2)}
            AS importance_score
        FROM places p JOIN (SELECT variable, sum(w) AS w FROM events GROUP BY 1) e USING (variable)""",
    "v": """SELECT *, CASE WHEN importance_score >= 8 THEN 'high' WHEN importance_score >= 4
        THEN 'medium' ELSE 'low' END AS importance_bucket FROM vars""",
    "clusters": """SELECT concept_root, count(*) AS n_variables,
        string_agg(variable, ',' ORDER BY importance_score DESC, variable) AS variables
        FROM v GROUP BY 1 HAVING count(*) >= 2""",
    "top": "SELECT * FROM v ORDER BY importance_score DESC, variable LIMIT 20",
}
ORACLES["catalog_merge"] = sql(
    f"""SELECT dataset, "column", kind, rows, missing, role, {r('missing_percent')} AS missing_percent,
       exclusion_reason IS NULL AS usable FROM roles WHERE dataset IN ('encounters', 'graded', 'planted')""",
    *_views, **_kcat,
)
ORACLES["var_importance"] = sql(
    f"""SELECT variable, concept_root, importance_score, importance_bucket, datasets, roles,
       {r('min_missing')} AS min_missing FROM v""",
    *_views, **_k,
)
ORACLES["concept_clusters"] = sql("SELECT * FROM clusters", *_views, **_k)
WHY = """coalesce(nullif(concat_ws('; ',
    CASE WHEN variable = 'target' THEN 'it is the modeled outcome' END,
    CASE WHEN variable IN ('n_chars', 'source') THEN 'it is used in the likelihood model' END,
    CASE WHEN variable = 'lang' THEN 'it is used in group comparisons' END,
    CASE WHEN variable IN (SELECT column_a FROM strong UNION SELECT column_b FROM strong)
         THEN 'it appears in strong discovered relationships' END,
    CASE WHEN n_datasets >= 2 THEN 'it appears across multiple datasets' END,
    CASE WHEN variable IN (SELECT variable FROM pairs) THEN 'it may help connect files' END), ''),
    'it appears repeatedly in the generated outputs')"""
ORACLES["top_variables"] = sql(
    f"SELECT variable, importance_score, importance_bucket, {WHY} AS why_it_matters FROM top",
    *_views, **_k,
)
ORACLES["priority_by_dataset"] = sql(
    """SELECT dataset, variable, importance_score, rank FROM
      (SELECT dataset, variable, importance_score, row_number() OVER (PARTITION BY dataset
              ORDER BY importance_score DESC, variable) AS rank
       FROM (SELECT *, unnest(string_split(datasets, ',')) AS dataset FROM top)) WHERE rank <= 8""",
    *_views, **_k,
)
_cand = {
    "cand": """
        SELECT dataset_a || ' <-> ' || dataset_b AS dataset_pair,
               string_agg(variable, ',' ORDER BY variable) AS shared_columns,
               CASE WHEN dataset_a = 'departments' AND dataset_b = 'encounters' THEN 'strong'
                    WHEN count(*) >= 2 THEN 'moderate' ELSE 'weak' END AS join_strength,
               CASE WHEN dataset_a = 'departments' AND dataset_b = 'encounters' THEN 'departmentkey'
                    ELSE array_to_string(list_slice(list(variable ORDER BY variable), 1, 3), ', ') END AS keys
        FROM pairs GROUP BY dataset_a, dataset_b""",
    "merges": """SELECT *, CASE join_strength WHEN 'strong' THEN 'test_merge_first'
        WHEN 'moderate' THEN 'evaluate_merge_after_standardization'
        ELSE 'hold_for_manual_review' END AS recommended_action FROM cand""",
}
ORACLES["join_candidates"] = sql(
    """SELECT dataset_pair, shared_columns, join_strength,
       'Consider testing a merge for ' || dataset_pair || ' using ' || keys || '.' AS recommendation
    FROM cand""",
    *_views, **_kcat, **_cand,
)
ORACLES["merge_readiness"] = sql(
    """SELECT dataset_pair, join_strength, recommended_action,
       CASE join_strength WHEN 'weak' THEN 'needs_review' ELSE 'ready_to_test' END AS readiness
    FROM merges""",
    *_views, **_kcat, **_cand,
)
MODEL_ROLES = """
SELECT variable AS variable_name, model_role, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY model_role ORDER BY importance_score DESC, variable) AS rank
   FROM (SELECT variable, importance_score, CASE WHEN variable = 'target' THEN 'target' ELSE 'feature' END
                AS model_role FROM v WHERE variable IN (SELECT variable FROM used)))
WHERE rank <= CASE model_role WHEN 'target' THEN 5 ELSE 15 END"""
ORACLES["model_roles"] = sql(MODEL_ROLES, *_views, **_k)
ORACLES["action_rows"] = sql(
    """SELECT * FROM (SELECT 'feature' AS action_type, variable AS subject,
         'prioritize_for_feature_engineering' AS recommended_action
       FROM v ORDER BY importance_score DESC, variable LIMIT 25)
    UNION ALL SELECT 'merge', dataset_pair, recommended_action FROM merges
    UNION ALL SELECT 'standardize', concept_root, 'standardize_variable_names_and_meaning' FROM clusters
    UNION ALL SELECT 'chart', variable, CASE WHEN is_time = 1 THEN 'time_series_line_chart'
         WHEN roles LIKE '%numeric%' THEN 'histogram_or_boxplot' ELSE 'bar_chart' END FROM top
    UNION ALL SELECT 'model_' || model_role, variable_name, 'use_for_next_model_iteration' FROM mr""",
    *_views, **_k, **_cand, mr=MODEL_ROLES,
)


def chart_rows() -> str:
    """Every chart that a top variable may get, of its first dataset by name; only those of ``top`` stay."""
    first: dict[str, tuple[str, str, str]] = {}
    for dataset in sorted(COLLECTION):
        view, columns = COLLECTION[dataset]
        for column, kind in columns.items():
            first.setdefault(column, (dataset, view, kind))
    parts = []
    for column, (dataset, view, kind) in first.items():
        said = f"'{column}' AS variable_name, '{dataset}' AS dataset_name"
        # A bare number counts nanoseconds.
        stamp = {"time": column, "number": f"make_timestamp(CAST({column} / 1000 AS BIGINT))"}.get(kind)
        months = f"strftime({stamp}, '%Y-%m')" if stamp else "NULL"
        parts.append(
            f"""SELECT {said}, 'time_series_line_chart' AS graph_type, {months} AS label, count(*) AS count FROM {view}
                WHERE {months} IS NOT NULL GROUP BY {months}"""
        )
        if kind == "number":
            bins = histogram(view, column, 20)
            parts.append(f"SELECT {said}, 'histogram_or_boxplot', lpad(bin::VARCHAR, 2, '0'), count FROM ({bins}) WHERE bin_from IS NOT NULL")
        else:
            parts.append(
                f"""SELECT {said}, 'bar_chart', label, count FROM (
                    SELECT coalesce({column}::VARCHAR, 'nan') AS label, count(*) AS count FROM {view} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
            )
    return " UNION ALL ".join(parts)


CHOSEN_CHARTS = """
SELECT variable AS variable_name, CASE WHEN is_time = 1 THEN 'time_series_line_chart'
       WHEN roles LIKE '%numeric%' THEN 'histogram_or_boxplot' ELSE 'bar_chart' END AS graph_type,
       split_part(datasets, ',', 1) AS dataset_name FROM top"""
ORACLES["chart_dispatch"] = sql(
    "SELECT * FROM charted SEMI JOIN chosen USING (variable_name, graph_type, dataset_name)",
    *_views, **_k, charted=chart_rows(), chosen=CHOSEN_CHARTS,
)
ORACLES["chart_status"] = sql(
    """SELECT variable_name, dataset_name, graph_type,
       CASE WHEN drawn > 0 THEN 'created' ELSE 'skipped' END AS status,
       CASE WHEN drawn > 0 THEN NULL ELSE 'The column has no values to draw.' END AS reason
    FROM (SELECT variable_name, dataset_name, graph_type, coalesce(sum(count), 0) AS drawn
          FROM chosen LEFT JOIN charted USING (variable_name, graph_type, dataset_name) GROUP BY ALL)
    UNION ALL SELECT 'not_there', NULL, 'bar_chart', 'skipped', 'No dataset has a column of this name.'""",
    *_views, **_k, charted=chart_rows(), chosen=CHOSEN_CHARTS,
)
JOINED = """
SELECT '{pair}' AS dataset_pair, 'merged' AS status, CAST(NULL AS VARCHAR) AS reason, '{keys}' AS keys_used,
       (SELECT count(*) FROM {a}) AS left_rows, (SELECT count(*) FROM {b}) AS right_rows,
       t.rows AS inner_rows,
       (SELECT count(*) FROM {a} l LEFT JOIN {b} q ON {on}) AS left_join_rows,
       {ua} AS left_unique_ratio, {ub} AS right_unique_ratio,
       t.rows AS merged_rows, t.nulls AS null_cells, t.checksum
FROM (SELECT count(*) AS rows, CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS nulls,
             CAST(coalesce(sum({hl} + {hr}), 0) % 4294967291 AS BIGINT) AS checksum
      FROM {a} l JOIN {b} q ON {on}) t"""


def joined(pair: str, keys: list[str], fractions: tuple[str, ...] = ()) -> str:
    """Facts of an inner join, taken from the joined rows themselves."""
    (a, left), (b, right) = (COLLECTION[n] for n in pair.split(" <-> "))

    def ratio(view: str) -> str:
        there = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        fields = ", ".join(keys)
        return r(
            f"(SELECT count(*) FROM (SELECT DISTINCT {fields} FROM {view} WHERE {there})) * 1.0e0"
            f" / (SELECT count(*) FROM {view} WHERE {there})"
        )

    def text(x: str) -> str:
        whole = f"CAST(round_even({x} * 10000, 0) AS BIGINT)" if x[2:] in fractions else x
        return f"coalesce(CAST({whole} AS VARCHAR), chr(30))"

    def hashed(cells: list[str]) -> str:
        return f"CAST('0x' || substr(md5(concat_ws(chr(31), {', '.join(map(text, cells))})), 1, 8) AS BIGINT)"

    ours = [f"l.{c}" for c in sorted(left)]
    theirs = [f"q.{c}" for c in sorted(right) if c not in keys]
    return JOINED.format(
        pair=pair, keys=",".join(keys), a=a, b=b, on=" AND ".join(f"l.{k} = q.{k}" for k in keys),
        ua=ratio(a), ub=ratio(b), hl=hashed(ours), hr=hashed(theirs),
        nulls=" + ".join(f"CAST({c} IS NULL AS INT)" for c in ours + theirs),
    )


ORACLES["merge_all"] = sql(
    joined("departments <-> encounters", ["departmentkey"], fractions=("censustract",))
    + " UNION ALL "
    + joined("encounters <-> screenings", ["encounterkey", "patientdurablekey"]),
    "dept", "enc", "sdoh",
)
ORACLES["run_summary"] = sql(
    """SELECT (SELECT count(DISTINCT dataset) FROM roles) AS datasets, (SELECT count(*) FROM roles) AS columns,
       (SELECT count(*) FROM (SELECT DISTINCT dataset_a, dataset_b FROM pairs)) AS shared_pairs,
       (SELECT count(*) FROM found) AS relationships""",
    *_views, **_kcat, **_found,
)

# ----------------------------------------------------------------- sources

ORACLES["csv_roundtrip"] = sql(
    """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority
    FROM orders_nulled""",
    "orders_nulled",
)
ORACLES["infer_types"] = """
SELECT c AS "column", ty AS type, (SELECT count(*) FROM customer) AS rows FROM
(VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'bigint'), ('c_acctbal', 'double'),
        ('c_mktsegment', 'string'), ('active', 'boolean')) t(c, ty)"""
ORACLES["csv_latin1"] = "SELECT c_custkey, 'Café ' || c_name AS label FROM customer"
ORACLES["csv_malformed"] = """
SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name,
       CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS nation
FROM supplier WHERE s_suppkey % 7 <> 0"""
ORACLES["csv_required"] = sql(
    "SELECT patientdurablekey, encounterkey, CAST(admityear AS BIGINT) AS admityear FROM enc", "enc"
)
ORACLES["csv_folder"] = " UNION ALL ".join(
    f"SELECT '{x}.csv' AS dataset, count(*) AS rows, {big(len(names(x)))} AS columns FROM {x}"
    for x in ("region", "nation", "supplier")
)
CSV_TYPES = {
    "nation": "n_nationkey:bigint,n_name:string,n_regionkey:bigint",
    "supplier": "s_suppkey:bigint,s_name:string,s_nationkey:bigint,s_acctbal:double",
    "customer": "c_custkey:bigint,c_name:string,c_nationkey:bigint,c_acctbal:double,c_mktsegment:string",
}
ORACLES["csv_folder_staged"] = " UNION ALL ".join(
    f"SELECT '{x}.csv' AS dataset, count(*) AS rows, '{types}' AS types FROM {x}" for x, types in CSV_TYPES.items()
)
ORACLES["json_roundtrip"] = sql(
    "SELECT censustract, total_encounters, ed_rate FROM areas", "enc", "sdoh", "dept", **_rq3
)
