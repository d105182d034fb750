"""Thresholds, names and word lists that decide results.

Every list here is a plain constant that other modules import. They are
defaults; operators take them as parameters wherever a caller may differ.
"""

# Tokens a CSV reader turns into missing (lower-case "none" is not one).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Characters stripped from both ends of a label.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

# Boolean-like words and the share that makes a column boolean.
TRUE_WORDS = ["yes", "true", "y", "1", "t"]
FALSE_WORDS = ["no", "false", "n", "0", "f"]
BOOLEAN_SHARE = 0.8

# Feature engineering.
REFERENCE_YEAR = 2026
AGE_EDGES = [0, 18, 25, 35, 50, 65, 120]
AGE_LABELS = ["0-18", "19-25", "26-35", "36-50", "51-65", "66+"]
UNEMPLOYED_WORDS = ["unemployed", "not employed", "jobless", "none"]
UNINSURED_WORDS = ["none", "no", "uninsured", "no insurance"]
BURDEN_INDICATORS = [
    "low_income", "housing_instability", "transportation_barrier", "unemployed",
    "no_health_insurance", "snap_participation", "food_access_barrier",
    "utility_insecurity",
]
BURDEN_CUTOFF = 2
TEXT_TARGETS = ["food_insecurity", "food_insecure", "target", "outcome", "label"]
TEXT_TARGET_VALUES = {
    "yes": 1, "no": 0, "true": 1, "false": 0, "food insecure": 1, "food secure": 0,
    "positive": 1, "negative": 0, "1": 1, "0": 0,
}

# Choice of target, features and group column.
TARGET_NAMES = [
    "food_insecurity", "food_insecure", "high_social_determinant_burden",
    "target", "outcome", "label",
]
TARGET_KEYWORDS = [
    "risk", "outcome", "target", "label", "insecurity", "burden", "flag", "status",
]
FEATURE_NAMES = [
    "birth_year", "age", "age_group", "income", "income_level", "employment_status",
    "household_size", "housing_instability", "transportation_barrier",
    "snap_participation", "education_level", "insurance_status", "zip_code", "sex",
    "gender", "race", "ethnicity", "social_determinant_score", "low_income",
    "unemployed",
]
GROUP_NAMES = [
    "age_group", "birth_year", "income_level", "employment_status",
    "education_level", "race", "ethnicity", "gender", "sex", "zip_code",
]

# Relationship discovery thresholds.
MAX_MISSING_PERCENT = 60.0
MAX_CATEGORIES = 20
MAX_DISCRETE = 10
TEXT_DISTINCT = 50
IDENTIFIER_RATIO = 0.95
IDENTIFIER_DISTINCT = 20
MIN_ROWS = 15
MIN_GROUP_ROWS = 3
MIN_CORRELATION = 0.15
MIN_MEAN_DIFFERENCE = 0.10
MIN_RATE_DIFFERENCE = 0.05
TOP_PER_DATASET = 12
TOP_OVERALL = 25
TOP_PER_TYPE = 3
TIME_NAME_TOKENS = ["date", "time", "timestamp", "month", "year"]
TIME_PARSED_SHARE = 0.25
TIME_PARSED_ROWS = 5
STRENGTH_LABELS = [(0.7, "very strong"), (0.5, "strong"), (0.3, "moderate"), (0.15, "weak")]

# Date spellings tried in this order, each with the shape a text must
# have before it is parsed. A bare number or a month name alone is not a date.
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$", "yyyy-MM-dd HH:mm:ss.SSS"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6}$", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{2}-[A-Z][a-z]{2}-\d{4}$", "dd-MMM-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
]

# Cohort questions.
MIN_SIDE_PATIENTS = 30
SIGNIFICANCE = 0.05
UTILIZER_QUANTILE = 0.9
ENCOUNTER_CAP = 200
ENCOUNTER_BINS = 80
TOP_DIAGNOSES = 15
MIN_AREA_VOLUME = 50
TOP_DOMAINS = 8
YEAR_WINDOW = (2020, 2026)

# Weights of the variable importance score.
WEIGHT_PRESENT = 1.0
WEIGHT_NUMERIC = 0.5
WEIGHT_CATEGORICAL = 0.25
WEIGHT_DATE = 0.5
WEIGHT_RELATIONSHIP = 1.5
RELATIONSHIP_SCORE_CAP = 2.0
WEIGHT_FEATURE = 2.5
WEIGHT_TARGET = 4.0
WEIGHT_GROUP = 1.5
WEIGHT_SHARED = 1.25
WEIGHT_MISSING = [(10, 1.0), (25, 0.5)]
WEIGHT_SEVERAL_DATASETS = 2.0
WEIGHT_USED = 0.5
IMPORTANCE_BUCKETS = [(8, "high"), (4, "medium")]
TOP_VARIABLES = 20
TOP_FEATURE_ACTIONS = 25
TOP_CHART_ACTIONS = 20
PRIORITY_PER_DATASET = 8
MAX_TARGET_ROLES = 5
MAX_FEATURE_ROLES = 15

# Name parts dropped before the concept lookup, and the lookup.
CONCEPT_SUFFIXES = ["_flag", "_status", "_score", "_group", "_level", "_rate", "_count"]
CONCEPT_ALIASES = {
    "birth_year": "age",
    "year_of_birth": "age",
    "dob_year": "age",
    "age_group": "age",
    "age": "age",
    "income_level": "income",
    "low_income": "income",
    "household_income": "income",
    "food_insecure": "food_insecurity",
    "food_insecurity": "food_insecurity",
    "social_determinant": "social_determinants",
    "social_determinant_score": "social_determinants",
    "high_social_determinant_burden": "social_determinants",
    "housing_instability": "housing",
    "housing_status": "housing",
    "transportation_barrier": "transportation",
    "transport_access": "transportation",
    "employment_status": "employment",
    "unemployed": "employment",
    "insurance_status": "insurance",
    "no_health_insurance": "insurance",
    "zip_code": "location",
    "zipcode": "location",
    "county": "location",
    "city": "location",
    "state": "location",
    "gender": "gender",
    "sex": "gender",
    "race": "race_ethnicity",
    "ethnicity": "race_ethnicity",
}

# Join keys preferred among shared columns.
PREFERRED_KEYS = ["id", "year", "date", "zip_code", "zipcode"]
MERGE_ACTIONS = ["test_merge_first", "evaluate_merge_after_standardization"]

# Sentences that the result tables hold.
CLUSTER_ADVICE = "Standardize or harmonize the variables in the '%s' cluster."
MERGE_ADVICE = "Consider testing a merge for %s using %s."
CLUSTER_REASON = "These variables likely represent the same or related concepts."
NO_DATASETS = "No datasets available for modeling."
NO_TARGET = "No target column was detected."
NO_FEATURES = "No usable feature columns were available for modeling."
NO_TARGET_VALUES = "No rows available after dropping missing target values."
ONE_CLASS = "Target column does not have at least two classes."
