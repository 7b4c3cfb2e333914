"""Column lists, tokens and label maps for loan-application decision tables.

Everything under "Fixed values" must equal what the audited workflow uses, so
results line up with its published tables.  They are stated once, here, in
their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------- #
# Fixed values
# --------------------------------------------------------------------------- #

# Tokens that the pandas CSV reader turns into missing values by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Decision codes kept for modelling (1 = originated/approved, 3 = denied).
DECISION_CODES = [1, 3]
APPROVED_CODE = 1

# Leakage / redundant columns dropped when present.
LEAKAGE_COLUMNS = [
    "action_taken", "denial_reason-1", "denial_reason-2", "denial_reason-3", "denial_reason-4",
    "purchaser_type", "hoepa_status", "interest_rate", "rate_spread",
    "total_loan_costs", "total_points_and_fees", "origination_charges",
    "discount_points", "lender_credits", "prepayment_penalty_term", "intro_rate_period",
    "activity_year", "lei", "state_code", "census_tract",
    "aus-1", "aus-2", "aus-3", "aus-4", "aus-5",
    "initially_payable_to_institution",
    "applicant_ethnicity_observed", "co-applicant_ethnicity_observed",
    "applicant_race_observed", "co-applicant_race_observed",
    "applicant_sex_observed", "co-applicant_sex_observed",
    "applicant_ethnicity-1", "applicant_ethnicity-2", "applicant_ethnicity-3", "applicant_ethnicity-4", "applicant_ethnicity-5",
    "co-applicant_ethnicity-1", "co-applicant_ethnicity-2", "co-applicant_ethnicity-3", "co-applicant_ethnicity-4", "co-applicant_ethnicity-5",
    "applicant_race-1", "applicant_race-2", "applicant_race-3", "applicant_race-4", "applicant_race-5",
    "co-applicant_race-1", "co-applicant_race-2", "co-applicant_race-3", "co-applicant_race-4", "co-applicant_race-5",
    "applicant_sex", "co-applicant_sex", "applicant_age_above_62", "co-applicant_age_above_62",
]

# Ordinal age encoding of the applicant / co-applicant age bands.
AGE_CODES = {"<25": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55-64": 4, "65-74": 5, ">74": 6}
AGE_COLUMNS = ["applicant_age", "co-applicant_age"]

# Range-string columns turned into midpoints, and their missing sentinels.
RANGE_COLUMNS = ["debt_to_income_ratio", "total_units"]
RANGE_SENTINELS = ["Unknown", "Exempt", "8888", "9999"]
RANGE_STRIP_CHARS = "%<>"

# Numeric columns coerced and median-imputed.
NUMERIC_IMPUTE_COLUMNS = [
    "loan_amount", "property_value", "income", "loan_to_value_ratio",
    "debt_to_income_ratio", "loan_term", "total_units",
    "applicant_age", "co-applicant_age", "tract_population",
    "tract_minority_population_percent", "ffiec_msa_md_median_family_income",
    "tract_to_msa_income_percentage", "tract_owner_occupied_units",
    "tract_one_to_four_family_homes", "tract_median_age_of_housing_units",
]

# Fill value for missing categorical strings.
UNKNOWN = "Unknown"

# Audit label maps.
AGE_LABELS = {0: "<25", 1: "25-34", 2: "35-44", 3: "45-54", 4: "55-64", 5: "65-74", 6: ">74"}
COUNTY_LABELS = {48029: "Bexar", 48113: "Dallas", 48201: "Harris", 48453: "Travis"}
RACE_LABELS = {
    "White": "White",
    "Black or African American": "Black",
    "Asian": "Asian",
    "American Indian or Alaska Native": "Other",
    "Native Hawaiian or Other Pacific Islander": "Other",
    "Joint": "Other",
}
GENDER_LABELS = {"Male": "Male", "Female": "Female"}

# Declared group order of each audited attribute.
GROUP_ORDER = {
    "Race": ["White", "Black", "Asian", "Other"],
    "Gender": ["Male", "Female"],
    "Age": ["<25", "25-34", "35-44", "45-54", "55-64", "65-74", ">74"],
    "County": ["Bexar", "Dallas", "Harris", "Travis"],
}

# Attributes dropped for the "blind" model.
PROTECTED_FEATURES = ["derived_race", "derived_sex"]

# Default decision threshold, minimum group size, bins, seed.
THRESHOLD = 0.5
MIN_GROUP_SIZE = 10
ECE_BINS = 10
CURVE_BINS = 5
SEED = 42
TEST_FRACTION = 0.2

# --------------------------------------------------------------------------- #
# Cleaned-table typing (which surviving columns are strings / integer codes)
# --------------------------------------------------------------------------- #

STRING_FEATURES = [
    "conforming_loan_limit", "derived_loan_product_type", "derived_dwelling_category",
    "multifamily_affordable_units", "derived_ethnicity", "derived_race", "derived_sex",
]

INT_CODE_FEATURES = [
    "derived_msa-md", "county_code", "preapproval", "loan_type", "loan_purpose",
    "lien_status", "reverse_mortgage", "open-end_line_of_credit",
    "business_or_commercial_purpose", "negative_amortization", "interest_only_payment",
    "balloon_payment", "other_nonamortizing_features", "construction_method",
    "occupancy_type", "manufactured_home_secured_property_type",
    "manufactured_home_land_property_interest", "applicant_credit_score_type",
    "co-applicant_credit_score_type", "submission_of_application",
]

TARGET = "target"

# Raw dictionary columns in source order (all ingested as strings).
RAW_COLUMNS = [
    "activity_year", "lei", "derived_msa-md", "state_code", "county_code", "census_tract",
    "conforming_loan_limit", "derived_loan_product_type", "derived_dwelling_category",
    "action_taken", "purchaser_type",
    "preapproval", "loan_type", "loan_purpose", "lien_status", "reverse_mortgage",
    "open-end_line_of_credit", "business_or_commercial_purpose", "loan_amount",
    "loan_to_value_ratio", "loan_term",
    "interest_rate", "rate_spread", "hoepa_status", "total_loan_costs", "total_points_and_fees",
    "origination_charges", "discount_points", "lender_credits", "prepayment_penalty_term",
    "intro_rate_period", "negative_amortization", "interest_only_payment", "balloon_payment",
    "other_nonamortizing_features", "property_value", "construction_method",
    "occupancy_type", "manufactured_home_secured_property_type",
    "manufactured_home_land_property_interest", "total_units", "multifamily_affordable_units",
    "income", "debt_to_income_ratio", "applicant_credit_score_type",
    "co-applicant_credit_score_type", "submission_of_application",
    "initially_payable_to_institution",
    "derived_ethnicity",
    "applicant_ethnicity-1", "applicant_ethnicity-2", "applicant_ethnicity-3",
    "applicant_ethnicity-4", "applicant_ethnicity-5",
    "co-applicant_ethnicity-1", "co-applicant_ethnicity-2", "co-applicant_ethnicity-3",
    "co-applicant_ethnicity-4", "co-applicant_ethnicity-5",
    "applicant_ethnicity_observed", "co-applicant_ethnicity_observed",
    "derived_race",
    "applicant_race-1", "applicant_race-2", "applicant_race-3", "applicant_race-4", "applicant_race-5",
    "co-applicant_race-1", "co-applicant_race-2", "co-applicant_race-3",
    "co-applicant_race-4", "co-applicant_race-5",
    "applicant_race_observed", "co-applicant_race_observed",
    "derived_sex", "applicant_sex", "co-applicant_sex", "applicant_sex_observed",
    "co-applicant_sex_observed", "applicant_age", "co-applicant_age",
    "applicant_age_above_62", "co-applicant_age_above_62",
    "aus-1", "aus-2", "aus-3", "aus-4", "aus-5",
    "denial_reason-1", "denial_reason-2", "denial_reason-3", "denial_reason-4",
    "tract_population", "tract_minority_population_percent",
    "ffiec_msa_md_median_family_income", "tract_to_msa_income_percentage",
    "tract_owner_occupied_units", "tract_one_to_four_family_homes",
    "tract_median_age_of_housing_units",
]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def raw_schema(columns: list[str] | None = None) -> T.StructType:
    """All-string schema for a raw extract (explicit; never inferred)."""
    if columns is None:
        return RAW_SCHEMA
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
