"""Values that results depend on, in one place.

Everything below is a fixed value: changing one changes results.
"""

# --- fixed values: classes, bands, horizon -----------------------------------
NUM_CLASSES = 4
SEVERE = 3                            # worst class after capping
CARVE_CATEGORY = 3                    # current category >= this is never ranked
RAW_CATEGORIES = 5                    # raw bands 0..4
DPD_BAND_STARTS = (1, 61, 156, 181)   # 0 / 1-60 / 61-155 / 156-180 / 181+
LABEL_MONTHS = 6
DAYS_PER_MONTH = 30.4375
NEVER = 99999                         # "event never happened" code
CLASS_NAMES = ("No Delay", "Current", "Past Due+", "Severe Past Due")

# COST[true][predicted]
COST_MATRIX = (
    (0.0, 0.5, 1.0, 1.5),
    (1.5, 0.0, 0.5, 1.0),
    (4.0, 2.0, 0.0, 0.5),
    (7.5, 5.0, 2.5, 0.0),
)

# --- fixed values: call budget and queue --------------------------------------
CALLS_PER_HOUR = 240
REF_WINDOWS = {"1_day": 24, "1_week": 168, "1_month": 720}    # name -> hours
CALL_TTL_DAYS = 30
EXPOSURE_FEATURE = "REMAINING_AMNT"

# --- fixed values: splits, calibration ----------------------------------------
SEED = 42
CUSTOMER_VAL_FRACTION = 0.20
CALIBRATION_MIN_STRATUM_N = 5000
MIN_TRAIN_SNAPSHOTS = 1

# --- fixed values: monitor ----------------------------------------------------
USABLE_RUN_STATUSES = ("SUCCESS", "PARTIAL_SUCCESS")
MONITOR_CUTOFFS = {"top_1pct": 0.01, "top_5pct": 0.05, "top_1000": 1000}
MONITOR_MAIN_CUTOFF = "top_5pct"
PSI_REF_SNAPSHOTS = 6
WILSON_Z = 1.96

# --- fixed values: feed checks ------------------------------------------------
CATEGORY_COLS = ("LOAN_CATEGORY", "CATEGORY_T1", "CATEGORY_T2", "CATEGORY_T3",
                 "WORST_FUTURE_CAT", "HIST_MAX_CATEGORY")
DAYS_SINCE_LADDER = ("DAYS_SINCE_LAST_DPD", "DAYS_SINCE_LAST_30_DPD",
                     "DAYS_SINCE_LAST_60_DPD", "DAYS_SINCE_LAST_90_DPD")
SENTINEL_CHECK_MIN_ROWS = 1000

# --- fixed values: arms -------------------------------------------------------
TREE_DEFAULTS = {"n_trees": 200, "max_depth": 5, "learning_rate": 0.05,
                 "subsample": 0.8, "colsample": 0.8}
ARMS = ("multiclass", "binary", "ordinal", "per_cat")
FULL_DISTRIBUTION_ARMS = ("multiclass", "ordinal", "per_cat")
DEPLOY_ARM = "multiclass"

# --- fixed values: diagnostics ------------------------------------------------
DELETION_CANARIES = (
    "COUNT_ACTIVE_CONTRACTS", "COUNT_DELINQUENT_CONTRACTS", "AVG_DPD_OTHER_LOANS",
    "MAX_DPD_ANY_PAST_LOAN", "WORST_CLOSED_LOAN_DPD", "AVERAGE_CLOSE_LOAN_DPD",
    "CNT_RECOVERED_BEFORE", "HAS_RECOVERED_BEFORE", "HAS_EVER_BEEN_NPL",
    "PRE_UPTO30_DPD_LOANS", "PRE_UPTO150_DPD_LOANS",
)
RHO_THRESHOLD = 0.7
UNSTABLE_AP = 0.45
CLIP_MIN_TAIL_ROWS = 200
CLIP_MIN_EVENTS = 100
SWAMP_RATIO = 0.5
CLIP_LIFT_THRESHOLD = 1.5
CLIP_GRADIENT_THRESHOLD = 1.5
CLIP_HIGH_NULL_RATE = 0.002
SKIM_QUANTILES = (.5, .8, .9, .95, .99, .995, .999)
STAT_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

# --- fixed values: response explorer ------------------------------------------
RESPONSE_META_COLUMNS = (
    "national_code", "snapshot_date", "n_loans_in_portfolio", "current_cat",
    "endpoint", "risk_rank", "risk_score", "expected_cost", "predicted_class",
    "rule_flag", "risk_bin", "p_no_delay", "p_current", "p_past_due",
    "p_severe_past_due", "worst_future_cat", "worst_future_dpd", "dpd_days",
    "called_at",
)
PII_SUBSTRINGS = (
    "name", "family", "address", "dateofbirth", "birthdate",
    "phone", "mobile", "email", "nationalid", "nationalcode", "iban", "contact",
)
MIN_PRESENT = 20
MAX_CAT_LEVELS = 12
MAX_ID_CARDINALITY = 50
MIN_ROWS_PER_LEVEL = 5

# --- fixed values: the loan table's columns, in order -------------------------
# name, type, role, then flags. "null" = nullable, "binary" = 0/1 flag,
# "noclip"/"noscale" = exempt, "sentinel" = carries NEVER, "unit" = clip to [0,1].
CONTRACT_VERSION = 3
CONTRACT_COLUMNS = """
LOAN_ID BIGINT key
SNAPSHOT_DATE BIGINT key
DPD_DAYS INT feature
LOAN_CATEGORY INT feature noclip
DAYS_TO_NEXT_THRESHOLD INT feature
PAYED_OVERDUE_INST_CNT INT feature noclip
UNPAYED_INST_CNT INT feature
PAYED_OVERDUE_AMNT DECIMAL(18,2) feature
MATURED_INST_CNT INT feature null
OVERDUE_RATIO FLOAT feature unit
IS_IN_WARNING_ZONE INT feature binary
ONTIME_RATIO FLOAT feature null unit
UPCOMING_INST_CNT INT feature null
UPCOMING_AMNT DECIMAL(18,2) feature null
CNT_INSTALLMENT_WARNING_ZONE INT feature null
DPD_DAYS_T1 INT feature
DPD_DAYS_T2 INT feature
DPD_DAYS_T3 INT feature
DPD_DAYS_T4 INT feature
DPD_DAYS_T5 INT feature
CATEGORY_T1 INT feature noclip
CATEGORY_T2 INT feature noclip
CATEGORY_T3 INT feature noclip
DPD_TREND_1M FLOAT feature noclip
DPD_TREND_3M FLOAT feature noclip
CATEGORY_TREND_1M FLOAT feature noclip
CATEGORY_TREND_3M FLOAT feature noclip
IS_DETERIORATING INT feature binary
IS_ACCELERATING INT feature binary
IS_IMPROVING INT feature binary
MONTHS_IN_CURRENT_CATEGORY INT feature noclip
HIST_MAX_DPD_DAYS INT feature null noclip
HIST_MAX_CATEGORY INT feature null noclip
HAS_EVER_BEEN_NPL INT feature binary
HAS_EVER_BEEN_PRENPL INT feature binary
HAS_RECOVERED_BEFORE INT feature binary
CNT_RECOVERED_BEFORE INT feature null
COUNT_CATEGORY_CHANGES INT feature null
COUNT_DPD_EVENTS_LAST_3M INT feature null noclip
COUNT_DPD_EVENTS_LAST_6M INT feature null noclip
COUNT_30PLUS_DPD_LAST_3M INT feature null noclip
COUNT_60PLUS_DPD_LAST_3M INT feature null noclip
COUNT_90PLUS_DPD_LAST_3M INT feature null noclip
MAX_DPD_LAST_3M INT feature null
MAX_DPD_LAST_6M INT feature null
TOTAL_DPD_DAYS_LAST_3M INT feature null
TOTAL_DPD_DAYS_LAST_6M INT feature null
CONSECUTIVE_MONTHS_WITH_DPD INT feature
DAYS_SINCE_LAST_DPD INT feature sentinel noclip noscale
DAYS_SINCE_LAST_30_DPD INT feature sentinel noclip noscale
DAYS_SINCE_LAST_60_DPD INT feature sentinel noclip noscale
DAYS_SINCE_LAST_90_DPD INT feature sentinel noclip noscale
WORST_CLOSED_LOAN_DPD INT feature null
AVERAGE_CLOSE_LOAN_DPD FLOAT feature null
MAX_DPD_ANY_PAST_LOAN INT feature null
AVG_DPD_OTHER_LOANS FLOAT feature null
PRE_UPTO30_DPD_LOANS INT feature null noclip
PRE_UPTO60_DPD_LOANS INT feature null noclip
PRE_UPTO120_DPD_LOANS INT feature null noclip
PRE_UPTO150_DPD_LOANS INT feature null noclip
COUNT_ACTIVE_CONTRACTS INT feature null noclip
COUNT_DELINQUENT_CONTRACTS INT feature null noclip
CONTRACT_AGE_MONTH INT feature null
PCT_COMPLETED FLOAT feature null unit
REMAINING_INST_CNT INT feature
REMAINING_AMNT DECIMAL(18,2) feature
WORST_FUTURE_DPD INT label null
WORST_FUTURE_CAT INT label null
NATIONAL_CODE VARCHAR(20) meta null
CONTRACT_NUMBER VARCHAR(50) meta null
LABEL_HORIZON_DATE BIGINT meta null
"""
