"""Fixed values the engine must share with the original application.

Everything in this module is data, not logic: status vocabularies, the
default migration matrix, rate constants, placeholders and thresholds.
They are stated plainly, in their natural order, so results line up with
the application this engine re-implements.
"""

from __future__ import annotations

# --- fixed values: loan status vocabulary ---------------------------------
# Finished loans and their binary default label (0 paid, 1 default).
FINISHED_STATUS_LABEL = {
    "Fully Paid": 0,
    "Does not meet the credit policy. Status:Fully Paid": 0,
    "Charged Off": 1,
    "Default": 1,
    "Does not meet the credit policy. Status:Charged Off": 1,
}
# Ongoing loans and their credit state (4 = default, absorbing).
ONGOING_STATUS_STATE = {
    "Current": 0,
    "In Grace Period": 1,
    "Late (16-30 days)": 2,
    "Late (31-120 days)": 3,
}
ONGOING_STATUSES = list(ONGOING_STATUS_STATE)
# Status values that mark a defaulted loan for realised LGD.
DEFAULTED_STATUSES = ["Charged Off", "1", "Default"]

# --- fixed values: default 5x5 migration matrix (rows = from state) ------
DEFAULT_TPM = [
    [0.95, 0.03, 0.01, 0.01, 0.00],
    [0.40, 0.40, 0.15, 0.04, 0.01],
    [0.15, 0.10, 0.50, 0.20, 0.05],
    [0.05, 0.05, 0.10, 0.40, 0.40],
    [0.00, 0.00, 0.00, 0.00, 1.00],
]
DEFAULT_STATE = 4
PD_HORIZON_STEPS = 12

# --- fixed values: risk tag by state ---------------------------------------
STATE_TAG = {0: "stable", 1: "late", 2: "attention", 3: "warning", 4: "default"}

# --- fixed values: monitoring actions (tag, PD threshold, above, at-or-below)
ACTION_RULES = [
    ("late", 0.15, "direct outreach", "automated reminder"),
    ("attention", 0.40, "escalate to collections", "soft call"),
    ("warning", 0.50, "legal recovery initiation", "hard collection"),
]
DEFAULT_ACTION = "monitor"
PROVISION_TAGS = ["warning", "attention"]

# --- fixed values: LGD defaults and scenario multipliers -------------------
MISSING_LGD = 0.45
LGD_LOWER_FACTOR = 0.9
LGD_UPPER_FACTOR = 1.2

# --- fixed values: capital ---------------------------------------------------
CAPITAL_PD_FLOOR = 1e-6
CAPITAL_PD_CAP = 0.99
CAPITAL_LGD_FLOOR = 0.05
STANDARD_WEIGHT = 0.75
STANDARD_WEIGHT_DISTRESSED = 1.50
DISTRESSED_TAGS = ["warning", "attention"]
CORR_LOW = 0.03
CORR_HIGH = 0.16
CORR_DECAY = 35.0
IRB_CONFIDENCE = 0.999
IRB_MATURITY_SCALE = 1.06
IRB_SCALING = 0.85
RWA_MULTIPLIER = 12.5
N_SCENARIOS = 10000

# --- fixed values: pricing ---------------------------------------------------
FED_FUNDS_RATE = 0.0525
OPERATIONAL_COST = 0.0200
PURPOSE_SPREADS = {
    "debt_consolidation": 0.0150, "credit_card": 0.0140,
    "home_improvement": 0.0120, "car": 0.0100,
    "major_purchase": 0.0160, "medical": 0.0130,
    "house": 0.0150, "vacation": 0.0250,
    "wedding": 0.0200, "small_business": 0.0350,
    "moving": 0.0250, "renewable_energy": 0.0120,
    "other": 0.0250,
}
DEFAULT_SPREAD = 0.0250
RISK_PREMIUM_FACTOR = 45.0
USURY_CAP = 35.99

# --- fixed values: scorecard -------------------------------------------------
SCORE_PDO = 20.0
SCORE_BASE = 600.0
SCORE_BASE_ODDS = 50.0

# --- fixed values: cleaning --------------------------------------------------
STRING_PLACEHOLDERS = ["?", "-1", "-1.0", "NAN", "nan", "n/a", "None"]
NEGATIVE_EXEMPT = ["dti", "revol_util", "dti_joint"]
DATE_COLUMNS = ["issue_d", "earliest_cr_line", "last_pymnt_d", "next_pymnt_d",
                "last_credit_pull_d"]
CRUCIAL_COLUMNS = [
    "id", "loan_amnt", "term", "emp_length", "home_ownership",
    "annual_inc", "purpose", "addr_state", "dti", "fico_range_low",
    "fico_range_high", "open_acc", "pub_rec", "revol_bal", "revol_util",
]
ALWAYS_KEEP = ["loan_status", "int_rate"]
ROW_NULL_THRESHOLD = 0.5
COLUMN_NULL_LIMIT = 0.25
MISSING_CRUCIAL = ["loan_amnt", "annual_inc", "dti", "loan_status"]
MISSING_DROP_SHARE = 0.05
REJECTED_RENAME = {
    "Amount Requested": "loan_amnt",
    "Application Date": "issue_d",
    "Loan Title": "title",
    "Risk_Score": "fico_range_high",
    "Debt-To-Income Ratio": "dti",
    "Zip Code": "zip_code",
    "State": "addr_state",
    "Employment Length": "emp_length",
    "Policy Code": "policy_code",
}

# --- fixed values: feature engineering ---------------------------------------
CREDIT_AGE_REFERENCE = "2019-01-01"
CREDIT_AGE_FALLBACK = "2010-01-01"
DEFAULT_TERM_MONTHS = 36.0
FEATURE_SOURCE_COLUMNS = ["loan_amnt", "annual_inc", "earliest_cr_line",
                          "avg_cur_bal", "total_rev_hi_lim", "inq_last_6mths",
                          "num_tl_op_past_12m"]

# --- fixed values: model feature lists ----------------------------------------
REVIEW_FEATURES = ["loan_amnt", "emp_length", "issue_d", "title", "zip_code",
                   "addr_state", "dti", "fico_range_high", "policy_code"]
REVIEW_CATEGORICAL = ["emp_length", "title", "zip_code", "addr_state"]
LGD_CATEGORICAL = ["purpose", "addr_state", "disbursement_method", "term"]

# --- fixed values: sampling sizes and seeds ----------------------------------
TRAIN_SAMPLE = 40000
TRAIN_SEED = 42
SCORE_SAMPLE = 5000
SCORE_SEED = 7
MONITOR_CAP = 50000
STRATUM_CAP = 10000
UI_SAMPLE = 30
THRESHOLD_POINTS = 100

# --- fixed values: stage column selectors ------------------------------------
PD_FEATURES = [
    "loan_amnt", "term", "grade", "emp_title", "home_ownership",
    "annual_inc", "verification_status", "dti", "earliest_cr_line",
    "inq_last_6mths", "total_rev_hi_lim", "acc_open_past_24mths",
    "avg_cur_bal", "bc_open_to_buy", "bc_util", "mo_sin_old_rev_tl_op",
    "mo_sin_rcnt_rev_tl_op", "mo_sin_rcnt_tl", "mort_acc",
    "mths_since_recent_bc", "mths_since_recent_inq", "num_actv_rev_tl",
    "num_tl_op_past_12m",
]
PD_TRAIN_COLUMNS = ["id", "loan_status"] + PD_FEATURES
PD_PREDICT_COLUMNS = ["id"] + PD_FEATURES
PRICING_TRAIN_COLUMNS = ["loan_status"] + PD_FEATURES + ["purpose"]
PRICING_PREDICT_COLUMNS = ["id"] + PD_FEATURES + ["purpose"]
LGD_TRAIN_COLUMNS = [
    "id", "loan_status", "int_rate", "term", "purpose", "addr_state",
    "disbursement_method", "annual_inc", "home_ownership", "loan_amnt",
    "total_rec_prncp", "recoveries", "collection_recovery_fee",
    "total_pymnt", "last_pymnt_amnt", "debt_settlement_flag",
]
LGD_PREDICT_STATUS_COLUMNS = ["id", "loan_status", "purpose", "addr_state",
                              "disbursement_method", "term", "int_rate"]
LGD_PREDICT_COLUMNS = ["id", "purpose", "addr_state", "disbursement_method", "term", "int_rate"]
FEATURE_DROP_COLUMNS = ["loan_amnt", "earliest_cr_line", "avg_cur_bal", "inq_last_6mths",
                        "num_tl_op_past_12m", "mo_sin_old_rev_tl_op", "term"]

# --- fixed values: declared types of the accepted-loan file, in file order -----
ACCEPTED_TYPES = {
    "id": "string", "member_id": "string", "loan_amnt": "double", "funded_amnt": "double",
    "funded_amnt_inv": "double", "term": "string", "int_rate": "double", "installment": "double", "grade": "string",
    "sub_grade": "string", "emp_title": "string", "emp_length": "string", "home_ownership": "string",
    "annual_inc": "double", "verification_status": "string", "issue_d": "string", "loan_status": "string",
    "pymnt_plan": "string", "url": "string", "desc": "string", "purpose": "string", "title": "string",
    "zip_code": "string", "addr_state": "string", "dti": "double", "delinq_2yrs": "double",
    "earliest_cr_line": "string", "fico_range_low": "double", "fico_range_high": "double", "inq_last_6mths": "double",
    "mths_since_last_delinq": "double", "mths_since_last_record": "double", "open_acc": "double", "pub_rec": "double",
    "revol_bal": "double", "revol_util": "double", "total_acc": "double", "initial_list_status": "string",
    "out_prncp": "double", "out_prncp_inv": "double", "total_pymnt": "double", "total_pymnt_inv": "double",
    "total_rec_prncp": "double", "total_rec_int": "double", "total_rec_late_fee": "double", "recoveries": "double",
    "collection_recovery_fee": "double", "last_pymnt_d": "string", "last_pymnt_amnt": "double",
    "next_pymnt_d": "string", "last_credit_pull_d": "string", "last_fico_range_high": "double",
    "last_fico_range_low": "double", "collections_12_mths_ex_med": "double", "mths_since_last_major_derog": "double",
    "policy_code": "double", "application_type": "string", "annual_inc_joint": "double", "dti_joint": "double",
    "verification_status_joint": "string", "acc_now_delinq": "double", "tot_coll_amt": "double",
    "tot_cur_bal": "double", "open_acc_6m": "double", "open_act_il": "double", "open_il_12m": "double",
    "open_il_24m": "double", "mths_since_rcnt_il": "double", "total_bal_il": "double", "il_util": "double",
    "open_rv_12m": "double", "open_rv_24m": "double", "max_bal_bc": "double", "all_util": "double",
    "total_rev_hi_lim": "double", "inq_fi": "double", "total_cu_tl": "double", "inq_last_12m": "double",
    "acc_open_past_24mths": "double", "avg_cur_bal": "double", "bc_open_to_buy": "double", "bc_util": "double",
    "chargeoff_within_12_mths": "double", "delinq_amnt": "double", "mo_sin_old_il_acct": "double",
    "mo_sin_old_rev_tl_op": "double", "mo_sin_rcnt_rev_tl_op": "double", "mo_sin_rcnt_tl": "double",
    "mort_acc": "double", "mths_since_recent_bc": "double", "mths_since_recent_bc_dlq": "double",
    "mths_since_recent_inq": "double", "mths_since_recent_revol_delinq": "double", "num_accts_ever_120_pd": "double",
    "num_actv_bc_tl": "double", "num_actv_rev_tl": "double", "num_bc_sats": "double", "num_bc_tl": "double",
    "num_il_tl": "double", "num_op_rev_tl": "double", "num_rev_accts": "double", "num_rev_tl_bal_gt_0": "double",
    "num_sats": "double", "num_tl_120dpd_2m": "double", "num_tl_30dpd": "double", "num_tl_90g_dpd_24m": "double",
    "num_tl_op_past_12m": "double", "pct_tl_nvr_dlq": "double", "percent_bc_gt_75": "double",
    "pub_rec_bankruptcies": "double", "tax_liens": "double", "tot_hi_cred_lim": "double",
    "total_bal_ex_mort": "double", "total_bc_limit": "double", "total_il_high_credit_limit": "double",
    "revol_bal_joint": "double", "sec_app_fico_range_low": "double", "sec_app_fico_range_high": "double",
    "sec_app_earliest_cr_line": "string", "sec_app_inq_last_6mths": "double", "sec_app_mort_acc": "double",
    "sec_app_open_acc": "double", "sec_app_revol_util": "double", "sec_app_open_act_il": "double",
    "sec_app_num_rev_accts": "double", "sec_app_chargeoff_within_12_mths": "double",
    "sec_app_collections_12_mths_ex_med": "double", "sec_app_mths_since_last_major_derog": "double",
    "hardship_flag": "string", "hardship_type": "string", "hardship_reason": "string", "hardship_status": "string",
    "deferral_term": "double", "hardship_amount": "double", "hardship_start_date": "string",
    "hardship_end_date": "string", "payment_plan_start_date": "string", "hardship_length": "double",
    "hardship_dpd": "double", "hardship_loan_status": "string",
    "orig_projected_additional_accrued_interest": "double", "hardship_payoff_balance_amount": "double",
    "hardship_last_payment_amount": "double", "disbursement_method": "string", "debt_settlement_flag": "string",
    "debt_settlement_flag_date": "string", "settlement_status": "string", "settlement_date": "string",
    "settlement_amount": "double", "settlement_percentage": "double", "settlement_term": "double",
}
