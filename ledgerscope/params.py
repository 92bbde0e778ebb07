"""Parameters of the loan book. Results depend on them being exactly these."""

from __future__ import annotations

CRORE = 10_000_000

PRODUCTS = ["BNPL", "Personal", "SME"]
GRADES = ["A", "B", "C", "D", "E"]
BUCKETS = ["Current", "1-30", "31-60", "61-90", "90+"]
CHANNELS = ["Referral", "Partner-embedded", "Digital ads", "Organic", "DSA"]
STATUSES = ["Active", "Closed", "Written-off"]

# severity, fee and running cost per product
LGD = {"BNPL": 0.40, "Personal": 0.65, "SME": 0.75}
FEE_RATE = {"BNPL": 0.005, "Personal": 0.015, "SME": 0.015}
SERVICING_PER_MONTH = 80
COST_OF_FUNDS = 0.11

# days past due
DPD_MISS = 30
DPD_PARTIAL = 15
DPD_FULL = -30
DEFAULT_DPD = 90
WRITE_OFF_DPD = 180
ESCALATION_DPD = 30

# right-closed ticket bands: product -> (edges, labels)
TICKET_BANDS = {
    "BNPL": ([10_000, 25_000], ["<10k", "10-25k", ">25k"]),
    "Personal": ([50_000, 150_000], ["<50k", "50-150k", ">150k"]),
    "SME": ([250_000, 1_000_000], ["<250k", "250k-1M", ">1M"]),
}
MIN_BAND_SHARE = 0.05
# right-closed tenure bands: product -> (edges, labels)
TENURE_BANDS = {
    "BNPL": ([3], ["1-3", "4-6"]),
    "Personal": ([12, 24], ["3-12", "13-24", "25-36"]),
    "SME": ([12, 24], ["6-12", "13-24", "25-36+"]),
}
CASHFLOW_EDGES = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 1.0]
CASHFLOW_LABELS = ["<0.3", "0.3-0.4", "0.4-0.5", "0.5-0.6", "0.6-0.7", "0.7+"]

SEASONED_MOB = 3
MATURE_MOB = 12

# segments
HIGH_APR = 32.4
HEURISTIC_SEGMENTS = {
    "BNPL": {"ABCDE": "1. BNPL (all grades)"},
    "Personal": {
        "AB": "2. Personal Prime (A-B)",
        "C": "3. Personal Mid (C)",
        "DE": "4. Personal Subprime (D-E)",
    },
    "SME": {"AB": "5. SME Prime (A-B)", "CDE": "6. SME Non-prime (C-D-E)"},
}
FROZEN_SEGMENTS = {
    "BNPL": {"ABC": "1. BNPL (grade A-C)", "DE": "6. Subprime BNPL (D-E)"},
    "Personal": {
        "AB": "2. Personal Prime (A-B)",
        "CDE": "3. Personal Non-prime (C-E)",
    },
    "SME": {"AB": "4. SME Prime (A-B)", "CDE": "5. SME Non-prime (C-E)"},
}
HYBRID_SEGMENTS = {
    "BNPL": {"ABCDE": "1. BNPL (APR ≤ 32.4%)"},
    "Personal": {
        "AB": "2. Personal Prime (A-B)",
        "C": "3. Personal Mid (C)",
        "DE": "4. Personal Subprime (D-E)",
    },
    "SME": {"AB": "5. SME Prime (A-B)", "CDE": "6. SME Non-prime (C-D-E)"},
}
HIGH_APR_SEGMENT = "7. High-APR Danger (>32.4%)"
PRIORITY_SEGMENTS = ["3. Personal Non-prime (C-E)", "6. Subprime BNPL (D-E)"]

# early warning
LABEL_WINDOW = 3
MOB_FLOOR = 3
RECENCY_CAP = 24
TEST_SHARE = 0.25
DAYS_PER_MONTH = 30.44
ROUND_DAYS_PER_MONTH = 30
DETERIORATION_CASHFLOW = 0.60
LOOK_BACK_MONTHS = 6
# feature -> declared direction of risk
FEATURE_SIGNS = {
    "bounce_streak": 1,
    "bounce_count_3m": 1,
    "spending_shock_recency": -1,
    "spending_shock_rate_3m": 1,
    "utilisation_level": 1,
    "utilisation_creep_3m": 1,
    "balance_volatility_level": 1,
    "cashflow_consistency_level": -1,
    "cashflow_consistency_slope": -1,
    "inquiry_velocity_accel": 1,
    "app_engagement_drop": -1,
    "partial_run": 1,
    "first_bounce_flag": 1,
}
FEATURES = list(FEATURE_SIGNS)
LEVEL_FEATURES = ["utilisation_level", "balance_volatility_level", "cashflow_consistency_level"]
ESCALATION_FEATURES = ["dpd_current", "missed_cum_at_t"]
MAX_BINS = 6
WOE_SMOOTHING = 0.5
# risk tree
TREE_LEAVES = 6
TREE_MIN_LEAF = 1000
TREE_REFITS = 25
# mixed-type clusters
CLUSTER_COUNTS = [4, 5, 6]
CLUSTER_STARTS = 2
CLUSTER_ROUNDS = 20
CLUSTER_REFITS, REFIT_ROUNDS = 3, 10
# boosted challenger
BOOST_TREES = 400
BOOST_RATE = 0.03
BOOST_LEAVES = 31
BOOST_MIN_LEAF = 200
BOOST_SHARE = 0.8

# band capacity per month and unit costs
RED_CAPACITY = 500
AMBER_CAPACITY = 1500
COST_FALSE_ALARM = 300
COST_MISSED_DEFAULT = 25_000
BAND_RANK = {"ESCALATION": 0, "RED": 1, "AMBER": 2, "GREEN": 3}
BAND_ACTION = {
    "ESCALATION": "immediate collections",
    "RED": "proactive outreach / restructure",
    "AMBER": "watchlist / monitor monthly",
    "GREEN": "no action",
}
SCORE_GATE = {
    "lead_time": 30.0,
    "oot_auc": 0.70,
    "oot_ks": 0.30,
    "lift": 2.5,
    "stable": 0.15,
}

# posture quadrant: risk split in %, value floor, value above which to grow
POSTURE_SEASONED = (10.0, 0.0, 9600.0)
POSTURE_ALL = (7.6, 0.0, 9550.0)

# near-duplicate segments
NEAR_DEFAULT_PP = 1.0
NEAR_VALUE = 2000.0

# levers
LEVER_CHANNELS = ["Digital ads", "DSA"]
L2_CUTOFF = 0.60
L5_CUTOFF = 0.65
GROWTH_PCT = 10
LEVER_NAMES = {
    "L1": "Lever 1 — Cease BNPL Digital + DSA",
    "L2": "Lever 2 — Tighten Personal D-E (cashflow_consistency < 0.6)",
    "L4": "Lever 4 — Grow SME A-B by 10%",
    "L5": "Lever 5 — Contain SME C-D-E (cashflow_consistency < 0.65)",
}
COMBINED_NAME = "COMBINED (all 4 levers)"
STRESS_LEVELS = [("0pp (baseline)", 0), ("+2pp", 2), ("+3pp", 3)]
EXTENDED_STRESS = [0, 1, 2, 3, 4, 5]
LGD_FLEX = [
    ("LGD −10pp (optimistic)", -0.10),
    ("LGD −5pp", -0.05),
    ("Locked (baseline)", 0.00),
    ("LGD +5pp", 0.05),
    ("LGD +10pp (pessimistic)", 0.10),
]
CUTOFFS = [0.50, 0.55, 0.60, 0.65, 0.70]
GROWTH_RATES = [5, 10, 15, 20]

# gate targets
DEFAULT_BY_PRODUCT = {"BNPL": 0.10, "Personal": 0.07, "SME": 0.05}
DEFAULT_BY_GRADE = {"A": 0.015, "B": 0.035, "C": 0.07, "D": 0.14, "E": 0.26}
TICKET_MEDIANS = {"BNPL": 12_000, "Personal": 120_000, "SME": 800_000}
PRODUCT_MIX = {"BNPL": 0.35, "Personal": 0.45, "SME": 0.20}
GRADE_MIX = {"A": 0.15, "B": 0.30, "C": 0.30, "D": 0.18, "E": 0.07}
CHANNEL_MIX = {
    "Digital ads": 0.35,
    "Partner-embedded": 0.25,
    "Referral": 0.15,
    "DSA": 0.15,
    "Organic": 0.10,
}
REGION_MIX = {"Urban": 0.45, "Semi-urban": 0.40, "Rural": 0.15}
INCOME_MIX = {"Low": 0.35, "Mid": 0.45, "High": 0.20}
EMPLOYMENT_MIX = {"Salaried": 0.45, "Self-employed": 0.25, "Gig": 0.18, "Informal": 0.12}
REPEAT_LOAN_SPLIT = {1: 0.80, 2: 0.16, 3: 0.04}
MIX_TOLERANCE = 0.03
NEW_TO_CREDIT_SHARE = 0.35

FORBIDDEN_COLUMNS = ["true_latent_risk", "_true_latent_risk", "z"]
