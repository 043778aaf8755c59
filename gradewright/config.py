"""Constants of the learning model and the text pipeline, in one place (fixed values)."""

# Text pipeline
CHUNK_TARGET, CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 900, 300, 1400, 0.15
CHROME_SHARE, MIN_PAGE_CHARS, NGRAM = 0.30, 40, 8
# Vectors
DUPLICATE_COS, VARIANT_COS, MERGE_COS, BRIDGE_COS, BRIDGE_TOP, LIFT_COS, OPTION_COS = 0.90, 0.83, 0.92, 0.60, 6, 0.90, 0.85
# Ability and question ratings
K_BASE, K_MIN, K_MAX, KQ_BASE, THETA_MAX, MASTERY_LOGIT = 0.6, 0.08, 0.6, 0.15, 6.0, 0.3
CONFIDENCE = {
    ("correct", "sure"): 1.0, ("correct", "unsure"): 0.7, ("correct", "guessing"): 0.25,
    ("wrong", "sure"): 1.6, ("wrong", "unsure"): 1.0, ("wrong", "guessing"): 0.6,
}
# Retention
GROW_BASE, GROW_MASTERY, FAIL_MULT, STABILITY_MIN, DUE_R = 1.4, 1.8, 0.35, 0.5, 0.85
# Priorities and sampling
WEIGHT_WEAK, WEIGHT_OVERDUE, WEIGHT_MISCONCEPTION, WEIGHT_NOVELTY = 0.45, 0.30, 0.20, 0.05
SOFTMAX_T, DIFFICULTY_OFFSET, CLEAR_STREAK, DIAGNOSTIC_K = 0.7, 0.3, 2, 0.5
# Exams
NEGATIVE, SE_BASE, CALIBRATION_DAYS, DEAD_PULLS, INTERVAL = 0.25, 1.2, 3, 20, (0.025, 0.975)
RESERVE_DAYS, REUSE_DAYS, MIN_COVERAGE, PASS_SHARE = 3, 5, 0.30, 0.6
# Intake
PARSE_LEAST, COVER_LEAST = 0.98, 0.97
