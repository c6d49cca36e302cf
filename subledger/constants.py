"""Fixed business values the reports depend on.

These must equal the source warehouse's values for results to match; each is
also exposed as a keyword default so callers can override it.
"""

import datetime as _dt

# --- fixed values -----------------------------------------------------------
# Business time zone for turning UTC instants into local dates.
BUSINESS_TZ = "Europe/Prague"
# VAT multiplier (20 %), applied as a double, never as a decimal literal.
VAT_RATE = 1.2
# Invoice type codes and their labels; codes outside the list map to NULL.
INVOICE_TYPE_LABELS = {1: "invoice", 2: "return", 3: "credit_note", 4: "other"}
# Invoice status codes below this value have been issued.
ISSUED_STATUS_LIMIT = 100
# Product categories that are sold (kept in L2).
SOLD_CATEGORIES = ("product", "rent")
# Product types the reports single out.
TRIAL_TYPE = "product_trial"
EQUIPMENT_TYPE = "equipment"
# End date that marks an open-ended ("unlimited") product.
UNLIMITED_END_DATE = _dt.date(2035, 12, 31)
# Report cut-offs.
CHURN_CUTOFF = _dt.date(2024, 9, 1)
DISCONTINUATION_DATE = _dt.date(2023, 7, 31)
CANCELLATION_WINDOW = (_dt.date(2021, 1, 1), _dt.date(2024, 9, 30))
# Contract-duration bins: inclusive upper bounds in days, then labels
# (one more label than bounds; the last one catches everything else, NULL too).
DURATION_BIN_BOUNDS = (30, 61, 91, 122, 152, 183, 365, 1230)
DURATION_BIN_LABELS_V1 = ("M1", "M2", "M3", "M4", "M5", "M6", "M6-M12", "Y2", "Y2+")
DURATION_BIN_LABELS = ("M1", "M2", "M3", "M4", "M5", "M6", "M6-M12", "Y1-Y2", "Y2+")
# Revenue segments by global percentile of revenue per contract, lowest first.
SEGMENT_PERCENTILES = (0.25, 0.50, 0.75)
SEGMENT_LABELS = (
    "Light spenders (bottom quartile)",
    "Moderate spenders (3rd quartile)",
    "Heavy spenders (2nd quartile)",
    "Superstars (top quartile)",
)
# Top-k sizes of the ranked reports.
TOP_CHURNED_CONTRACTS = 50
TOP_CANCEL_DATES = 50
TOP_PRODUCT_END_DATES = 20
TOP_SPENDERS = 50
# ---------------------------------------------------------------------------

# Digits kept on aggregated money / mean values, so results do not depend on
# the order in which a distributed sum adds its terms.
RESULT_DIGITS = 4
