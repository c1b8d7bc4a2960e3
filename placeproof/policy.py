"""Vocabularies, thresholds and score tables.

These must equal the published rules for results to agree, so they are stated plainly here and
nowhere else.  `Policy` bundles the knobs a sweep may vary.
"""
from dataclasses import dataclass

# Stored beliefs carry it; the memory arm reads beliefs of the current rules only.
RULES_VERSION = "rules-1"

# Candidate arms in registry order, and which of them carry evidence.
ARMS = ["frozen_baseline", "locality_centroid", "town_centroid", "official_landmark",
        "address_book", "field_evidence", "memory"]
STATIC_ARMS = ARMS[:5]
EVIDENCE_ARMS = ["field_evidence", "memory"]

# Outcome -> base weight, and outcome classes.
OUTCOME_BASE = {
    "met_borrower": 0.95, "met_family": 0.80, "cash_collected": 1.00,
    "neighbour_says_shifted": 0.35, "locked_premises": 0.45,
    "no_such_person": 0.00, "address_not_traceable": 0.00,
}
POSITIVE_OUTCOMES = ["met_borrower", "met_family", "cash_collected"]
AMBIGUOUS_OUTCOMES = ["neighbour_says_shifted", "locked_premises"]
NEGATIVE_OUTCOMES = ["no_such_person", "address_not_traceable"]
OBSERVATION_KINDS = ["visit", "adjudication", "ingest"]

# Ranking tables.
ARM_PRIOR = {
    "field_evidence": 0.62, "memory": 0.55, "frozen_baseline": 0.50, "official_landmark": 0.45,
    "address_book": 0.42, "locality_centroid": 0.38, "town_centroid": 0.15,
}
GRANULARITY_RANK = {"rooftop": 1.00, "street": 0.85, "locality": 0.60, "town": 0.25}
PRECISION_TO_GRANULARITY = {"rooftop": "rooftop", "street": "street", "locality": "locality",
                            "pincode": "locality", "town": "town"}

# Radius table (metres), its calibration size and measured coverage.
# Only a stratum with n >= 15 is published under its own name; the rest fall back to `locality`.
FALLBACK_STRATUM = "locality"
RADIUS_MIN_N = 15
RADIUS_TABLE = [
    ("locality", 539.9, 24, 0.792, True),
    ("street", 162.1, 5, 1.000, False),
    ("pincode", 1204.2, 4, 0.000, False),
    ("rooftop", None, 1, None, False),
]

# Recency half-life in months, by granularity.
HALF_LIFE_MONTHS = {"rooftop": 24.0, "street": 18.0, "locality": 12.0, "town": 6.0}

# Request purposes that need a serve-grade place.
STRICT_PURPOSES = ["NOTICE_SERVICE", "VISIT_PLANNING"]

# Relation phrases, in matching order.
RELATION_WORDS = ["close to", "next to", "opposite", "opp", "near", "behind", "beside", "adjacent",
                  "ಹತ್ತಿರ"]

# Generic address words that never identify a locality (record lookup).
GENERIC_WORDS = [
    "road", "street", "nagar", "layout", "layt", "colony", "cross", "main", "block", "gali",
    "extension", "sector", "ward", "village", "town", "near", "opposite", "behind", "beside",
    "house", "plot", "door", "flat", "floor", "society", "apartment", "east", "west", "north",
    "south",
]
# Generic words for the residue matchers.
RESIDUE_GENERIC_WORDS = [
    "nagar", "nagara", "layout", "layt", "colony", "badavane", "extension", "extn", "block",
    "sector", "stage", "phase", "road", "street", "cross", "main", "lane", "gali", "east", "west",
    "north", "south", "new", "old", "town", "village",
]

# Task state machine, (from, to).
TASK_TRANSITIONS = [
    ("open", "in_progress"), ("open", "resolved"), ("open", "reopened"),
    ("in_progress", "resolved"), ("in_progress", "reopened"),
    ("reopened", "in_progress"), ("reopened", "resolved"), ("resolved", "reopened"),
]
# Reviewer decision -> outcome.
DECISION_OUTCOME = {"confirm": "met_family", "deny": "no_such_person",
                    "inconclusive": "locked_premises"}

# The words a reviewer may use, and the decision each stands for.
DECISION_ALIASES = {
    "confirm": "confirm", "confirmed": "confirm", "location_confirmed": "confirm",
    "deny": "deny", "denied": "deny", "not_true": "deny", "moved_confirmed": "deny",
    "inconclusive": "inconclusive", "unresolved": "inconclusive",
}

# Column availability tiers for the late-column check.
COLUMN_TIERS = {
    "address_text": "T0", "town_id": "T0", "address_type": "T0", "source": "T0", "added_date": "T0",
    "geocoder_x": "T0", "geocoder_y": "T0", "precision": "T0", "centroid_x": "T0", "centroid_y": "T0",
    "pincode": "T0", "approx_radius_m": "T0", "address_style": "T0", "outstanding": "T0",
    "dpd_start": "T0", "channel": "T2", "tenure_months": "T2", "shift": "T2", "checkin_x": "T2",
    "checkin_y": "T2", "gps_accuracy_m": "T2", "dwell_s": "T2", "outcome": "T3", "remark": "T3",
    "photo_hash": "T2", "point_ts": "T2", "surveyed_x": "T4", "surveyed_y": "T4", "split": "meta",
    "ptp_id": "T3",
}


@dataclass(frozen=True)
class Policy:
    """The constants a policy sweep may change; defaults are the published rule set."""
    name: str = "base"
    w_min: float = 0.35
    w_promote: float = 0.50
    consistency_band_m: float = 30.0
    agreement_m: float = 150.0
    contest_multiple: float = 2.0
    negatives_min: int = 2
    stale_days: float = 365.0
    period_gap_days: int = 7
    singles_max: int = 3
    landmark_max_m: float = 1000.0
    locality_coverage: float = 0.5
    period_cut: str = "2024-01-15"


BASE = Policy()
