"""Rule tables. Values below are fixed values: results depend on them being exactly these."""

from __future__ import annotations

# fixed values: scoring weights and thresholds
SCORING = {
    "method_version": "1.1.0",
    "minimum_sector_size": 5,
    "completeness": {"core_weight": 2, "essential_weight": 1},
    "substance": {
        "quantified_target": "0.35",
        "dated_commitment": "0.25",
        "methodology": "0.20",
        "originality": "0.20",
        "company_threshold": 3,
        "phrase_words": 8,
    },
    "assurance_readiness": {"assurance": "0.40", "core_coverage": "0.35", "lineage": "0.25"},
    "screen_tolerance": "0.01",
}

# fixed values: unit -> (family, canonical unit, factor to the canonical unit)
UNITS = {
    "gj": ("energy", "GJ", "1"),
    "kwh": ("energy", "GJ", "0.0036"),
    "mwh": ("energy", "GJ", "3.6"),
    "kl": ("water", "KL", "1"),
    "kilolitre": ("water", "KL", "1"),
    "kilolitres": ("water", "KL", "1"),
    "ml": ("water", "KL", "1000"),
    "megalitre": ("water", "KL", "1000"),
    "megalitres": ("water", "KL", "1000"),
    "tco2e": ("emissions", "tCO2e", "1"),
    "kgco2e": ("emissions", "tCO2e", "0.001"),
    "mtco2e": ("emissions", "tCO2e", "1000000"),
    "mt": ("mass", "MT", "1"),
    "kg": ("mass", "MT", "0.001"),
    "percent": ("percentage", "percent", "1"),
    "%": ("percentage", "percent", "1"),
    "count": ("count", "count", "1"),
    "inr": ("currency", "INR", "1"),
}

# fixed values: reported-amount scales
SCALE_FACTORS = {"inr": 1, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000}
ABSOLUTE_THRESHOLD = 1_000_000_000

# fixed values: publication gates
QA_PASSED = ("sampled_ok", "corrected")
PUBLISH_CONFIDENCE = "0.90"
FAMILY_ACCURACY_TARGET = "0.98"
BULK_ACCEPT_CONFIDENCE = "0.90"

# fixed values: governed query catalogue
TIERS_ALL = ("explore", "pro", "studio", "research")
TIERS_PAID = ("pro", "studio", "research")
DIMENSIONS = ("sector", "industry", "mcap_band", "fy", "company", "assurance_status")
SHAPES = ("distribution", "ranking", "timeseries", "comparison", "single")
OPERATORS = ("eq", "in", "gte", "lte", "between", "score_band", "top_n", "bottom_n")
SCORE_MEASURES = ("completeness", "substance", "assurance_readiness")
COHORT_LABEL = "anonymised lower-performing cohort"

# fixed values: themes of questions, feature labels, outcomes counted as positive
THEME_SEEDS = {
    "Assurance & Core": "assurance brsr core deadline audit readiness",
    "Climate & energy": "climate emissions energy renewable scope carbon intensity",
    "Water & waste": "water waste circularity recycling discharge",
    "Workforce & rights": "employee workforce diversity safety human rights grievance",
    "Peer benchmarking": "compare peer sector benchmark leader ranking",
}
THEME_OTHER = "Other disclosure questions"
POSITIVE_OUTCOMES = ("qualified", "meeting", "proposal", "won")
BLOCKED_TERMS = ("stock tip", "share price", "buy stock", "sell stock", "weather", "cricket")

# fixed values: document kinds, first kind wins a tie
DOCUMENT_KINDS = (
    ("policy", ("policy", "code of conduct", "governance")),
    ("hr_report", ("employee", "worker", "headcount", "training", "safety")),
    ("energy_utility", ("electricity", "energy", "utility", "kwh", "gigajoule")),
    ("sustainability_report", ("sustainability", "esg", "environment")),
    ("prior_brsr", ("business responsibility", "brsr")),
    ("csr_report", ("csr", "corporate social responsibility")),
)

# fixed values: headings that start a section of a report
SECTION_TITLE = "business responsibility and sustainability report"
SECTION_ANCHORS = {
    "a": ("section a", "general disclosures"),
    "b": ("section b", "management and process disclosures"),
    "p1": ("principle 1", "integrity"),
    "p2": ("principle 2", "sustainable and safe goods"),
    "p3": ("principle 3", "employee well-being"),
    "p4": ("principle 4", "stakeholder"),
    "p5": ("principle 5", "human rights"),
    "p6": ("principle 6", "environment"),
    "p7": ("principle 7", "public policy"),
    "p8": ("principle 8", "inclusive growth"),
    "p9": ("principle 9", "consumer value"),
}

# fixed values: quotas by plan tier; a quota that a tier lacks is 0
QUOTAS = {
    "explore": {"nlq_per_day": 10, "exports_per_month": 0, "studio_tokens_per_month": 0},
    "pro": {"nlq_per_day": 100, "exports_per_month": 25, "studio_tokens_per_month": 0},
    "studio": {"nlq_per_day": 100, "exports_per_month": 50, "studio_tokens_per_month": 1000000},
    "research": {
        "nlq_per_day": 500,
        "exports_per_month": 100,
        "studio_tokens_per_month": 0,
        "api_queries_per_minute": 60,
    },
}

# fixed values: two-digit industry divisions per sector
SECTOR_DIVISIONS = (
    ("Agriculture & Natural Resources", (1, 2, 3, 5, 6, 7, 8, 9)),
    ("Manufacturing", (10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33)),
    ("Energy & Utilities", (35, 36, 37, 38, 39)),
    ("Construction & Real Estate", (41, 42, 43, 68)),
    ("Consumer & Logistics", (45, 46, 47, 49, 50, 51, 52, 53, 55, 56)),
    ("Technology & Communications", (58, 59, 60, 61, 62, 63)),
    ("Financial Services", (64, 65, 66)),
    ("Professional Services", (69, 70, 71, 72, 73, 74, 75, 77, 78, 79, 80, 81, 82)),
    ("Health, Education & Social", (84, 85, 86, 87, 88, 90, 91, 92, 93, 94, 95, 96)),
)
SECTOR_FALLBACK = "Other / Review Required"
