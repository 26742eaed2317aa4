"""Names, thresholds and word lists that results depend on."""

# --- Fixed values: thresholds -------------------------------------------------
MIN_REPORTS = 3
TIER_STRONG = 2.0
TIER_MODERATE = 1.0
TIER_WEAK = 0.0
Z95 = 1.96
SPIKE_SHARE = 0.25
INDICATION_SHARE = 0.5
COLLAPSE_SHRINKAGE = 0.9
NOTE_SHRINKAGE = 0.5
IC025_RISE = 0.5
MIN_TERM_LENGTH = 5
QUOTE_LIMIT = 400
MAX_MEDICINES = 12
LIST_PER_DRUG = 8
LIST_SHARED_ROWS = 60
MAX_TRACKED = 40
TRACKED_ROWS = 3
SPECIFICITY_COMMON = 0.5
SPECIFICITY_BROAD = 0.15
TREND_MAX_POINTS = 40
TREND_MAX_QUARTERS = 116
TREND_FIRST_YEAR = 1968
MGPS_START = (0.2, 0.1, 2.0, 4.0, 1 / 3)
SAFE_QUERY = r"^[A-Za-z0-9 ,.\-/+']{1,64}$"

TIERS = ("none", "weak", "moderate", "strong")

# --- Fixed values: words ignored when a reaction is compared with indications --
TRIVIAL_WORDS = [
    "AND", "OR", "WITH", "OF", "A", "AN", "THE", "IN", "TO", "FOR", "USED",
    "PRODUCT", "UNKNOWN", "INDICATION", "PROPHYLAXIS", "THERAPY", "NOS",
]

# --- Fixed values: words ignored when a reaction is looked up in label text ----
LABEL_STOPWORDS = [
    "and", "or", "of", "the", "in", "to", "for", "with", "a", "an",
    "increased", "decreased", "abnormal", "disorder", "nos", "unspecified",
]

# --- Fixed values: label sections that describe harm ---------------------------
HARM_SECTIONS = [
    "boxed_warning",
    "warnings_and_cautions",
    "warnings",
    "adverse_reactions",
    "adverse_reactions_table",
    "contraindications",
    "precautions",
    "postmarketing_experience",
]
BOXED_SECTION = "boxed_warning"

# --- Fixed values: label sections that name other drugs ------------------------
INTERACTION_SECTIONS = [
    "drug_interactions",
    "drug_and_or_laboratory_test_interactions",
    "drug_interactions_table",
    "boxed_warning",
]

# --- Fixed values: outcome flags of a report -----------------------------------
OUTCOMES = ["deaths", "hospitalisations", "life_threatening", "disabling"]
