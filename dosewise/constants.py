"""Fixed values.

Everything in this module is a fixed value: the results depend on these exact
words, thresholds and grids. They are data, not logic, and live in one place.
"""

# --- Characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Words a text table may use for "missing" (compared exactly, case matters).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --- Words that mean "no identifier" after stripping (case matters: 'na' is an id).
ID_NULL_TOKENS = ["", "nan", "None", "NA", "<NA>"]

# --- Column roles: name variants per role, and the exact name that wins outright.
RESPONSE_ROLES = {
    "drug_name": ["DRUG_NAME", "Drug Name", "DRUG", "COMPOUND_NAME", "Compound", "drug"],
    "cell_line_name": ["CELL_LINE_NAME", "Cell line name", "CELL_LINE", "CCLE_NAME", "cell line"],
    "cosmic_id": ["COSMIC_ID", "COSMIC ID", "COSMIC_IDENTIFIER", "COSMIC"],
    "ln_ic50": ["LN_IC50", "ln_ic50", "LN IC50", "LNIC50", "LOG_IC50", "log ic50"],
    "auc": ["AUC", "area under curve", "AUC_VALUE"],
}
EXPRESSION_ID_ALIASES = ["ModelID", "MODEL_ID", "DepMap_ID", "DEPMAP_ID", "CCLE_NAME", "CELL_LINE_NAME"]
METADATA_MODEL_ALIASES = ["ModelID", "SangerModelID", "ModelIDAlias"]
METADATA_COSMIC_ALIASES = ["COSMIC_ID", "COSMICID"]
EXACT_NAMES = {"drug_name": "DRUG_NAME", "join_id": "COSMIC_ID", "model_id": "ModelID"}
NOT_DETECTED = "NOT_DETECTED_OR_AMBIGUOUS"

# --- Output columns a feature may not be named after.
RESERVED_OUTPUT_NAMES = ["drug_name", "cell_line_id", "depmap_model_id", "LN_IC50"]

# --- Thresholds and sizes.
MIN_SHARED_FEATURES = 5000
TEST_FRACTION = 0.2
SEED = 42
CV_FOLDS = 5
L1_RATIOS = [0.1, 0.5, 0.9]
N_ALPHAS = 50
ALPHA_EXPONENT_LOW = -3.0
ALPHA_EXPONENT_HIGH = 1.0
MAX_SWEEPS = 5000
SIGNIFICANCE = 0.05
BACKGROUND_SIZE = 20000
SMALLEST_NORMAL_DOUBLE = 2.2250738585072014e-308
TOP_FEATURES = 25
TOP_TERMS = 10
TOP_PLOTTED_FEATURES = 15
TOP_MISSING_COLUMNS = 20
PREVIEW_TERMS = 5
OVERLAP_SAMPLE = 10
VIOLATION_SAMPLE = 5
HISTOGRAM_BINS = 30
FALLBACK_SLUG = "drug"

#: Folder of the entity with the empty name; slugs have no hyphens.
EMPTY_ENTITY = "no-name"
