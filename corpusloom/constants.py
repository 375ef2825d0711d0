"""Fixed values that must equal the behaviour being reproduced.

Everything here is data (templates, rule tables, config defaults), stated
plainly and in natural order.  Operators read them; nothing else lives here.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: pipeline configuration defaults
# ---------------------------------------------------------------------------
SEED = 1337
SPLIT_RATIOS = (0.8, 0.1, 0.1)
ALLOWED_LANGUAGES = ["en"]
MIN_TEXT_LEN = 20
IMAGE_MIN_RESOLUTION = (256, 256)
ALLOWED_LICENSES = ["public-domain", "CC-BY", "CC-BY-NC", "ODbL", "MIT"]
TOP_K = 5
RAG_FIELDS = ["title", "abstract", "body", "label_text"]
INDEX_TEXT_CHARS = 2000
EVIDENCE_TEXT_CHARS = 800
SPL_SECTION_CHARS = 600
ENCODE_BATCH = 256
DEDUP_THRESHOLD = 0.85
DEDUP_NUM_PERM = 128
DEDUP_SHINGLE = 5
FUZZY_LIMIT = 3
FUZZY_CUTOFF = 86
TOKENIZER_MAX_LINES = 2_000_000
TOKENIZER_SENTENCE_SAMPLE = 10_000_000
CHARACTER_COVERAGE = 0.9995
VOCAB_SIZE = 48000
SPECIAL_TOKENS = ["<pad>", "<unk>", "<s>", "</s>"]  # ids 0, 1, 2, 3

# ---------------------------------------------------------------------------
# FIXED VALUES: schema v2 defaults (filled only when a key is missing)
# ---------------------------------------------------------------------------
DEFAULT_MODALITY = ["text"]
DEFAULT_TASK = "summarize"
DEFAULT_SOURCE = "unknown"
DEFAULT_LICENSE = "unknown"
DEFAULT_SPLIT = "train"

# ---------------------------------------------------------------------------
# FIXED VALUES: answer templates and texts
# ---------------------------------------------------------------------------
# The assistant / report name is ours (the template's wording around it is fixed).
ASSISTANT_NAME = "Corpusloom Research"
PROMPT_TEMPLATE_HEAD = (
    f"You are {ASSISTANT_NAME}, a medical assistant. Answer the user's query using only the EVIDENCE provided. \n"
    "Cite sources inline as [#] indices corresponding to the evidence items. Be concise, evidence-first, "
    "and include a short, verifiable rationale.\n"
    "If safety flags or missing information appear, say so and recommend next steps.\n"
    "\n"
    "User Query:\n"
)
PROMPT_TEMPLATE_MID = "\n\nEvidence:\n"
PROMPT_TEMPLATE_TAIL = "\n\nOutput:\n"
NO_HIT_EVIDENCE = "No relevant passages were retrieved."
DDI_HEADER = "\n\nDrug–Drug Interactions detected:\n- "
DDI_JOIN = "\n- "
CITATION_JOIN = " | "

DISCLAIMER_PATIENT = (
    "⚠️ Not a medical diagnosis. If you have severe symptoms "
    "or feel unwell, seek urgent medical care."
)
DISCLAIMER_OTHER = "Research-use only. Do not rely on this for clinical decisions."

MCQ_PROMPT_HEAD = (
    "You are a concise medical expert. Choose the single best answer (A/B/C/D). "
    "Return only the letter.\n\n"
)
MCQ_LETTERS = ["A", "B", "C", "D"]
SHORT_PROMPT_HEAD = "Answer the medical question briefly and factually.\n"
YESNO_PROMPT_HEAD = "Answer 'yes' or 'no' based on evidence.\n"

LEADERBOARD_HEADERS = ["Dataset", "Mode", "Role", "N", "Acc", "F1", "EM", "Timestamp"]
LEADERBOARD_TITLE = f"{ASSISTANT_NAME} — Evaluation Leaderboard"
LEADERBOARD_HTML_TITLE = "Corpusloom Leaderboard"

# ---------------------------------------------------------------------------
# FIXED VALUES: drug-interaction rules as shipped (synonyms, pairs, classes,
# class members), in file order
# ---------------------------------------------------------------------------
DDI_RULES = {
    "synonyms": {
        "ibuprofen": ["nurofen", "advil", "motrin"],
        "warfarin": ["coumadin"],
        "clarithromycin": ["biaxin"],
        "simvastatin": ["zocor"],
    },
    "pairs": [
        {"a": "ibuprofen", "b": "warfarin", "note": "↑ bleeding risk (avoid or monitor INR)"},
        {"a": "clarithromycin", "b": "simvastatin", "note": "↑ statin levels (rhabdomyolysis risk) — avoid"},
    ],
    "classes": [
        {"classA": ["macrolide"], "classB": ["statin"],
         "note": "Some macrolides ↑ statin levels — prefer pravastatin or hold statin"},
    ],
    "class_members": {
        "macrolide": ["clarithromycin", "erythromycin", "azithromycin"],
        "statin": ["simvastatin", "atorvastatin", "lovastatin", "rosuvastatin", "pravastatin"],
    },
}

# ---------------------------------------------------------------------------
# FIXED VALUES: routing per role, and enabled data sources
# ---------------------------------------------------------------------------
ROUTING = [
    # role, use_rag, use_ddi
    ("patient", True, True),
    ("clinician", True, True),
    ("pharma", True, False),
    ("student", True, False),
]
TOOLS_ENABLED = [("ddi_checker", True), ("bmi", True)]
DATA_SOURCES = [
    # kind, source, enabled
    ("text", "pubmed", True),
    ("text", "pmc_oa", True),
    ("text", "dailymed", True),
    ("text", "openfda_labels", True),
    ("text", "clinicaltrials", True),
    ("text", "qa_sets", False),
    ("images", "chexpert", True),
    ("images", "isic", True),
    ("images", "brats", False),
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png"]
BRATS_MODALITIES = ["flair", "t1ce", "t1", "t2"]
SPL_INDICATIONS_CODES = ["34067-9", "34067-9 Indications & Usage"]
SPL_INTERACTIONS_CODE = "34073-7"
RETRY_STATUS = [429, 500, 502, 503, 504]
