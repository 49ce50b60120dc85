"""Word lists, enumerations, routing table, patterns.

These must equal the values of the data model for right results.
"""

from __future__ import annotations

# ---- fixed values: word lists ---------------------------------------------
STOP_WORDS = (
    "a", "an", "the", "of", "for", "on", "and", "in", "to", "with", "based",
    "is", "are", "was", "were", "at", "by", "from", "as", "that", "this",
    "using", "via",
)
TITLE_STOP_WORDS = (
    "for", "and", "the", "with", "via", "from", "using", "into",
    "toward", "towards", "based",
)
UNITLESS_WORDS = ("iou", "accuracy", "f1", "dice", "ratio", "loss")

# ---- fixed values: enumerations -------------------------------------------
METRIC_STATUSES = ("reported", "not_reported", "not_applicable", "unclear")
AGG_TYPES = ("mean", "best", "max", "worst", "per_case", "unknown")
COMPARISON_VALIDITY = ("comparable", "partially_comparable", "not_comparable")
CLAIM_TYPES = (
    "definition", "methodological", "quantitative", "comparative", "causal",
    "limitation", "conclusion",
)
EVIDENCE_TYPES = (
    "definition", "methodological_statement", "observation",
    "experimental_result", "comparison", "limitation", "causal_claim",
    "quantitative_result",
)
STRENGTHS = ("A", "B", "C", "D")
RELATIONS = (
    "cites", "extends", "improves", "compares_with", "uses", "criticizes",
    "builds_on", "same_method_family",
)
FORMULA_ROLES = (
    "objective", "loss", "forward_model", "constraint", "regularization",
    "metric", "physical_model", "evaluation", "network", "update_rule",
)
USE_KEYS = (
    "background", "motivation", "related_work", "method", "discussion",
    "citation_evidence",
)
USE_LEVELS = ("none", "weak", "moderate", "strong")
SYSTEM_CONTEXT_KEYS = (
    "technology_node", "wavelength", "numerical_aperture", "NA",
    "resist_model", "lithography_condition", "pattern_type", "resolution",
)
METHOD_FIELDS = (
    "method_name", "method_family", "task", "input", "output", "architecture",
    "algorithm", "optimization", "loss_function", "training_strategy",
    "inference_strategy", "iterative_or_direct",
)
WORK_TYPES = {
    "journal-article": "journal",
    "proceedings-article": "conf",
    "book-chapter": "book_chapter",
    "book": "book",
    "posted-content": "preprint",
    "preprint": "preprint",
}
GATES = ("QG-1", "QG-2", "QG-3", "QG-4", "QG-5")

# ---- fixed values: identifiers ---------------------------------------------
DEFAULT_DOMAIN = "ILT"
SUB_ID_TAGS = {
    "method": "md", "metric": "mt", "comparison": "cm", "claim": "cl",
    "evidence": "ev", "formula": "fm", "record": "cr", "chunk": "ch",
}
DOI_PATTERN = r"^10\.\d{4,9}/"
SPEC_VERSION = "1.0"
PREAMBLE = "Preamble"
LAYER_TEXT_CHARS = 28000
TRUNCATION_MARK = "\n...[truncated]"

# ---- fixed values: intents --------------------------------------------------
# intent, start layer, escalation layers, default token budget, result cap
ROUTES = (
    ("DISCOVERY", "L0", ("L1",), 1000, 10),
    ("CITATION", "L0", (), 400, 1),
    ("TECHNICAL", "L1", ("L2", "L3", "L4"), 1500, 5),
    ("RESULT", "L2", ("L3", "L4"), 1500, 10),
    ("FORMULA", "FORMULA", (), 800, 10),
    ("VERIFICATION", "L3", ("L4",), 1500, 10),
    ("COMPARISON", "L2", ("L3", "L4"), 1200, 10),
)
# layer, next layer, hint
NEXT_LAYERS = (
    ("L0", "L1", "escalate to L1 for method details"),
    ("L1", "L2", "escalate to L2 for structured results"),
    ("L2", "L3", "escalate to L3 for evidence trace"),
    ("L3", "L4", "escalate to L4 for full-text context"),
)

# ---- fixed values: score weights -------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
LEXICAL_WEIGHTS = (0.55, 0.20, 0.15, 0.10)
HYBRID_WEIGHTS = (0.45, 0.20, 0.15, 0.10, 0.10)

# ---- fixed values: manuscript blocks ---------------------------------------
BLOCKS = (
    "Title", "Authors", "Affiliations", "Corresponding Author", "Abstract",
    "Keywords", "Sections", "Disclosures",
    "Code, Data, and Materials Availability", "Acknowledgments", "References",
)
HEADING_ALIASES = {
    "title": "Title",
    "paper title": "Title",
    "authors": "Authors",
    "author": "Authors",
    "affiliations": "Affiliations",
    "affiliation": "Affiliations",
    "corresponding author": "Corresponding Author",
    "correspondence": "Corresponding Author",
    "abstract": "Abstract",
    "keywords": "Keywords",
    "key words": "Keywords",
    "sections": "Sections",
    "body": "Sections",
    "introduction": "Sections",
    "related work": "Sections",
    "methods": "Sections",
    "materials and methods": "Sections",
    "method": "Sections",
    "results": "Sections",
    "discussion": "Sections",
    "conclusion": "Sections",
    "disclosures": "Disclosures",
    "conflicts of interest": "Disclosures",
    "data availability": "Code, Data, and Materials Availability",
    "code, data, and materials availability": "Code, Data, and Materials Availability",
    "acknowledgments": "Acknowledgments",
    "acknowledgements": "Acknowledgments",
    "funding": "Acknowledgments",
    "references": "References",
    "bibliography": "References",
}
SECTION_NUMBERS = {
    "introduction": "1", "related work": "2", "materials and methods": "2",
    "methods": "2", "method": "2", "methodology": "2", "results": "3",
    "discussion": "4", "conclusion": "5", "conclusions": "5",
}
REQUIRED_SECTIONS = ("1", "2", "3", "4", "5")
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")
REQUIRED_REFERENCES = 30
MAX_KEYS_PER_CITE = 3
