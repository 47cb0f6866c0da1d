"""Fixed values of the curation programmes: labels, groups, bins, slices, budgets."""

# Fixed values.
TOPIC_LABELS = (
    "mathematics_statistics", "computer_science_software_engineering", "machine_learning_ai", "physical_sciences", "life_sciences_biology",
    "medicine_health", "engineering_technology", "business_economics", "law_government", "social_sciences", "history_geography",
    "philosophy_ethics", "education_pedagogy", "language_writing", "arts_humanities", "environmental_science_energy", "personal_finance_practical_life",
)

# Group, label indices, share of the target, priority.
GROUPS = (
    ("mathematics", (0,), 0.07, 0),
    ("computer_science", (1,), 0.08, 0),
    ("ml_ai", (2,), 0.05, 0),
    ("physical_sciences", (3,), 0.04, 1),
    ("life_sciences", (4,), 0.03, 1),
    ("engineering_tech", (6,), 0.05, 1),
    ("environmental", (15,), 0.02, 1),
    ("medicine_health", (5,), 0.04, 2),
    ("business_economics", (7,), 0.04, 2),
    ("law_government", (8,), 0.03, 2),
    ("general", (9, 10, 11, 12, 13, 14, 16), 0.55, 3),
)
STEM_CORE = (0, 1, 2)

# Bin, lower bound, upper bound, share.
COMPLEXITY_BINS = (("L1", 1.0, 1.75, 0.10), ("L2", 1.75, 2.5, 0.20), ("L3", 2.5, 3.25, 0.40), ("L4", 3.25, 4.0, 0.30))
SD_BINS = (("SD0", 0.0, 0.5, 0.10), ("SD1", 0.5, 1.5, 0.20), ("SD2", 1.5, 2.5, 0.35), ("SD3", 2.5, 3.5, 0.35))

TOPIC_THRESHOLD = AMBIGUITY_FLOOR = 0.3
WEB_TOKENS = (50, 100_000)
CODE_TOKENS = (20, 100_000)
WEB_TARGET_TOKENS = 23_500_000_000
QUALITY_FLOOR, QUALITY_BOOST, ZLIB_FLOOR = 1.5, 3.5, 0.10
SEED = 42

# Fixed values.
CONTENT_TYPES = ("library", "application", "script", "test", "config", "data", "generated", "tutorial", "other")
CONTENT_GROUPS = {"library": "library", "application": "application", "script": "script", "test": "test"}
LOW_VALUE = "low_value"

# Slice, target tokens, strategy, least relevance, languages. general_code also has those of GENERAL_LANGUAGES.
SLICES = (
    ("schema_languages", 800_000_000, "light_filter", 0.0, ("json", "yaml", "sql", "protocol-buffer", "thrift", "xslt")),
    ("typescript", 600_000_000, "relevance_filter", 2.0, ("typescript",)),
    ("python", 600_000_000, "relevance_filter", 2.0, ("python",)),
    ("rust_go_java", 600_000_000, "relevance_filter", 2.0, ("rust", "go", "java")),
    ("jupyter", 400_000_000, "relevance_filter", 2.0, ("jupyter-scripts-dedup-filtered",)),
    ("github_issues", 500_000_000, "keyword_filter", 0.0, ("github-issues-filtered-structured",)),
    ("general_code", 1_000_000_000, "light_filter", 0.0, ()),
)
# Fixed values.
GENERAL_LANGUAGES = (
    "ada", "agda", "alloy", "antlr", "applescript", "assembly", "augeas", "awk", "batchfile", "bluespec", "c", "c-sharp", "clojure", "cmake",
    "coffeescript", "common-lisp", "cpp", "css", "cuda", "dart", "dockerfile", "elixir", "elm", "emacs-lisp", "erlang", "f-sharp", "fortran", "glsl",
    "groovy", "haskell", "html", "idris", "isabelle", "java-server-pages", "javascript", "julia", "jupyter-structured-clean-dedup", "kotlin", "lean",
    "literate-agda", "literate-coffeescript", "literate-haskell", "lua", "makefile", "maple", "markdown", "mathematica", "matlab", "ocaml", "pascal",
    "perl", "php", "powershell", "prolog", "r", "racket", "restructuredtext", "rmarkdown", "ruby", "sas", "scala", "scheme", "shell", "smalltalk",
    "solidity", "sparql", "stan", "standard-ml", "stata", "systemverilog", "tcl", "tcsh", "tex", "verilog", "vhdl", "visual-basic", "yacc", "zig",
)

# Fixed values.
KEYWORDS = (
    "json", "schema", "api endpoint", "serializ", "deserializ", "protobuf", "grpc", "graphql", "openapi", "swagger", "rest api", "restful",
    "json schema", "json parse", "json format", "yaml", "xml schema", "xsd", "struct", "interface", "marshal", "unmarshal", "payload",
    "request body", "response body", "type definition", "type system", "function call", "function signature",
)

PAD_BUCKETS_WEB = (32, 64, 96, 128, 192, 256, 384, 512)
PAD_BUCKETS_CODE = (64, 96, 128, 192, 256, 384, 512)

CONTEXT = 2048
SHARD_SEQUENCES = 131_072
VOCABULARY = 50_304
END_OF_TEXT = 50_256

# Packing source, token budget, text column, text function.
SOURCES = (
    ("fineweb_edu_curated", 4_300_000_000, "text", None),
    ("fineweb_edu_random", 2_000_000_000, "text", None),
    ("starcoderdata", 3_900_000_000, "content", None),
    ("finemath", 3_200_000_000, "text", None),
    ("wiki_structured", 1_500_000_000, None, "structured_wikipedia"),
    ("wiki_plain", 500_000_000, "text", None),
    ("pes2o", 2_200_000_000, "text", None),
    ("stackexchange", 1_000_000_000, None, "stackexchange"),
    ("ultrachat", 400_000_000, None, "ultrachat"),
    ("sqale", 1_000_000_000, None, "sqale"),
)


def slice_languages() -> dict[str, str]:
    """Language to slice."""
    out = {lang: name for name, _, _, _, langs in SLICES for lang in langs}
    return out | dict.fromkeys(GENERAL_LANGUAGES, "general_code")
