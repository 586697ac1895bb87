"""Fixed values that results depend on, kept together and in plain text."""

# --- fixed values: corpus scan ------------------------------------------------
SOURCE_SUFFIXES = (
    ".py", ".js", ".ts", ".java", ".kt", ".go", ".rs", ".c", ".cpp", ".h", ".cs",
    ".json", ".yaml", ".yml", ".md", ".xml", ".html", ".css", ".gradle", ".pom",
)

# --- fixed values: language by suffix -----------------------------------------
LANGUAGE_SUFFIXES = {
    "java": (".java", ".kt"),
    "python": (".py",),
    "js": (".js", ".ts"),
    "html": (".html", ".htm"),
    "css": (".css",),
}
OTHER_LANGUAGE = "other"

# --- fixed values: role by path, first hit wins -------------------------------
ROLE_TERMS = (
    ("controllers", ("controller", "controllers")),
    ("services", ("service", "services", "serviceimpl")),
    ("repositories", ("repository", "repositories", "respository", "repo", "/dao/")),
    ("entities", ("entity", "entities", "model", "models", "domain", "pojo")),
    ("security", ("security", "securingweb", "auth", "config")),
)
OTHER_ROLE = "other"
ROLES = tuple(role for role, _ in ROLE_TERMS) + (OTHER_ROLE,)

# --- fixed values: branch tokens, counted on lower-cased text ------------------
BRANCH_TOKENS = (
    " if ", " for ", " while ", " case ", "&&", "||", "elif ", "else if", "catch ",
)
VALIDATION_BRANCH_TOKENS = BRANCH_TOKENS + ("?:", "switch")

# --- fixed values: sizes --------------------------------------------------------
BODY_WINDOW = 1200
TOP_FUNCTIONS = 12
TOKEN_TARGET = 1500
CHARS_PER_TOKEN = 4
MIN_HARD_SPLIT = 1000
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 270
TOP_K = 8
EMBED_BATCH = 64
CHAT_BATCH = 12
EMBED_RETRIES = 3
EMBED_BACKOFF = 0.8
CHAT_RETRIES = 2
CHAT_BACKOFF = 2.0
PROMPT_BODY_CHARS = 800
PROMPT_MODULES = 40
PROMPT_FUNCTIONS = 6
ANALYSIS_CONTEXT_CHARS = 1500
ASK_CONTEXT_CHARS = 3000
REPORT_MODULES = 20
SHOWN_WARNINGS = 10
HEURISTIC_CHARS = 140
SNIPPET_LINES = 50
SNIPPET_DEFAULT_END = 200
METHOD_DEFAULT_SPAN = 200

# --- fixed values: confidences and texts ----------------------------------------
MODULE_CONFIDENCE = 0.95
FUNCTION_CONFIDENCE = 0.9
DEFAULT_CONFIDENCE = 0.5
CONFIDENCE_CAP = 0.6
SIMPLE_BONUS = 0.05
COMPLEX_FROM = 15
SIMPLE_UP_TO = 3
SUMMARY_MISSING = "<summary unavailable>"
HEURISTIC_PREFIX = "Performs: "
HEURISTIC_EMPTY = "Performs an operation (heuristic summary)."
EVIDENCE_SEPARATOR = "\n\n===MODULE_EVIDENCE===\n\n"
CONTEXT_SEPARATOR = "\n\n---\n\n"
ANALYSIS_QUERY = "Provide high-level summary, architecture, key methods, and risks"

# --- character classes and patterns (java.util.regex) ---------------------------
# Patterns have the meaning of Unicode text patterns in Python, whose white space
# set includes U+001C..U+001F, and a word character is a letter, a number or
# an underscore. Spelling the classes out avoids the slower (?U) mode. Only "\n"
# ends a line, hence the d flag.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_S = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORD = r"\p{L}\p{N}_"

# Group 1 is always the function name. White space before the first token is taken
# possessively and an attempt right after an empty line is skipped, because the
# attempt at that empty line already covers it: both leave every match unchanged
# and keep long blank runs linear.
_LINE_START = r"(?dm)^(?<!\n\n)"
FUNCTION_PATTERNS = {
    "java": _LINE_START
    + rf"(?:public|private|protected|static|{_S}++)*"
    + rf"[{_WORD}<>\[\]]+{_S}+([a-zA-Z0-9_]+){_S}*\([^)]*\){_S}*\{{",
    "python": _LINE_START + rf"{_S}*+def{_S}+([A-Za-z0-9_]+){_S}*\([^)]*\){_S}*:",
    "js": _LINE_START
    + rf"{_S}*+(?:function{_S}+)?([A-Za-z0-9_]+){_S}*\([^)]*\){_S}*\{{",
}
CHUNK_BOUNDARY = (
    rf"(?dm)^{_S}*+(?:public|private|protected|static|final|def|class|function)"
    rf"(?![{_WORD}]).*$|\n{_S}*\n"
)
OPENING_BRACE = rf"{_S}*\{{{_S}*$"
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
