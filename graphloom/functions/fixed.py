"""Word lists, patterns, limits and formats that results depend on."""

# File extensions and their languages.
LANGUAGES = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}

# Directory names left out when reading texts, and when extracting symbols.
TEXT_EXCLUDES = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".claude", "output", "traces", "worktrees", ".context-cache", ".next", ".turbo", "vendor")
SYMBOL_EXCLUDES = (".git", "node_modules", "__pycache__", "venv", ".venv", "env", ".env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".claude", ".gemini", ".vscode", ".bobide", "output", "traces", "worktrees", ".context-cache")

# What makes a path a test.
TEST_PARTS = ("tests", "test", "__tests__", "spec", "testdata", "fixtures")
TEST_STEM = r"^test_|_test$|\.test$|\.spec$"
MODULE_ROOTS = ("tools", "packages", "apps", "services")

# Capability patterns, in order.
DYNAMIC_FLAGS = (
    ("eval", r"\beval\s*\("),
    ("exec", r"\bexec\s*\("),
    ("importlib", r"importlib\.import_module|\b__import__\s*\("),
    ("reflection", r"\bgetattr\s*\(|\bsetattr\s*\(|\breflect\.|\bgetattr\b"),
    ("dynamic_require", r"\brequire\s*\(\s*[A-Za-z_$]|new\s+Function\s*\("),
    ("go_plugin", r"plugin\.Open"),
    ("namespace", r"(globals|locals|vars)\s*\("),
    ("subscript_dispatch", r"\[\s*[A-Za-z_][\w\s.\-]*\]\s*\("),
)
PLAIN_FLAGS = (
    ("concurrency", r"\b(lock|mutex|semaphore|Atomic|threading|asyncio\.Lock|sync\.Mutex|sync\.RWMutex)\b|\bgo\s+func\b|\bchan\s"),
    ("retry", r"\b(retry|backoff|max_attempts|maxRetries)\b"),
    ("cache", r"\b(cache|memoiz|ttl|lru_cache)\b"),
    ("timeout", r"\b(timeout|deadline|circuit.?breaker)\b"),
    ("io", r"\b(requests\.|httpx|axios|fetch\s*\(|http\.Get|urllib|urlopen)\b"),
    ("db", r"(\.query\s*\(|\.execute\s*\(|session\.(add|commit|query)|prisma\.|SELECT\s+\w|INSERT\s+INTO)"),
    ("filesystem", r"\b(open\s*\(|Path\s*\(|read_text|write_text|os\.walk)\b"),
)
COMPLEXITY = r"\b(if|elif|else\s+if|for|while|case|catch|except|when|&&|\|\||and|or)\b"
COMPLEXITY_CAP = 80

# The text-based complexity's tokens and cap.
TEXT_COMPLEXITY = ("if ", "elif ", "else if ", "case ", "for ", "while ", "catch ", "except ", " && ", " || ", " and ", " or ")
TEXT_COMPLEXITY_CAP = 25

# Words that mark unusual logic, and calls that don't count as outbound.
UNUSUAL_LOGIC = (
    ("Adaptive Retry / Exponential Backoff Logic", ("retry", "backoff")),
    ("Concurrency Synchronization (Lock / Mutex / Semaphore)", ("lock", "mutex", "semaphore")),
    ("Defensive Fault Tolerance & Graceful Fallbacks", ("fallback",)),
    ("Performance Caching / Memoization Barrier", ("cache", "ttl")),
    ("Explicit Legacy Workaround / Inlined Hotfix", ("hack", "fixme", "workaround", "todo")),
    ("Execution Deadline & Circuit Breaker Guard", ("timeout", "deadline")),
)
NOT_OUTBOUND = ("if", "for", "while", "switch", "catch", "def", "function", "return", "print", "len", "range", "dict", "list", "str", "int")

# Phrases that the ledger's policy refuses, in order.
BUG_FIX = ("fix bug", "bugfix", "bug fix", "fix syntax", "syntax error", "fix error", "fix import", "fix lint", "patch error", "debug error", "debug bug")
EXPLORATION = ("explore codebase", "codebase exploration", "automated exploration", "scan files", "survey codebase")

# Micro labels.
STOP_WORDS = ("the", "a", "an", "to", "of", "for", "in", "on", "and", "or", "with", "from", "at")
VERBS = {
    "get": "Returns", "fetch": "Fetches", "load": "Loads", "read": "Reads", "write": "Writes", "save": "Saves", "store": "Stores", "persist": "Persists",
    "create": "Creates", "make": "Builds", "build": "Builds", "init": "Initializes", "setup": "Configures", "configure": "Configures", "run": "Runs", "start": "Starts",
    "stop": "Stops", "close": "Closes", "open": "Opens", "parse": "Parses", "extract": "Extracts", "scan": "Scans", "find": "Finds", "search": "Searches",
    "match": "Matches", "validate": "Validates", "verify": "Verifies", "check": "Checks", "assert": "Asserts", "handle": "Handles", "process": "Processes", "render": "Renders",
    "draw": "Draws", "paint": "Paints", "print": "Prints", "main": "Entry point", "use": "Uses", "apply": "Applies", "update": "Updates", "delete": "Deletes",
    "remove": "Removes", "add": "Adds", "insert": "Inserts", "map": "Maps", "sort": "Sorts", "filter": "Filters", "collect": "Collects", "gather": "Gathers",
    "resolve": "Resolves", "route": "Routes", "dispatch": "Dispatches", "compute": "Computes", "calculate": "Calculates", "analyse": "Analyzes", "analyze": "Analyzes", "detect": "Detects",
    "infer": "Infers", "emit": "Emits", "send": "Sends", "receive": "Receives", "listen": "Listens", "serve": "Serves", "publish": "Publishes", "subscribe": "Subscribes",
    "encode": "Encodes", "decode": "Decodes", "normalize": "Normalizes", "format": "Formats", "index": "Indexes", "hash": "Hashes", "sign": "Signs", "encrypt": "Encrypts",
    "decrypt": "Decrypts", "merge": "Merges", "split": "Splits", "join": "Joins", "copy": "Copies", "move": "Moves", "clean": "Cleans", "strip": "Strips",
    "cache": "Caches", "refresh": "Refreshes", "sync": "Synchronises", "test": "Tests", "mock": "Mocks", "assert_": "Asserts",
}
PREFIXES = (("is_", "Checks"), ("has_", "Checks"), ("can_", "Checks"), ("should_", "Checks"), ("to_", "Converts"), ("from_", "Converts"), ("on_", "Handles"), ("test_", "Tests"))
MICRO_WORDS = 5

# Called names that Python's syntax tree shows, with family, confidence and description.
DYNAMIC_CALLS = {
    "getattr": ("reflection", 0.95, "Python built-in 'getattr()' dynamic attribute reflection"),
    "setattr": ("reflection", 0.95, "Python built-in 'setattr()' dynamic attribute reflection"),
    "hasattr": ("reflection", 0.95, "Python built-in 'hasattr()' dynamic attribute reflection"),
    "delattr": ("reflection", 0.95, "Python built-in 'delattr()' dynamic attribute reflection"),
    "import_module": ("dynamic_import", 0.95, "Dynamic module loader 'import_module()'"),
    "__import__": ("dynamic_import", 0.95, "Dynamic module loader '__import__()'"),
    "eval": ("eval", 0.95, "Arbitrary runtime code execution via 'eval()'"),
    "exec": ("eval", 0.95, "Arbitrary runtime code execution via 'exec()'"),
    "getenv": ("env_conditional", 0.9, "Environment variable retrieval via os.getenv()"),
}
DYNAMIC_ENVIRON = ("env_conditional", 0.95, "Environment variable lookup via os.environ index")

# Dynamic invocation patterns by family, in order: pattern, description, confidence.
DYNAMIC_PATTERNS = (
    ("reflection", r"\bgetattr\s*\(", "Python dynamic getattr lookup", 0.9),
    ("reflection", r"\bsetattr\s*\(", "Python dynamic setattr mutation", 0.9),
    ("reflection", r"\bhasattr\s*\(", "Python reflection hasattr check", 0.8),
    ("reflection", r"\bdelattr\s*\(", "Python reflection delattr", 0.8),
    ("reflection", r"\breflect\.ValueOf\s*\(", "Go reflect.ValueOf introspection", 0.95),
    ("reflection", r"\breflect\.TypeOf\s*\(", "Go reflect.TypeOf introspection", 0.95),
    ("reflection", r"\.MethodByName\s*\(", "Go dynamic method lookup via reflection", 0.95),
    ("reflection", r"\.FieldByName\s*\(", "Go dynamic field lookup via reflection", 0.95),
    ("reflection", r"\bReflect\.(?:get|set|apply|construct)\s*\(", "JavaScript / TypeScript Reflect API call", 0.9),
    ("dynamic_import", r"\bimportlib\.import_module\s*\(", "Python importlib dynamic module loading", 0.95),
    ("dynamic_import", r"\b__import__\s*\(", "Python __import__ built-in dynamic load", 0.95),
    ("dynamic_import", r"\bimportlib\.", "Python importlib subsystem invocation", 0.85),
    ("dynamic_import", r"\brequire\s*\(\s*(?!['\"][^'\"]+['\"]\s*\))", "Node.js dynamic require with variable argument", 0.9),
    ("dynamic_import", r"\bimport\s*\(\s*(?!['\"][^'\"]+['\"]\s*\))", "Dynamic import() with expression argument", 0.85),
    ("dynamic_import", r"\bplugin\.Open\s*\(", "Go dynamic plugin loading", 0.95),
    ("eval", r"\beval\s*\(", "Runtime eval() code execution", 0.95),
    ("eval", r"\bexec\s*\(", "Python exec() arbitrary code execution", 0.95),
    ("eval", r"\bnew\s+Function\s*\(", "JavaScript new Function constructor invocation", 0.95),
    ("eval", r"\bcompile\s*\([^)]*['\"]exec['\"]", "Python compile with mode='exec'", 0.85),
    ("event_emitter", r"\.(?:on|once)\s*\(\s*['\"][^'\"]+['\"]", "Event emitter listener subscription", 0.85),
    ("event_emitter", r"\.emit\s*\(\s*['\"][^'\"]+['\"]", "Event emitter notification dispatch", 0.85),
    ("event_emitter", r"\.addEventListener\s*\(", "DOM / EventTarget listener registration", 0.85),
    ("event_emitter", r"\.removeEventListener\s*\(", "DOM / EventTarget listener removal", 0.75),
    ("event_emitter", r"\.addListener\s*\(", "Node.js EventEmitter addListener", 0.85),
    ("env_conditional", r"\bos\.environ(?:\.get)?\s*[\[\(]", "Python environment variable lookup", 0.9),
    ("env_conditional", r"\bos\.getenv\s*\(", "Python os.getenv invocation", 0.9),
    ("env_conditional", r"\bos\.Getenv\s*\(", "Go os.Getenv environment lookup", 0.9),
    ("env_conditional", r"\bos\.LookupEnv\s*\(", "Go os.LookupEnv environment check", 0.9),
    ("env_conditional", r"\bprocess\.env\.[A-Za-z0-9_]+", "Node.js process.env property access", 0.9),
    ("env_conditional", r"\bprocess\.env\[", "Node.js process.env dynamic access", 0.9),
    ("string_dispatch", r"(?:actions|handlers|routes|commands|dispatch_table)\[[^\]]+\]\s*\(", "Table-driven string dispatch function call", 0.85),
    ("string_dispatch", r"\bgetattr\s*\([^,]+,\s*[A-Za-z0-9_]+\s*\)\s*\(", "Dynamic getattr invoked immediately as function", 0.95),
)
FAMILIES = ("reflection", "dynamic_import", "eval", "event_emitter", "env_conditional", "string_dispatch")

# Extraction patterns.
GO_FUNC = r"(?m)^func\s+(?:\(([^)]*)\)\s+)?(\w+)\s*\(([^)]*)\)(?:\s*([^\{]+))?\s*\{"
GO_TYPE = r"(?m)^type\s+(\w+)\s+(struct|interface)\b"
GO_IMPORT_BLOCK, GO_IMPORT_LINE, GO_QUOTED = r"(?s)import\s*\(([^)]+)\)", r"(?m)^import\s+\"([^\"]+)\"", r"\"([^\"]+)\""
GO_CALL, GO_NOT_CALLS = r"\b(\w+(?:\.\w+)*)\s*\(", ("if", "for", "switch", "select", "go", "defer", "return", "make", "len", "cap", "append", "copy", "delete", "new")
TS_FUNC = r"(?m)(?:^|(?<=\n))(export\s+)?(?:async\s+)?(?:function\*?\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\*?\s*\w*|\([^)]*\)\s*=>|\w+\s*=>))"
TS_CLASS = r"(export\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?"
TS_INTERFACE = r"(export\s+)?interface\s+(\w+)(?:\s+extends\s+([\w,\s]+))?"
TS_TYPE = r"(export\s+)?type\s+(\w+)\s*="
TS_IMPORT = r"(?:import|require)\s*\(?['\"]([\w@/.\-]+)['\"]\)?"
TS_CALL, TS_NOT_CALLS = r"\b([\w.]+)\s*\(", ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "instanceof")
TS_ROUTE = r"(?i)(?:app|router)\s*\.\s*(get|post|put|patch|delete|all|use)\s*\("
# How far from its head a block or an arrow belongs to a declaration, and how far behind an arrow a block does.
BRACE_NEAR, ARROW_NEAR, ARROW_TO_BRACE = 500, 200, 100
TS_METHOD = r"^([ \t]+)(?:(?:public|private|protected|static|async|readonly|override|abstract|declare)\s+)*(?:get\s+|set\s+)?([A-Za-z_$][\w$]*)\s*\("
TS_METHOD_CLASS = r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"
TS_NOT_METHODS = ("constructor", "if", "for", "while", "switch", "return", "catch", "function")

# Crawler patterns.
PY_ROUTE = r"(?i)@(?:\w+\.)?(get|post|put|delete|patch|options|head|route)\s*\(\s*[\"']([^\"']+)[\"']"
PY_ROUTE_METHODS = r"(?i)methods\s*=\s*\[[\"'](\w+)[\"']\]"
PY_DEF = r"^\s*(?:async\s+)?def\s+([a-zA-Z_]\w*)\s*\((.*?)\)"
DJANGO_ROUTE = r"(?i)path\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)*)"
EXPRESS_ROUTE = r"(?i)\b(?:app|router|server)\.(get|post|put|delete|patch|use)\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*(.*)"
EXPRESS_HANDLER = r"([a-zA-Z_]\w*)(?:\s*,|\s*\))"
NEXT_ROUTE = r"(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH)\s*\("
GO_ROUTE = r"\b\w+\.(GET|POST|PUT|DELETE|PATCH|HandleFunc)\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*([a-zA-Z_]\w*)"
PRISMA_MODEL = r"model\s+([A-Za-z0-9_]+)\s*\{([^}]+)\}"
PRISMA_REFERENCES = r"references:\s*\[([^\]]+)\]"
PY_MODEL = r"class\s+([A-Za-z0-9_]+)\s*\(\s*(?:Base|db\.Model|models\.Model|declarative_base\(\))\s*\):"
PY_TABLE = r"__tablename__\s*=\s*[\"']([^\"']+)[\"']"
PY_FIELD = r"^([a-zA-Z_]\w*)\s*=\s*(?:Column|models\.\w+|db\.Column)\((.*)\)"
PY_FOREIGN = r"ForeignKey\([\"']([^\"']+)[\"']"
TS_ENTITY_CLASS = r"class\s+([A-Za-z0-9_]+)"
GO_MODEL = r"type\s+([A-Za-z0-9_]+)\s+struct\s*\{([^}]+)\}"
AXIOS_CALL = r"(?i)\b(?:axios|api|client|apiClient|httpClient)\.(get|post|put|delete|patch)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]"
FETCH_CALL = r"(?i)\bfetch\s*\(\s*[`'\"]([^`'\"]+)[`'\"](?:\s*,\s*\{\s*method:\s*[`'\"]([A-Z]+)[`'\"])?"
NAMED_EXPORT = r"export\s+(?:const|function|async\s+function)\s+([a-zA-Z_]\w*)"
PY_HTTP_CALL = r"(?i)\b(?:requests|httpx|session|client)\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']"

# Limits.
RAW_CALLS, IMPORTS, SYMBOLS, SCC_GROUPS, PIVOTAL, MODULE_EDGES, LAYER, DOC = 80, 60, 20_000, 40, 200, 400, 200, 400
FLOWS, FLOW_DEPTH, FLOW_FAN, FLOW_CHAINS, FLOW_HUBS = 12, 4, 2, 2, 8
CALLER_DETAILS, LEDGER_CAP, CONTEXT_FLOWS = 25, 40, 3
FUNCTION_KINDS, CLASS_KINDS = ("function", "method"), ("class", "interface", "type", "struct")

# Called names that hide calls, with how serious each is.
RISKY_CALLS = {"eval": "HIGH", "exec": "HIGH", "__import__": "HIGH", "getattr": "MED", "setattr": "MED", "importlib.import_module": "HIGH", "vars": "LOW", "locals": "LOW", "globals": "LOW"}

# Subsystems and the words that suggest them.
SUBSYSTEMS = {
    "Backend": ("api", "route", "server", "handler", "controller", "middleware"),
    "Desktop": ("window", "dialog", "widget", "gui", "app", "frame"),
    "Storage": ("db", "database", "repo", "repository", "model", "schema", "orm", "query"),
    "Inference": ("model", "predict", "train", "infer", "embedding", "tensor", "neural"),
    "CLI": ("cli", "args", "argv", "argparse", "click", "command"),
    "Testing": ("test", "spec", "mock", "fixture", "assert"),
    "Utilities": ("util", "helper", "common", "shared", "base"),
}

# Words that are no symbols when looked up under a cursor.
KEYWORDS = (
    "if", "else", "elif", "while", "for", "in", "of", "do", "switch", "case", "break", "continue", "return", "yield", "try", "catch", "finally", "except", "raise", "throw",
    "import", "from", "as", "export", "default", "package", "const", "let", "var", "def", "class", "func", "type", "interface", "struct", "enum", "true", "false",
    "null", "undefined", "nil", "none", "self", "this", "super", "new", "delete", "async", "await", "public", "private", "protected", "static", "readonly",
)

# Heads of definitions by language, for text that isn't parsed.
TEXT_FUNCTION = {"python": r"^\s*(?:async\s+)?def\s+([a-zA-Z_]\w*)\s*\(", "typescript": r"(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_]\w*)\s*\(", "go": r"^\s*func\s+(?:\([^)]+\)\s+)?([a-zA-Z_]\w*)\s*\("}
FAN_IN_WEIGHT, MOST_COMPLEXITY, UNUSUAL_BONUS = 3, 20, 2
DEFINITION_LINES = 35

# Kinds of nodes of the tree in the order in which they stand under one parent.
TREE_KINDS = ("module", "folder", "file", "symbol")
