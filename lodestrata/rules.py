"""Word lists, names, patterns and limits that results depend on."""

from __future__ import annotations

import hashlib

# Fixed values of the file scan.
IGNORE_DIRS = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".cache", "target", "build", "dist", "node_modules", ".tox", ".eggs", ".idea", ".vscode")
CACHE_DIRS = ("__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", "node_modules")
SNIFF_BYTES = 8192
HASH_MAX_BYTES = 512 * 1024
MAX_HASH_FILES = 5000
MAX_FILE_SIZE = 2 * 1024 * 1024
TREE_DEPTH = 8
TREE_ENTRIES = 100

# Extensions whose content is embedded, and their fence language.
ESSENTIAL_EXTENSIONS = (
    ".py .rs .toml .json .yaml .yml .md .txt .lock .sh .bash .zsh .ini .cfg .conf .proto .c .h .cpp .hpp .go .js .ts .jsx .tsx .java .kt .kts .xml .gradle .properties .lua .rockspec"
).split()
FENCE_LANGUAGE = {
    ".py": "python", ".rs": "rust", ".toml": "toml", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".proto": "protobuf", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".go": "go", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx", ".tsx": "tsx",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".xml": "xml", ".gradle": "groovy", ".lua": "lua", ".rockspec": "lua",
}

# Fixed patterns of file names that are never embedded, matched to the lower-cased name.
SECRET_NAMES = (
    r"^id_rsa$", r"^id_dsa$", r"^id_ecdsa$", r"^id_ed25519$", r"\.pem$", r"\.key$", r"\.pfx$", r"\.p12$", r"^\.env($|\..+$)", r"service.?account.*\.json$",
    r"credentials.*\.json$", r"^\.npmrc$", r"^\.netrc$", r"^local\.properties$", r"\.jks$", r"\.keystore$", r"^google-services\.json$",
)

# Fixed words of line scans.
TODO_WORDS = ("TODO", "FIXME", "BUG", "HACK", "SAFETY", "XXX")
TODO_CHARS = 200
TODO_MAX = 1000
WARNINGS = ("warning:", "warning[", "deprecated", "unused")
ERRORS = ("error:", "failed", "traceback", "panic", "exception")
KNOWN_ISSUES = (
    ("Failed to parse", "A tool could not read the syntax of some file."),
    ("ModuleNotFoundError", "Python did not find a module that is imported."),
    ("error:", "A compiler or checker reported an error."),
)

# Content rules, from publicly documented token formats: name and pattern.
SECRET_RULES = (
    ("AWS Access Key ID", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("GitHub Token", r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b"),
    ("Private Key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("Slack Token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Assigned Secret", r"""(?i)\b(token|secret|password|passwd|api_?key)\b["']?\s*[:=]\s*["'][^"'\s]{16,}["']"""),
)

#: Every match of a rule but the last has one of these; the last has an assignment.
SECRET_PARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "PRIVATE KEY", "xox")
ASSIGNMENT = r"""[:=]\s*["'][^"'\s]{16,}["']"""

#: Paths whose findings are those of test fixtures.
FIXTURE = r"(^|/)tests?/"

# Fixed project markers in order of priority: file, language, kind, build tool.
PROJECT_MARKERS = (
    ("Cargo.toml", "Rust", "binary/library", "cargo"), ("pyproject.toml", "Python", "package", "pip/poetry/uv"), ("setup.py", "Python", "package", "setuptools"),
    ("setup.cfg", "Python", "package", "setuptools"), ("requirements.txt", "Python", "application", "pip"), ("package.json", "Node.js", "application", "npm"),
    ("go.mod", "Go", "module", "go"), ("CMakeLists.txt", "C/C++", "binary/library", "cmake"), ("pom.xml", "Java", "application", "maven"),
    ("build.gradle", "Java/Kotlin", "application", "gradle"), ("build.gradle.kts", "Java/Kotlin", "application", "gradle"), ("Makefile", "Generic", "unknown", "make"),
    ("init.lua", "Lua", "module/library", "none"),
)
ENTRY_POINTS = {
    "Rust": ("src/main.rs", "src/lib.rs"), "Python": ("src/main.py", "main.py", "cli.py", "__main__.py", "app.py"), "Node.js": ("index.js", "src/index.js", "server.js", "src/index.ts"),
    "Go": ("main.go", "cmd/main.go"), "Java/Kotlin": ("src/main/java", "src/main/kotlin"), "C/C++": ("src/main.cpp", "src/main.c", "main.cpp", "main.c"),
    "Lua": ("init.lua", "main.lua", "app.lua", "src/main.lua", "src/init.lua"),
}
EXTENSION_LANGUAGE = {".py": "Python", ".rs": "Rust", ".go": "Go", ".js": "Node.js", ".ts": "Node.js", ".java": "Java/Kotlin", ".kt": "Java/Kotlin", ".c": "C/C++", ".cpp": "C/C++", ".lua": "Lua"}
READ_FIRST = ("readme.md", "readme.rst", "readme", "cargo.toml", "pyproject.toml", "setup.py", "setup.cfg", "package.json", "go.mod", "makefile")
READ_NEXT = ("main.py", "cli.py", "lib.rs", "main.rs", "__main__.py", "app.py", "main.go", "index.js", "index.ts")
READ_NEXT_PARTS = ("core", "analyzers", "scanners", "model")

# Fixed sizes of transfers.
BLOCK_LINES = 1000
CHUNK_BYTES = 4000


def fingerprint() -> str:
    """Changes with any rule that findings in a cache depend on."""
    parts = [*sorted(TODO_WORDS), *sorted(SECRET_NAMES), *sorted(f"{n}={p}" for n, p in SECRET_RULES), *sorted(SECRET_PARTS), ASSIGNMENT, FIXTURE, str(TODO_CHARS)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]
