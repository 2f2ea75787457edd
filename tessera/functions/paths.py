"""Path predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

# Names of folders and files that are not part of a workspace, at any place of a path; and lock files.
IGNORED_DIRS = (
    "node_modules", "target", ".git", "dist", "build", ".next", ".nuxt", "vendor", ".venv", "venv", "__pycache__", ".cache", "appdata", ".cargo", ".rustup", ".gemini", ".npm", ".nuget", ".gradle", ".m2", ".local", ".vscode", ".idea",
    "local settings", "application data", "benches", "examples", "testdata", "test_data", ".tox", ".mypy_cache", ".pytest_cache", ".dart_tool", "pods", ".build", ".svelte-kit", ".playwright-cli", ".playwright", ".output",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "composer.lock")
LANGUAGES = {
    "rust": ("rs",), "typescript": ("ts", "tsx", "mts"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",), "go": ("go",),
    "java": ("java",), "kotlin": ("kt", "kts"), "php": ("php",), "ruby": ("rb",), "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc"), "csharp": ("cs",),
    "swift": ("swift",), "dart": ("dart",), "vue": ("vue",), "svelte": ("svelte",), "astro": ("astro",), "html": ("html", "htm"), "css": ("css",),
    "scss": ("scss", "sass"), "less": ("less",), "json": ("json",), "toml": ("toml",), "yaml": ("yaml", "yml"), "sql": ("sql",), "markdown": ("md",),
    "twig": ("twig",), "shell": ("sh",),
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column | str) -> Column:
    """The language of a path by its extension, or null."""
    pairs = [F.lit(x) for name, ends in LANGUAGES.items() for e in ends for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def segments(path: Column | str) -> Column:
    return F.split(F.lower(col(path)), "/")


def ignored(path: Column | str) -> Column:
    parts = segments(path)
    return F.exists(parts, lambda s: s.isin(*IGNORED_DIRS)) | F.element_at(parts, -1).isin(*LOCK_FILES)


def test_like(path: Column | str) -> Column:
    return F.exists(segments(path), lambda s: s.isin("test", "tests"))


def package_slug(path: Column | str) -> Column:
    """The component after crates, packages or apps, else the first one."""
    found = F.regexp_extract(col(path), r"(?:^|/)(?:crates|packages|apps)/([^/]+)", 1)
    return F.when(found != "", found).otherwise(F.split(col(path), "/")[0])


def app_prefix(path: Column | str) -> Column:
    found = F.regexp_extract(col(path), r"(?:^|/)(apps/[^/]+)", 1)
    return F.when(found != "", found)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def hint_match(path: Column | str, hint: Column | str) -> Column:
    """Dashes count as underscores, case doesn't; the hint or one of its parts of over two characters is contained."""
    flat = F.lower(F.replace(col(path), F.lit("-"), F.lit("_")))
    want = F.lower(F.replace(col(hint), F.lit("-"), F.lit("_")))
    return F.contains(flat, want) | F.exists(F.split(want, "/"), lambda p: (F.length(p) > 2) & F.contains(flat, p))


def matches(path: Column | str, gold: Column | str) -> Column:
    """Suffix or containment."""
    return col(path).endswith(col(gold)) | F.contains(col(path), col(gold))


def crate_dir(path: Column | str) -> Column:
    """The folder before src, lib or app, else the first component."""
    before = r"^(.*?)/?(?:src|lib|app)/"
    return F.when(col(path).rlike(r"(^|/)(src|lib|app)/"), F.regexp_extract(col(path), before, 1)).otherwise(F.split(col(path), "/")[0])
