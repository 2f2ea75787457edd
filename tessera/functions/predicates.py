"""What paths and prompts are about: predicates over both as column expressions, and as SQL conditions of the same rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col

# Folder names, file stems, and words that prompts use.
BENCH_DIRS = ("bench", "benches", "benchmark", "benchmarks", "perf", "__benchmarks__")
LOCALE_DIRS = ("locales", "locale", "i18n", "l10n")
TEST_DIRS = ("tests", "test")
TEST_PARTS = ("_tests.rs", "quality_tests")
EXAMPLE_DIRS = ("examples", "example")
TESTDATA_DIRS = ("testdata", "test_data")
LEGACY_DIRS = ("v2", "v3", "compat", "legacy", "deprecated")
LEGACY_STEMS = ("compat", "legacy", "deprecated")
ALT_DIRS = ALT_STEMS = ("mini", "lite", "slim", "light")
SCHEMA_DIRS = ("migrations", "seeders", "seeds", "factories", "sql")
EDITOR_DIRS = ("editors",)
DATABASE_WORDS = ("migration", "seeder", "factory", "eloquent", "schema::", "create table", ".sql", " sql", "sql ")
BENCH_WORDS = ("benchmark", "benches", "/bench/", "bench/", "__benchmarks__", "/perf/")
LOCALE_WORDS = ("locale", "i18n", "l10n", "translat")
LEGACY_WORDS = ("v3", "v2", "compat", "legacy", "deprecated")
ALT_WORDS = ("/mini/", " mini ", "minified", "lite api", "/lite/", "slim", "lightweight")
JSON_SCHEMA_WORDS = ("json-schema", "json schema", "tojsonschema", "to-json-schema")
TYPE_WORDS = ("generic", "z.infer", "infer", "type parameter", "type-level")
EDITOR_WORDS = ("vscode", "vs code", "visual studio", "jetbrains", "windsurf", "cursor extension", "cursor plugin", "ide extension", "ide plugin", "editors/")
CALLER_WORDS = (
    "dead code", "dead-code", "unused", "unreferenced", "not used", "never used", "no caller", "callers", "who calls", "all usages", "all references", "references across", "list all references", "find unused",
)
BUG_WORDS = ("bug", "fix", "double discount", "wrong total")
STYLE_WORDS = (
    "scss", "sass", "stylesheet", "style sheet", "design token", "tokens and mixins", "tokens/mixins", "mixins", "mixin", "hover-lift", "focus-within", "price-card", "_tokens.", "_mixins.",
)
STYLE_PARTS = ("/styles/", "_tokens.", "_mixins.", "tokens.scss", "mixins.scss")
STYLE_ENDS = (".scss", ".sass", ".less")
STYLE_NOISE = ("promo", "cartdrawer", "cartview", "/stores/cart", "appbutton")


class Rule:
    """A condition on a column, as SQL and as an expression, which is built when it is asked for."""

    def __init__(self, build: Callable[[], Column], sql: str):
        self.build, self.sql = build, sql

    @property
    def column(self) -> Column:
        return self.build()

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column | other.column, f"({self.sql} OR {other.sql})")

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column & other.column, f"({self.sql} AND {other.sql})")

    def __invert__(self) -> Rule:
        return Rule(lambda: ~self.column, f"(NOT {self.sql})")


def any_of(parts: Iterable[Column]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | part
    return found


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def within(name: str, folders: Sequence[str]) -> Rule:
    """A part of the path is one of the names."""
    return Rule(lambda: F.arrays_overlap(F.split(F.lower(col(name)), "/"), F.array(*map(F.lit, folders))), f"list_has_any(string_split(lower({name}), '/'), [{quoted(folders)}])")


def says(name: str, words: Sequence[str]) -> Rule:
    """One of the words is in the text."""
    return Rule(lambda: any_of(F.contains(F.lower(col(name)), F.lit(w)) for w in words), "(" + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + ")")


def ends(name: str, words: Sequence[str]) -> Rule:
    return Rule(lambda: any_of(F.endswith(F.lower(col(name)), F.lit(w)) for w in words), "(" + " OR ".join(f"suffix(lower({name}), '{w}')" for w in words) + ")")


def stem(name: str) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(col(name), "/"), -1), r"(?<=.)\.[^.]*$", ""))


def stem_sql(name: str) -> str:
    return f"lower(regexp_replace(string_split({name}, '/')[-1], '(.)\\.[^.]*$', '\\1'))"


def stemmed(name: str, stems: Sequence[str]) -> Rule:
    return Rule(lambda: stem(name).isin(*stems), f"{stem_sql(name)} IN ({quoted(stems)})")


def path_rules(p: str = "path") -> dict[str, Rule]:
    """Kinds of source paths."""
    rules = {
        "bench": within(p, BENCH_DIRS), "locale": within(p, LOCALE_DIRS), "test": within(p, TEST_DIRS) | says(p, TEST_PARTS) | ends(p, ("/tests.rs",)), "example": within(p, EXAMPLE_DIRS), "testdata": within(p, TESTDATA_DIRS),
        "legacy": within(p, LEGACY_DIRS) | stemmed(p, LEGACY_STEMS), "alt_surface": within(p, ALT_DIRS) | stemmed(p, ALT_STEMS), "schema": within(p, SCHEMA_DIRS) | says(p, ("/database/",)) | ends(p, (".sql",)), "editors": within(p, EDITOR_DIRS),
    }
    twins = rules["bench"] | rules["locale"] | rules["legacy"] | rules["alt_surface"]
    rules["core"] = within(p, ("core",)) & ~twins
    rules["decoy"] = twins | rules["schema"] | rules["editors"]
    rules["low_priority"] = twins | rules["test"] | rules["example"] | rules["testdata"] | rules["editors"]
    rules["json_schema"] = says(p, ("/json-schema",)) | Rule(lambda: stem(p).rlike("json[-_]schema"), f"regexp_matches({stem_sql(p)}, 'json[-_]schema')")
    rules["embed_noise"] = rules["low_priority"] | says(p, ("/docs/", "/editors/", "/types/")) | ends(p, (".md", ".rst", ".d.ts"))
    rules["style"] = says(p, STYLE_PARTS) | ends(p, STYLE_ENDS)
    return rules


def prompt_rules(p: str = "prompt") -> dict[str, Rule]:
    """What a prompt asks for."""
    graph = (says(p, ("caller", "callee")) & says(p, ("call", "trace", "graph"))) | says(p, ("callers and callees", "call graph"))
    return {
        "database": says(p, DATABASE_WORDS), "bench": says(p, BENCH_WORDS), "locale": says(p, LOCALE_WORDS), "legacy": says(p, LEGACY_WORDS), "alt_surface": says(p, ALT_WORDS), "json_schema": says(p, JSON_SCHEMA_WORDS),
        "types": says(p, TYPE_WORDS), "editors": says(p, EDITOR_WORDS), "call_graph": graph, "callers": graph | says(p, CALLER_WORDS) | (says(p, ("reference",)) & says(p, ("across",))),
        "bug_hunt": says(p, BUG_WORDS) | (says(p, ("discount",)) & says(p, ("total",))), "style": says(p, STYLE_WORDS),
    }


def seed_allowed(path: str = "path", prompt: str = "prompt") -> list[tuple[Rule, Rule]]:
    """Kinds of paths that seed a packet only if the prompt asks for them, in order: (path rule, prompt rule)."""
    kinds, asked = path_rules(path), prompt_rules(prompt)
    return [
        (kinds["bench"], asked["bench"]), (kinds["locale"], asked["locale"]), (kinds["legacy"], asked["legacy"]), (kinds["alt_surface"], asked["alt_surface"]),
        (ends(path, (".sql",)) | within(path, ("sql",)), says(prompt, (".sql", "create table", " sql", "sql "))), (within(path, ("migrations",)), says(prompt, ("migration", "schema::"))),
        (within(path, ("seeders", "seeds")), says(prompt, ("seeder", "seed"))), (within(path, ("factories",)), says(prompt, ("factory",))), (kinds["schema"], asked["database"]), (kinds["editors"], asked["editors"]),
    ]


def first_that_fits(pairs: list[tuple[Rule, Rule]]) -> Rule:
    """The second rule of the first pair whose first rule holds; true if none does."""

    def build() -> Column:
        column = F.lit(True)
        for when, then in reversed(pairs):
            column = F.when(when.column, then.column).otherwise(column)
        return column

    sql = "TRUE"
    for when, then in reversed(pairs):
        sql = f"CASE WHEN {when.sql} THEN {then.sql} ELSE {sql} END"
    return Rule(build, sql)
