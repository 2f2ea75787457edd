"""Framework overlays: what marks, calls, declarations and paths say about routes, components and links.

One scanner finds calls and marks with their first string, and declarations with their bases and marks; a table tells which
of them mean something to a framework. Frameworks fix these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERBS = ("get", "post", "put", "patch", "delete")
UPPER = tuple(v.upper() for v in VERBS)
TITLE = tuple(v.title() for v in VERBS)


@dataclass(frozen=True)
class Called:
    """Calls, or marks before a declaration, of these names; receivers: what they are called on (none given: anything)."""

    kind: str
    names: tuple[str, ...]
    receivers: tuple[str, ...] | None = None
    marks: tuple[str, ...] = ("",)
    begins: str = ""
    strip: str = ""


@dataclass(frozen=True)
class Declared:
    """Declarations by these words: of one of the bases, or one that ends so, or after a mark, or of a capital letter."""

    kind: str
    words: tuple[str, ...]
    bases: tuple[str, ...] = ()
    base_ends: tuple[str, ...] = ()
    marks: tuple[str, ...] = ()
    capital: bool = False


@dataclass(frozen=True)
class Lined:
    """Lines, or places, that begin with a sign and go on with a name: kind, what is before, what is after."""

    kind: str
    before: str
    after: str
    name: str = r"[A-Za-z_][\w-]*"
    anywhere: bool = False


#: What each framework's sources declare. All names are fixed by the frameworks.
FRAMEWORKS: dict[str, tuple[Called | Declared | Lined, ...]] = {
    "express": (Called("route", VERBS, ("app", "router")),), "fastapi": (Called("route", VERBS, marks=("@",)),), "flask": (Called("route", ("route",), marks=("@",)),),
    "spring": (Called("route", (*(f"{v}Mapping" for v in TITLE), "RequestMapping"), marks=("@",), strip="Mapping"),), "gin": (Called("route", UPPER),), "laravel": (Called("route", (*VERBS, "resource"), ("Route",)),),
    "rails": (Called("route", VERBS, (), marks=("bare",)),), "nest": (Called("route", TITLE, marks=("@",)),), "aspnet": (Called("route", tuple(f"Map{v}" for v in TITLE), strip="Map"),), "axum": (Called("route", ("route",)),),
    "ktor": (Called("route", VERBS, (), begins="/"),), "django": (Called("route", ("path", "re_path"), ()),), "symfony": (Called("route", ("Route",), marks=("#[",)),),
    "react": (Declared("component", ("function", "const"), capital=True),), "flutter": (Declared("component", ("class",), base_ends=("Widget",)),), "swiftui": (Declared("component", ("struct",), bases=("View", "App", "Scene")),),
    "android": (Declared("component", ("class",), base_ends=("Activity", "Fragment", "Receiver", "Service")),), "compose": (Declared("component", ("fun",), marks=("Composable",)),), "angular": (Declared("component", ("class",), marks=("Component",)),),
    "eloquent": (Declared("component", ("class",), bases=("Model",)),), "tauri": (Declared("component", ("fn",), marks=("tauri::command", "command")),),
    "blade": (Called("view", ("extends", "include", "component", "livewire", "includeIf"), marks=("@",)),), "electron": (Called("channel", ("handle", "on"), ("ipcMain",)),), "wordpress": (Called("route", ("register_rest_route",), ()),),
    "schema": (Called("table", ("create", "table"), ("Schema",)),), "factory": (Called("factory", ("factory",)), Lined("model", r"\$model\s*=\s*", "::class", anywhere=True)), "cjs": (Called("module", ("require",), ()),),
    "vue_store": (Called("store", ("use*Store",), ()),), "vue_router": (Lined("route", r"path\s*:\s*['\"]", "['\"]", r"[^'\"]*", True),), "view_render": (Called("view", ("render",), ("View",)),), "vite_tags": (Called("entry", ("vite",), ()),),
    "hmvc_routes": (Called("route", ("collection", *VERBS)), Called("action", ("name",))), "hmvc_manifest": (Lined("config", r"['\"](?:package|name|theme|lang)['\"]\s*=>\s*['\"]", "['\"]", r"[^'\"]*", True),),
    "twig": (Lined("block", r"\{%-?\s*block\s+", "", r"\w+", True),), "razor": (Lined("page", r"@page\s+\"", "\"", r"[^\"]+"),), "env": (Lined("variable", "", "=", r"[A-Z][A-Z0-9_]*"),),
    "scss": (Lined("variable", r"\$", r"\s*:"), Lined("mixin", r"@mixin\s+", "")), "css": (Lined("property", "--", r"\s*:", anywhere=True),), "prime": (Lined("widget", r"import\s+", r"\s+from\s+['\"]primevue/", r"\w+"),),
}
#: Folders whose files are routes, by framework: what comes before the route, the names of the files that are one, their endings.
PAGES = {
    "next": ("app", ("page", "route"), ("tsx", "ts", "jsx", "js")), "nuxt": ("pages", (), ("vue",)), "sveltekit": ("routes", ("+page", "+server", "+page.server"), ("svelte", "ts", "js")), "astro": ("src/pages", (), ("astro", "ts", "md")),
    "remix": ("app/routes", (), ("tsx", "ts", "jsx", "js")),
}
_CHAIN = re.compile(r"(@|\#\[)?\s*([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)(?:\s*\(\s*|[ \t]+(?=['\"]))")
_STRING = re.compile(r"""[\s\[({]*(?:\w+\s*=\s*)?[rbfu]?(['"`])((?:\\.|(?!\1)[^\\\n])*)\1""")
_DECLARED = re.compile(r"\b(class|struct|fun|fn|function|const)\s+(\w+)\s*(?:\([^)]*\))?\s*((?:extends|implements|with|:|<)[^{;=]*)?")
_MARK = re.compile(r"(?:@([\w.]+)|\#\[([\w:]+))")


def calls_of(text: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(mark, receiver, name, first string, line); what a line begins with, without brackets, is marked `bare`."""
    line, last = 1, 0
    for m in _CHAIN.finditer(text):
        line, last = line + text.count("\n", last, m.start()), m.start()
        parts = re.split(r"\.|::|->", m[2])
        found = _STRING.match(text, m.end())
        mark = m[1] or ("" if m[0].rstrip().endswith("(") else "bare")
        yield mark, parts[-2] if len(parts) > 1 else "", parts[-1], found[2] if found else "", line + text.count("\n", m.start(), m.start(2))


def declared_in(text: str) -> Iterator[tuple[str, str, list[str], list[str], int]]:
    """(word, name, bases, marks before it, line)"""
    last, line = 0, 1
    for m in _DECLARED.finditer(text):
        held = text[last : m.start()]
        line += held.count("\n")
        marks = [a or b for a, b in _MARK.findall(held)]
        yield m[1], m[2], re.findall(r"[A-Za-z_]\w*", m[3] or ""), marks, line
        last, line = m.end(), line + m[0].count("\n")


def named(wanted: str, name: str) -> bool:
    head, star, tail = wanted.partition("*")
    return name.startswith(head) and name.endswith(tail) and len(name) > len(head) + len(tail) if star else name == wanted


def found_in(text: str, framework: str) -> list[tuple[str, str, str, int]]:
    """(kind, verb or word, name or path, line) of what a framework's overlay adds, in order of the rules."""
    out = []
    for rule in FRAMEWORKS[framework]:
        if isinstance(rule, Called):
            for mark, receiver, name, first, line in calls_of(text):
                on = rule.receivers is None or receiver in (rule.receivers or ("",))
                if mark in rule.marks and on and any(named(w, name) for w in rule.names) and first.startswith(rule.begins):
                    target = first or (receiver if rule.kind == "factory" else name)
                    out.append((rule.kind, name.replace(rule.strip, "") if rule.strip else name, target, line))
        elif isinstance(rule, Declared):
            for word, name, bases, marks, line in declared_in(text):
                fits = any(b in rule.bases or b.endswith(rule.base_ends) for b in bases if rule.bases or rule.base_ends) or any(m in rule.marks for m in marks) or rule.capital and name[:1].isupper()
                if word in rule.words and fits:
                    out.append((rule.kind, word, name, line))
        else:
            start = "" if rule.anywhere else r"(?m)^[ \t]*"
            for m in re.finditer(f"{start}{rule.before}({rule.name}){rule.after}", text):
                out.append((rule.kind, "", m[1], text.count("\n", 0, m.start(1)) + 1))
    return out


def routes_of(text: str, framework: str) -> list[tuple[str, str, int]]:
    """(verb, path, line) of the routes that a framework's source declares."""
    return [(verb.upper(), path, line) for kind, verb, path, line in found_in(text, framework) if kind == "route"]


def overlay(files: DataFrame) -> DataFrame:
    """files (path, framework, content): rows (path, framework, kind, verb, name, line); other frameworks have none."""
    schema = pa.schema([(n, pa.string()) for n in ("path", "framework", "kind", "verb", "name")] + [("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            found = [(path, name, *row) for path, name, text in told if name in FRAMEWORKS for row in found_in(text or "", name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t.type) for i, t in enumerate(schema)], schema=schema)

    return files.select("path", "framework", "content").mapInArrow(run, "path string, framework string, kind string, verb string, name string, line int")


def of_path(path: Column) -> Column:
    """What a file's name alone says: `component` of a PHP controller, `config` of a bundler's configuration, else null."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.endswith("Controller.php"), "component").when(last.rlike(r"^vite\.config\.[a-z]+$"), "config")


def page_route(path: Column, framework: str) -> Column:
    """The URL that a file's path stands for, or null: groups in brackets go, `[id]` is a parameter, `index` is the folder."""
    folder, names, ends = PAGES[framework]
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    ending = F.element_at(F.split(file, r"\."), -1)
    stem = F.substring(file, F.lit(1), F.length(file) - F.length(ending) - 1)
    at = F.instr(F.concat(F.lit("/"), path), f"/{folder}/")
    inner = F.substring(path, at + len(folder) + 1, F.length(path))
    inner = F.substring(inner, F.lit(1), F.greatest(F.lit(0), F.length(inner) - F.length(file)))
    inner = F.rtrim(inner, F.lit("/")) if names else F.concat(inner, stem)
    if framework == "remix":
        inner = F.replace(F.replace(inner, F.lit("."), F.lit("/")), F.lit("$"), F.lit(":"))
    shown = F.filter(F.split(inner, "/"), lambda s: ~s.isin("", "index", "_index") & ~(F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))))
    shown = F.transform(shown, lambda s: F.when(F.startswith(s, F.lit("[")), F.concat(F.lit(":"), F.translate(s, "[].", ""))).otherwise(s))
    fits = (at > 0) & ending.isin(*ends) & (stem.isin(*names) if names else F.lit(True))
    return F.when(fits, F.concat(F.lit("/"), F.array_join(shown, "/")))
