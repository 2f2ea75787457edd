"""Source text to rows: declarations with their spans and docs, calls with their callers and receivers, imports.

A text is masked first: comments and strings become blanks, so that positions stay and nothing inside them counts. What
encloses a place is the smallest span around it. Bodies end at their closing brace, or where indentation returns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that declare something, by language: what kind it is.
DECLARES = {
    "rust": {"fn": "function", "struct": "class", "enum": "class", "trait": "class", "impl": "impl"}, "python": {"def": "function", "class": "class"}, "javascript": {"function": "function", "class": "class"},
    "typescript": {"function": "function", "class": "class", "interface": "class", "enum": "class"}, "go": {"func": "function", "type": "class"}, "java": {"class": "class", "interface": "class", "enum": "class", "record": "class"},
    "kotlin": {"fun": "function", "class": "class", "interface": "class", "object": "class"}, "csharp": {"class": "class", "interface": "class", "record": "class", "struct": "class"}, "php": {"function": "function", "class": "class", "interface": "class", "trait": "class"},
    "swift": {"func": "function", "class": "class", "struct": "class", "protocol": "class", "enum": "class"}, "dart": {"class": "class", "mixin": "class"}, "ruby": {"def": "function", "class": "class", "module": "class"},
    "c": {"struct": "class"}, "cpp": {"class": "class", "struct": "class"},
}
#: Languages whose methods are declared without a word, and those whose bodies are told by indentation.
BARE_METHODS = ("javascript", "typescript", "java", "csharp", "dart", "c", "cpp")
INDENTED = ("python", "ruby")
HASH_COMMENTS = ("python", "ruby", "php")
NOT_CALLS = frozenset(
    "if for while switch match catch return new else elif except in not and or is with assert del lambda fn func fun def function class struct enum trait impl typeof instanceof sizeof throw throws await async yield super do try unless until when where print_ "
    "foreach elseif isset empty unset echo include require_once foreach_ case let var const".split()
)
SELF = ("self", "this", "Self", "cls", "@", "$this")
_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<![\w$.])({_NAME}(?:(?:\.|::|->|\?\.){_NAME})*)(!?)\s*(?:::<[^<>()]*>)?\(")
_STRING = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_SLASHED = re.compile(rf"//[^\n]*|/\*.*?\*/|{_STRING}", re.S)
_HASHED = re.compile(rf'""".*?"""|' + r"'''.*?'''" + rf"|\#[^\n]*|//[^\n]*|/\*.*?\*/|{_STRING}", re.S)
_PYTHON = re.compile(rf'""".*?"""|' + r"'''.*?'''" + rf"|\#[^\n]*|{_STRING}", re.S)
#: A Rust lifetime or a character is no string that a quote opens.
_RUST = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""", re.S)
DOC = 120


@dataclass
class Found:
    kind: str
    name: str
    start: int
    end: int
    line: int
    parent: str = ""
    doc: str = ""
    named: int = 0
    me: str = ""


def masked(text: str, language: str) -> str:
    rule = _RUST if language == "rust" else _PYTHON if language in ("python", "ruby") else _HASHED if language in HASH_COMMENTS else _SLASHED
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(plain: str, opened: int) -> int:
    """The place after the brace that closes the one at `opened`; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, opened):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(plain)


def indented_end(plain: str, at: int) -> int:
    """Where the block of the line at `at` ends: before the next line that isn't deeper and isn't blank."""
    start = plain.rfind("\n", 0, at) + 1
    margin = len(plain[start:at]) - len(plain[start:at].lstrip()) if plain[start:at].strip() else at - start
    line = plain.find("\n", at)
    while line != -1:
        following = plain.find("\n", line + 1)
        content = plain[line + 1 : following if following != -1 else len(plain)]
        if content.strip() and len(content) - len(content.lstrip()) <= margin and content.strip() != "end":
            return line
        line = following
    return len(plain)


def declarations(text: str, language: str, plain: str | None = None) -> list[Found]:
    """In order: kind, name, span, line from 1, the enclosing class or impl, and the first words of the doc."""
    plain = masked(text, language) if plain is None else plain
    kinds = DECLARES.get(language, {})
    if not kinds:
        return []
    lines = [m.start() for m in re.finditer(r"\n", text)]
    heads, methods = [], {}
    for m in re.finditer(rf"(?<![\w$.])({'|'.join(kinds)})\s+(?:<[^>]*>\s*)?(?:\([^)]*\)\s*)?(?:self\.)?({_NAME})", plain):
        name = m[2]
        if m[1] == "impl":  # the type that is implemented, not the trait
            after = re.match(rf"[^{{;]*?\bfor\s+({_NAME})", plain[m.end() :])
            name = after[1] if after else name
        if name not in NOT_CALLS:
            heads.append((m.start(), m.end(), kinds[m[1]], name))
            if method := re.match(rf"func\s+\(({_NAME})?\s*\*?\s*({_NAME})", m[0]):  # a method says its type before its name
                methods[m.start()] = (method[1] or "", method[2])
    if language in BARE_METHODS:
        taken = {end for _, end, *_ in heads}
        for m in re.finditer(rf"({_NAME})\s*\([^(){{}};]*\)\s*(?::[^={{;]+)?(?:throws\s+[\w., ]+)?\{{", plain):
            if m[1] not in NOT_CALLS and m.end(1) not in taken:
                heads.append((m.start(), m.end(1), "function", m[1]))
    out = []
    for start, end, kind, name in sorted(heads):
        if language in INDENTED:
            stop = indented_end(plain, start)
        else:
            m = re.compile(r"[{;]").search(plain, end)
            stop = closing(plain, m.start()) if m and m[0] == "{" else m.end() if m else len(plain)
        out.append(Found(kind, name, start, stop, bisect_right(lines, start - 1) + 1 if start else 1, doc=doc_of(text, plain, start, end, language), named=end))
    for f in out:
        around = [p for p in out if p.kind in ("class", "impl") and p is not f and p.start <= f.start and f.end <= p.end]
        f.me, f.parent = methods.get(f.start, ("", min(around, key=lambda p: p.end - p.start).name if around else ""))
    return out


def doc_of(text: str, plain: str, start: int, end: int, language: str) -> str:
    """The comment that ends on the line before, or a string that begins the body; its first DOC characters."""
    if language == "python":
        m = re.compile(r":[ \t]*\n\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", re.S).search(text, end)
        if m and not plain[end : m.start()].count("\n") and not plain[m.start() + 1 : m.end()].strip():
            return " ".join((m[1] or m[2] or "").split())[:DOC]
    above = text[: text.rfind("\n", 0, start) + 1].rstrip("\n").split("\n")
    block: list[str] = []
    while above and re.match(r"\s*(#\[|@\w)", above[-1]):  # marks stand between a doc and what it tells of
        above.pop()
    if above and above[-1].rstrip().endswith("*/"):
        while above:
            block.insert(0, above.pop())
            if "/*" in block[0]:
                break
    else:
        while above and re.match(r"\s*(///?|//!|#)(?!\[)", above[-1]):
            block.insert(0, above.pop())
    return " ".join(" ".join(re.sub(r"^\s*(/\*\*?|\*/|\*|//[/!]?|#)|\*/\s*$", "", b).strip() for b in block).split())[:DOC]


def calls(text: str, language: str) -> list[tuple[str, str, str, int]]:
    """(caller, callee, hint, line), each once for a caller. The hint tells the receiver: `impl:` the enclosing type, `field:`
    a field of it, `type:` a type, `obj:` another object."""
    plain = masked(text, language)
    found = declarations(text, language, plain)
    functions = [f for f in found if f.kind == "function"]
    named = {f.named for f in found}
    lines = [m.start() for m in re.finditer(r"\n", text)]
    out: dict[tuple[str, str, str], int] = {}
    for m in _CALL.finditer(plain):
        parts = re.split(r"\?\.|\.|::|->", m[1])
        callee, receiver = parts[-1], parts[:-1]
        if (not receiver and callee in NOT_CALLS) or m[2] or m.end(1) in named or plain[: m.start()].rstrip().endswith(" new"):
            continue
        around = [f for f in functions if f.start <= m.start() < f.end]
        if not around:
            continue
        caller = min(around, key=lambda f: f.end - f.start)
        hint = ""
        if receiver and receiver[0] in (*SELF, caller.me or "this"):
            hint = f"field:{receiver[1]}" if len(receiver) > 1 else f"impl:{caller.parent}" if caller.parent else ""
        elif receiver:
            hint = f"type:{receiver[-1]}" if receiver[-1][:1].isupper() else f"obj:{receiver[-1]}"
        out.setdefault((caller.name, callee, hint), bisect_right(lines, m.start() - 1) + 1 if m.start() else 1)
    return [(*k, line) for k, line in out.items()]


def type_uses(text: str, language: str) -> list[tuple[str, str, int]]:
    """(caller, type, line): types that a function throws, makes anew, or catches and throws on."""
    plain = masked(text, language)
    functions = [f for f in declarations(text, language, plain) if f.kind == "function"]
    caught = {m[2]: m[1] for m in re.finditer(rf"catch\s*\(\s*({_NAME})\s+(\$?{_NAME})\s*\)", plain)}
    out: dict[tuple[str, str], int] = {}
    for m in re.finditer(rf"\b(?:throw\s+(?:new\s+({_NAME})|(\$?{_NAME})\s*;)|new\s+({_NAME}))", plain):
        name = m[1] or m[3] or caught.get(m[2] or "")
        around = [f for f in functions if f.start <= m.start() < f.end]
        if name and around:
            out.setdefault((min(around, key=lambda f: f.end - f.start).name, name), plain.count("\n", 0, m.start()) + 1)
    return [(*k, line) for k, line in out.items()]


def expand_use(tree: str) -> list[tuple[str, str]]:
    """(path, local name) of each leaf of a Rust use tree such as `a::{b, c::{self, d as e}, f::*}`."""

    def split(body: str) -> list[str]:
        parts, depth, held = [], 0, ""
        for c in body:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(held)
                held = ""
            else:
                held += c
        return [p.strip() for p in [*parts, held] if p.strip()]

    def walk(part: str, before: str) -> Iterator[tuple[str, str]]:
        part = part.strip().removeprefix("::")
        if "{" in part:
            head, _, body = part.partition("{")
            for inner in split(body.rstrip().removesuffix("}")):
                yield from walk(inner, before + head.strip())
            return
        path, _, alias = (x.strip() for x in part.partition(" as "))
        whole = before.removesuffix("::") if path == "self" else before + path
        yield whole, alias or whole.rsplit("::", 1)[-1]

    return list(walk(tree, ""))


def imports(text: str, language: str) -> list[tuple[str, str, int]]:
    """(module, local name, line) of what a text imports."""
    out = []
    blank = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S) if language not in ("python", "ruby") else text
    at = lambda m: blank.count("\n", 0, m.start()) + 1
    if language == "rust":
        for m in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", blank):
            out += [(path, name, at(m)) for path, name in expand_use(m[1])]
    elif language == "python":
        for m in re.finditer(r"(?m)^[ \t]*(?:from\s+([\w.]+)\s+)?import\s+(\([^)]*\)|[^\n#]+)", blank):
            for part in re.split(r",", m[2].strip("() \n")):
                name, _, alias = (x.strip() for x in part.partition(" as "))
                if name:
                    out.append((f"{m[1]}.{name}" if m[1] else name, alias or (name if m[1] else name.split(".")[0]), at(m)))
    elif language in ("javascript", "typescript", "vue"):
        for m in re.finditer(r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:([^'";]+?)\s+from\s+)?['"]([^'"]+)['"]|\b(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)""", blank):
            names = re.findall(r"(?:\*\s+as\s+)?(?:(\w+)\s*(?:as|:)\s*)?(\w+)", m[1] or m[3] or "")
            out += [(m[2] or m[4], local, at(m)) for _, local in names] or [(m[2] or m[4], "", at(m))]
    elif language == "go":
        for m in re.finditer(r'(?m)^[ \t]*(?:import\s+)?(?:([\w.]+)[ \t]+)?"([\w./-]+)"[ \t]*$', blank):
            out.append((m[2], m[1] or m[2].rsplit("/", 1)[-1], at(m)))
    elif language == "ruby":
        out += [(m[1], "", at(m)) for m in re.finditer(r"""(?m)^[ \t]*require(?:_relative)?\s+['"]([^'"]+)['"]""", blank)]
    else:
        word = {"php": "use", "csharp": "using"}.get(language, "import")
        for m in re.finditer(rf"""(?m)^[ \t]*{word}\s+(?:static\s+|function\s+)?['"]?([\w.\\:/-]+)['"]?(?:\s+as\s+(\w+))?""", blank):
            out.append((m[1], m[2] or re.split(r"[.\\/:]", m[1])[-1], at(m)))
    return out


def rows(path: str, language: str, text: str) -> Iterator[tuple]:
    """(path, kind, name, parent or caller or module, hint or doc, line)"""
    for f in declarations(text, language):
        yield path, f.kind, f.name, f.parent, f.doc, f.line
    for caller, callee, hint, line in calls(text, language):
        yield path, "call", callee, caller, hint, line
    for caller, name, line in type_uses(text, language):
        yield path, "type_use", name, caller, "", line
    for module, name, line in imports(text, language):
        yield path, "import", name, module, "", line


def analyse(files: DataFrame) -> DataFrame:
    """files (path, language, content): rows (path, kind, name, owner, detail, line). A null content has none."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("detail", pa.string()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for r in rows(path, language or "", text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t.type) for i, t in enumerate(schema)], schema=schema)

    return files.select("path", "language", "content").mapInArrow(run, "path string, kind string, name string, owner string, detail string, line int")
