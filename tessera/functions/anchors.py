"""What a prompt names: identifiers, files and routes, clauses and their nouns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.prompts import ROUTE_METHODS, SOURCE_ENDINGS, after_method, is_http_path, is_route_query, route_of_url
from tessera.functions.text import col

# Words that are no identifiers, words of a clause that say nothing, verbs that ask for work.
STOP_WORDS = (
    "the and for how does what this that with from into using when where which about after before should would could please make update change add fix create implement explain modify refactor remove delete "
    "rewrite improve design define plan inspect review give architect deploy configure identify scaffold build show find get set run use need want task code file function class method type module project "
    "context minimal active exact real why any all our your their have has been were was are is not can will just also than then them they you its"
).split()
FILLER_WORDS = (
    "action actions flow work works check checks role roles each also plus both half part piece request requests response responses produce handle handles used using make made thing things case cases logic "
    "based named called related distinct second first other another every under over through during without within between among against toward across route routes including extract intent pipeline works "
    "server start process"
).split()
ASKING_VERBS = (
    "design define plan inspect review give create implement build architect deploy configure identify scaffold generate develop establish outline propose prepare analyze analyse evaluate assess document "
    "describe explain modify update change add fix make show find get set run use need want"
).split()
NO_SUBJECTS = "the and for how does what this that with from into using when where which about user users app page view file code".split()
CLAUSE_BORDERS = ("and how", "including", "as well as", "and also")

NAME, PART = "[A-Za-z_][A-Za-z0-9_]*", "[A-Za-z0-9_.-]+"
FILE_ENDINGS = [e for e in SOURCE_ENDINGS if e not in ("toml", "md")]
PATH_CHARS = "A-Za-z0-9._~:@!$&'*+,;=%-"
SPOKEN_METHODS = ROUTE_METHODS[:9]


def all_of(text: Column, rule: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(group))


def unique(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def none() -> Column:
    return F.array().cast("array<string>")


def is_code(x: Column) -> Column:
    """Written like a name in code, and no plain word."""
    marked = F.contains(x, F.lit("_")) | x.rlike(r"\p{Lu}") | F.contains(x, F.lit("::")) | F.contains(x, F.lit("/"))
    return (F.octet_length(x) >= 3) & ~F.lower(x).isin(*ASKING_VERBS, *STOP_WORDS) & marked


def is_subject(x: Column) -> Column:
    """A word that `how does ...` may be about, lower-cased ones too."""
    return x.rlike("^[A-Za-z0-9_]{3,}$") & ~F.lower(x).isin(*NO_SUBJECTS)


def routes_of(x: Column) -> Column:
    """`METHOD path` and the path, or the path alone."""
    path = after_method(x)
    both = F.array(F.concat(F.upper(F.substring_index(x, " ", 1)), F.lit(" "), path), path)
    return F.when(is_http_path(path), both).when(path.isNull() & is_http_path(x), F.array(x)).otherwise(none())


def members(text: Column, owner: str, least: str = "[A-Za-z0-9_]*") -> Column:
    return all_of(text, rf"\b{owner}\.[A-Za-z_]{least}\b")


def identifiers(prompt: Column | str) -> Column:
    """The names in a prompt, each once, kind after kind: qualified names, quoted ones, subjects of `how does`, members, calls, names
    written like code, routes."""
    text = col(prompt)
    last = lambda x, sign: F.element_at(F.split(x, sign), -1)
    named = lambda x: is_code(x) | is_subject(x)
    kept = lambda ok, x: F.when(ok, F.array(x)).otherwise(none())
    each = lambda found, f: F.flatten(F.transform(found, f))
    quoted = F.transform(all_of(text, "`([^`]+)`", 1), F.trim)
    routes = all_of(text, r"(?i)\b(?:" + "|".join(SPOKEN_METHODS) + r")\s+/[^\s`'<>,]+")
    routes = F.transform(routes, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[.,)\];:!?]+$", ""))
    return unique(
        each(all_of(text, rf"\b{NAME}(?:::{NAME})+\b"), lambda x: F.array(x, last(x, "::"))),
        each(quoted, lambda x: F.when(is_route_query(x), routes_of(x)).when(is_file(x), none()).otherwise(kept(named(x), x))),
        F.filter(all_of(text, rf"(?i)\bhow\s+do(?:es)?\s+(?:(?:the|a|an|this|that)\s+)?({NAME})\b", 1), is_subject),
        each(members(text, "[A-Z][A-Za-z0-9_]*"), lambda x: F.concat(kept(is_code(F.split(x, r"\.")[0]), F.split(x, r"\.")[0]), kept(named(last(x, r"\.")), last(x, r"\.")))),
        F.filter(all_of(text, rf"\b({NAME})\(\)", 1), lambda x: is_subject(x) & ~F.lower(x).isin(*STOP_WORDS)),
        F.filter(F.transform(members(text, "[a-z]", "[A-Za-z0-9_]{2,}"), lambda x: last(x, r"\.")), named),
        each(members(text, "[a-z][a-z0-9_]*"), lambda x: F.concat(F.array(x), kept(named(last(x, r"\.")), last(x, r"\.")))),
        F.filter(all_of(text, r"\b(?:[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-zA-Z0-9]{2,})\b"), is_code),
        each(routes, routes_of),
        F.filter(all_of(text, rf"(?:^|[\s`'(])(/[{PATH_CHARS}]+(?:/[{PATH_CHARS}]*)*)", 1), is_http_path),
        F.array_compact(F.transform(all_of(text, r"(?i)https?://[^\s`'<>,]+"), route_of_url)),
    )


def is_file(x: Column) -> Column:
    """What is quoted like a path: a dot and a slash, or a backslash."""
    return (F.contains(x, F.lit(".")) & F.contains(x, F.lit("/"))) | F.contains(x, F.lit("\\"))


def file_hints(prompt: Column | str) -> Column:
    """The files that a prompt names, each once: paths, bare names with a known ending, quoted paths."""
    text = col(prompt)
    quoted = F.transform(all_of(text, "`([^`]+)`", 1), F.trim)
    slashed = lambda x: F.replace(x, F.lit("\\"), F.lit("/"))
    return unique(
        F.transform(all_of(text, rf"(?:{PART}[/\\])+{PART}\.[A-Za-z0-9]+"), slashed), all_of(text, rf"\b{PART}\.(?:{'|'.join(FILE_ENDINGS)})\b"),
        F.transform(F.filter(quoted, lambda x: ~is_route_query(x) & is_file(x)), slashed),
    )


def embedded_names(prompt: Column | str, names: Column, most: int = 12) -> Column:
    """The identifiers (names) and what is in snake case, so many."""
    snake = all_of(col(prompt), r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b")
    return F.slice(unique(names, F.filter(snake, lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*STOP_WORDS, *FILLER_WORDS))), 1, most)


def clauses(prompt: Column | str) -> Column:
    """The parts that a prompt's joining phrases border, of 8 bytes or more; the prompt itself if that leaves one at most."""
    text = col(prompt)
    borders = "|".join(rf"\b{b}\b" for b in CLAUSE_BORDERS)
    parts = F.transform(F.split(text, rf"(?i)\s*(?:,\s*)?(?:{borders})\s*"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), "^[,.;:]+|[,.;:]+$", ""), r"^\s+|\s+$", ""))
    long = F.filter(parts, lambda x: F.octet_length(x) >= 8)
    return F.when(F.size(long) > 1, long).otherwise(F.array(text))


def nouns(clause: Column | str, most: int = 4) -> Column:
    """The longest words of a clause that say what it is about, of five letters or more; equally long ones in order."""
    words = all_of(col(clause), "[A-Za-z0-9_]+")
    telling = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 5) & ~F.contains(w, F.lit("__")) & ~F.lower(w).isin(*STOP_WORDS, *FILLER_WORDS))
    ranked = F.sort_array(F.transform(telling, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(ranked, 1, most)["w"]
