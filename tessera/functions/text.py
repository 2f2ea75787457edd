"""Text scalars. All are built-in expressions, so they stay inside generated code and reach the scan's projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out: the JVM's \\s is ASCII only.
SPACE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
PUNCT = "!-/:-@\\[-`{-~"
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ENGLISH = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "not")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text: Column | str) -> Column:
    """Words, plus one per ASCII punctuation mark and line break; at least a quarter of the UTF-8 bytes, rounded up."""
    text = col(text)
    # one pass: words, marks and breaks never overlap; a run begins with plain letters and digits, which are looked up in
    # a table; no group repeats, as that would fill the stack
    told = F.regexp_count(text, F.lit(f"[{PLAIN}]++[^{SPACE}{PUNCT}]*+|[^{SPACE}{PUNCT}]++|[{PUNCT}]|\\n"))
    return F.greatest(told, F.ceil(F.octet_length(text) / 4)).cast("long")


def identifier_tokens(name: Column | str) -> Column:
    """Lower-cased parts of an identifier, split at separators and camel-case borders; parts of one character go."""
    spaced = F.regexp_replace(col(name), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    return F.filter(F.transform(F.split(spaced, r"[_\-/\\.:]+"), F.lower), lambda t: F.length(t) > 1)


def specificity(query: Column | str, name: Column | str) -> Column:
    """1 for equal names, 0 where the query isn't contained, else the root of the byte share, from 0.12 to 1."""
    query, name = F.lower(col(query)), F.lower(col(name))
    share = F.sqrt(F.octet_length(query) / F.octet_length(name))
    return F.when(query == name, 1.0).when(~F.contains(name, query), 0.0).otherwise(F.greatest(F.lit(0.12), F.least(F.lit(1.0), share)))


def snake_case(name: Column | str) -> Column:
    """An underscore before every capital but the first letter, all lower-cased."""
    return F.lower(F.regexp_replace(col(name), "(?<!^)([A-Z])", "_$1"))


def camel_case(name: Column | str) -> Column:
    """From snake case: the parts after the first are capitalised."""
    parts = F.split(col(name), "_")
    rest = F.transform(F.slice(parts, 2, 1000), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100000)))
    return F.concat(parts[0], F.array_join(rest, ""))


def pascal_case(name: Column | str) -> Column:
    parts = F.split(col(name), "_")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 100000))), "")


def stem_variants(word: Column | str) -> Column:
    """The word and what it is without -ing, -ation or -tion, if enough is left."""
    word = F.lower(col(word))

    def without(end: str, least: int) -> Column:
        return F.when(word.endswith(end) & (F.length(word) >= len(end) + least), F.substring(word, F.lit(1), F.length(word) - len(end)))

    ing = without("ing", 3)
    return F.array_distinct(F.array_compact(F.array(word, ing, F.concat(ing, F.lit("e")), without("ation", 3), F.concat(without("ation", 3), F.lit("ate")), F.concat(without("tion", 3), F.lit("t")))))


def english_likeness(text: Column | str) -> Column:
    """At least two different English stop words."""
    return F.size(F.array_intersect(F.split(F.lower(col(text)), r"[^a-z]+"), F.array(*map(F.lit, ENGLISH)))) >= 2


def script(text: Column | str) -> Column:
    """The first script found, asked in a fixed order."""
    text = col(text)
    return (
        F.when(text.rlike("[\\u0600-\\u06FF]"), "arabic")
        .when(text.rlike("[\\u4E00-\\u9FFF]"), "han")
        .when(text.rlike("[\\u0400-\\u04FF]"), "cyrillic")
        .when(text.rlike("[\\u00C0-\\u024F]"), "latin_extended")
        .otherwise("latin")
    )


def djb2_20(text: Column | str) -> Column:
    """A 20-bit djb2 hash of the bytes as five hexadecimal digits."""
    bytes_ = F.transform(F.regexp_extract_all(F.hex(F.encode(col(text), "UTF-8")), F.lit("(..)")), lambda h: F.conv(h, 16, 10).cast("long"))
    value = F.aggregate(bytes_, F.lit(5381).cast("long"), lambda acc, b: (acc * 33 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(value.bitwiseAND(F.lit(0xFFFFF)))), 5, "0")


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)
