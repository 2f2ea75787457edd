"""Scalars over prompts, routes and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.predicates import stem
from tessera.functions.text import SPACE, col

# Fixed values.
ROUTE_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ANY", "MATCH", "API-RESOURCE", "RESOURCE", "COLLECTION")
SOURCE_ENDINGS = (
    "rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "vue", "go", "java", "cs", "kt", "kts", "dart", "rb", "php", "astro", "svelte", "twig", "cshtml", "razor", "swift", "css", "scss", "sass", "less",
    "html", "htm", "svg", "sql", "json", "jsonc", "toml", "md",
)
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
CAREFUL_WORDS = ("auth", "security", "payment", "migration", "secret", "credential")


def words(prompt: Column | str, least: int = 4) -> Column:
    """Distinct lower-cased words of so many letters or more."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(col(prompt)), F.lit("([a-z0-9]+)"))), lambda w: F.length(w) >= least)


def focused(path: str, terms: Column) -> Column:
    """A term is the file's stem or within its path."""
    return F.exists(terms, lambda w: (w == stem(path)) | F.contains(F.lower(col(path)), w))


def app_prefix(path: Column | str) -> Column:
    """`apps/<name>` of an app's file, else null; a hidden folder is no app."""
    rule = r"(?i)(^|/)apps/([^./][^/]*)"
    return F.when(col(path).rlike(rule), F.concat(F.lit("apps/"), F.regexp_extract(col(path), rule, 2)))


def stem_overlap(path: Column | str, prompt: Column | str) -> Column:
    """1 if the prompt says the file's stem, else the share of its parts of three letters or more that it says."""
    name = F.split(F.lower(F.element_at(F.split(col(path), "/"), -1)), r"\.")[0]
    low = F.lower(col(prompt))
    parts = F.filter(F.split(name, "[-_]"), lambda p: F.length(p) >= 3)
    share = F.size(F.filter(parts, lambda p: F.contains(low, p))) / F.size(parts)
    return F.when((F.length(name) >= 3) & F.contains(low, name), 1.0).when(F.size(parts) == 0, 0.0).otherwise(share)


def confidence_hint(claim: Column, sufficiency: Column) -> Column:
    """How far a claim is to be trusted: one of a coincidental hit isn't."""
    low, middle = sufficiency < 0.45, sufficiency < 0.65
    return (
        F.when(claim.isin("no_confident_match", "no_seed_resolved"), 0.25).when(claim == "partial", 0.55)
        .when(claim.isin("likely_sufficient", "bounded"), F.when(low, 0.40).when(middle, 0.70).otherwise(0.85))
        .when(claim == "no_recorded_gap", F.when(low, 0.65).otherwise(0.95)).otherwise(0.70)
    )


def is_http_path(path: Column) -> Column:
    """Begins with a slash and isn't a source file's path."""
    return path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.lower(path).rlike(r"\.(" + "|".join(SOURCE_ENDINGS) + ")$")


def after_method(query: Column | str) -> Column:
    """What follows an HTTP method in `POST /sms`, or null."""
    rest = F.trim(F.regexp_extract(F.trim(col(query)), "(?i)^(?:" + "|".join(ROUTE_METHODS) + ") (.*)$", 1))
    return F.when(rest != "", rest)


def is_route_query(query: Column | str) -> Column:
    return is_http_path(F.coalesce(after_method(query), F.trim(col(query))))


def route_alias(query: Column | str) -> Column:
    """The path alone of a route with a method."""
    path = after_method(query)
    return F.when(is_http_path(path), path)


def route_of_url(url: Column | str) -> Column:
    """The route that a URL in a text stands for: no host, query, fragment or closing slash; no repository pages or source files."""
    raw = F.regexp_replace(col(url), r"""[.,)\];!"']+$""", "")
    rest = F.regexp_replace(F.regexp_extract(raw, "(?s)://(.*)$", 1), "(?s)[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/]*)/", 1)), r"^www\.", "")
    tail = F.regexp_extract(rest, "(?s)^[^/]*(/.*)$", 1)
    path = F.when(F.length(tail) > 1, F.regexp_replace(tail, "/+$", "")).otherwise(tail)
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    return F.when((path != "") & (path != "/") & ~(host.isin(*GIT_HOSTS) & (segments == 2)) & is_http_path(path), path)


def workspace_of_uri(raw: Column | str) -> Column:
    """The path of a `file:` address, percent signs decoded, or of a plain path; null for nothing."""
    raw = F.trim(col(raw))
    rest = F.substring(raw, F.lit(6), F.length(raw))
    after = F.substring(rest, F.lit(3), F.length(rest))
    encoded = (
        F.when(~rest.startswith("//"), rest).when(F.contains(after, F.lit("/")), F.regexp_extract(after, "(?s)(/.*)$", 1))
        .when(F.lower(after) != "localhost", after)
    )
    decoded = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    path = F.when(F.lower(raw).startswith("file:"), F.coalesce(decoded, encoded)).otherwise(raw)
    return F.when((raw != "") & (F.lower(raw) != "null") & (path != ""), path)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no function for it. Plain ASCII is left as it is."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalized(text: Column | str) -> Column:
    """Compatibility-composed, without joiners, marks and byte orders, Arabic kaf and yeh as in Persian, trimmed."""
    plain = F.translate(nfkc(col(text)), "\u200c\u0643\u064a\u200d\u200e\u200f\ufeff", " \u06a9\u06cc")
    return F.regexp_replace(plain, f"^[{SPACE}]+|[{SPACE}]+$", "")


def as_keyword(clean: Column) -> Column:
    """Normalised, with single blanks."""
    return F.regexp_replace(clean, f"[{SPACE}]+", " ")


def prompt_tokens(clean: Column) -> Column:
    """Blank-separated tokens without punctuation at their edges, but for _ . / and :"""
    edge = r"[^\p{L}\p{N}_./:]+"
    return F.filter(F.transform(F.split(clean, f"[{SPACE}]+"), lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", "")), lambda t: t != "")
