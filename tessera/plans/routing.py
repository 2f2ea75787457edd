"""Queries of path and prompt predicates, routes, addresses and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import predicates as P
from tessera.functions import prompts as T
from tessera.sources.tables import table
from tessera.sources.workspace import FILES_SQL, PROMPTS_SQL, files, prompts

PATH_RULES, PROMPT_RULES, ALLOWED = P.path_rules(), P.prompt_rules(), P.first_that_fits(P.seed_allowed())


def columns_sql(rules: dict[str, P.Rule], prefix: str = "") -> str:
    return ", ".join(f"{rule.sql} AS {prefix}{name}" for name, rule in rules.items())


def columns(rules: dict[str, P.Rule], prefix: str = "") -> list[Column]:
    return [rule.column.alias(f"{prefix}{name}") for name, rule in rules.items()]


@query(f"WITH {FILES_SQL} SELECT path_id, {columns_sql(PATH_RULES, 'is_')} FROM files")
def source_path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path_id", *columns(PATH_RULES, "is_"))


@query(f"WITH {PROMPTS_SQL} SELECT conv_id, turn, {columns_sql(PROMPT_RULES, 'asks_')} FROM prompts")
def prompt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("conv_id", "turn", *columns(PROMPT_RULES, "asks_"))


@query(f"WITH {FILES_SQL} SELECT path_id, {ALLOWED.sql} AS allowed FROM files")
def seed_path_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path_id", ALLOWED.column.alias("allowed"))


STYLED = f"CASE WHEN {PROMPT_RULES['style'].sql} AND NOT {PATH_RULES['style'].sql} AND {P.says('path', P.STYLE_NOISE).sql} THEN 28.0 ELSE 0.0 END"


@query(f"WITH {FILES_SQL} SELECT path_id, suffix(lower(path), '.scss') OR suffix(lower(path), '.sass') AS fits_scss, suffix(lower(path), '.less') AS fits_less, CAST({STYLED} AS DOUBLE) AS penalty FROM files")
def style_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = PROMPT_RULES["style"].column & ~PATH_RULES["style"].column & P.says("path", P.STYLE_NOISE).column
    return files(spark, sf_dir).select("path_id", P.ends("path", (".scss", ".sass")).column.alias("fits_scss"), P.ends("path", (".less",)).column.alias("fits_less"), F.when(noisy, 28.0).otherwise(0.0).alias("penalty"))


@query(f"WITH {FILES_SQL} SELECT prompt, CASE WHEN any_value({PROMPT_RULES['style'].sql}) THEN round(count(*) FILTER (WHERE {PATH_RULES['style'].sql}) / count(*), 6) END AS share FROM files GROUP BY prompt")
def style_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of style files among what a style prompt selected; null for other prompts."""
    share = F.round(F.count_if(PATH_RULES["style"].column) / F.count(F.lit(1)), 6)
    return files(spark, sf_dir).groupBy("prompt").agg(F.when(F.any_value(PROMPT_RULES["style"].column), share).alias("share"))


WORDS_SQL = "list_filter(list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+')), lambda w: length(w) >= 4)"


@query(f"WITH {FILES_SQL} SELECT path_id, coalesce(list_bool_or(list_transform({WORDS_SQL}, lambda w: {P.stem_sql('path')} = w OR contains(lower(path), w))), FALSE) AS focused FROM files")
def focus_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of four letters or more of the prompt is the file's stem or within its path."""
    return files(spark, sf_dir).select("path_id", T.focused("path", T.words("prompt")).alias("focused"))


HINT_SQL = "CASE path_id % 4 WHEN 0 THEN path WHEN 1 THEN string_split(path, '/')[-1] WHEN 2 THEN 'repo/' || path ELSE 'other/' || name END"


@query(f"WITH {FILES_SQL} SELECT path_id, suffix(path, hint) OR contains(path, hint) AS matches, suffix(path, hint) OR contains(path, hint) OR suffix(hint, path) AS matches_back FROM (SELECT *, {HINT_SQL} AS hint FROM files)")
def path_match_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, last = F.pmod("path_id", F.lit(4)), F.element_at(F.split("path", "/"), -1)
    hint = F.when(kind == 0, F.col("path")).when(kind == 1, last).when(kind == 2, F.concat(F.lit("repo/"), "path")).otherwise(F.concat(F.lit("other/"), "name"))
    forward = F.endswith("path", "hint") | F.contains("path", "hint")
    return files(spark, sf_dir).withColumn("hint", hint).select("path_id", forward.alias("matches"), (forward | F.endswith("hint", "path")).alias("matches_back"))


@query(f"WITH {FILES_SQL} SELECT path_id, CASE WHEN regexp_matches(path, '(?i)(^|/)apps/[^./][^/]*') THEN 'apps/' || regexp_extract(path, '(?i)(^|/)apps/([^./][^/]*)', 2) END AS app FROM files")
def app_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path_id", T.app_prefix("path").alias("app"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT path_id, lower(prompt || ' ' || CASE path_id % 3 WHEN 0 THEN name WHEN 1 THEN string_split(name, '_')[1] ELSE '' END) AS low, string_split(lower(string_split(path, '/')[-1]), '.')[1] AS stem FROM files),
p AS (SELECT *, list_filter(regexp_split_to_array(stem, '[-_]'), lambda x: length(x) >= 3) AS parts FROM s)
SELECT path_id, round(CASE WHEN length(stem) >= 3 AND contains(low, stem) THEN 1.0 WHEN len(parts) = 0 THEN 0.0 ELSE len(list_filter(parts, lambda x: contains(low, x))) / len(parts) END, 6) AS overlap FROM p""")
def path_stem_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a file's stem the prompt says; some prompts name the file, or a part of it."""
    kind = F.pmod("path_id", F.lit(3))
    more = F.when(kind == 0, F.col("name")).when(kind == 1, F.split("name", "_")[0]).otherwise("")
    return files(spark, sf_dir).withColumn("prompt", F.concat_ws(" ", "prompt", more)).select("path_id", F.round(T.stem_overlap("path", "prompt"), 6).alias("overlap"))


CLAIMS = ("no_confident_match", "no_seed_resolved", "partial", "likely_sufficient", "bounded", "no_recorded_gap", "other")
CLAIM_SQL = "([" + ", ".join(f"'{c}'" for c in CLAIMS) + f"])[CAST(event_id % {len(CLAIMS)} + 1 AS INT)]"


@query(f"""SELECT event_id, claim, CASE WHEN claim IN ('no_confident_match', 'no_seed_resolved') THEN 0.25 WHEN claim = 'partial' THEN 0.55
  WHEN claim IN ('likely_sufficient', 'bounded') THEN CASE WHEN s < 0.45 THEN 0.40 WHEN s < 0.65 THEN 0.70 ELSE 0.85 END
  WHEN claim = 'no_recorded_gap' THEN CASE WHEN s < 0.45 THEN 0.65 ELSE 0.95 END ELSE 0.70 END::DOUBLE AS hint FROM (SELECT event_id, {CLAIM_SQL} AS claim, event_id % 100 / 100.0 AS s FROM events)""")
def lexical_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.element_at(F.array(*map(F.lit, CLAIMS)), (F.pmod("event_id", F.lit(len(CLAIMS))) + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("claim", claim).select("event_id", "claim", T.confidence_hint(F.col("claim"), F.pmod("event_id", F.lit(100)) / 100.0).alias("hint"))


SOURCE = "'" + "|".join(T.SOURCE_ENDINGS) + "'"
RAW_URL = "CASE page_id % 5 WHEN 0 THEN url || '.' WHEN 1 THEN url || '/' WHEN 2 THEN 'https://github.com/acme/app' WHEN 3 THEN url || '/main.rs' ELSE url END"


@query(f"""WITH u AS (SELECT page_id, regexp_replace({RAW_URL}, '[.,)\\];!"'']+$', '') AS raw FROM pages WHERE url IS NOT NULL),
r AS (SELECT page_id, regexp_replace(regexp_extract(raw, '(?s)://(.*)$', 1), '(?s)[?#].*$', '') AS rest FROM u),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/]*)/', 1)) AS host, CASE WHEN contains(rest, '/') THEN substr(rest, position('/' IN rest)) ELSE '' END AS tail FROM r),
p AS (SELECT page_id, regexp_replace(host, '^www\\.', '') AS host, CASE WHEN length(tail) > 1 THEN rtrim(tail, '/') ELSE tail END AS path FROM h)
SELECT page_id, CASE WHEN path IN ('', '/') OR (host IN ('github.com', 'gitlab.com', 'bitbucket.org') AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) = 2) OR contains(path, '\\')
  OR regexp_matches(lower(path), '\\.(' || {SOURCE} || ')$') THEN NULL ELSE path END AS route FROM p""")
def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("page_id", F.lit(5))
    raw = F.when(kind == 0, F.concat("url", F.lit("."))).when(kind == 1, F.concat("url", F.lit("/"))).when(kind == 2, "https://github.com/acme/app").when(kind == 3, F.concat("url", F.lit("/main.rs"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", T.route_of_url(raw).alias("route"))


ASKED = "CASE path_id % 5 WHEN 0 THEN 'POST /' || name WHEN 1 THEN '/' || name || '.rs' WHEN 2 THEN 'get  /api/' || name WHEN 3 THEN path ELSE '/' || name END"


@query(f"""WITH {FILES_SQL}, q AS (SELECT path_id, trim({ASKED}) AS q FROM files), m AS (SELECT path_id, q, regexp_extract(q, '(?i)^({'|'.join(T.ROUTE_METHODS)}) (.*)$', 2) AS rest FROM q),
r AS (SELECT path_id, CASE WHEN trim(rest) <> '' THEN trim(rest) END AS rest, q FROM m), h AS (SELECT path_id, rest, coalesce(rest, q) AS path FROM r),
k AS (SELECT path_id, rest, starts_with(path, '/') AND NOT regexp_matches(lower(path), '\\.(' || {SOURCE} || ')$') AS is_route FROM h)
SELECT path_id, is_route, CASE WHEN is_route THEN rest END AS alias FROM k""")
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("path_id", F.lit(5))
    asked = (
        F.when(kind == 0, F.concat(F.lit("POST /"), "name")).when(kind == 1, F.concat(F.lit("/"), "name", F.lit(".rs"))).when(kind == 2, F.concat(F.lit("get  /api/"), "name"))
        .when(kind == 3, F.col("path")).otherwise(F.concat(F.lit("/"), "name"))
    )
    return files(spark, sf_dir).withColumn("q", asked).select("path_id", T.is_route_query("q").alias("is_route"), T.route_alias("q").alias("alias"))


URI_SQL = "CASE path_id % 6 WHEN 0 THEN 'file:///' || path WHEN 1 THEN 'FILE://localhost/' || replace(path, '_', '%20') WHEN 2 THEN 'file:' || path WHEN 3 THEN ' null ' WHEN 4 THEN 'file://localhost' ELSE '  ' || path || '+x ' END"


@query(f"""WITH {FILES_SQL}, u AS (SELECT path_id, trim({URI_SQL}) AS raw FROM files), s AS (SELECT path_id, raw, starts_with(lower(raw), 'file:') AS is_uri, substr(raw, 6) AS rest FROM u),
e AS (SELECT path_id, raw, is_uri, CASE WHEN NOT starts_with(rest, '//') THEN rest WHEN contains(substr(rest, 3), '/') THEN substr(substr(rest, 3), position('/' IN substr(rest, 3))) WHEN lower(substr(rest, 3)) = 'localhost' THEN '' ELSE substr(rest, 3) END AS enc FROM s)
SELECT path_id, CASE WHEN raw = '' OR lower(raw) = 'null' THEN NULL WHEN NOT is_uri THEN raw WHEN enc = '' THEN NULL ELSE replace(enc, '%20', ' ') END AS workspace FROM e""")
def workspace_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, path = F.pmod("path_id", F.lit(6)), F.col("path")
    raw = (
        F.when(kind == 0, F.concat(F.lit("file:///"), path)).when(kind == 1, F.concat(F.lit("FILE://localhost/"), F.replace(path, F.lit("_"), F.lit("%20")))).when(kind == 2, F.concat(F.lit("file:"), path))
        .when(kind == 3, " null ").when(kind == 4, "file://localhost").otherwise(F.concat(F.lit("  "), path, F.lit("+x ")))
    )
    return files(spark, sf_dir).withColumn("raw", raw).select("path_id", T.workspace_of_uri("raw").alias("workspace"))


DIRTY_SQL = "chr(65279) || '  ' || replace(prompt, ' ', CASE turn % 3 WHEN 0 THEN chr(8204) WHEN 1 THEN '  ' ELSE ' ' || chr(8206) END) || chr(1603) || chr(1610) || ' '"
CLEAN_SQL = "regexp_replace(replace(replace(translate(replace(dirty, chr(8204), ' '), chr(8205) || chr(8206) || chr(8207) || chr(65279), ''), chr(1603), chr(1705)), chr(1610), chr(1740)), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {PROMPTS_SQL}, d AS (SELECT conv_id, turn, {DIRTY_SQL} AS dirty FROM prompts) SELECT conv_id, turn, {CLEAN_SQL} AS clean, trim(regexp_replace({CLEAN_SQL}, '\\s+', ' ', 'g')) AS keyword FROM d")
def prompts_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("turn", F.lit(3))
    gap = F.when(kind == 0, "\u200c").when(kind == 1, "  ").otherwise(" \u200e")
    dirty = F.concat(F.lit("\ufeff  "), F.replace("prompt", F.lit(" "), gap), F.lit("\u0643\u064a "))
    clean = T.normalized(dirty)
    return prompts(spark, sf_dir).select("conv_id", "turn", clean.alias("clean"), T.as_keyword(clean).alias("keyword"))


@query(f"WITH {PROMPTS_SQL} SELECT conv_id, turn, {P.says('prompt', T.CAREFUL_WORDS).sql} AS conservative FROM prompts")
def conservative_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select("conv_id", "turn", P.says("prompt", T.CAREFUL_WORDS).column.alias("conservative"))
