"""Queries of text and path scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.sources.tables import table
from tessera.sources.workspace import FILES_SQL, files

SPACE = "\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
PUNCT = "!-/:-@\\[-`{-~"
COUNT = f"""greatest(len(regexp_extract_all(text, '[^{SPACE}{PUNCT}]+')) + len(regexp_extract_all(text, '[{PUNCT}]')) + length(text) - length(replace(text, chr(10), '')), CAST(ceil(strlen(text) / 4.0) AS BIGINT))"""
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
PART = "replace(p_name, ' ', '_')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, CAST({COUNT} AS BIGINT) AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.token_count("text").alias("tokens"))


@query(f"WITH c AS (SELECT conv_id, turn, CAST({COUNT} AS BIGINT) AS n FROM conversations) SELECT b.conv_id, b.turn, b.n - a.n AS diff FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def token_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn less those of the turn before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_count("text").alias("n"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("n").alias("was"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("n") - F.col("was")).alias("diff"))


@query("""SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-/\\\\.:]+'), lambda t: length(t) > 1), ',') AS tokens
FROM (SELECT p_partkey, p_name || 'HTTPServer.get' || p_brand || '/x' AS x FROM part)""")
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("HTTPServer.get"), "p_brand", F.lit("/x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.identifier_tokens(name), ",").alias("tokens"))


@query(f"SELECT p_partkey, round(CASE WHEN lower({PART}) = 'widget' THEN 1.0 WHEN NOT contains(lower({PART}), 'widget') THEN 0.0 ELSE greatest(0.12, least(1.0, sqrt(6.0 / strlen({PART})))) END, 6) AS specificity FROM part")
def name_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.specificity(F.lit("widget"), F.replace("p_name", F.lit(" "), F.lit("_"))), 6).alias("specificity"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT word, array_to_string(list_distinct_ordered, ',') AS variants FROM (SELECT word, list_filter([word,
  CASE WHEN word LIKE '%ing' AND length(word) >= 6 THEN left(word, length(word) - 3) END, CASE WHEN word LIKE '%ing' AND length(word) >= 6 THEN left(word, length(word) - 3) || 'e' END,
  CASE WHEN word LIKE '%ation' AND length(word) >= 8 THEN left(word, length(word) - 5) END, CASE WHEN word LIKE '%ation' AND length(word) >= 8 THEN left(word, length(word) - 5) || 'ate' END,
  CASE WHEN word LIKE '%tion' AND length(word) >= 7 THEN left(word, length(word) - 4) || 't' END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM w)""")
def stem_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).distinct()
    return words.select("word", F.array_join(T.stem_variants("word"), ",").alias("variants"))



@query("SELECT n_nationkey, 'get_' || regexp_replace(lower(n_name), '[^a-z]', '', 'g') || '_by' AS snake FROM nation")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace(F.lower("n_name"), "[^a-z]", "")
    camel = F.concat(F.lit("get"), F.initcap(plain), F.lit("By"))
    return table(spark, sf_dir, "nation").select("n_nationkey", T.snake_case(camel).alias("snake"))


@query(f"""SELECT p_partkey, split_part({PART}, '_', 1) || array_to_string(list_transform(string_split({PART}, '_')[2:], lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS camel,
array_to_string(list_transform(string_split({PART}, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS pascal FROM part""")
def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", T.camel_case(name).alias("camel"), T.pascal_case(name).alias("pascal"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'arabic' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'han' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'cyrillic' WHEN regexp_matches(text, '[\\x{00C0}-\\x{024F}]') THEN 'latin_extended' ELSE 'latin' END AS script FROM documents""")
def script_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.script("text").alias("script"))


@query("""SELECT doc_id, len(list_intersect(list_distinct(string_split_regex(lower(text), '[^a-z]+')), ['the', 'and', 'for', 'with', 'that', 'this', 'from', 'are', 'was', 'not'])) >= 2 AS english FROM documents""")
def english_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.english_likeness("text").alias("english"))


LANGS = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for n, ends in P.LANGUAGES.items() for e in ends) + " END"


@query(f"SELECT page_id, {LANGS} AS language FROM (SELECT page_id, {PATH} AS path FROM pages)")
def language_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.language(T.url_path("url")).alias("language"))


@query(f"""WITH {FILES_SQL}, p AS (SELECT 'page:' || page_id AS path_id, {PATH} AS path FROM pages UNION ALL SELECT 'part:' || path_id, path FROM files)
SELECT path_id, list_has_any(s, ['node_modules', 'target', 'dist', 'build', 'vendor', 'benches', 'examples', 'testdata', '.git', '.cargo', 'pods']) AS ignored, list_has_any(s, ['test', 'tests']) AS test_like, CAST(len(s) AS INT) AS depth
FROM (SELECT path_id, string_split(lower(path), '/') AS s FROM p)""")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths of pages and of a workspace's files; its folders have some of the ignored names."""
    web = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), "page_id").alias("path_id"), T.url_path("url").alias("path"))
    paths = web.unionByName(files(spark, sf_dir).select(F.concat(F.lit("part:"), "path_id").alias("path_id"), "path"))
    return paths.select("path_id", P.ignored("path").alias("ignored"), P.test_like("path").alias("test_like"), F.size(P.segments("path")).alias("depth"))


@query(f"""SELECT page_id, CASE WHEN x LIKE 'apps/%' THEN split_part(x, '/', 2) ELSE split_part(x, '/', 1) END AS slug, CASE WHEN x LIKE 'apps/%' THEN 'apps/' || split_part(x, '/', 2) END AS app
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'apps/' ELSE '' END || ltrim({PATH}, '/') AS x FROM pages)""")
def package_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "apps/").otherwise(""), F.ltrim(T.url_path("url"), F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("x")).select("page_id", P.package_slug("x").alias("slug"), P.app_prefix("x").alias("app"))


@query(f"""SELECT page_id, contains(f, 'en/1') OR contains(f, '1') AND length('1') > 2 AS hit FROM (SELECT page_id, lower(replace({PATH}, '-', '_')) AS f FROM pages)""")
def path_hint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.hint_match(T.url_path("url"), F.lit("en/1")).alias("hit"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents) SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY hash HAVING count(*) > 1""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""WITH known AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'), now AS (SELECT doc_id, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE source <> 'src3')
SELECT coalesce(now.doc_id, known.doc_id) AS doc_id, CASE WHEN known.doc_id IS NULL THEN 'created' WHEN now.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM now FULL JOIN known USING (doc_id) WHERE now.n_chars IS DISTINCT FROM known.n_chars""")
def incremental_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints known before against those now: what was created (French), modified (German) or deleted (one source)."""
    known = docs(spark, sf_dir).filter("lang <> 'fr'").select("doc_id", F.col("n_chars").alias("was"))
    now = docs(spark, sf_dir).filter("source <> 'src3'").select("doc_id", F.when(F.col("lang") == "de", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("is"))
    both = now.join(known, "doc_id", "full").filter(~F.col("is").eqNullSafe(F.col("was")))
    return both.select("doc_id", F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").otherwise("modified").alias("change"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars < 60)")
def prune_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose path isn't present any more."""
    present = docs(spark, sf_dir).filter("n_chars < 60").select("source").distinct()
    return docs(spark, sf_dir).join(present, "source", "left_anti").select("doc_id")


@query("SELECT source, count(*) AS n_foreign FROM documents WHERE substr(sha256(lang), 1, 16) <> substr(sha256('en'), 1, 16) GROUP BY source")
def foreign_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another project than the current one; a project's id is the first 16 digits of its root's hash."""
    project = F.substring(F.sha2("lang", 256), 1, 16)
    return docs(spark, sf_dir).filter(project != F.substring(F.sha2(F.lit("en"), 256), 1, 16)).groupBy("source").agg(F.count(F.lit(1)).alias("n_foreign"))


@query(f"""SELECT page_id, lpad(lower(hex(list_reduce(list_concat([5381::BIGINT], list_transform(regexp_extract_all(hex(encode({PATH})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: (a * 33 + b) & 4294967295) & 1048575)), 5, '0') AS fold_id FROM pages""")
def fold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold's short id: 20 bits of a hash of its path and lines."""
    return table(spark, sf_dir, "pages").select("page_id", T.djb2_20(T.url_path("url")).alias("fold_id"))


@query(f"""SELECT page_id, CASE WHEN regexp_matches(x, '(^|/)(src|lib|app)/') THEN regexp_extract(x, '^(.*?)/?(src|lib|app)/', 1) ELSE split_part(x, '/', 1) END AS dir FROM (SELECT page_id, 'crates/c' || (page_id % 3) || '/src' || {PATH} AS x FROM pages)""")
def crate_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies before the sources' folder, for spreading a selection."""
    x = F.concat(F.lit("crates/c"), (F.col("page_id") % 3).cast("string"), F.lit("/src"), T.url_path("url"))
    return table(spark, sf_dir, "pages").select("page_id", P.crate_dir(x).alias("dir"))
