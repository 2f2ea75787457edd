"""Search and resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions.paths import package_slug
from tessera.functions.text import url_path
from tessera.operators import search as S
from tessera.sources.tables import NODES_SQL, nodes, table

QUERIES = ("cold_widget", "red", "widget", "supplier#000000001", "customer", "france", "m3", "bolt")
SPEC = "CASE WHEN low = lower(name) THEN 1.0 WHEN NOT contains(lower(name), low) THEN 0.0 ELSE greatest(0.12, least(1.0, sqrt(strlen(low) / strlen(name)))) END"
LEARN = "greatest(0.0, 5 * ln(1 + access_count) + 10 * greatest(base_relevance - 1, 0.0) - 12 * greatest(1 - base_relevance, 0.0))"
STEM = "regexp_replace(list_last(string_split(file_path, '/')), '\\.[^.]*$', '')"
TESTS = "len(list_filter(string_split(lower(file_path), '/'), lambda s: s IN ('test', 'tests'))) > 0"
BONUS = f"""(CASE WHEN node_type IN ('Class', 'Component', 'Api') THEN 8.0 WHEN node_type = 'Function' THEN 4.0 ELSE 0.0 END
  + CASE WHEN lower(name) = low THEN 16.0 ELSE 0.0 END + 10 * {SPEC}
  + CASE WHEN list_contains(string_split(lower(file_path), '/'), low) THEN 12.0 ELSE 0.0 END
  + CASE WHEN lower({STEM}) = low THEN 30.0 ELSE 0.0 END + CASE WHEN {TESTS} THEN -24.0 ELSE 0.0 END + {LEARN})"""


def search_sql(queries: tuple[str, ...], limit: int) -> str:
    listed = ", ".join(f"('{q}')" for q in queries)
    return f"""WITH {NODES_SQL}, asked AS (SELECT q, lower(q) AS low FROM (VALUES {listed}) AS t(q)),
tokened AS (SELECT *, string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_\\-/\\\\.:]+') AS tokens FROM nodes),
found AS (SELECT t.*, q, low, lower(name) = low AS is_exact, list_contains(tokens, low) AND length(low) > 1 AS has_token FROM tokened t JOIN asked ON contains(lower(name), low) OR list_contains(tokens, low) OR contains(lower(file_path), low)),
marked AS (SELECT *, bool_or(is_exact) OVER (PARTITION BY q) AS any_exact, bool_or(is_exact AND node_type IN ('Class', 'Component', 'Api')) OVER (PARTITION BY q) AS class_exact FROM found),
ranked AS (SELECT *, CASE WHEN is_exact THEN 1 WHEN starts_with(lower(name), low) THEN 2 WHEN contains(lower(name), low) AND NOT any_exact THEN 3 WHEN has_token AND NOT class_exact THEN 4 WHEN contains(lower(file_path), low) THEN 5 END AS priority FROM marked),
scored AS (SELECT *, round(CASE priority WHEN 1 THEN CASE WHEN node_type IN ('Class', 'Component', 'Api') THEN 240.0 ELSE 120.0 END WHEN 2 THEN 80 + 12 * {SPEC} WHEN 3 THEN 48 + 28 * {SPEC} WHEN 4 THEN 74.0 ELSE 70.0 END + {BONUS}, 6) AS score,
  ['exact', 'prefix', 'substring', 'token', 'path'][priority] AS reason,
  coalesce(list_position(['Class', 'Component', 'Api', 'Function', 'Symbol', 'File', 'Config'], node_type), 8) AS kind FROM ranked WHERE priority IS NOT NULL)
SELECT q, place, id, name, reason, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY is_exact DESC, kind, score DESC, length(name), id) AS INT) AS place FROM scored) WHERE place <= {limit}"""


def asked(spark: SparkSession, *queries: str) -> DataFrame:
    return spark.createDataFrame([(q,) for q in queries], "q string")


@query(search_sql(("cold_widget",), 20))
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(nodes(spark, sf_dir), asked(spark, "cold_widget"), 20)


@query(search_sql(QUERIES, 10))
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(nodes(spark, sf_dir), asked(spark, *QUERIES), 10)


@query(f"""WITH {NODES_SQL}, refs AS (SELECT 'r' || c_custkey AS ref, upper(c_name) AS name FROM customer UNION ALL SELECT 'p' || p_partkey, replace(p_name, ' ', '_') FROM part),
named AS (SELECT lower(name) AS k, count(*) AS n, min(id) AS id FROM nodes GROUP BY 1 HAVING count(*) = 1) SELECT ref, id FROM refs JOIN named ON lower(refs.name) = k""")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("ref"), F.upper("c_name").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.replace("p_name", F.lit(" "), F.lit("_")))
    return S.resolve_unique(people.union(parts), nodes(spark, sf_dir))


@query(f"""WITH {NODES_SQL}, t AS (SELECT *, regexp_extract(file_path, 'crates/([^/]+)', 1) AS package FROM nodes WHERE node_type = 'Symbol'),
j AS (SELECT r.id AS ref, t.id, r.file_path = t.file_path AS f, r.package = t.package AS p FROM t r JOIN t ON lower(r.name) = lower(t.name)),
g AS (SELECT ref, CASE WHEN count(*) FILTER (WHERE f) = 1 THEN min(id) FILTER (WHERE f) END AS a, CASE WHEN count(*) FILTER (WHERE p) = 1 THEN min(id) FILTER (WHERE p) END AS b, CASE WHEN count(*) = 1 THEN min(id) END AS c FROM j GROUP BY ref)
SELECT ref, coalesce(a, b, c) AS id, CASE WHEN a IS NOT NULL THEN 'file' WHEN b IS NOT NULL THEN 'package' ELSE 'global' END AS scope FROM g WHERE coalesce(a, b, c) IS NOT NULL""")
def resolve_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = nodes(spark, sf_dir).filter("node_type = 'Symbol'").withColumn("package", package_slug("file_path"))
    return S.resolve_scoped(symbols.select(F.col("id").alias("ref"), "name", "file_path", "package"), symbols)


DEGREE_SQL = "degrees AS (SELECT 'part:' || l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1)"


@query(f"""WITH {NODES_SQL}, {DEGREE_SQL}, c AS (SELECT name AS ref, n.id, token_cost * 0.1 + 4 * coalesce(degree, 0) AS score FROM nodes n LEFT JOIN degrees d USING (id) WHERE node_type = 'Symbol'),
l AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, id) AS place, lead(score) OVER (PARTITION BY ref ORDER BY score DESC, id) AS nxt FROM c)
SELECT ref, id, round(score, 6) AS score, CASE WHEN nxt IS NULL OR score - nxt >= 8 THEN 'proven' ELSE 'likely' END AS confidence FROM l WHERE place = 1""")
def resolve_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    symbols = nodes(spark, sf_dir).filter("node_type = 'Symbol'").join(degree, "id", "left")
    scored = symbols.select(F.col("name").alias("ref"), "id", (F.col("token_cost") * 0.1 + 4 * F.coalesce("degree", F.lit(0))).alias("score"))
    return S.resolve_dominant(scored)


@query(f"""WITH {NODES_SQL}, refs AS (SELECT DISTINCT split_part(file_path, '/', 2) || '/src/' || split_part(file_path, '/', 4) AS hint FROM nodes UNION SELECT split_part(file_path, '/', 4) FROM nodes),
files AS (SELECT DISTINCT file_path AS path FROM nodes)
SELECT hint AS ref, min(path) AS path FROM refs JOIN files ON path = hint OR path LIKE '%/' || hint WHERE hint <> '' GROUP BY hint HAVING count(*) = 1""")
def resolve_file_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = nodes(spark, sf_dir).select(F.col("file_path").alias("path")).distinct()
    parts = F.split("path", "/")
    refs = files.select(F.concat(parts[1], F.lit("/src/"), F.get(parts, F.lit(3))).alias("hint")).union(files.select(F.get(parts, F.lit(3)))).filter("hint <> ''").distinct()
    return S.resolve_hint(refs.select(F.col("hint").alias("ref"), "hint"), files)


LINKS_SQL = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"', 1)) AS href FROM pages)"""
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH {LINKS_SQL}, known AS (SELECT lower(split_part({PATH}, '/', 2)) AS k, min(page_id) AS page, count(*) AS n FROM pages GROUP BY 1)
SELECT l.page_id, count(*) AS links, count(*) FILTER (WHERE k IS NOT NULL AND n = 1) AS proven, count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS likely, count(*) FILTER (WHERE k IS NULL) AS unresolved
FROM links l LEFT JOIN known ON lower(ltrim(l.href, '/')) = k GROUP BY l.page_id""")
def import_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages against the first path segment of known pages: one match is proven, more are likely, none is unresolved."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]* href="([^"]*)"'))).alias("href"))
    known = pages.groupBy(F.lower(F.split_part(url_path("url"), F.lit("/"), F.lit(2))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = links.join(known, F.lower(F.ltrim("href", F.lit("/"))) == F.col("k"), "left")
    return joined.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("n") == 1).alias("proven"), F.count_if(F.col("n") > 1).alias("likely"), F.count_if(F.col("n").isNull()).alias("unresolved"))


@query(f"""WITH {LINKS_SQL}, known AS (SELECT DISTINCT lower(split_part({PATH}, '/', 2)) AS k FROM pages) SELECT href, count(*) AS n FROM links WHERE lower(ltrim(href, '/')) NOT IN (SELECT k FROM known) GROUP BY href""")
def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('<a[^>]* href="([^"]*)"'))).alias("href"))
    known = pages.select(F.lower(F.split_part(url_path("url"), F.lit("/"), F.lit(2))).alias("k")).distinct()
    return links.join(known, F.lower(F.ltrim("href", F.lit("/"))) == F.col("k"), "left_anti").groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH files AS (SELECT DISTINCT ltrim({PATH}, '/') AS path FROM pages), m AS (SELECT '' AS dir, 'Cargo.toml' AS manifest UNION ALL VALUES ('en', 'package.json'), ('de', 'composer.json'), ('de', 'package.json'))
SELECT path, dir, manifest FROM (SELECT path, dir, manifest, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END DESC, manifest) AS k FROM files JOIN m ON dir = '' OR starts_with(path, dir || '/')) WHERE k = 1""")
def nearest_ancestor_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.ltrim(url_path("url"), F.lit("/")).alias("path")).distinct()
    manifests = spark.createDataFrame([("", "Cargo.toml"), ("en", "package.json"), ("de", "composer.json"), ("de", "package.json")], "dir string, manifest string")
    return S.nearest_manifest(files, manifests)


@query("""WITH spans AS (SELECT l_orderkey AS f, l_linenumber AS id, CAST(l_linenumber * 10 - l_quantity AS BIGINT) AS a, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS b FROM lineitem),
points AS (SELECT o_orderkey AS f, CAST(20 + o_custkey % 30 AS BIGINT) AS pos FROM orders)
SELECT f, pos, id FROM (SELECT p.f, pos, id, row_number() OVER (PARTITION BY p.f ORDER BY b - a, a, id) AS k FROM points p JOIN spans s ON s.f = p.f AND a <= pos AND pos < b) WHERE k = 1""")
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest span of a file that holds a position: an equality join on the file bounds the interval join."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 10 - F.col("l_quantity")).cast("long").alias("a"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("b"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f"), (20 + F.col("o_custkey") % 30).cast("long").alias("pos"))
    inside = points.join(spans, "f").filter("a <= pos AND pos < b")
    order = W.partitionBy("f").orderBy(F.col("b") - F.col("a"), "a", "id")
    return inside.withColumn("k", F.row_number().over(order)).filter("k = 1").select("f", "pos", "id")


@query(f"""WITH {NODES_SQL}, j AS (SELECT p.p_partkey AS ref, n.id FROM part p JOIN nodes n ON n.name = replace(p.p_name, ' ', '_') AND contains(n.file_path, 'm' || (p.p_size % 10)) WHERE n.node_type = 'Symbol')
SELECT ref, min(id) AS id, CASE WHEN count(*) = 1 THEN 'proven' ELSE 'likely' END AS confidence FROM j GROUP BY ref""")
def resolve_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported name with a path hint: one match is proven, of more the first is likely."""
    symbols = nodes(spark, sf_dir).filter("node_type = 'Symbol'").select("name", "id", "file_path")
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat(F.lit("m"), (F.col("p_size") % 10).cast("string")).alias("hint"))
    return S.resolve_export(refs, symbols)


@query(f"""WITH folds AS (SELECT sha256(url) AS id, split_part({PATH}, '/', 2) AS symbol, page_id FROM pages), asked AS (SELECT DISTINCT lower(split_part({PATH}, '/', 2)) AS q FROM pages UNION SELECT substr(sha256(url), 1, 6) FROM pages),
f AS (SELECT q, page_id, CASE WHEN id = q THEN 1 WHEN left(id, 6) = q THEN 2 ELSE 3 END AS p FROM asked JOIN folds ON id = q OR left(id, 6) = q OR lower(symbol) = q WHERE q <> '')
SELECT q, page_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p, page_id) AS k FROM f) WHERE k = 1""")
def fold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold by its id, else by the id's first six digits, else by its symbol: each is an equality join."""
    symbol = F.split_part(url_path("url"), F.lit("/"), F.lit(2))
    folds = table(spark, sf_dir, "pages").select(F.sha2("url", 256).alias("id"), symbol.alias("symbol"), "page_id")
    asked = folds.select(F.lower("symbol").alias("q")).union(folds.select(F.substring("id", 1, 6))).filter("q <> ''").distinct()
    keys = [folds.select(F.col("id").alias("q"), "page_id", F.lit(1).alias("p")), folds.select(F.substring("id", 1, 6).alias("q"), "page_id", F.lit(2).alias("p")), folds.select(F.lower("symbol").alias("q"), "page_id", F.lit(3).alias("p"))]
    found = asked.join(keys[0].union(keys[1]).union(keys[2]), "q")
    return found.groupBy("q").agg(F.min_by("page_id", F.struct("p", "page_id")).alias("page_id"))
