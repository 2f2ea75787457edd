"""Queries of reinforcement, learning by file, caches, passages, manifests and call resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import memory as M
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from tessera.sources.workspace import FILES_SQL, PROMPTS_SQL, SYMBOLS_SQL, chosen, files, listed, prompts, symbols

LEARN = "greatest(0.0, 5 * ln(1 + access_count) + 10 * greatest(base_relevance - 1, 0.0) - 12 * greatest(1 - base_relevance, 0.0))"
MOVES_SQL = """moves AS (SELECT * FROM (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b, ts, event_id FROM events) WHERE a IS NOT NULL)"""


@query(f"""WITH {MOVES_SQL}, e AS (SELECT a || '->' || b AS id, list(CASE WHEN b = 'error' THEN 2.0 ELSE 1.0 END::DOUBLE ORDER BY ts, event_id) AS kinds FROM moves WHERE a <> b GROUP BY 1)
SELECT id, round(list_reduce(list_concat([0.5::DOUBLE], kinds), lambda x, y: greatest(0.05, least(1.0, CASE WHEN y = 1 THEN x + 0.15 ELSE x - 0.10 END))), 6) AS weight FROM e""")
def reinforce_path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' ways from event to event reinforce the edges between kinds of events; a step to an error penalises."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.lag("event_type").over(order).alias("source"), F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    ways = kinds.select(F.col("event_type").alias("source")).join(kinds.select(F.col("event_type").alias("target")), F.col("source") != F.col("target"))  # a handful of kinds
    return M.reinforce_path(ways.withColumn("id", F.concat_ws("->", "source", "target")), steps.filter("source IS NOT NULL"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, t AS (SELECT id FROM nodes WHERE access_count >= 3)
SELECT id, round(greatest(0.05, least(1.0, weight + 0.15)) + 1e-9, 6) AS weight FROM edges WHERE edge_type IN ('Calls', 'Imports', 'References', 'UsedBy') AND (source IN (SELECT id FROM t) OR target IN (SELECT id FROM t))""")
def reinforce_callee_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reinforce_around(edges(spark, sf_dir), nodes(spark, sf_dir).filter("access_count >= 3"))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, v AS (SELECT source AS id, target AS neighbour, id AS edge_id, edge_type, weight FROM edges UNION ALL SELECT target, source, id, edge_type, weight FROM edges),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY edge_id, neighbour) AS INT) AS place FROM v)
SELECT n.id, access_count, base_relevance, round({LEARN}, 6) AS bonus, place, neighbour, edge_type, round(weight + 1e-9, 6) AS weight FROM nodes n LEFT JOIN r ON r.id = n.id AND place <= 12""")
def node_learning_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.learning_profile(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT file_path, round(max({LEARN}), 6) AS boost, round(min(base_relevance), 6) AS least_relevance FROM nodes GROUP BY file_path")
def file_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.file_learning(nodes(spark, sf_dir))


@query(f"WITH {NODES_SQL} SELECT file_path, round(max({LEARN}), 6) AS boost FROM nodes GROUP BY file_path HAVING round(max({LEARN}), 6) >= 2 ORDER BY boost DESC, file_path LIMIT 12")
def high_learning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.high_learning(nodes(spark, sf_dir), 2.0, 12)


ASKED = ("brass", "economy", "Brand#1", "polished", "zinc", "er")


@query("SELECT w.word, p_partkey AS id FROM part JOIN (VALUES " + ", ".join(f"('{w}')" for w in ASKED) + ") AS w(word) ON contains(lower(p_type), lower(w.word)) OR contains(lower(p_brand), lower(w.word))")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matching_patterns(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("domain"), F.col("p_brand").alias("intent")), ASKED)


CACHED = "CASE event_type WHEN 'error' THEN 'clear' WHEN 'click' THEN 'put' WHEN 'signup' THEN 'put' ELSE 'get' END"


@query(f"""WITH e AS (SELECT user_id, event_id, concat_ws(':', user_id, event_id % 3, 'ctx', 'model') AS key, {CACHED} AS kind FROM events)
SELECT g.user_id AS project, g.key, g.event_id AS seq, CASE WHEN p.put > coalesce(c.cleared, -1) THEN p.put END AS hit FROM e g
LEFT JOIN LATERAL (SELECT max(event_id) AS put FROM e x WHERE x.user_id = g.user_id AND x.key = g.key AND x.kind = 'put' AND x.event_id < g.event_id) p ON TRUE
LEFT JOIN LATERAL (SELECT max(event_id) AS cleared FROM e x WHERE x.user_id = g.user_id AND x.kind = 'clear' AND x.event_id < g.event_id) c ON TRUE WHERE g.kind = 'get'""")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is project, task, context and model, as they are."""
    key = F.concat_ws(":", "user_id", F.pmod("event_id", F.lit(3)), F.lit("ctx"), F.lit("model"))
    return M.response_cache(table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), key.alias("key"), F.col("event_id").alias("seq"), F.expr(CACHED).alias("kind")))


@query(f"""WITH e AS (SELECT user_id, event_id, concat_ws(':', user_id, event_id % 3, 'ctx', 'model') AS key, {CACHED} AS kind FROM events),
g AS (SELECT g.user_id, (SELECT max(event_id) FROM e x WHERE x.key = g.key AND x.kind = 'put' AND x.event_id < g.event_id) > coalesce((SELECT max(event_id) FROM e x WHERE x.user_id = g.user_id AND x.kind = 'clear' AND x.event_id < g.event_id), -1) AS hit FROM e g WHERE kind = 'get')
SELECT user_id AS project, count(*) AS asked, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS share FROM g GROUP BY user_id""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = response_cache(spark, sf_dir)
    return told.groupBy("project").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))


@query("""WITH p AS (SELECT event_type AS project, user_id % 60 AS key, ts, event_id AS seq, CAST(value * 800 AS BIGINT) AS size FROM events),
n AS (SELECT *, max(ts) OVER (PARTITION BY project) AS now, row_number() OVER (PARTITION BY project, key ORDER BY ts DESC, seq DESC) AS k FROM p),
l AS (SELECT * FROM n WHERE k = 1 AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= 86400),
h AS (SELECT project, key, CAST(row_number() OVER w AS INT) AS place, CAST(sum(size) OVER w AS BIGINT) AS held FROM l WINDOW w AS (PARTITION BY project ORDER BY ts DESC, seq DESC))
SELECT * FROM h WHERE place <= 32 AND held <= 1048576""")
def packet_cache_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as projects; entries live a day here, as events are minutes apart."""
    puts = table(spark, sf_dir, "events").select(F.col("event_type").alias("project"), F.pmod("user_id", F.lit(60)).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.round(F.col("value") * 800).cast("long").alias("size"))
    return M.packet_cache(puts, ttl=86_400)


@query("SELECT conv_id AS scope, count(*) AS asked, count(DISTINCT lower(trim(string_split(text, ' ')[1]))) AS embedded FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def query_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a scope, the first words of its turns are the queries."""
    return M.memo(table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").alias("scope"), F.split("text", " ")[0].alias("text")))


SIGNED = "CASE WHEN access_count > 0 THEN ' fn ' || name || '(' || token_cost || ') ' || repeat('x', CAST(token_cost * 4 AS INT)) END"
DOCUMENTED = "CASE WHEN access_count % 2 = 1 THEN repeat('about ' || name || ' ', 9) END"
SKETCH = f"""CASE WHEN node_type NOT IN ('File', 'Directory', 'Project', 'Api') THEN 'title: ' || file_path || '::' || name || ' | text: ' || lower(node_type)
  || CASE WHEN {SIGNED} IS NULL THEN '' ELSE ' ' || substr(trim({SIGNED}), 1, 180) END || CASE WHEN {DOCUMENTED} IS NULL THEN '' ELSE ' - ' || substr(trim({DOCUMENTED}), 1, 120) END END"""


def sketched(df: DataFrame) -> DataFrame:
    return df.select("id", "access_count", M.sketch(F.col("file_path"), F.col("name"), F.col("node_type"), F.expr(SIGNED), F.expr(DOCUMENTED)).alias("sketch")).filter("sketch IS NOT NULL")


@query(f"WITH {NODES_SQL}, s AS (SELECT id, {SKETCH} AS sketch FROM nodes) SELECT id, sketch, sha256(sketch) AS hash FROM s WHERE sketch IS NOT NULL")
def symbol_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched(nodes(spark, sf_dir)).select("id", "sketch", F.sha2("sketch", 256).alias("hash"))


@query(f"""WITH {NODES_SQL}, s AS (SELECT id, access_count AS c, {SKETCH} AS sketch FROM nodes), o AS (SELECT id, CASE WHEN c % 3 = 1 THEN 'old' ELSE sha256(sketch) END AS before FROM s WHERE sketch IS NOT NULL AND c % 4 <> 3),
n AS (SELECT id, sha256(sketch) AS after FROM s WHERE sketch IS NOT NULL AND c <> 5), r AS (SELECT CASE WHEN after IS NULL THEN 'drop' WHEN before = after THEN 'reuse' ELSE 'embed' END AS action FROM o FULL JOIN n USING (id))
SELECT action, count(*) AS n, CAST(ceil(count(*) / 128) AS BIGINT) AS batches FROM r GROUP BY action""")
def passage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some passages changed since, some are new, some went; what is left to embed goes in batches of 128."""
    told = sketched(nodes(spark, sf_dir)).withColumn("hash", F.sha2("sketch", 256))
    old = told.filter("access_count % 4 <> 3").select("id", F.when(F.col("access_count") % 3 == 1, "old").otherwise(F.col("hash")).alias("hash"))
    done = M.reuse(old, told.filter("access_count <> 5").select("id", "hash"))
    return done.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 128).cast("long").alias("batches"))


@query("""WITH s AS (SELECT event_id AS id, 3 + event_id % 5 AS version, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'mini' END AS model, CASE WHEN event_id % 7 = 0 THEN 128 ELSE 64 END AS dim, event_id % 2 AS generation, user_id % 2 AS files FROM events),
f AS (SELECT *, version BETWEEN 4 AND 6 AND model = 'mini' AND dim = 64 AND generation = 1 AS fits FROM s) SELECT id, fits, fits AND version >= 6 AND files > 0 AS hierarchical FROM f""")
def sidecar_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    held = table(spark, sf_dir, "events").select(
        e.alias("id"), (3 + F.pmod(e, F.lit(5))).alias("version"), F.when(F.pmod(e, F.lit(3)) == 0, "other").otherwise("mini").alias("model"), F.when(F.pmod(e, F.lit(7)) == 0, 128).otherwise(64).alias("dim"),
        F.pmod(e, F.lit(2)).alias("generation"), F.lit("d").alias("digest"), F.pmod("user_id", F.lit(2)).alias("files"),
    )
    return M.compatible(held, "mini", 64, 1, "d")


@query(f"""WITH {FILES_SQL}, {SYMBOLS_SQL}, s AS (SELECT f.prompt, string_split(path, '/')[1] AS file, path_id AS id, lower(symbol) AS name FROM files f JOIN symbols y ON y.id = f.path_id),
o AS (SELECT prompt AS task, file, id, CAST(CASE WHEN length(name) >= 3 AND contains(prompt, name) THEN 3 ELSE 0 END + len(list_filter(regexp_split_to_array(name, '[^a-z0-9]'), lambda p: length(p) >= 4 AND contains(prompt, p))) AS INT) AS overlap FROM (SELECT s.* REPLACE (lower(s.prompt) AS prompt) FROM s)),
k AS (SELECT *, row_number() OVER (PARTITION BY task, file ORDER BY overlap DESC, id) AS k FROM o), p AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY file, k) AS place FROM k WHERE k <= 3) SELECT task, file, id, overlap FROM p WHERE place <= 16""")
def lazy_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three symbols of a file and sixteen in all here, as files are small; a file is a folder's name."""
    held = symbols(spark, sf_dir).join(files(spark, sf_dir).select(F.col("path_id").alias("id"), F.split("path", "/")[0].alias("file")), "id")
    return M.lazy_symbols(held.select(F.lower("prompt").alias("task"), "prompt", "file", F.col("file").alias("file_place"), "id", F.col("symbol").alias("name")), 3, 16)


MANIFEST_SQL = """m AS (SELECT 'go.mod' AS name, '// x' || chr(10) || 'module github.com/acme/s' || s_suppkey || chr(10) || 'go 1.21' AS content FROM supplier
  UNION ALL SELECT 'composer.json', '{"name":"a/b","autoload":{"psr-4":{"App\\\\N' || n_nationkey || '\\\\":"src/n' || n_nationkey || '/","App\\\\N' || n_nationkey || '\\\\Deep\\\\":"deep' || n_nationkey || '"}},"autoload-dev":{"psr-4":{"Tests\\\\T' || n_nationkey || '\\\\":"tests/"}}}' FROM nation
  UNION ALL SELECT 'package.json', '{}' FROM region)"""
PREFIXES_SQL = """pre AS (SELECT 'github.com/acme/s' || s_suppkey AS prefix, '' AS folder FROM supplier UNION ALL SELECT 'App/N' || n_nationkey, 'src/n' || n_nationkey FROM nation UNION ALL SELECT 'App/N' || n_nationkey || '/Deep', 'deep' || n_nationkey FROM nation
  UNION ALL SELECT 'Tests/T' || n_nationkey, 'tests' FROM nation)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    go = F.concat(F.lit("// x\nmodule github.com/acme/s"), "s_suppkey", F.lit("\ngo 1.21"))
    n = F.col("n_nationkey").cast("string")
    composer = F.concat(F.lit('{"name":"a/b","autoload":{"psr-4":{"App\\\\N'), n, F.lit('\\\\":"src/n'), n, F.lit('/","App\\\\N'), n, F.lit('\\\\Deep\\\\":"deep'), n, F.lit('"}},"autoload-dev":{"psr-4":{"Tests\\\\T'), n, F.lit('\\\\":"tests/"}}}'))
    rows = table(spark, sf_dir, "supplier").select(F.lit("go.mod").alias("name"), go.alias("content")).union(table(spark, sf_dir, "nation").select(F.lit("composer.json"), composer))
    return rows.union(table(spark, sf_dir, "region").select(F.lit("package.json"), F.lit("{}")))


@query(f"WITH {PREFIXES_SQL} SELECT prefix, folder FROM pre")
def manifest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.manifest_prefixes(manifests(spark, sf_dir))


HINT_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'App\\N' || o_custkey % 25 || '\\Deep\\X' WHEN 1 THEN 'App/N' || o_custkey % 30 || '/Y/Z' WHEN 2 THEN 'github.com/acme/s' || o_custkey % 20 || '/pkg' WHEN 3 THEN 'github.com/acme/s' || o_custkey % 20 ELSE 'Tests/T' || o_custkey % 25 END"


@query(f"""WITH {PREFIXES_SQL}, h AS (SELECT o_orderkey AS ref, replace({HINT_SQL}, '\\', '/') AS hint FROM orders), f AS (SELECT ref, prefix, folder, ltrim(substr(hint, length(prefix) + 1), '/') AS rest FROM h JOIN pre ON hint = prefix OR starts_with(hint, prefix || '/')),
p AS (SELECT ref, length(prefix) AS n, CASE WHEN folder = '' THEN rest WHEN rest = '' THEN folder ELSE folder || '/' || rest END AS path FROM f) SELECT ref, max_by(path, n) AS path FROM p WHERE path <> '' GROUP BY ref""")
def import_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("o_orderkey", F.lit(5))
    number = lambda n: F.pmod("o_custkey", F.lit(n)).cast("string")
    hint = (
        F.when(kind == 0, F.concat(F.lit("App\\N"), number(25), F.lit("\\Deep\\X"))).when(kind == 1, F.concat(F.lit("App/N"), number(30), F.lit("/Y/Z"))).when(kind == 2, F.concat(F.lit("github.com/acme/s"), number(20), F.lit("/pkg")))
        .when(kind == 3, F.concat(F.lit("github.com/acme/s"), number(20))).otherwise(F.concat(F.lit("Tests/T"), number(25)))
    )
    return M.rewrite_imports(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), hint.alias("hint")), M.manifest_prefixes(manifests(spark, sf_dir)))


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, c AS (SELECT id, name, file_path FROM nodes WHERE file_path IN ('crates/orders/src/m3.rs', 'crates/part/src/m1.rs', 'crates/geo/src/france.rs'))
SELECT DISTINCT source, edge_type, name, file_path FROM edges JOIN c ON c.id = target WHERE source NOT IN (SELECT id FROM c)""")
def inbound_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = spark.createDataFrame([("crates/orders/src/m3.rs",), ("crates/part/src/m1.rs",), ("crates/geo/src/france.rs",)], "file_path string")
    return M.inbound_pending(nodes(spark, sf_dir), edges(spark, sf_dir), changed)


@query("""SELECT doc_id AS id, round(CASE WHEN n_chars = 0 THEN 0.0 ELSE 0.50 * greatest(0, n_chars - doc_id % 900) / n_chars + CASE WHEN doc_id % 4 > 0 THEN 0.35 ELSE 0 END + 0.15 * least(1.0, doc_id % 13 / 10) END, 6)::DOUBLE AS fitness FROM documents""")
def fold_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return M.fitness(table(spark, sf_dir, "documents").select(d.alias("id"), F.col("n_chars").alias("original"), F.pmod(d, F.lit(900)).alias("skeleton"), (F.pmod(d, F.lit(4)) > 0).cast("int").alias("sound"), (F.pmod(d, F.lit(13)) / 10).alias("types")))


CLIENT = ("Router", "session", "  Cart ", "", "router", "checkout", "price", "Total", "stock")


@query(f"""WITH {PROMPTS_SQL}, w AS (SELECT conv_id, turn, list_filter(list_transform(list_concat(['{"', '".join(CLIENT)}'], regexp_extract_all(prompt, '[A-Za-z]+')), lambda x: lower(trim(x))), lambda x: x <> '') AS ws FROM prompts)
SELECT conv_id || ':' || turn AS task, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 12), ',') AS keywords FROM w""")
def client_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prompts(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("task"), F.regexp_extract_all("prompt", F.lit("([A-Za-z]+)")).alias("own"), F.array(*map(F.lit, CLIENT)).alias("client"))
    return M.merged_signals(own, 12).select("task", F.array_join("keywords", ",").alias("keywords"))


@query("""WITH v AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, coalesce(text, '') AS after, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT conv_id || ':' || turn AS id, string_split(replace(before, '. ', chr(10)), chr(10)) AS o, string_split(replace(after, '. ', chr(10)), chr(10)) AS n, before, after FROM v WHERE k > 1 AND before <> after),
l AS (SELECT id, CASE WHEN before = '' THEN CAST([] AS VARCHAR[]) ELSE o END AS o, CASE WHEN after = '' THEN CAST([] AS VARCHAR[]) ELSE n END AS n FROM s),
u AS (SELECT id, 'added' AS side, unnest(range(1, len(n) + 1)) AS line, n AS here, o AS there FROM l UNION ALL SELECT id, 'removed', unnest(range(1, len(o) + 1)), o, n FROM l)
SELECT id, side, CAST(line AS INT) AS line, here[line] AS text FROM u WHERE NOT list_contains(there, here[line])""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before it, a line for each sentence."""
    order = W.partitionBy("conv_id").orderBy("turn")
    split = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(". "), F.lit("\n"))
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).withColumn("k", F.row_number().over(order)).filter("k > 1")
    return M.line_changes(turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), split(F.col("before")).alias("before"), split(F.col("text")).alias("after")))


CLASSES = ("Cart", "ShoppingCart", "OrderService", "UserRepository", "Session", "PriceList", "stock_item", "")
HINTS = ("impl:Cart", "type:OrderService", "field:cart", "obj:repository", "obj:order_service", "", "field:price_list", "type:Nothing", "obj:item", "impl:Session")
CALLS_SQL = f"""methods AS (SELECT p_partkey AS id, 'm' || (p_partkey * 7 % 701) AS name, {listed(CLASSES, 'p_partkey')} AS parent, 'src/f' || p_partkey % 97 || '.rs' AS file_path, 'pkg' || p_partkey % 13 AS package FROM part),
calls AS (SELECT o_orderkey AS ref, 'M' || (o_orderkey % 709) AS name, {listed(HINTS, 'o_orderkey')} AS hint, 'src/f' || o_custkey % 97 || '.rs' AS file_path, 'pkg' || o_custkey % 13 AS package FROM orders),
ends AS (SELECT id, lower(name) AS name, unnest(list_transform(range(1, len(ws) + 1), lambda i: lower(array_to_string(list_slice(ws, i, len(ws)), '')))) AS thing FROM (SELECT *, list_filter(string_split(regexp_replace(parent, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '_'), lambda w: w <> '') AS ws FROM methods)),
c AS (SELECT ref, lower(name) AS name, string_split(hint, ':')[1] AS told, lower(replace(coalesce(string_split(hint, ':')[2], ''), '_', '')) AS thing, file_path, package FROM calls)"""


def only(where: str, source: str = "methods") -> str:
    return f"(SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM {source} x WHERE lower(x.name) = c.name AND {where})"


@query(f"""WITH {CALLS_SQL}, r AS (SELECT ref, CASE WHEN told IN ('impl', 'type') THEN {only("lower(replace(parent, '_', '')) = c.thing AND c.thing <> ''")} END AS a, CASE WHEN told IN ('field', 'obj') THEN {only("x.thing = c.thing AND c.thing <> ''", "ends")} END AS b,
  {only('x.file_path = c.file_path')} AS f, {only('x.package = c.package')} AS p, {only('TRUE')} AS g FROM c)
SELECT ref, coalesce(a, b, f, p, g) AS id, CASE WHEN a IS NOT NULL THEN 'receiver' WHEN b IS NOT NULL THEN 'thing' WHEN f IS NOT NULL THEN 'file' WHEN p IS NOT NULL THEN 'package' ELSE 'global' END AS tier FROM r WHERE coalesce(a, b, f, p, g) IS NOT NULL""")
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("m"), F.pmod(F.col("p_partkey") * 7, F.lit(701))).alias("name"), chosen(CLASSES, F.col("p_partkey")).alias("parent"), F.concat(F.lit("src/f"), F.pmod("p_partkey", F.lit(97)), F.lit(".rs")).alias("file_path"), F.concat(F.lit("pkg"), F.pmod("p_partkey", F.lit(13))).alias("package"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), F.concat(F.lit("M"), F.pmod("o_orderkey", F.lit(709))).alias("name"), chosen(HINTS, F.col("o_orderkey")).alias("hint"), F.concat(F.lit("src/f"), F.pmod("o_custkey", F.lit(97)), F.lit(".rs")).alias("file_path"), F.concat(F.lit("pkg"), F.pmod("o_custkey", F.lit(13))).alias("package"))
    return M.resolve_calls(calls, methods)
