"""Queries of a task's context: concepts, roles, gaps, impact, filters, sufficiency and escalation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import predicates as P
from tessera.functions import prompts as T
from tessera.operators import context as C
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from tessera.sources.workspace import FILE_EDGES_SQL, FILES_SQL, SYMBOLS_SQL, chosen, file_edges, files, listed, symbols

PATH_RULES, PROMPT_RULES = P.path_rules(), P.prompt_rules()


def says(name: str, words: tuple[str, ...]) -> str:
    return "(" + (" OR ".join(f"contains({name}, '{w}')" for w in words) or "FALSE") + ")"


CONCEPT_SQL = """list_filter([
  CASE WHEN contains(low, 'middleware') THEN 'middleware' END, CASE WHEN contains(low, 'router') OR contains(low, 'routing') OR suffix(low, 'route') THEN 'routing' END,
  CASE WHEN starts_with(low, 'auth') OR contains(low, 'authenticate') THEN 'auth' END, CASE WHEN contains(low, 'session') OR contains(low, 'cookie') THEN 'session' END, CASE WHEN contains(low, 'repo') THEN 'repository' END,
  CASE WHEN starts_with(low, 'render') OR contains(low, 'template') THEN 'render' END, CASE WHEN contains(low, 'store') AND NOT contains(low, 'restore') THEN 'store' END, CASE WHEN contains(low, 'config') OR contains(low, 'settings') THEN 'config' END,
  CASE WHEN contains(low, 'static') OR contains(low, 'asset') THEN 'static' END, CASE WHEN contains(low, 'model') OR contains(low, 'schema') THEN 'database' END, CASE WHEN contains(low, 'valid') OR contains(low, 'schema') THEN 'validation' END,
  CASE WHEN contains(low, 'plugin') OR contains(low, 'encapsul') THEN 'plugin' END, CASE WHEN contains(low, 'contenttype') OR contains(low, 'content-type') OR contains(low, 'parser') THEN 'content_type' END,
  CASE WHEN contains(low, 'error') AND (contains(low, 'handler') OR contains(low, 'serial')) THEN 'errors' END], lambda x: x IS NOT NULL)"""
INDEX_SQL = f"""{FILES_SQL}, {SYMBOLS_SQL}, told AS (SELECT id, symbol, unnest({CONCEPT_SQL}) AS concept FROM (SELECT *, lower(symbol) AS low FROM symbols)),
index AS (SELECT * FROM (SELECT concept, CAST(row_number() OVER (PARTITION BY concept ORDER BY id) AS INT) AS place, id, symbol FROM told) WHERE place <= 24)"""


@query(f"WITH {INDEX_SQL} SELECT concept, place, id, symbol FROM index")
def concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.concept_index(symbols(spark, sf_dir))


@query(f"""WITH {INDEX_SQL}, tasks AS (SELECT DISTINCT prompt AS task, regexp_extract_all(prompt, '[a-z0-9]+') AS ws FROM files), asked AS (SELECT task, list_filter(ws, lambda w: length(w) >= 4) AS identifiers, concept FROM tasks JOIN (SELECT DISTINCT concept FROM index) c ON contains(task, concept)),
s AS (SELECT task, id, max(round(least(0.95, 0.72 + CASE WHEN contains(lower(symbol), concept) THEN 0.12 ELSE 0 END + CASE WHEN len(list_filter(identifiers, lambda w: contains(lower(symbol), w))) > 0 THEN 0.18 ELSE 0 END), 6)) AS score FROM index JOIN asked USING (concept) WHERE NOT contains(symbol, '.') GROUP BY ALL)
SELECT task, id, CAST(place AS INT) AS place, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.84) WHERE place <= 6""")
def concept_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(F.contains("task", F.lit(c)), c) for c in (*[x[0] for x in C.CONCEPTS], "errors")]))
    none = F.array().cast("array<string>")
    asked = files(spark, sf_dir).select(F.col("prompt").alias("task")).distinct().select("task", F.explode(named).alias("concept"), T.words("task").alias("identifiers"), none.alias("keywords"), none.alias("stems"))
    return C.concept_seeds(C.concept_index(symbols(spark, sf_dir)), asked)


PROFILE_SQL = "CASE " + " ".join(f"WHEN {says('lower(prompt)', words)} THEN '{name}'" for name, words in C.PROFILES) + " ELSE 'general' END"
ROLES_SQL = "CASE profile " + " ".join(f"WHEN '{name}' THEN [{P.quoted(words)}]" for name, words in C.ROLES.items()) + " ELSE CAST([] AS VARCHAR[]) END"


@query(f"""WITH {FILES_SQL}, t AS (SELECT prompt, {PROFILE_SQL} AS profile, path FROM files), r AS (SELECT prompt, profile, path, {ROLES_SQL} AS roles FROM t),
h AS (SELECT prompt, profile, any_value(len(roles)) AS n, len(list_distinct(flatten(list(list_filter(roles, lambda w: contains(lower(path), w)))))) AS hits FROM r GROUP BY ALL)
SELECT prompt AS task, profile, round(CASE WHEN n = 0 THEN 1.0 ELSE hits / n END, 6) AS coverage FROM h""")
def role_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.role_coverage(files(spark, sf_dir).select(F.col("prompt").alias("task"), "prompt", "path"))


REASONS = ("callers not in packet", "missing seed", "required by session", "dependency outside", "style file", "auth handler", "route not covered")
SPECIAL_SQL = "CASE " + " ".join(f"WHEN profile = '{k}' THEN {says('lower(path)', a)} OR {says('reason', b)}" for k, (a, b) in C.CRITICAL.items()) + f" ELSE {says('reason', C.ELSE_CRITICAL)} END"


@query(f"""WITH {FILES_SQL}, t AS (SELECT path_id, path, {listed(REASONS, 'path_id')} AS reason, {PROFILE_SQL} AS profile FROM files)
SELECT path_id, profile, len(list_filter({ROLES_SQL}, lambda w: contains(lower(path), w) OR contains(reason, w))) > 0 OR {SPECIAL_SQL} AS critical FROM t""")
def gap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = files(spark, sf_dir).select("path_id", "path", chosen(REASONS, F.col("path_id")).alias("reason"), C.profile(F.col("prompt")).alias("profile"))
    return told.select("path_id", "profile", C.critical_gap(F.col("path"), F.col("reason"), F.col("profile")).alias("critical"))


INTENTS = (*C.PATTERNS, "explain")
FITS_SQL = "CASE intent " + " ".join(f"WHEN '{k}' THEN {says('text', words)}" for k, words in C.PATTERNS.items()) + " ELSE TRUE END"


@query(f"""WITH {FILES_SQL}, {FILE_EDGES_SQL}, n AS (SELECT a AS seed, b AS id FROM steps UNION SELECT b, a FROM steps UNION SELECT path_id, path_id FROM files),
t AS (SELECT seed, id, {listed(INTENTS, 'seed')} AS intent, lower(name || ' ' || path) AS text FROM n JOIN files ON path_id = id)
SELECT seed, CAST(place AS INT) AS place, id FROM (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS place FROM t WHERE {FITS_SQL}) WHERE place <= 6""")
def pattern_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files(spark, sf_dir).select(F.col("path_id").alias("id"), "name", "path")
    return C.expand_by_pattern(held, file_edges(spark, sf_dir), held.select(F.col("id").alias("seed"), chosen(INTENTS, F.col("id")).alias("intent")))


REACHED_SQL = "two AS (SELECT a, b FROM steps UNION SELECT x.a, y.b FROM steps x JOIN steps y ON x.b = y.a)"


@query(f"""WITH {FILES_SQL}, {FILE_EDGES_SQL}, {REACHED_SQL}, k AS (SELECT a AS origin, b AS id, 'callee' AS kind FROM two WHERE a <> b UNION ALL SELECT b, a, 'caller' FROM two WHERE a <> b UNION ALL SELECT path_id, path_id, 'origin' FROM files),
t AS (SELECT origin, kind, lower(path) AS path FROM k JOIN files ON path_id = id)
SELECT origin AS id, count(DISTINCT path) FILTER (WHERE kind = 'caller') AS callers, count(DISTINCT path) FILTER (WHERE kind = 'callee') AS callees, count(DISTINCT path) AS affected,
  count(DISTINCT path) FILTER (WHERE contains(path, 'test') OR contains(path, 'spec')) AS tests, count(DISTINCT path) FILTER (WHERE contains(path, 'config') OR contains(path, '.env') OR regexp_matches(path, '\\.(json|toml|yaml|yml)$')) AS configs FROM t GROUP BY origin""")
def impact_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.impact(files(spark, sf_dir).select(F.col("path_id").alias("id"), "path"), file_edges(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, g AS (SELECT path_id AS id, CASE path_id % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) ELSE [path, string_split(path, '/')[-1], 'lib/x.rs'] END AS gold, CASE path_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['repo/' || path, 'other.rs'] ELSE [string_split(path, '/')[-1]] END AS got FROM files)
SELECT id, round(CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_filter(gold, lambda g: len(list_filter(got, lambda r: contains(r, g) OR suffix(g, r))) > 0)) / len(gold) END, 6) AS recall,
  round(CASE WHEN len(got) = 0 THEN 0.0 ELSE len(list_filter(got, lambda r: len(list_filter(gold, lambda g: contains(r, g) OR suffix(g, r))) > 0)) / len(got) END, 6) AS "precision" FROM g""")
def impact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    last, none = F.element_at(F.split("path", "/"), -1), F.array().cast("array<string>")
    gold = F.when(F.pmod("path_id", F.lit(5)) == 0, none).otherwise(F.array("path", last, F.lit("lib/x.rs")))
    kind = F.pmod("path_id", F.lit(4))
    got = F.when(kind == 0, none).when(kind == 1, F.array(F.concat(F.lit("repo/"), "path"), F.lit("other.rs"))).otherwise(F.array(last))
    return C.impact_scores(files(spark, sf_dir).select(F.col("path_id").alias("id"), gold.alias("gold"), got.alias("retrieved")))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet's figures for each event."""
    e = F.col("event_id")

    def part(n: int) -> F.Column:
        return F.pmod(e, F.lit(n))

    return table(spark, sf_dir, "events").select(
        "event_id", part(5).alias("hits"), F.when(part(4) == 0, part(3)).otherwise(F.lit(0).cast("long")).alias("misses"), (part(11) / 10).alias("dependency"), (part(7) / 6).alias("task_role"), (part(10) / 10).alias("coherence"),
        (part(21) / 20).alias("seed_confidence"), F.when(part(9) == 0, 1).otherwise(0).alias("critical"), part(2).alias("non_critical"), part(8).alias("unresolved"), (part(13) / 13).alias("redundancy"),
        F.when(part(6) == 0, 0.5).otherwise(0.0).alias("open_concepts"), (part(17) == 0).alias("over_budget"),
    )


PACKETS_SQL = """p AS (SELECT event_id, event_id % 5 AS hits, CASE WHEN event_id % 4 = 0 THEN event_id % 3 ELSE 0 END AS misses, event_id % 11 / 10 AS dependency, event_id % 7 / 6 AS task_role, event_id % 10 / 10 AS coherence,
  event_id % 21 / 20 AS seed_confidence, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS critical, event_id % 2 AS non_critical, event_id % 8 AS unresolved, event_id % 13 / 13 AS redundancy, CASE WHEN event_id % 6 = 0 THEN 0.5 ELSE 0.0 END AS open_concepts,
  event_id % 17 = 0 AS over_budget FROM events),
r AS (SELECT *, CASE WHEN hits + misses = 0 THEN 0.0 ELSE hits / (hits + misses) END AS relevance FROM p),
s AS (SELECT *, round(greatest(0.0, least(1.0, 0.25 * relevance + 0.20 * dependency + 0.20 * task_role + 0.10 * coherence + 0.15 * seed_confidence - 0.15 * (critical + 0.25 * non_critical) - 0.01 * least(unresolved, 5) - 0.05 * redundancy - 0.08 * open_concepts)), 6) AS score,
  round(greatest(0.0, least(1.0, 0.4 * seed_confidence + 0.3 * relevance + 0.3 * task_role)), 6) AS confidence FROM r),
c AS (SELECT *, CASE WHEN hits = 0 THEN 'insufficient' WHEN critical > 0 OR open_concepts > 0 OR (misses > 0 AND task_role < 0.5) OR score < 0.45 THEN 'partial' WHEN score >= 0.72 AND task_role >= 0.67 AND dependency >= 0.5 AND confidence >= 0.7 THEN 'likely_sufficient' ELSE 'partial' END AS claim FROM s)"""


@query(f"WITH {PACKETS_SQL} SELECT event_id, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence, claim, claim = 'likely_sufficient' AND NOT over_budget AS early_exit FROM c")
def sufficiency_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sufficiency(packets(spark, sf_dir)).select("event_id", "score", "confidence", "claim", "early_exit")


@query(f"""WITH {PACKETS_SQL}, e AS (SELECT *, claim = 'likely_sufficient' AND NOT over_budget AS early_exit, event_id % 900 AS tokens, event_id % 3 = 0 AS strong, event_id % 4 <> 0 AS vectors, CASE WHEN event_id % 5 > 0 THEN event_id % 100 / 100.0 END AS best FROM c),
d AS (SELECT *, hits > 0 AND NOT strong AND (NOT vectors OR coalesce(best < 0.45, FALSE)) AS doubtful FROM e)
SELECT event_id, doubtful, early_exit AND tokens <= 600 AND critical = 0 AND NOT doubtful AS stays, critical > 0 OR doubtful AS escalates FROM d""")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    more = C.sufficiency(packets(spark, sf_dir)).withColumns(
        {
            "tokens": F.pmod(e, F.lit(900)), "budget": F.lit(600), "resolved": F.col("hits"), "strong_lexical": F.pmod(e, F.lit(3)) == 0, "vectors": F.pmod(e, F.lit(4)) != 0,
            "best_cosine": F.when(F.pmod(e, F.lit(5)) > 0, F.pmod(e, F.lit(100)) / 100.0), "least_cosine": F.lit(0.45),
        }
    )
    return C.escalation(more).select("event_id", "doubtful", "stays", "escalates")


STEMS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {{}} THEN '{c}' END" for c, *_ in C.STEMS) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {FILES_SQL}, {SYMBOLS_SQL}, t AS (SELECT prompt, unnest({STEMS_SQL.format(*[says('lower(prompt)', x[1]) for x in C.STEMS])}) AS concept FROM (SELECT DISTINCT prompt FROM files)),
f AS (SELECT path_id AS id, unnest({STEMS_SQL.format(*[says('lower(symbol)', x[2]) for x in C.STEMS])}) AS concept FROM files JOIN symbols ON id = path_id WHERE NOT {PATH_RULES['embed_noise'].sql})
SELECT DISTINCT prompt AS task, id, CAST(0.45 AS DOUBLE) AS score FROM t JOIN f USING (concept)""")
def stem_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are named by their symbols here."""
    held = files(spark, sf_dir).select(F.col("path_id").alias("id"), PATH_RULES["embed_noise"].column.alias("noise")).join(symbols(spark, sf_dir).select("id", F.lower("symbol").alias("stem")), "id")
    return C.stem_union(held, files(spark, sf_dir).select(F.col("prompt").alias("task"), "prompt").distinct(), 0.45)


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT e.source AS id, count(DISTINCT lower(t.name)) AS callees FROM (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'Calls' AND confidence <> 'unresolved') e
JOIN nodes s ON s.id = e.source AND s.node_type <> 'File' JOIN nodes t ON t.id = e.target GROUP BY e.source""")
def seed_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.seed_callees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, {FILE_EDGES_SQL}, {REACHED_SQL} SELECT DISTINCT prompt AS task, t.a AS id, CAST(17 AS DOUBLE) AS score FROM files f JOIN two t ON t.b = f.path_id AND t.a <> t.b WHERE {PROMPT_RULES['callers'].sql}""")
def caller_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = files(spark, sf_dir).filter(PROMPT_RULES["callers"].column).select(F.col("prompt").alias("task"), F.col("path_id").alias("id"))
    return C.caller_files(file_edges(spark, sf_dir), seeds)


@query(f"""WITH {FILES_SQL}, {FILE_EDGES_SQL}, seeds AS (SELECT prompt AS task, min(path_id) AS id FROM files GROUP BY prompt), one AS (SELECT a, b FROM steps UNION SELECT b, a FROM steps),
near AS (SELECT task, b AS id FROM seeds JOIN one ON a = id UNION SELECT task, id FROM seeds), o AS (SELECT s.task, f.path_id AS id FROM seeds s JOIN files f ON f.prompt = s.task OR f.path_id IN (s.id + 1, s.id - 1, s.id * 2))
SELECT task, id, CAST(kept AS INT) AS kept FROM (SELECT DISTINCT task, id, dense_rank() OVER (PARTITION BY task ORDER BY id) AS kept FROM o SEMI JOIN near USING (task, id)) WHERE kept <= 6""")
def call_graph_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt's first file is its seed; the files of the prompt and those around the seed are what could be taken."""
    held = files(spark, sf_dir).select(F.col("prompt").alias("task"), F.col("path_id").alias("id"))
    seeds = held.groupBy("task").agg(F.min("id").alias("id"))
    near = seeds.select("task", F.explode(F.array(F.col("id") + 1, F.col("id") - 1, F.col("id") * 2)).alias("id")).join(held.select("id"), "id", "left_semi").select("task", "id")
    optional = held.union(near).distinct().withColumn("place", F.col("id"))
    return C.call_graph_only(optional, file_edges(spark, sf_dir), seeds)


APP_SQL = "CASE WHEN starts_with(path, 'apps/') THEN 'apps/' || string_split(path, '/')[2] END"


@query(f"""WITH {FILES_SQL}, p AS (SELECT prompt, path_id AS id, {APP_SQL} AS app, {PATH_RULES['schema'].sql} AS schema, path_id % 4 = 0 AS is_seed, {PROMPT_RULES['database'].sql} AS asks FROM files),
l AS (SELECT prompt, min(app) AS lock FROM p WHERE is_seed AND app IS NOT NULL GROUP BY prompt HAVING count(DISTINCT app) = 1)
SELECT p.prompt AS task, id FROM p LEFT JOIN l ON l.prompt = p.prompt WHERE is_seed OR NOT ((lock IS NOT NULL AND app IS NOT NULL AND app <> lock) OR (schema AND NOT asks))""")
def app_lock_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = files(spark, sf_dir).select(
        F.col("prompt").alias("task"), F.col("path_id").alias("id"), T.app_prefix("path").alias("app"), PATH_RULES["schema"].column.alias("schema"), (F.pmod("path_id", F.lit(4)) == 0).alias("is_seed"),
        PROMPT_RULES["database"].column.alias("asks_database"),
    )
    return C.app_locked(packet)


@query(f"""WITH {FILES_SQL}, {SYMBOLS_SQL}, t AS (SELECT id, symbol, string_split(symbol, '_')[1] AS entity, regexp_extract_all(prompt, '[a-z]+') AS concepts, id % 100 / 100.0 AS confidence FROM symbols)
SELECT id, round(least(1.0, 0.5 + CASE WHEN contains(lower(symbol), lower(entity)) AND id % 3 > 0 THEN 0.4 ELSE 0 END + 0.2 * len(list_filter(list_distinct(concepts), lambda c: length(c) >= 4 AND contains(lower(symbol), c)))), 6)::DOUBLE AS score,
  CASE WHEN confidence > 0.8 THEN 0.15 ELSE 0.65 END::DOUBLE AS uncertainty, CASE WHEN confidence > 0.8 THEN 'balanced' ELSE 'conservative' END AS compression FROM t""")
def local_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.when(F.pmod("id", F.lit(3)) > 0, F.split("symbol", "_")[0]).otherwise("something else")
    return C.assessed(symbols(spark, sf_dir).select("id", F.col("symbol").alias("name"), entity.alias("entity"), T.words("prompt").alias("concepts"), (F.pmod("id", F.lit(100)) / 100.0).alias("confidence")))


@query(f"""WITH {FILES_SQL}, t AS (SELECT prompt, list_distinct(list_filter(regexp_extract_all(prompt, '[a-z0-9]+'), lambda w: length(w) >= 4)) AS terms, CASE WHEN path_id % 3 = 0 THEN path || ' ' || name END AS blob FROM files),
m AS (SELECT prompt, any_value(len(terms)) AS n, bool_or(blob IS NOT NULL) AS any_, len(list_distinct(flatten(list(list_filter(terms, lambda w: contains(lower(coalesce(blob, '')), w)))))) AS matched FROM t GROUP BY prompt)
SELECT prompt AS task, matched, n - matched AS missed, round(CASE WHEN any_ THEN least(0.2 + 0.25 * matched / greatest(n, 1), 0.45) ELSE 0.15 END, 6)::DOUBLE AS confidence, round(CASE WHEN any_ THEN least(0.15 + 0.3 * matched / greatest(n, 1), 0.45) ELSE 0.0 END, 6)::DOUBLE AS sufficiency FROM m""")
def outside_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = F.when(F.pmod("path_id", F.lit(3)) == 0, F.concat_ws(" ", "path", "name"))
    return C.outside_hints(files(spark, sf_dir).select(F.col("prompt").alias("task"), T.words("prompt").alias("terms"), blob.alias("blob")))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN event_type END AS tier, CASE WHEN event_type IN ('view', 'click') THEN event_id % 100 / 100.0 END AS cosine, event_type = 'purchase' AND event_id % 40 = 3 AS lexical FROM events),
u AS (SELECT user_id, min_by(tier, event_id) FILTER (WHERE tier IS NOT NULL) AS tier, max(cosine) AS best, bool_or(lexical) AS lexical FROM s GROUP BY user_id)
SELECT user_id, tier, CAST(best AS DOUBLE) AS best, CASE WHEN NOT lexical AND coalesce(best, 0) < 0.985 THEN 'no_confident_match' END AS override FROM u""")
def embedding_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the seeds of a prompt: the first one's tier, the best cosine, and the claim that weak vectors alone call for."""
    tier = F.when(F.col("value") > 20, F.col("event_type"))
    cosine = F.when(F.col("event_type").isin("view", "click"), F.pmod("event_id", F.lit(100)) / 100.0)
    lexical = (F.col("event_type") == "purchase") & (F.pmod("event_id", F.lit(40)) == 3)
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(tier, F.when(tier.isNotNull(), F.col("event_id"))).alias("tier"), F.max(cosine).alias("best"), F.max(lexical).alias("lexical"))
    return by.select("user_id", "tier", "best", F.when(~F.col("lexical") & (F.coalesce("best", F.lit(0.0)) < 0.985), "no_confident_match").alias("override"))
