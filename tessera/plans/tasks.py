"""Queries of prompts: what they name, what they ask for, their plans, steps and seeds; of outside answers, types and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.functions import anchors as A
from tessera.functions import tasks as T
from tessera.functions.predicates import quoted
from tessera.operators import memory as M
from tessera.operators import outside as O
from tessera.operators import seeds as S
from tessera.plans.parse import expected_sql, filled, numbered
from tessera.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from tessera.sources.workspace import PROMPTS_SQL, prompts

#: Prompts, one for each part, with what they name, (entity, concepts, confidence), and their keywords.
ASKED = (
    ("How does the {n} loader call `crate::net::Conn`?", (("name", 0, "crate::net::Conn"), ("name", 1, "Conn"), ("name", 2, "{n}")), (("crate::net::Conn", 3, 0.94),), (("crate::net::Conn,{n}",),)),
    (
        "Fix src/net/{n}.rs and main.go after POST /sms/send.",
        (("file", 0, "src/net/{n}.rs"), ("file", 1, "{n}.rs"), ("file", 2, "main.go"), ("name", 0, "{n}.rs"), ("name", 1, "main.go"), ("name", 2, "{n}"), ("name", 3, "POST"), ("name", 4, "POST /sms/send"), ("name", 5, "/sms/send"), ("name", 6, "/sms/send.")),
        (("{n}.rs", 7, 0.94),), (("{n}.rs,main.go,{n},POST /sms/send,/sms/send,/sms/send.",),),
    ),
    ("What is Cart.total() in {n}", (("name", 0, "Cart"), ("name", 1, "total"), ("name", 2, "{n}")), (("Cart", 3, 0.94),), (("{n}",),)),
    (
        "explain z.parseAsync and app.use for `GET /users`",
        (("name", 0, "GET /users"), ("name", 1, "/users"), ("name", 2, "parseAsync"), ("name", 3, "z.parseAsync"), ("name", 4, "app.use"), ("name", 5, "use")), (("GET /users", 6, 0.94),),
        (("GET /users,/users,parseAsync,z.parseAsync,app.use,use",),),
    ),
    (
        "see `src\\lib\\{n}.ts` and https://example.com/docs/{n}/?q=1.",
        (("file", 0, "src/lib/{n}.ts"), ("file", 1, "{n}.ts"), ("name", 0, "{n}.ts"), ("name", 1, "example.com"), ("name", 2, "com"), ("name", 3, "{n}"), ("name", 4, "/docs/{n}")), (("{n}.ts", 5, 0.94),),
        (("{n}.ts,example.com,{n},/docs/{n}",),),
    ),
    ("make it faster", (), (("Workspace", 0, 0.62),), (("",),)), ("Make the shopping cart responsive, including the checkout header", (), (("Cart", 3, 0.82),), (("",),)),
    ("Build a complete shop", (), (("Workspace", 0, 0.62),), (("",),)), ("why is the маршрут lost in {n}", (("name", 0, "{n}"),), (("{n}", 1, 0.94),), (("Router,route,app,addRoute,{n}",),)),
    ("which token does validateToken check, tokens or token_estimate", (("name", 0, "validateToken"), ("name", 1, "token_estimate")), (("validateToken", 2, 0.94),), (("verifyJwt,validateToken,token_estimate",),)),
)
TERMS = {"routing": ("route", "router", "маршрут", "ルーティング"), "auth": ("auth", "token", "входа"), "errors": ("error", "errors")}
SEEDS = {"routing": ("Router", "addRoute"), "auth": ("verifyJwt", "validateToken"), "errors": ("errorHandler",)}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir, ASKED, "prompt")


@query(expected_sql(numbered(ASKED, 1), "kind", "place", "name"))
def prompt_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and files of a prompt, in order."""
    told = asked(spark, sf_dir).select("path", A.identifiers("prompt").alias("name"), A.file_hints("prompt").alias("file"))
    each = told.select("path", F.explode(F.create_map(F.lit("name"), "name", F.lit("file"), "file")).alias("kind", "names"))
    return each.select("path", "kind", F.posexplode("names").alias("place", "name"))


@query(expected_sql(numbered(ASKED, 2), "entity", "concepts", "confidence"))
def task_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.signature(T.named(asked(spark, sf_dir))).select("path", "entity", F.size("concepts").alias("concepts"), "confidence")


@query(f"WITH {PROMPTS_SQL} SELECT conv_id, turn, {', '.join(f'{rule.sql} AS {name}' for name, rule in T.labels().items())} FROM prompts")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the words of each prompt decide: intent, technology, style, domain, goal, risk."""
    return prompts(spark, sf_dir).select("conv_id", "turn", *[rule.column.alias(name) for name, rule in T.labels().items()])


LOOKED_UP = "CASE intent " + " ".join(f"WHEN '{name}' THEN '{','.join(plan[0])}|{','.join(plan[1])}'" for name, plan in T.PLANS.items()) + " ELSE '' END"


@query(f"WITH {PROMPTS_SQL}, i AS (SELECT conv_id, turn, {T.chosen('prompt', T.QUERY_INTENTS, 'none').sql} AS intent FROM prompts) SELECT conv_id, turn, intent, {LOOKED_UP} AS plan FROM i WHERE intent <> 'none'")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each prompt that traces something looks for: concepts and kinds of edges."""
    told = T.named(prompts(spark, sf_dir)).select("conv_id", "turn", T.query_intent().alias("intent")).filter(F.startswith("intent", F.lit("trace")))
    joined = F.concat(F.array_join(T.looked_up(F.col("intent"), 0), ","), F.lit("|"), F.array_join(T.looked_up(F.col("intent"), 1), ","))
    return told.select("conv_id", "turn", "intent", joined.alias("plan"))


@query(expected_sql(numbered(ASKED, 3), "keywords"))
def assisted_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.assisted(T.named(asked(spark, sf_dir)), TERMS, SEEDS).select("path", F.array_join("keywords", ",").alias("keywords"))


def term_sql(words: tuple[str, ...]) -> str:
    return "regexp_matches(lower(prompt), '" + "|".join(f"(^|[^0-9_]){w}($|[^a-z0-9_]|_$|_[^a-z0-9])" for w in words) + "')"


SPOKEN = {"greeting": ("the", "and"), "place": ("der", "die"), "time": ("les", "des"), "thing": ("los", "las"), "router": ("router", "route"), "caller": ("callers", "calls this")}


@query(f"WITH {PROMPTS_SQL} SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {term_sql(words)} THEN '{name}' END" for name, words in SPOKEN.items()) + "], lambda x: x IS NOT NULL), ',') AS concepts FROM prompts")
def alias_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts whose terms stand in a prompt, by a table of terms."""
    return prompts(spark, sf_dir).select("conv_id", "turn", F.array_join(T.aliases("prompt", SPOKEN, SPOKEN)[0], ",").alias("concepts"))


def task_rows() -> list[tuple]:
    rows = []
    for k, (prompt, _, ((entity, _, _),), _) in enumerate(ASKED):
        if "complete" in prompt:
            rows += [(k, i, step, title, ",".join(after), ",".join(files)) for i, (step, title, after, files) in enumerate(T.STEPS)]
        else:
            rows.append((k, 0, "task_main", f"Execute: {entity}", "", f"{entity}.vue"))
    return rows


@query(expected_sql(task_rows(), "place", "step", "title", "after", "files"))
def task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's steps and what each waits for."""
    each = T.signature(T.named(asked(spark, sf_dir))).select("path", F.explode(T.steps()).alias("s"))
    return each.select("path", "s.place", "s.step", "s.title", F.array_join("s.after", ",").alias("after"), F.array_join("s.files", ",").alias("files"))


BORDERS = "|".join(rf"\b{b}\b" for b in A.CLAUSE_BORDERS)
TRIM = r"'^\s+|\s+$', '', 'g'"


@query(rf"""WITH t AS (SELECT item_id, text || ', and how so including ' || text AS p FROM benchmark),
c AS (SELECT item_id, list_filter(list_transform(string_split_regex(p, '(?i)\s*(?:,\s*)?(?:{BORDERS})\s*'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, {TRIM}), '^[,.;:]+|[,.;:]+$', '', 'g'), {TRIM})), lambda x: strlen(x) >= 8) AS c FROM t)
SELECT item_id, CAST(i - 1 AS INT) AS place, c[i] AS clause FROM (SELECT item_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)""")
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat("text", F.lit(", and how so including "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(A.clauses(told)).alias("place", "clause"))


@query(f"""SELECT item_id, array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')),
lambda w: length(w) >= 5 AND NOT contains(w, '__') AND lower(w) NOT IN ({quoted(A.STOP_WORDS + A.FILLER_WORDS)})), lambda w: {{'n': -length(w), 'w': w}})), 1, 4), lambda s: s.w), ',') AS nouns FROM benchmark""")
def cluster_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(A.nouns("text"), ",").alias("nouns"))


GENES = "folds, docs, depth, boost"


def bred_sql(name: str, generation: int, before: str) -> str:
    moved = f"(pos + {generation}) % 100 / 100.0 < 0.2"
    delta = f"(CASE WHEN (pos + {generation}) % 2 = 0 THEN 1 ELSE -1 END)"
    gene = lambda g, child, step, low, high: f"CASE WHEN pos < 2 THEN {g} WHEN {moved} THEN greatest({low}, least({high}, {child} + {delta} * {step})) ELSE {child} END AS {g}"
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fitness DESC, place) - 1 AS pos, least(4, count(*) OVER (PARTITION BY run)) AS n FROM {before}),
{name}_b AS (SELECT r.*, a.folds AS af, b.folds AS bf, a.docs AS ad, b.docs AS bd, a.depth AS ae, b.depth AS be, a.boost AS ab, b.boost AS bb FROM {name}_r r JOIN {name}_r a ON r.run = a.run AND a.pos = r.pos % r.n JOIN {name}_r b ON r.run = b.run AND b.pos = (r.pos + 1) % r.n),
{name} AS (SELECT run, pos AS place, {gene('folds', '((af + bf) // 2)', 1, 2, 15)}, {gene('docs', '((ad + bd) / 2)', '0.05::DOUBLE', '0.1::DOUBLE', '1.0::DOUBLE')}, CASE WHEN pos < 2 THEN depth ELSE greatest(ae, be) END AS depth,
{gene('boost', '((ab + bb) / 2)', '0.1::DOUBLE', '0.5::DOUBLE', '3.0::DOUBLE')}, CASE WHEN pos < 2 THEN fitness ELSE 0.0::DOUBLE END AS fitness FROM {name}_b)"""


@query(f"""WITH g0 AS (SELECT CAST(c_nationkey AS BIGINT) AS run, c_custkey AS place, 3 + (c_custkey + 42) % 7 AS folds, 0.5 + ((c_custkey + 42) * 1103515245 + 12345) % 100 / 100::DOUBLE * 0.5 AS docs, 1 + (c_custkey + 42) % 3 AS depth,
1.0 + ((c_custkey + 42) * 1664525 + 1013904223) % 100 / 100::DOUBLE AS boost, c_custkey * 37 % 101 / 100::DOUBLE AS fitness FROM customer), {bred_sql('g1', 1, 'g0')}, {bred_sql('g2', 2, 'g1')}
SELECT run, place, folds, round(docs, 6) AS docs, depth, round(boost, 6) AS boost, fitness FROM g2""")
def fold_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of folding parameters, a population for each nation."""
    key = F.col("c_custkey")
    population = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("run"), key.alias("place"), *M.random_folding(key + 42), (F.pmod(key * 37, F.lit(101)) / 100.0).alias("fitness"))
    last = M.next_generation(M.next_generation(population, 1), 2)
    return last.select("run", "place", "folds", F.round("docs", 6).alias("docs"), "depth", F.round("boost", 6).alias("boost"), "fitness")


#: Answers of an outside search, with their hits: path, label, name.
ANSWERS = (
    ('{"groups": [{"file": "src\\\\{n}.rs", "prefix": "shop", "rows": [{"name": "sell", "label": "Function"}, ["buy", "Method"], {"qn": "a.b", "file": "c/{n}.ts"}, 7]}], "results": [{"name": "no"}]}', (("src/{n}.rs", "Function", "shop.sell"), ("src/{n}.rs", "Method", "shop.buy"), ("c/{n}.ts", "Symbol", "a.b"))),
    ('{"results": [{"name": "{n}", "label": "Class", "file": "x/{n}.py"}, {"label": "none"}]}', (("x/{n}.py", "Class", "{n}"),)), ('{"groups": [{"path": "p.go", "rows": [["{n}"]]}]}', (("p.go", "Symbol", "{n}"),)),
    ('{"cols": ["qn", "name", "file", "label"], "rows": [["", "{n}", "a\\\\b.rs", ""], ["q.{n}", "z", "c.rs", "Function"], ["r", "r", "d.rs", "Route"], ["s", "s", "", "Class"]]}', (("a/b.rs", "Symbol", "{n}"), ("c.rs", "Function", "q.{n}"))), ("not json", ()), ("{}", ()),
)
TREES = (("src/{n}.rs\n  sell Function 3\n\n  buy\nlib\\\\x/{n}.ts\n  Cart Class\n", (("src/{n}.rs", "Function", "sell"), ("lib//x/{n}.ts", "Class", "Cart"))), ("{n} Class", (("unknown", "Class", "{n}"),)), ("", ()), ("a/b.go\n x y z", (("a/b.go", "y", "x"),)))


@query("SELECT path AS id, home AS path, label, name FROM (" + expected_sql([(k, *row) for k, *row in numbered(ANSWERS, 1)], "home", "label", "name").replace("file_id % 4 =", f"file_id % {len(ANSWERS)} =") + ")")
def outside_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.hits(filled(spark, sf_dir, ANSWERS, "answer").withColumnRenamed("path", "id"))


@query("SELECT path AS id, home AS path, label, name FROM (" + expected_sql(numbered(TREES, 1), "home", "label", "name") + ")")
def outside_tree_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tree_hits(filled(spark, sf_dir, TREES, "answer").withColumnRenamed("path", "id"))


#: Files with the types they declare: name, kind, signature, exported.
TYPED = (
    ("src/{n}.ts", "export interface {n} { a: string }\ntype B = 1\n  enum C {}\nconst type = 2\nexport type B = 3", (("{n}", "interface", "export interface {n}", "yes"), ("B", "type", "export type B", "yes"), ("C", "enum", "enum C", "no"))),
    ("src/{n}.rs", "pub struct {n};\nenum E { A }\nfn f() {}\npub trait T {}", (("{n}", "struct", "pub struct {n}", "yes"), ("E", "enum", "enum E", "no"), ("T", "trait", "pub trait T", "yes"))), ("{n}.go", "type X struct {}", ()),
    ("a/{n}.py", "class {n}(Base, Other):\n    x = 1\nclass Plain:\n  class Inner:\nclass_x = 1", (("{n}", "class", "class {n}(Base, Other):", "yes"), ("Plain", "class", "class Plain:", "yes"), ("Inner", "class", "class Inner:", "yes"))),
)


@query(expected_sql([(k, TYPED[k][0], *row) for k, *row in numbered(TYPED, 2)], "home", "name", "kind", "signature", "exported").replace("CAST(file_id AS VARCHAR) AS path, ", "").replace(" AS home,", " AS path,"))
def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.types(filled(spark, sf_dir, TYPED, "path", "content")).withColumn("exported", F.when(F.col("exported"), "yes").otherwise("no"))


STEM_SQL = "regexp_extract(file_path, '([^/]*)\\.[^./]*$', 1)"


@query(f"""WITH {NODES_SQL}, {EDGES_SQL}, s AS (SELECT *, {STEM_SQL} AS base, CASE WHEN access_count > 1 THEN 'said' ELSE '' END AS doc, CASE WHEN token_cost % 2 = 0 THEN '(' || token_cost || ')' END AS signature FROM nodes WHERE node_type <> 'File'),
c AS (SELECT target AS id, count(*) AS n FROM edges WHERE edge_type = 'Calls' GROUP BY 1),
r AS (SELECT s.*, CASE node_type WHEN 'Function' THEN 10 WHEN 'Class' THEN 10 WHEN 'Api' THEN 9 WHEN 'Config' THEN 7 ELSE 4 END + CASE WHEN lower(name) = lower(base) THEN 8 WHEN contains(lower(base), lower(name)) OR contains(lower(name), lower(base)) THEN 4 ELSE 0 END
+ CASE WHEN doc <> '' THEN 2 ELSE 0 END + CASE WHEN signature IS NOT NULL THEN 1.5 ELSE 0 END + least(coalesce(n, 0), 8) * 0.5 AS score FROM s LEFT JOIN c USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS place, CASE node_type WHEN 'Function' THEN 'fn ' WHEN 'Class' THEN 'class ' WHEN 'Api' THEN 'api ' WHEN 'Config' THEN 'config ' ELSE 'sym ' END || name || coalesce(' ' || signature, '') AS line FROM r),
f AS (SELECT DISTINCT file_path, {STEM_SQL} AS base FROM nodes)
SELECT file_path, file_path || ' [' || base || ']' AS title, base || chr(10) || 'Holds ' || base || '.' || coalesce((SELECT string_agg(chr(10) || line, '' ORDER BY place) FROM k WHERE k.file_path = f.file_path AND place <= 16), '') AS body FROM f""")
def file_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = nodes(spark, sf_dir)
    base = F.regexp_extract("file_path", r"([^/]*)\.[^./]*$", 1)
    symbols = held.filter("node_type <> 'File'").withColumn("doc", F.when(F.col("access_count") > 1, "said").otherwise("")).withColumn("signature", F.when(F.col("token_cost") % 2 == 0, F.concat(F.lit("("), F.col("token_cost").cast("string"), F.lit(")"))))
    told = held.select("file_path", F.concat(F.lit("Holds "), base, F.lit(".")).alias("doc")).distinct()
    return O.passages(told, symbols, edges(spark, sf_dir).filter("edge_type = 'Calls'"))


KEYED = "c_custkey AS k FROM customer"


@query(f"""WITH n AS (SELECT 'order:' || o_orderkey AS id, 'order_' || o_orderkey AS name FROM orders), t AS (SELECT {KEYED}),
a AS (SELECT k, 'order_' || k AS query, 1.0 AS energy, 'identifier' AS reason, 0 AS place, 0 AS step FROM t WHERE k % 4 = 0 UNION ALL SELECT k, 'order_' || (k + 1), 1.0, 'identifier', 1, 0 FROM t WHERE k % 4 = 0
UNION ALL SELECT k, 'order_' || (k + 2), 0.8, 'client_keyword', 2, 0 FROM t WHERE k % 4 IN (0, 1) UNION ALL SELECT k, 'order_' || (k + 3), 0.8 / 1.08, 'client_keyword', 3, 0 FROM t WHERE k % 4 IN (0, 1) UNION ALL SELECT k, 'order_' || (k + 4), 0.5, 'client_expansion', 4, 0 FROM t WHERE k % 4 IN (0, 1)
UNION ALL SELECT k, 'nation', 0.5, 'never', 0, 9 FROM t WHERE FALSE),
f AS (SELECT k, id, energy, reason || ':' || query AS reason, place FROM a JOIN n ON lower(query) = lower(name)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY energy DESC, place) AS rank FROM f)
SELECT k AS task, CAST(rank AS INT) AS rank, id, round(energy, 6)::DOUBLE AS energy, reason FROM r WHERE rank <= 5
UNION ALL SELECT k, 1, 'order:' || o_orderkey, 0.5, 'fallback:ORDER_' || o_orderkey FROM t JOIN orders ON o_orderkey = k + 7 WHERE k % 4 = 3""")
def seed_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for orders: by name, by their client's words, for nothing, and in capitals, that only the last step reads."""
    k = F.col("c_custkey")
    order = lambda d, word="order_": F.concat(F.lit(word), (k + d).cast("string"))
    kind = F.pmod(k, F.lit(4))
    prompt = F.when(kind == 0, F.concat(F.lit("Fix "), order(0), F.lit(" and "), order(1))).when(kind == 1, "explain why it is late").when(kind == 2, "explain why they are late").otherwise(F.concat(F.lit("is it 1, 2, 3, 4, 5 or 6, or "), order(7, "ORDER_")))
    client, none = kind < 2, F.array().cast("array<string>")
    tasks = table(spark, sf_dir, "customer").select(k.alias("task"), prompt.alias("prompt"), F.when(client, F.array(order(2), order(3))).otherwise(none).alias("keywords"), F.when(client, F.array(order(4))).otherwise(none).alias("expansion"), none.alias("path_hints"), none.alias("entity_types"))
    return S.seeds(T.signature(T.named(tasks)), nodes(spark, sf_dir).filter("node_type = 'Function'"), "hybrid")
