"""A workspace's files and prompts as rows of the driver's tables: a file for each part, a prompt for each turn of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

FOLDERS = (
    "src/core", "crates/engine/benches", "packages/bench", "src/locales", "app/i18n", "tests", "examples/basic", "testdata", "src/v3", "src/legacy", "src/mini", "lib/lite", "database/migrations", "database/seeders",
    "db/factories", "sql", "apps/com_shop/src", "apps/com_blog/view", "web/styles", "editors/vscode", "docs", "src/types", "src/middleware", "src/routes", "src/auth/session", "src/models", "config", "web/json-schema", "src/core/bench", "web/promo", "src/stores/cart", "node_modules/left", "target/debug", "src/bin",
)
ENDINGS = (".rs", ".ts", ".sql", ".scss", ".md", ".d.ts", ".vue", ".json", ".py", "_test.go", ".less", "_tokens.css", ".toml")
PHRASES = (
    "explain the router", "write a migration for orders", "run the benchmark", "translate the locale files", "keep the legacy compat layer", "shrink the minified build", "export the json schema", "infer the generic type parameter",
    "the vscode plugin crashes", "who calls this", "show the call graph of callers", "fix the wrong total", "create table for parts", "scss mixins and tokens", "add a seeder", "list all references across crates", "which middleware checks auth",
    "why does the session cookie break", "render the template", "refactor and rename the model", "trace the callers", "a slim lightweight app", "drop unused sql views", "the plugin error handler", "validate the content type parser", "store auth config",
)

SYMBOLS = (
    "AuthMiddleware", "routerMain", "sessionStore", "renderTemplate", "restoreAll", "UserRepository", "validateSchema", "pluginLoader", "contentTypeParser", "errorHandler", "staticAsset", "plainThing", "authenticate", "shopRoute",
    "appSettings", "cookie.jar", "dataModel",
)


def chosen(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def listed(values: tuple[str, ...], number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({number} % {len(values)} + 1 AS INT)]"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_id, name, path, prompt): a file for each part and what somebody asks about it."""
    key = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.concat(chosen(FOLDERS, key), F.lit("/"), name, chosen(ENDINGS, F.floor(key / len(FOLDERS))))
    return table(spark, sf_dir, "part").select(key.alias("path_id"), name.alias("name"), path.alias("path"), chosen(PHRASES, F.floor(key / 7)).alias("prompt"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, symbol, prompt): a symbol of each file."""
    word = chosen(SYMBOLS, F.col("path_id"))
    named = F.when(F.pmod("path_id", F.lit(2)) == 0, F.concat(word, F.lit("_"), "name")).otherwise(F.concat("name", F.lit("_"), word))
    return files(spark, sf_dir).select(F.col("path_id").alias("id"), named.alias("symbol"), "prompt")


def file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): each file calls the next one and the one at half its number."""
    ids = files(spark, sf_dir).select(F.col("path_id").alias("a"))
    steps = ids.select("a", F.explode(F.array(F.col("a") + 1, F.floor(F.col("a") / 2))).alias("b")).filter("a <> b")
    return steps.join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b").distinct()


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, prompt)"""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), chosen(PHRASES, F.col("conv_id") + F.col("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("prompt"))


FILES_SQL = f"""
files AS (
  SELECT p_partkey AS path_id, replace(p_name, ' ', '_') AS name,
    {listed(FOLDERS, 'p_partkey')} || '/' || replace(p_name, ' ', '_') || {listed(ENDINGS, f'(p_partkey // {len(FOLDERS)})')} AS path, {listed(PHRASES, '(p_partkey // 7)')} AS prompt FROM part
)"""
PROMPTS_SQL = f"""
prompts AS (
  SELECT conv_id, turn, coalesce(text, '') || ' ' || {listed(PHRASES, '(conv_id + turn)')} AS prompt FROM conversations
)"""
SYMBOLS_SQL = f"""
symbols AS (
  SELECT path_id AS id, CASE path_id % 2 WHEN 0 THEN {listed(SYMBOLS, 'path_id')} || '_' || name ELSE name || '_' || {listed(SYMBOLS, 'path_id')} END AS symbol, prompt FROM files
)"""
FILE_EDGES_SQL = """
steps AS (
  SELECT DISTINCT a, b FROM (SELECT path_id AS a, unnest([path_id + 1, path_id // 2]) AS b FROM files) WHERE a <> b AND b IN (SELECT path_id FROM files)
)"""
