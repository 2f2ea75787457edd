"""What other programs answer: hits of an outside search, as JSON or as a text tree; and passages and types of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.predicates import stem

ANSWER = "groups array<struct<file:string,path:string,prefix:string,rows:array<string>>>, results array<string>, cols array<string>, rows array<array<string>>"
ROW = "name string, qn string, label string, file string"
# Bounds of a passage, what kinds of symbols are called and weigh in it, names that an error file is about.
MOST_LINES, MOST_DOC, MOST_SIGNATURE, MOST_CALLERS = 16, 480, 220, 8
CALLED = {"Function": "fn", "Class": "class", "Component": "component", "Api": "api", "Config": "config", "Test": "test", "DbModel": "model"}
WEIGHS = {"Function": 10.0, "Class": 10.0, "Component": 10.0, "Api": 9.0, "DbModel": 7.0, "Config": 7.0, "Test": 2.0, "Symbol": 4.0}
ERROR_NAMES = ("seterrorhandler", "serializeerror", "errorhandler")
#: Words that declare a type, by the language of a file's ending, and the word that exports it.
TYPE_WORDS = {("ts", "tsx", "vue"): ("export", ("interface", "type", "enum"), "[A-Za-z0-9_$]+"), ("rs",): ("pub", ("struct", "enum", "trait", "type"), "[A-Za-z0-9_]+")}


def slashed(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def hits(answers: DataFrame) -> DataFrame:
    """answers (id, answer: JSON): (id, path, label, name) of grouped hits; without any, of listed ones; without those, of a table's
    rows, whose hits need a path and are no routes. Rows are objects, or lists of name and label; others are left out."""
    read = answers.select("id", F.from_json("answer", ANSWER).alias("a"))
    file = slashed(F.coalesce("g.file", "g.path", F.lit("unknown")))
    grouped = read.select("id", F.explode("a.groups").alias("g")).select("id", F.lit(0).alias("tier"), file.alias("file"), F.coalesce("g.prefix", F.lit("")).alias("prefix"), F.explode("g.rows").alias("row"))
    listed = read.select("id", F.lit(1).alias("tier"), F.lit("unknown").alias("file"), F.lit("").alias("prefix"), F.explode("a.results").alias("row"))
    rows = grouped.unionByName(listed).withColumn("o", F.from_json("row", ROW)).withColumn("l", F.from_json("row", "array<string>"))
    is_object, prefix = F.startswith("row", F.lit("{")), F.col("prefix")
    name = F.when(is_object, F.coalesce("o.name", "o.qn")).otherwise(F.try_element_at("l", F.lit(1)))
    label = F.coalesce(F.when(is_object, F.col("o.label")).otherwise(F.try_element_at("l", F.lit(2))), F.lit("Symbol"))
    full = F.when((prefix == "") | (is_object & F.contains(name, F.lit("."))), name).otherwise(F.concat(prefix, F.lit("."), name))
    path = F.when(is_object, slashed(F.coalesce("o.file", "file"))).otherwise(F.col("file"))
    told = rows.select("id", "tier", path.alias("path"), label.alias("label"), full.alias("name"))

    cell = lambda c: F.nullif(F.try_element_at("r", F.array_position("a.cols", c).cast("int")), F.lit(""))
    known = lambda c: F.when(F.array_contains("a.cols", c), cell(c))
    table = read.select("id", "a", F.explode("a.rows").alias("r")).select("id", F.lit(2).alias("tier"), slashed(F.coalesce(known("file"), F.lit(""))).alias("path"), F.coalesce(known("label"), F.lit("Symbol")).alias("label"), F.coalesce(known("qn"), known("name")).alias("name"))
    table = table.filter(~F.col("path").isin("", "unknown") & (F.lower("label") != "route") & ~F.contains("name", F.lit("__route__")))
    every = told.unionByName(table).filter("name IS NOT NULL")
    return every.withColumn("first", F.min("tier").over(W.partitionBy("id"))).filter("tier = first").select("id", "path", "label", "name")


def tree_hits(answers: DataFrame) -> DataFrame:
    """answers (id, answer: lines): (id, path, label, name). A line with a slash and no blank names the file of those below it; others
    are a name and a label."""
    lines = answers.select("id", F.posexplode(F.split("answer", "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    is_file = F.contains("line", F.lit("/")) & ~F.contains("line", F.lit(" "))
    above = W.partitionBy("id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("path", F.coalesce(F.last(F.when(is_file, slashed(F.col("line"))), True).over(above), F.lit("unknown")))
    words = F.split("line", r"\s+")
    return placed.filter(~is_file & (F.size(words) >= 2)).select("id", "path", words[1].alias("label"), words[0].alias("name"))


def types(sources: DataFrame) -> DataFrame:
    """sources (path, content): (path, name, kind, signature, exported) of the types that TypeScript, Rust and Python files declare, by
    lines; of a name's declarations the last counts."""
    lines = sources.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    ending, line = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    python = r"^(class\s+([A-Za-z0-9_]+)(?:\([^)]+\))?:)"
    found = F.when(ending == "py", F.struct(F.regexp_extract(line, python, 2).alias("name"), F.lit("class").alias("kind"), F.regexp_extract(line, python, 1).alias("signature"), F.lit(True).alias("exported")))
    for endings, (export, words, name) in TYPE_WORDS.items():
        rule = rf"^((?:({export})\s+)?({'|'.join(words)})\s+({name}))"
        part = lambda i, rule=rule: F.regexp_extract(line, rule, i)
        found = F.when(ending.isin(*endings), F.struct(part(4).alias("name"), part(3).alias("kind"), part(1).alias("signature"), (part(2) != "").alias("exported"))).otherwise(found)
    told = lines.select("path", "at", found.alias("t")).filter("t.name <> ''")
    return told.groupBy("path", "t.name").agg(F.max_by("t", "at").alias("t")).select("path", "t.name", "t.kind", "t.signature", "t.exported")


def shortened(text: Column, most: int, mark: str = "") -> Column:
    """At most so many characters, cut at the last blank before."""
    cut = F.substring(text, 1, most)
    whole = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(whole), F.lit(mark)))


def lookup(kind: str, table: dict, otherwise: object) -> Column:
    column = F.lit(otherwise)
    for name, value in table.items():
        column = F.when(F.col(kind) == name, value).otherwise(column)
    return column


def passages(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """files (file_path, doc), symbols (id, node_type, name, file_path, signature, doc), calls (source, target): (file_path, title, body).

    A body is the file's stem, its doc, and a line for each of its sixteen best symbols: those of weighty kinds, named like the
    file, with docs, signatures and callers. Callers are counted first; symbols are cut by file before their lines meet.
    """
    base = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    callers = calls.select("source", "target").groupBy("target").agg(F.count(F.lit(1)).alias("callers")).withColumnRenamed("target", "id")
    held = symbols.filter(F.col("node_type").isin(*WEIGHS)).join(callers, "id", "left")
    low, of_file, path = F.lower("name"), stem("file_path"), F.lower("file_path")
    said = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "")
    score = lookup("node_type", WEIGHS, 4.0) * F.when(F.contains(path, F.lit("/types/")) | F.endswith(path, F.lit(".d.ts")), 0.45).otherwise(1.0)
    score = score + F.when(F.contains(base("file_path"), F.lit("error")) & low.isin(*ERROR_NAMES), 6.0).otherwise(0.0)
    score = score + F.when(of_file == "", 0.0).when(low == of_file, 8.0).when(F.contains(of_file, low) | F.contains(low, of_file), 4.0).otherwise(0.0)
    score = score + F.when(said("doc"), 2.0).otherwise(0.0) + F.when(said("signature"), 1.5).otherwise(0.0) + F.least(F.coalesce("callers", F.lit(0)), F.lit(MOST_CALLERS)) * 0.5
    line = shortened(F.trim(F.concat_ws(" ", lookup("node_type", CALLED, "sym"), "name", F.trim("signature"))), MOST_SIGNATURE, "…")
    place = F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    best = held.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= MOST_LINES)
    told = best.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))  # sixteen a file
    name = base("file_path")
    title = F.when(F.contains("file_path", F.lit("/lib/")) & (name != ""), F.concat(F.lit("lib/"), name, F.lit(" implementation "), "file_path")).when(name == "", F.col("file_path")).otherwise(F.concat("file_path", F.lit(" ["), name, F.lit("]")))
    doc = shortened(F.trim(F.coalesce("doc", F.lit(""))), MOST_DOC)
    parts = F.filter(F.concat(F.array(name, doc), F.coalesce(F.col("lines.line"), F.array().cast("array<string>"))), lambda x: x != "")
    return files.join(told, "file_path", "left").select("file_path", title.alias("title"), F.array_join(parts, "\n").alias("body"))
