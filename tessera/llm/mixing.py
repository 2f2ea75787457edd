"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source whose target is x times its size takes each document floor(x) times for sure and
once more with the fractional probability. Those probabilities are rounded dependently: of two
documents, words' worth of probability moves from one to the other, up or down at random such
that the expectation stays, until one of the two is at 0 or 1; the other goes on to the next.
Documents meet in blocks of about BLOCK within a source, and what a block leaves (one document
at most) meets the others' leftovers in the next level of a reduction tree. In a source's last
level the largest documents come first, and each meets all the smaller ones as one partner: mass
moves between it and them, in shares that are the same in both directions, until it or half of
them are integral. So a document that is a large part of its source is settled by chance too, and
its words are made up for by many others. The last leftover of a source takes the nearer of 0 and 1, so its taken words differ from its target by half of that
document's size at most, whatever the source's size.

Blocks are dealt by a hash of the document, so a source with a third of all rows is many tasks,
and reruns agree.

Defined results: a null text has no words; a null source is a source, last in order; a document
of no words is taken 0 times; a null id is an id; repeated rows are documents of their own and
are told apart by a number; an empty table gives an empty result; extra columns of any name are
ignored, and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import fresh, pick, sized, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Documents that meet in one block of the tree, about.
BLOCK = 32
#: Of each source about so many documents, dealt by hash, wait for the last level: the short ones among them meet last
#: and leave a short leftover.
RESERVE = 256
#: So many of the largest documents of a source's last level meet all smaller ones there as one partner.
POOLED = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized_docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, n, target. Rows of `sized_docs`: source, size.

    Targets are weight shares of `share` times all sizes, filled up to `most` times the source's own size: with sources
    in order of that limit per unit of weight, all before the first that stays below its limit are at theirs.
    """
    by_source = sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    view = by_source.sparkSession
    listed = ", ".join(f"{w}D" for w in weights)
    return view.sql(
        f"""
        WITH ordered AS (
          SELECT *, {float(most)}D * source_size AS cap,
            array({listed})[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} AS INT)] AS weight,
            {float(share)}D * sum(source_size) OVER () AS total
          FROM {{by_source}}
        ), filled AS (
          SELECT *, cap / weight AS ratio,
            (total - coalesce(sum(cap) OVER before, 0D)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0D)) AS level
          FROM ordered
          WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), levelled AS (
          SELECT *, min_by(IF(ratio > level, level, NULL), IF(ratio > level, struct(ratio, source IS NULL, source), NULL)) OVER () AS water FROM filled
        )
        SELECT source, source_size, n, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM levelled
        """,
        by_source=by_source,
    )


#: One meeting: acc.c is the document that carries on, x the next one; p is the probability, s the size.
_MEET = """
aggregate(slice(items, 2, size(items)), named_struct('c', items[0], 'done', slice(items, 1, 0)), (acc, x) ->
  CASE WHEN acc.c.p <= 0D OR acc.c.p >= 1D THEN named_struct('c', x, 'done', concat(acc.done, array(acc.c)))
  ELSE transform(array(named_struct(
      'up', least((1D - acc.c.p) * acc.c.s, x.p * x.s), 'down', least(acc.c.p * acc.c.s, (1D - x.p) * x.s),
      'u', pmod(xxhash64(acc.c.doc_id, acc.c.k, acc.c.s, x.doc_id, x.k, x.s, {seed}), 1073741824L) / 1073741824D)), m ->
    transform(array(IF(m.u * (m.up + m.down) < m.down,
        named_struct('c', acc.c.p + m.up / acc.c.s, 'x', x.p - m.up / x.s),
        named_struct('c', acc.c.p - m.down / acc.c.s, 'x', x.p + m.down / x.s))), q ->
      transform(array(named_struct(
          'c', named_struct('s', acc.c.s, 'h', acc.c.h, 'doc_id', acc.c.doc_id, 'k', acc.c.k, 'p', CASE WHEN q.c < 1e-11D THEN 0D WHEN q.c > 1D - 1e-11D THEN 1D ELSE q.c END),
          'x', named_struct('s', x.s, 'h', x.h, 'doc_id', x.doc_id, 'k', x.k, 'p', CASE WHEN q.x < 1e-11D THEN 0D WHEN q.x > 1D - 1e-11D THEN 1D ELSE q.x END))), e ->
        IF(e.c.p <= 0D OR e.c.p >= 1D,
          named_struct('c', e.x, 'done', concat(acc.done, array(e.c))),
          named_struct('c', e.c, 'done', concat(acc.done, array(e.x)))))[0])[0])[0]
  END,
  acc -> concat(acc.done, array(acc.c)))
"""


def pooled(items: Column, seed: int) -> Column:
    """Items by size: each of the first ones meets all after it as one partner. Those give or take in proportion to the
    smaller of p and 1 - p, the same share in both directions, so every expectation stays."""

    def spare(x: Column) -> Column:
        return F.least(x["p"], 1 - x["p"])

    def moved(x: Column) -> Column:
        up, down = F.least((1 - x["c"]["p"]) * x["c"]["s"], x["rest"]), F.least(x["c"]["p"] * x["c"]["s"], x["rest"])
        chance = F.pmod(F.xxhash64(x["c"]["doc_id"], x["c"]["k"], x["c"]["s"], F.lit(seed + 3)), F.lit(1 << 30)) / (1 << 30)
        return F.struct(F.when(chance * (up + down) < down, up).otherwise(-down).alias("by"), x["rest"].alias("rest"))

    def settled(p: Column) -> Column:
        return F.when(p < 1e-11, 0.0).when(p > 1 - 1e-11, 1.0).otherwise(p)

    def meet(xs: Column, at: Column) -> Column:
        rest = F.aggregate(F.slice(xs, at + 2, F.size(xs)), F.lit(0.0), lambda total, x: total + spare(x) * x["s"])
        move = F.transform(F.array(F.struct(F.element_at(xs, at + 1).alias("c"), rest.alias("rest"))), moved)

        def apply(m: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                p = F.when(i == at, x["p"] + m["by"] / x["s"]).when((i > at) & (m["rest"] > 0), x["p"] - m["by"] / m["rest"] * spare(x)).otherwise(x["p"])
                return F.struct(x["s"], x["h"], x["doc_id"], x["k"], settled(p).alias("p"))

            return F.transform(xs, one)

        return F.when(at + 1 < F.size(xs), F.transform(move, apply)[0]).otherwise(xs)

    return F.aggregate(F.sequence(F.lit(0), F.lit(POOLED - 1)), items, meet)


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies, k (a number among equal rows)."""
    docs = pick(df, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    counted = written(docs.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    rows = counted.select("source", "doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("k"))
    aims = written(targets(rows, weights, share, most), "mix-targets")
    most_docs = aims.agg(F.max("n")).first()[0] or 0
    aim = aims.select(F.col("source").alias("_source"), "source_size", "target", "n")
    joined = rows.join(sized(aim), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wished = joined.select(
        "source", "doc_id", "size", "k", "n", "source_size",
        F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("x"),
    ).withColumn("sure", F.floor("x")).withColumn("p", F.col("x") - F.col("sure"))
    fractional = wished.filter("p > 1e-11 AND p < 1 - 1e-11").select(
        "source",
        F.expr(f"pmod(xxhash64(doc_id, size, k, {seed + 2}), n) < {RESERVE}").alias("waits"),
        F.expr(f"pmod(xxhash64(doc_id, size, k, {seed}), CAST(ceil(n / {BLOCK}) AS BIGINT))").alias("block"),
        F.expr(f"named_struct('s', CAST(size AS DOUBLE), 'h', xxhash64(doc_id, size, k, {seed + 1}), 'doc_id', doc_id, 'k', k, 'p', p)").alias("item"),
    )
    open_rows = fractional.filter("NOT waits").drop("waits")
    levels, blocks = [], -(-most_docs // BLOCK)
    while True:
        if blocks <= 1:
            open_rows = open_rows.select("source", "item").unionByName(fractional.filter("waits").select("source", "item")).withColumn("block", F.lit(0).cast("long"))
        # bounded: a block has about BLOCK documents or leftovers; larger documents settle first
        met = open_rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        if blocks <= 1:
            met = met.withColumn("items", pooled(F.col("items"), seed))
        level = written(met.select("source", "block", F.explode(F.expr(_MEET.replace("{seed}", str(seed)))).alias("item")), "mix-level")
        last = blocks <= 1
        settled = level if last else level.filter("item.p <= 0 OR item.p >= 1")
        levels.append(settled.select("source", "item.doc_id", F.col("item.s").cast("long").alias("size"), "item.k", F.round("item.p").cast("long").alias("extra")))
        if last:
            break
        open_rows = level.filter("item.p > 0 AND item.p < 1").select("source", F.expr(f"block div {BLOCK}").alias("block"), "item")
        blocks = -(-blocks // BLOCK)
    rounded = levels[0]
    for level in levels[1:]:
        rounded = rounded.unionByName(level)
    plain = wished.filter("NOT (p > 1e-11 AND p < 1 - 1e-11)").select("source", "doc_id", "size", "k", F.round("p").cast("long").alias("extra"))
    done = rounded.unionByName(plain).join(sized(aim), F.col("source").eqNullSafe(F.col("_source")))
    copies = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("source_size")) + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return done.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies", "k"
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns."""
    size, row, words, copies, copy, id_, source, k = fresh(df, "size", "row", "words", "copies", "copy", "id", "source_of", "k")
    taken = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter("copies > 0")
    taken = written(taken.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(words), F.col("k").alias(k), F.col("copies").alias(copies)), "mix-copies")
    rows = df.withColumn(size, word_count(df[f"`{text_col}`"]))
    if taken.filter(F.col(k) > 1).isEmpty():
        rows = rows.withColumn(row, F.lit(1).cast("long"))
    else:
        rows = rows.withColumn(row, F.row_number().over(W.partitionBy(f"`{id_col}`", f"`{source_col}`", size).orderBy(f"`{text_col}`")).cast("long"))
    on = rows[f"`{id_col}`"].eqNullSafe(taken[id_]) & rows[f"`{source_col}`"].eqNullSafe(taken[source]) & (rows[size] == taken[words]) & (rows[row] == taken[k])
    # one row of `taken` for each document: always a join of two shuffled sides
    joined = rows.join(taken.hint("merge"), on)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select([rows[f"`{c}`"] for c in df.columns])
