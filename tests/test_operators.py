"""Operators that SQL can't restate, sources, sinks and streams."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import tasks as T2
from tessera.functions import text as T
from tessera.operators import graph as G
from tessera.operators import learning as L
from tessera.operators import outside as X
from tessera.operators import overlays as O
from tessera.operators import parse as P
from tessera.operators import source as S
from tessera.sources.scratch import Store
from tessera.operators import vector as V
from tessera.plans import graph as graph_plans
from tessera.plans import select
from tessera.sources import files, snapshot
from tessera.streaming import state

EVENTS = [(i, dt.datetime(2024, 1, 1, 0, 0, i % 40), i % 3, ["reinforce", "penalise", "evaporate"][i * 7 % 3]) for i in range(120)]


def plain_fold(events):
    out = {}
    for seq, ts, key, kind in sorted(events, key=lambda e: (e[1], e[0])):
        w = out.get(key, 0.5)
        w = w + 0.15 if kind == "reinforce" else w - 0.10 if kind == "penalise" else w * 0.98
        out[key] = min(max(w, 0.05), 1.0)
    return out


@pytest.mark.parametrize("block", [10_000, 7])
def test_clamped_folds_compose(spark, block):
    df = spark.createDataFrame(EVENTS, "seq long, ts timestamp, key long, kind string")
    got = {r.key: r.weight for r in L.pheromone_fold(df, block=block).collect()}
    assert got == pytest.approx(plain_fold(EVENTS), abs=1e-6)


def test_physarum_keeps_the_only_path_and_drops_dead_ends():
    edges = [("a", "b", 0.5), ("b", "c", 0.5), ("b", "dead", 0.5)]
    tube = G.physarum(["a", "b", "c", "dead"], edges, ["a", "c"])
    assert set(tube) == {("a", "b"), ("b", "c")} and tube["a", "b"] == pytest.approx(tube["b", "c"], rel=1e-3)
    assert G.physarum([str(i) for i in range(300)], edges, ["a"]) == {}


def nation_edges(spark, people: int):
    """cust:1, cust:2 and others of one nation in one region."""
    rows = [(f"cust:{i}", "nation:1", "DependsOn", 0.5) for i in range(1, people + 1)] + [("region:1", "nation:1", "Contains", 1.0)]
    df = spark.createDataFrame(rows, "source string, target string, edge_type string, weight double")
    return df.select(F.concat_ws(">", "source", "target").alias("id"), "*", F.lit("proven").alias("state"))


@pytest.mark.parametrize("people", [20, 240, 260, 450])
def test_flux_leaves_energies_beyond_the_bound(spark, monkeypatch, people):
    e = nation_edges(spark, people)
    monkeypatch.setattr(select, "edges", lambda *_: e)
    plain = {r.id: r.energy for r in G.spread(e, spark.createDataFrame([("cust:1", 1.0), ("cust:2", 0.8)], "id string, energy double"), 2).collect()}
    got = {r.id: r.energy for r in select.activation_with_flux(spark, "").collect()}
    assert got.keys() == plain.keys() and len(got) >= people
    assert (got == plain) == (people > 248)  # with the nation and the region more than 250 nodes


@pytest.mark.parametrize("people", [20, 230, 260, 450])
def test_tube_is_of_the_whole_nation_or_empty(spark, monkeypatch, people):
    e = nation_edges(spark, people)
    monkeypatch.setattr(graph_plans, "edges", lambda *_: e)
    got = {(r.source, r.target): r.flux for r in graph_plans.physarum_tube(spark, "").collect()}
    rows = sorted((r.source, r.target, r.weight) for r in e.collect())
    people_of = [a for a, _, _ in rows if a.startswith("cust:")]
    plain = G.physarum(sorted({x for a, b, _ in rows for x in (a, b)}), rows, ["cust:1", *[p for p in people_of if p != "cust:1"][:2]])
    assert got == {k: round(q, 6) for k, q in plain.items()} and bool(got) == (people <= 248)


def test_greedy_dedup_follows_the_first_leader():
    assert V.greedy_dedup([(1, [1.0, 0.0]), (2, [0.95, 0.31]), (3, [0.0, 1.0]), (4, [0.3, 0.95])], 0.9) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_fold_id(spark):
    def plain(s):
        h = 5381
        for b in s.encode():
            h = (h * 33 + b) & 0xFFFFFFFF
        return f"{h & 0xFFFFF:05x}"

    texts = ["", "a", "crates/x/src/lib.rs:10", "über 日本"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.djb2_20("t").alias("x")).collect()]
    assert got == [plain(t) for t in texts]


def test_upsert_and_insert_rules(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert sorted(map(tuple, G.upsert_nodes(nodes, spark.createDataFrame([("b", 2), ("c", 3)], nodes.schema)).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    edges = spark.createDataFrame([("a->b", "a", "b", 0.5)], "id string, source string, target string, weight double")
    new = spark.createDataFrame([("a->b", "a", "b", 0.9), ("b->a", "b", "a", 0.1), ("a->x", "a", "x", 1.0)], edges.schema)
    assert sorted((r.id, r.weight) for r in G.insert_edges(nodes, edges, new).collect()) == [("a->b", 0.5), ("b->a", 0.1)]
    assert [r.id for r in G.remove_nodes(nodes, edges, nodes.filter("id = 'b'"))[1].collect()] == []


def test_graph_edge_cases(spark):
    edges = spark.createDataFrame([("l", "a", "a", "Calls", 0.9, "proven"), ("c1", "a", "b", "Calls", 0.9, "proven"), ("c2", "b", "a", "Calls", 0.9, "proven"), ("d", "x", "y", "Calls", 0.9, "proven")], "id string, source string, target string, edge_type string, weight double, confidence string")
    a = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.id, r.depth) for r in G.neighbourhood(edges, a, 3).collect()) == [("a", 0), ("b", 1)]
    assert G.neighbour_views(edges).filter("id = 'a'").count() == 4
    assert G.stats(edges.filter("false")).first().avg_weight == 0.5
    assert {r.id: r.path for r in G.shortest_paths(edges, "a", 3).collect()} == {"a": ["a"], "b": ["a", "b"]}


def test_parsers(spark):
    assert O.routes_of("app.get('/x', f)\nrouter.post(\"/y\", g)", "express") == [("GET", "/x", 1), ("POST", "/y", 2)]
    assert O.routes_of('@GetMapping("/a")', "spring") == [("GET", "/a", 1)]
    assert S.imports("import a.b\nfrom c import d", "python") == [("a.b", "a", 1), ("c.d", "d", 2)]
    text = "def f():\n    a\n    b\n    c\n\ndef g():\n    a\n"
    assert P.skeleton(text) == ("def f():\n    ...\n\ndef g():\n    a\n", 1) and P.skeleton(text, keep=("f",)) == (text, 0)
    assert S.declarations("", "rust") == [] and S.declarations("fn x() {}", "nope") == []


def test_workspace(spark, tmp_path):
    for name, body in {"src/a.py": "x = 1\n", "tests/t.py": "y", "node_modules/m.js": "z", "b.zzz": "q", "yarn.lock": "l", "src/b.rs": "fn a() {}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    listing = files.listing(spark, str(tmp_path))
    assert {r.path: r.skipped for r in listing.collect()} == {"src/a.py": None, "tests/t.py": None, "src/b.rs": None, "node_modules/m.js": "ignored", "yarn.lock": "ignored", "b.zzz": "unknown_extension"}
    assert [(r.ext, r["count"]) for r in files.skipped_summary(listing).collect()] == [("zzz", 1)]
    read = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in read.collect()) == ["src/a.py", "src/b.rs", "tests/t.py"]
    assert [r.path for r in files.capped(listing, 2).collect()] == ["src/a.py", "src/b.rs"]
    (tmp_path / "src/a.py").write_text("x = 2 + 3\n")
    known = spark.createDataFrame(read.filter("path <> 'src/a.py'").select("path", "length", "modified").collect(), "path string, length long, modified timestamp")
    assert [r.path for r in files.scan(spark, str(tmp_path), known).collect()] == ["src/a.py"]
    with pytest.raises(ValueError):
        files.inside(str(tmp_path), "../x")
    with pytest.raises(ValueError):
        files.safe_root("/")


def test_gold_tasks(spark, tmp_path):
    (tmp_path / "g.toml").write_text('[[task]]\nid = "a"\nprompt = "p"\ngold_files = ["x.py"]\n[[task]]\nid = "b"\nprompt = "q"\nexpect_seeds_missed = true\n')
    assert [(r.id, r.gold_files, r.expect_seeds_missed) for r in files.gold_tasks(spark, str(tmp_path / "g.toml")).orderBy("id").collect()] == [("a", ["x.py"], False), ("b", [], True)]


def test_snapshot(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "crates/x/a.rs", 1), ("b", "crates/y/b.rs", 2)], "id string, file_path string, v int")
    edges = spark.createDataFrame([("a->b", "a", "b")], "id string, source string, target string")
    first = snapshot.save(nodes, edges, str(tmp_path))
    assert snapshot.save(nodes.orderBy(F.desc("id")), edges, "/does/not/exist", first) == first
    n, e = snapshot.load(spark, str(tmp_path))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and [tuple(r) for r in e.collect()] == [("a->b", "a", "b")]
    assert sorted((r.id, r.v) for r in snapshot.merge([nodes, nodes.filter("id = 'a'").withColumn("v", F.lit(9))]).collect()) == [("a", 9), ("b", 2)]
    rows = spark.createDataFrame([(1, 10), (2, 20)], "k int, ts int")
    for _ in range(2):
        snapshot.append_once(spark, rows, str(tmp_path / "t"), "k")
    snapshot.append_once(spark, spark.createDataFrame([(3, 30)], rows.schema), str(tmp_path / "t"), "k", keep=2)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 3]


def test_streams_agree_with_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "seq long, ts timestamp, key long, kind string")
    for part in range(3):  # files in order of time: late ones would be another order
        df.filter(f"second(ts) >= {part * 14} AND second(ts) < {part * 14 + 14}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state.changes(spark, str(tmp_path / "in"), "seq long, ts timestamp, key long, kind string", 1000)
    state.run_once(state.learning_state(stream), "learned", str(tmp_path / "c1"), "update")
    assert {r.key: r.weight for r in spark.table("learned").collect()} == pytest.approx(plain_fold(EVENTS))
    events = df.select(F.col("seq").alias("event_id"), "ts", "key", F.lit("view").alias("event_type"))
    events.unionByName(events).coalesce(1).write.parquet(str(tmp_path / "twice"))
    again = state.changes(spark, str(tmp_path / "twice"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    state.run_once(state.deduplicated(again), "once", str(tmp_path / "c2"))
    assert spark.table("once").count() == len(EVENTS)


def test_a_store_survives_lost_writers(spark, tmp_path):
    """Wherever a writer stops, the old or the new rows are whole."""
    path, rows = str(tmp_path / "s"), spark.range(3)
    store = Store(spark, path)
    assert store.read() is None
    store.replace(rows)
    spark.range(5).write.parquet(f"{path}-next")  # written, not yet in place: undone
    assert Store(spark, path).read().count() == 3
    spark.range(5).write.parquet(f"{path}-next")
    (tmp_path / "s").rename(tmp_path / "s-old")  # the old one moved away, the new one whole: finished
    assert Store(spark, path).read().count() == 5 and not (tmp_path / "s-old").exists()
    (tmp_path / "s").rename(tmp_path / "s-old")  # the old one moved away, no new one: put back
    assert Store(spark, path).read().count() == 5
    store.replace(store.read().filter("id < 2"))
    assert Store(spark, path).read().count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["s"]


def test_upsert_keeps_the_newest(spark, tmp_path):
    for batch in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 3, "d")]):
        state.upsert(spark.createDataFrame(batch, "k int, at int, v string"), str(tmp_path / "t"), "k", "at")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, 3, "d"), (2, 1, "b")]


def test_prompts_without_text(spark):
    """Nulls and empty prompts name nothing and ask for nothing in particular."""
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Fix parse_url in a/b.rs")], "task long, prompt string")
    got = {r.task: r for r in T2.signature(T2.named(df.withColumn("prompt", F.coalesce("prompt", F.lit(""))))).collect()}
    assert [got[i].names for i in (1, 2)] == [[], []] and got[1].intent == "query" and got[2].entity == "Workspace" and got[1].confidence == 0.62
    assert got[3].entity == "b.rs" and got[3].files == ["a/b.rs", "b.rs"] and got[3].names == ["b.rs", "parse_url"]
    low = T2.aliases("prompt", {"auth": ("token",), "errors": ("error",)}, {"auth": ("verifyJwt",)}, F.lit(True))
    told = spark.createDataFrame([("token tokens",), ("tokens my_token token_x",), ("access-token",), ("error token",)], "prompt string").select(low[0], low[1]).collect()
    assert [tuple(r) for r in told] == [(["auth"], ["verifyJwt"]), ([], []), (["auth"], ["verifyJwt"]), (["auth"], ["verifyJwt"])]


def test_outside_answers_without_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, '{"rows": [["a"]]}'), (4, "[1, 2]")], "id long, answer string")
    assert X.hits(df).count() == 0 and X.tree_hits(df.filter("id < 3")).count() == 0
    assert X.types(spark.createDataFrame([("a.ts", None), (None, "type X"), ("b.rs", "")], "path string, content string")).count() == 0
    held = spark.createDataFrame([("a", None, ["f"]), ("b", "fn f() {}", None), ("c", "fn f() {}", [])], "path string, content string, symbols array<string>")
    assert {r.body for r in P.windows(held).collect()} == {""}


def test_nearest_is_exact_on_odd_vectors(spark, monkeypatch):
    """Copies, ties by id, nulls, no numbers, a threshold, factors, keys and a query's own row, over several tasks and chunks."""
    import random

    r = random.Random(3)
    held = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3, 1.0 + i % 2) for i in range(700)] + [(i, [0.5] * 8, i % 3, 1.0) for i in range(700, 5000)]
    rows = spark.createDataFrame([*held, (5000, None, 0, 1.0), (5001, [0.0] * 8, 1, 1.0)], "node_id long, v array<double>, dir int, factor double")
    queries = spark.createDataFrame([(700, [0.5] * 8, 0), (3, held[3][1], 1), (4, [-x for x in held[4][1]], 2), (9, None, 1)], "q long, x array<double>, dir int")

    def plain(q, x, k, least=None, key=None, factor=False, apart=False):
        scored = [(round(sum(a * b for a, b in zip(x, v)) * (f if factor else 1), 6), i) for i, v, d, f in [*held, (5001, [0.0] * 8, 1, 1.0)] if (key is None or d == key) and not (apart and i == q)]
        return [(i, s) for s, i in sorted(scored, key=lambda t: (-t[0], t[1])) if least is None or s >= least][:k]

    def told(df):
        out = {}
        for t in df.orderBy("q", "place").collect():
            out.setdefault(t.q, []).append((t.node_id, pytest.approx(t.score)))
        return out

    bare, asked = rows.drop("dir", "factor"), [(t.q, t.x, t.dir) for t in queries.collect() if t.x]
    assert {q: s for q, s in told(V.nearest(bare, queries.drop("dir"), 6)).items() if q != 9} == {q: plain(q, x, 6) for q, x, _ in asked}
    assert told(V.nearest(bare, queries.drop("dir"), 6, least=0.5, apart=True)) == {q: p for q, x, _ in asked if (p := plain(q, x, 6, 0.5, apart=True))}
    assert {q: s for q, s in told(V.top_k(rows, queries, 4, on="dir")).items() if q != 9} == {q: plain(q, x, 4, key=d, factor=True) for q, x, d in asked}
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [float("inf"), 1.0])], "node_id long, v array<double>")
    last = V.nearest(few, spark.createDataFrame([(1, [1.0, 1.0])], "q long, x array<double>"), 9).orderBy("place").collect()
    assert [t.node_id for t in last] == [3, 4, 1, 2] and math.isnan(last[0].score) and [t.score for t in last[1:]] == [math.inf, 1.0, None]


def test_correlations_of_products(spark, monkeypatch):
    """Moments and ranks against all pairs; equal rows have no correlation; ties of ranks go by id; blocks of queries lose none."""
    import random

    import numpy as np

    r = random.Random(5)
    held = [(i, [r.gauss(0, 1) for _ in range(6)] if i % 4 else [0.25] * 6) for i in range(300)]
    rows = spark.createDataFrame(held, "node_id long, v array<float>")
    queries = rows.filter("node_id % 20 = 0 OR node_id % 20 = 1").selectExpr("node_id AS q", "v AS x")
    m = np.array([v for _, v in rows.orderBy("node_id").collect()], dtype=float)
    x, y = m @ m.T, m[:, :3] @ m[:, :3].T
    place = lambda s: np.argsort(np.argsort(np.round(s, 9), kind="stable"), kind="stable")
    assert {t.q: t.pearson for t in V.pearson(rows, queries, 3).collect()} == pytest.approx({q: np.corrcoef(x[q], y[q])[0, 1] for q in range(300) if q % 20 < 2}, abs=2e-6)
    whole = V.blocks
    monkeypatch.setattr(V, "blocks", lambda q: whole(q, 7))
    assert {t.q: t.spearman for t in V.spearman(rows, queries, 3).collect()} == pytest.approx({q: np.corrcoef(place(x[q]), place(y[q]))[0, 1] for q in range(300) if q % 20 < 2}, abs=2e-6)
    same = spark.createDataFrame([(i, [0.1, 0.2]) for i in range(9)], "node_id long, v array<float>")
    assert {t.pearson for t in V.pearson(same, same.selectExpr("node_id AS q", "v AS x"), 1).collect()} == {None}
    big = np.array([1e30, 2.0, 2.0, -5.0])
    assert list(V.places(big, np.array([False, False, True, False]), np.arange(4))) == [3, 1, 0, 2]


def test_plans_of_searches_make_no_pairs(spark, tmp_path):
    """All rows with all queries as joined rows took hours at size: no plan joins them."""
    from tessera.plans import metrics, vector

    spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(200)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for f in (vector.vector_topk, vector.quantized_topk, vector.file_rerank, vector.pearson_scores, vector.spearman_ordinal, metrics.mrr):
        assert "NestedLoop" not in f(spark, str(tmp_path))._jdf.queryExecution().toString() and "Cartesian" not in f(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_exports_of_a_frequent_name_make_no_pairs(spark):
    """Files of a name meet its hints once; a reference told twice or a second match is likely."""
    from tessera.operators import search

    symbols = spark.createDataFrame([("w", f"part:{i:03}", f"a/m{i % 3}.rs") for i in range(300)] + [("v", "part:900", "a/m1.rs"), ("u", "part:901", "a/m12.rs")], "name string, id string, file_path string")
    refs = spark.createDataFrame([(i, "w", "m2") for i in range(200)] + [(500, "v", "m1"), (501, "v", "m7"), (502, "u", "m1"), (503, "none", "m1"), (504, "v", "m1"), (504, "v", "m1")], "ref long, name string, hint string")
    got = {r.ref: (r.id, r.confidence) for r in search.resolve_export(refs, symbols).collect()}
    assert got == {**{i: ("part:002", "likely") for i in range(200)}, 500: ("part:900", "proven"), 502: ("part:901", "proven"), 504: ("part:900", "likely")}
    assert "plan" not in got and search.resolve_export(refs, symbols.filter("false")).count() == 0


def test_windows_of_long_files(spark):
    """A file's lines are read once: thousands of functions are no more than their bytes."""
    text = "".join(f"fn f{i}() {{\n    x();\n}}\n\n" for i in range(3000))
    rows = [("all", text, [""]), ("one", text, ["f2999"]), ("gap", "a\nb\nfn p() {\n  1\n}\nfn q() {\n}\nz\n" * 1, ["p(", None]), ("crlf", "x\r\n  pub fn r() {\r\n}\r\n", ["r"]), ("none", text, None)]
    got = {r.path: r.body for r in P.windows(spark.createDataFrame(rows, "path string, content string, symbols array<string>")).collect()}
    assert got["all"].endswith(P.CUT) and len(got["all"].encode()) <= P.WINDOW_BYTES + len(P.CUT.encode()) and got["all"].startswith("fn f0() {\n    x();\n}\n\nfn f1")
    assert got["one"] == "\nfn f2999() {\n    x();\n}\n" and got["none"] == ""
    assert got["gap"] == "b\nfn p() {\n  1\n}\n" + P.GAP and got["crlf"] == "x\n  pub fn r() {\n}\n"


def test_texts_of_parts_are_dealt_out(spark, tmp_path):
    """A small file is read by one task: what is made of its rows goes to all cores."""
    from tessera.plans import parse

    spark.range(50).selectExpr("id AS p_partkey", "'a b' AS p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert parse.filled(spark, str(tmp_path), (("{n}",),), "content").rdd.getNumPartitions() >= 24


def test_seeds_are_counted_by_kinds_of_nodes(spark, monkeypatch):
    """What meets the prompts is as many as the kinds of nodes; each task keeps its first nodes by energy, then id."""
    from tessera.operators import packet

    names = ["red_bolt", "redBolt", "blue_ring", "red_ring", "order_7"]
    nodes = spark.createDataFrame([(f"n:{i:04}", names[i % 5] if i % 5 < 4 else f"order_{i}") for i in range(2000)] + [("n:x", None)], "id string, name string")
    prompts = spark.createDataFrame([("a", "fix the red bolt"), ("b", "ring, RING order 9!"), ("c", "nothing"), ("d", None)], "task string, prompt string")
    kinds, held = packet.cut, []
    monkeypatch.setattr(packet, "cut", lambda df, label="cut": held.append((label, (out := kinds(df, label)).count())) or out)
    got = {}
    for r in packet.seeds(prompts, nodes).orderBy("task", F.desc("energy"), "id").collect():
        got.setdefault(r.task, []).append((r.id, round(r.energy, 6)))
    assert got == {"a": [(f"n:{i:04}", 0.5) for i in (0, 1, 5, 6, 10)], "b": [(f"n:{i:04}", round(1 / 2, 6)) for i in (2, 3, 4, 7, 8)]}
    assert max(n for label, n in held if label == "kinds") <= 5 * 4


def test_edges_at_few_ids_are_thinned_first(spark, monkeypatch):
    """What surely isn't at any of the ids goes by a broadcast; without one, of too many ids, the rows are the same."""
    from tessera.operators import memory

    rows = [(f"e{i}", f"a{i % 50}", f"b{i % 70}", "Calls", i % 10 / 10) for i in range(700)]
    edges = spark.createDataFrame([*rows, ("n", None, "b1", "Calls", 0.5)], "id string, source string, target string, edge_type string, weight double")
    ids = spark.createDataFrame([("a1",), ("b1",), ("b1",), ("none",)], "id string")
    thin = memory.near_to(edges, "target", ids.distinct())
    assert {r.id for r in thin.collect()} == {e for e, _, b, *_ in rows if b == "b1"} | {"n"} and "BroadcastHashJoin" in thin._jdf.queryExecution().toString()
    told = lambda: sorted(map(tuple, memory.reinforce_around(edges, ids).collect()))
    want = sorted((e, pytest.approx(min(1.0, w + 0.15))) for e, a, b, _, w in [*rows, ("n", None, "b1", "", 0.5)] if a == "a1" or b == "b1")
    assert told() == want
    monkeypatch.setattr(memory, "BROADCAST_IDS", 0)
    assert told() == want


def test_traversals_write_only_the_ends_of_edges(spark, monkeypatch):
    """Each edge is written once, without its id, and turned when it is read."""
    rows = [(f"a-very-long-id-{i}", f"n{i}", f"n{(i * 7 + 1) % 40}", "Calls", 0.5) for i in range(40)]
    edges = spark.createDataFrame(rows, "id string, source string, target string, edge_type string, weight double")
    whole, held = G.cut, []
    monkeypatch.setattr(G, "cut", lambda df, label="cut": held.append((label, df.columns, df.count())) or whole(df, label))
    seed = spark.createDataFrame([("n0",)], "id string")
    depth, at = {"n0": 0}, {"n0"}
    for d in (1, 2, 3):
        at = {y for _, a, b, *_ in rows for x, y in ((a, b), (b, a)) if x in at} - depth.keys()
        depth |= dict.fromkeys(at, d)
    assert {r.id: r.depth for r in G.neighbourhood(edges, seed, 3).collect()} == depth
    assert {r.id: r.depth for r in G.shortest_paths(edges, "n0", 3).collect()} == depth
    assert [h for h in held if h[0] == "steps"] == [("steps", ["source", "target"], 40)] * 2


def test_tokens_are_counted_in_one_pass(spark):
    """Words, marks and breaks of all scripts, in long runs too; the plan has one pattern."""
    texts = ["", "a", "a b", "ab,cd\n\n e", "日本語" * 30000, "a日" * 30000, "x" * 50000, "!" * 999, "a b c\x01d\x7f", "a\n" * 500, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_count("t").alias("n"), "t")
    space = "\t-\r \u0085   -     　"
    import re

    plain = lambda t: max(len(re.findall(rf"[^{space}!-/:-@\[-`{{-~]+", t)) + len(re.findall(r"[!-/:-@\[-`{-~]", t)) + t.count("\n"), -(-len(t.encode()) // 4))
    assert [r.n for r in df.collect() if r.t is not None] == [plain(t) for t in texts[:-1]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_count") <= 1
