"""Queries against their SQL on small tables of all shapes the driver has."""

import datetime as dt
import math
import random

import duckdb
import pytest

from tessera import catalogue

TABLES = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int", "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def rows() -> dict[str, list[tuple]]:
    r = random.Random(1)
    day = lambda: dt.datetime(1997, 1, 1) + dt.timedelta(days=r.randrange(700))
    words = ["the", "and", "for", "der", "die", "les", "nation", "testing", "fix_bug", "style", "über", "日本", "running", "color"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)) + r.choice([".", "\n10.0.0.1", "", ", x@y.com"])
    html = '<a href="/en">x</a><div id="m" class="c d"><h1>T</h1><script>function go(a){}</script><a class="l" href="/zz/1">y</a></div>'
    return {
        "region": [(i, f"R{i}") for i in range(3)], "nation": [(i, f"NATION {chr(65 + i)}", i % 3) for i in range(9)], "customer": [(i, f"Customer#{i:09d}", r.randrange(9), 1.0, r.choice(["BUILDING", "MACHINERY"])) for i in range(30)],
        "supplier": [(i, f"Supplier#{i:09d}", r.randrange(9), 1.0) for i in range(5)], "part": [(i, r.choice(["cold widget", "red bolt", "widget", "blue ring"]), f"Brand#{i % 4}", r.choice(["ECONOMY", "SMALL"]), r.randrange(1, 50), 900 + i / 10) for i in range(40)],
        "orders": [(i, r.randrange(30), r.choice("FOP"), r.randrange(1000, 500000) / 1.0, day(), r.choice(["1-URGENT", "5-LOW"])) for i in range(80)],
        "lineitem": [(r.randrange(80), r.randrange(40), r.randrange(5), r.randrange(1, 8), float(r.randrange(1, 51)), 1.0, r.randrange(0, 11) / 100, 0.0, "A", "F", day()) for _ in range(300)],
        "events": [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(400000)), r.randrange(12), r.choice(["view", "click", "error", "purchase", "signup"]), r.randrange(1, 9999) / 100, f'{{"k": {i % 90}}}') for i in range(400)],
        "documents": [(i, t, r.choice(["en", "de", "fr"]), f"src{i % 5}", len(t)) for i, t in enumerate([text(r.randrange(1, 60)) for _ in range(60)] + ["", "x" * 9000, "the and"])],
        "embeddings": [(i, [r.gauss(0, 1) / 8 for _ in range(64)], r.randrange(4)) for i in range(90)], "pages": [(i, f"https://{r.choice(['a.example.com', 'x.net'])}/{r.choice(['en', 'de/x', 'test/y'])}/{i}{r.choice(['', '.html', '?q=1'])}", html * r.randrange(0, 3)) for i in range(25)],
        "benchmark": [(i, text(20)) for i in range(10)], "labels": [(i, r.randrange(2), r.randrange(2)) for i in range(0, 60, 2)],
        "conversations": [(i, t, ["user", "assistant"][t % 2], text(12)) for i in range(8) for t in range(r.randrange(1, 6))],
    }


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    for name, held in rows().items():
        spark.createDataFrame(held, TABLES[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    held = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name in catalogue.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
        want = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(held, key=repr) == sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in want.fetchall()), key=repr)
