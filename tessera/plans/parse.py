"""Queries of parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalogue import query
from tessera.operators import overlays as O
from tessera.operators import parse as P
from tessera.operators import source as S
from tessera.sources.tables import spread, table


def rows_sql(kind: str) -> str:
    rule = P.HTML[kind].replace("'", "''")
    return f"SELECT page_id, CAST(i - 1 AS INT) AS place, f[i] AS name FROM (SELECT page_id, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{rule}', 1) AS f FROM pages))"


@query(rows_sql("id"))
def html_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html(table(spark, sf_dir, "pages"), "id")


@query(rows_sql("link"))
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html(table(spark, sf_dir, "pages"), "link")


@query(rows_sql("class"))
def html_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html(table(spark, sf_dir, "pages"), "class")


@query(rows_sql("function"))
def html_script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html(table(spark, sf_dir, "pages"), "function")


@query(rows_sql("heading"))
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.html(table(spark, sf_dir, "pages"), "heading")


@query("SELECT key, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def filled(spark: SparkSession, sf_dir: str, samples: tuple[tuple, ...], *columns: str) -> DataFrame:
    """A text for each part, from the samples in turn: the named columns with the part's name and number for {n}."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    at = (F.pmod("p_partkey", F.lit(len(samples))) + 1).cast("int")
    held = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), name.alias("n"), at.alias("at")), "file_id")
    told = [F.replace(F.element_at(F.array(*[F.lit(s[i]) for s in samples]), F.col("at")), F.lit("{n}"), F.col("n")).alias(c) for i, c in enumerate(columns)]
    return held.select(F.col("file_id").cast("string").alias("path") if "path" not in columns else F.lit(None).alias("none"), "file_id", *told).drop("none")


def value(v: str | float | None) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def expected_sql(rows: list[tuple], *columns: str) -> str:
    """The rows that each sample gives, as (sample's number, ...), with each part's name and number for {n}."""
    told = ", ".join("(" + ", ".join(map(value, row)) + ")" for row in rows)
    shown = ", ".join(f"replace({c}, '{{n}}', n) AS {c}" if any(isinstance(row[i], str) for row in rows) else c for i, c in enumerate(columns, 1))
    count = max(row[0] for row in rows) + 1
    return f"""WITH w(k, {', '.join(columns)}) AS (VALUES {told}), p AS (SELECT p_partkey AS file_id, replace(p_name, ' ', '_') || '_' || p_partkey AS n FROM part)
SELECT CAST(file_id AS VARCHAR) AS path, {shown} FROM p JOIN w ON file_id % {count} = k"""


def numbered(samples: tuple[tuple, ...], at: int) -> list[tuple]:
    return [(k, *row) for k, sample in enumerate(samples) for row in sample[at]]


STATEMENTS = (
    ("SELECT * FROM {n} o JOIN Customer c ON o.x = c.y", (("{n}",), ("customer",))), ("CREATE TABLE IF NOT EXISTS {n} (id INT); INSERT INTO {n}_log VALUES (1)", (("{n}",), ("{n}_log",))),
    ("UPDATE part SET p_size = 1; CREATE VIEW {n} AS SELECT * FROM part", (("part",), ("{n}",))), ("SELECT 1", ()), ("select a from x.{n} where b in (select c from {n})", (("x.{n}",), ("{n}",))),
)


@query(expected_sql(numbered(STATEMENTS, 1), "table_name").replace("% 5", f"% {len(STATEMENTS)}"))
def sql_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sql_tables(filled(spark, sf_dir, STATEMENTS, "sql"), "path", "sql")


#: Language, text, and its rows: kind, name, owner (parent, caller or module), detail (doc or receiver), line.
CODE = (
    ("rust", "use crate::a::{{n}, c::{self, d as e}};\n/// Sells things.\n/// In a shop.\n#[derive(Debug)]\npub struct Shop { x: u32 }\n\nimpl Sell for Shop {\n    /* total\n     * of all */\n    pub fn total_{n}(&self) -> u32 {\n        self.check(\"a(b)\"); // skip(me)\n        self.cart.sum();\n        Cart::new(1);\n        helper(2);\n        println!(\"x\");\n        other.go()\n    }\n}\nfn helper(a: u32) -> u32 { a }\n", (
        ("import", "{n}", "crate::a::{n}", "", 1), ("import", "c", "crate::a::c", "", 1), ("import", "e", "crate::a::c::d", "", 1), ("class", "Shop", "", "Sells things. In a shop.", 5), ("impl", "Shop", "", "", 7), ("function", "total_{n}", "Shop", "total of all", 10),
        ("function", "helper", "", "", 19), ("call", "check", "total_{n}", "impl:Shop", 11), ("call", "sum", "total_{n}", "field:cart", 12), ("call", "new", "total_{n}", "type:Cart", 13), ("call", "helper", "total_{n}", "", 14), ("call", "go", "total_{n}", "obj:other", 16))),
    ("python", "import os\nfrom a.{n} import c as d, e\nclass Shop(Base):\n    \"\"\"A shop.\"\"\"\n    def buy(self, x):\n        \"\"\"Buys\n        it all.\"\"\"\n        self.pay(x)\n        self.cart.add(x)\n        Cart.make()\n        return {n}(x)\n\ndef {n}(x):\n    # done(1)\n    return d(x)\n", (
        ("import", "os", "os", "", 1), ("import", "d", "a.{n}.c", "", 2), ("import", "e", "a.{n}.e", "", 2), ("class", "Shop", "", "A shop.", 3), ("function", "buy", "Shop", "Buys it all.", 5), ("function", "{n}", "", "", 13), ("call", "pay", "buy", "impl:Shop", 8),
        ("call", "add", "buy", "field:cart", 9), ("call", "make", "buy", "type:Cart", 10), ("call", "{n}", "buy", "", 11), ("call", "d", "{n}", "", 15))),
    ("javascript", "import x, { y as z } from './{n}'\nconst { q } = require(\"fs\")\n/** Renders. */\nexport class View extends Base {\n  render(a) { this.draw(a); if (a) { util.{n}(a) } }\n}\nexport function main() { const v = new View(); v.render(`f(${1})`); }\n", (
        ("import", "x", "./{n}", "", 1), ("import", "z", "./{n}", "", 1), ("import", "q", "fs", "", 2), ("class", "View", "", "Renders.", 4), ("function", "render", "View", "", 5), ("function", "main", "", "", 7), ("call", "draw", "render", "impl:View", 5), ("call", "{n}", "render", "obj:util", 5),
        ("call", "render", "main", "obj:v", 7), ("type_use", "View", "main", "", 7))),
    ("php", "<?php\nuse App\\Models\\{n} as P;\nclass C { public function f($x) { try { $this->g($x); } catch (FooError $e) { throw $e; } throw new BarError('x'); } }\n", (
        ("import", "P", "App\\Models\\{n}", "", 2), ("class", "C", "", "", 3), ("function", "f", "C", "", 3), ("call", "g", "f", "impl:C", 3), ("type_use", "FooError", "f", "", 3), ("type_use", "BarError", "f", "", 3))),
    ("go", "package main\nimport (\n  \"fmt\"\n  m \"math/{n}\"\n)\ntype Shop struct { a int }\n// Total adds.\nfunc (s *Shop) Total(x int) int { s.check(x); return fmt.{n}(x) }\n", (
        ("import", "fmt", "fmt", "", 3), ("import", "m", "math/{n}", "", 4), ("class", "Shop", "", "", 6), ("function", "Total", "Shop", "Total adds.", 8), ("call", "check", "Total", "impl:Shop", 8), ("call", "{n}", "Total", "obj:fmt", 8))),
    ("java", "import a.b.{n};\npublic class Shop {\n  // Sells.\n  public int sell(int a) throws E { Util.run(a); return this.{n}(a); }\n  int {n}(int a) { return a; }\n}\n", (
        ("import", "{n}", "a.b.{n}", "", 1), ("class", "Shop", "", "", 2), ("function", "sell", "Shop", "Sells.", 4), ("function", "{n}", "Shop", "", 5), ("call", "run", "sell", "type:Util", 4), ("call", "{n}", "sell", "impl:Shop", 4))),
    ("kotlin", "import a.{n}\nclass Shop {\n  fun sell() { {n}(); cart.add(1) }\n}\n", (("import", "{n}", "a.{n}", "", 1), ("class", "Shop", "", "", 2), ("function", "sell", "Shop", "", 3), ("call", "{n}", "sell", "", 3), ("call", "add", "sell", "obj:cart", 3))),
    ("swift", "import Foundation\nstruct {n} {\n  func go() { self.stop() }\n}\n", (("import", "Foundation", "Foundation", "", 1), ("class", "{n}", "", "", 2), ("function", "go", "{n}", "", 3), ("call", "stop", "go", "impl:{n}", 3))),
    ("ruby", "require 'set'\nmodule Shop\n  # Sells.\n  def {n}(x)\n    cart.add(x)\n  end\nend\n", (("import", "", "set", "", 1), ("class", "Shop", "", "", 2), ("function", "{n}", "Shop", "Sells.", 4), ("call", "add", "{n}", "obj:cart", 5))),
    ("csharp", "using System.{n};\npublic class Shop {\n  void Go() { Console.Write(1); }\n}\n", (("import", "{n}", "System.{n}", "", 1), ("class", "Shop", "", "", 2), ("function", "Go", "Shop", "", 3), ("call", "Write", "Go", "type:Console", 3))),
    ("dart", "import 'package:{n}/x.dart';\nclass Shop {\n  void go() { run(); }\n}\n", (("import", "dart", "package:{n}/x.dart", "", 1), ("class", "Shop", "", "", 2), ("function", "go", "Shop", "", 3), ("call", "run", "go", "", 3))),
    ("cobol", "PERFORM {n}.", ()),
)
NAMED, USED = ("import", "class", "impl", "function"), ("call", "type_use")


def code_sql(kinds: tuple[str, ...]) -> str:
    rows = [row for row in numbered(CODE, 2) if row[1] in kinds]
    return expected_sql(rows, "kind", "name", "owner", "detail", "line").replace(f"% {max(r[0] for r in rows) + 1} =", f"% {len(CODE)} =")


@query(code_sql(NAMED))
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with their parents and docs, and imports, of a source text for each part."""
    return S.analyse(filled(spark, sf_dir, CODE, "language", "content")).filter(F.col("kind").isin(*NAMED))


@query(code_sql(USED))
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their callers and receivers, and uses of types."""
    return S.analyse(filled(spark, sf_dir, CODE, "language", "content")).filter(F.col("kind").isin(*USED))


BODIES = (
    ("def {n}():\n    a = 1\n    b = 2\n    return a + b\n\ndef x():\n    pass\n", (("def {n}():\n    ...\n\ndef x():\n    pass\n", 1),)),
    ("pub fn {n}() {\n    a();\n    b();\n    c();\n}\n", (("pub fn {n}() {\n    ...\n}\n", 1),)), ("x = '{n}'\n", (("x = '{n}'\n", 0),)),
    ("class {n}:\n    def a(self):\n        one\n        two\n        three\n    def b(self):\n        one\n        two\n        three\n", (("class {n}:\n    def a(self):\n        ...\n    def b(self):\n        ...\n", 2),)),
)


@query(expected_sql(numbered(BODIES, 1), "skeleton", "folds"))
def skeleton_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.skeletons(filled(spark, sf_dir, BODIES, "content"))


LONG = "".join(f"    step({i});\n" for i in range(60))
WIDE = "".join("    x = " + "y" * 990 + ";\n" for _ in range(8))
WINDOWED = (
    ("use a;\n// Sells.\npub fn {n}(x: u32) {\n    go();\n}\nfn other() {}\nimpl A {\n    fn {n}_more(&self) {}\n}\n", (("// Sells.\npub fn {n}(x: u32) {\n    go();\n}\n/* … */\nimpl A {\n    fn {n}_more(&self) {}\n}\n",),)),
    ("fn {n}() {\n" + LONG + "}\n", (("fn {n}() {\n" + "".join(f"    step({i});\n" for i in range(47)) + "/* … */\n",),)), ("fn a() {}\nlet {n} = 1;\n", (("",),)), ("", (("",),)),
    ("pub(crate) fn {n}() {\n" + WIDE + "}\n", (("pub(crate) fn {n}() {\n" + "    x = " + ("y" * 990 + ";\n    x = ") * 4 + "y" * 990 + ";\n/* … truncated seed window */\n",),)),
)


@query(expected_sql(numbered(WINDOWED, 1), "body"))
def body_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that a file's seeds name."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.array(name).alias("symbols"))
    return P.windows(filled(spark, sf_dir, WINDOWED, "content").join(named, "path"))


PAGE_FILES = (
    ("next", "web/app/{n}/[id]/page.tsx", (("/{n}/:id",),)), ("next", "app/(site)/{n}/page.tsx", (("/{n}",),)), ("next", "app/page.tsx", (("/",),)), ("next", "lib/{n}.ts", ((None,),)), ("nuxt", "pages/{n}/[name].vue", (("/{n}/:name",),)),
    ("nuxt", "pages/index.vue", (("/",),)), ("sveltekit", "src/routes/{n}/[slug]/+page.svelte", (("/{n}/:slug",),)), ("astro", "src/pages/{n}/index.astro", (("/{n}",),)), ("remix", "app/routes/{n}.$id.tsx", (("/{n}/:id",),)),
    ("remix", "app/routes/_index.tsx", (("/",),)), ("next", "app/api/{n}/route.ts", (("/api/{n}",),)), ("sveltekit", "src/routes/[...rest]/+server.ts", (("/:rest",),)),
)


@query(expected_sql(numbered(PAGE_FILES, 2), "route"))
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = filled(spark, sf_dir, PAGE_FILES, "framework", "file")
    route = F.lit(None).cast("string")
    for name in O.PAGES:
        route = F.when(F.col("framework") == name, O.page_route(F.col("file"), name)).otherwise(route)
    return held.select("path", route.alias("route"))


#: Framework, text, and its rows: kind, verb or word, name, line.
DECLARATIONS = (
    ("react", "export function App_{n}() {}\nconst Nav = () => 1\nfunction helper() {}", (("component", "function", "App_{n}", 1), ("component", "const", "Nav", 2))), ("flutter", "class {n} extends StatelessWidget {}\nclass X extends Y {}", (("component", "class", "{n}", 1),)),
    ("swiftui", "struct {n}: View { }\nstruct B: Codable {}", (("component", "struct", "{n}", 1),)), ("android", "class {n} : AppCompatActivity() {}", (("component", "class", "{n}", 1),)), ("compose", "@Composable\nfun {n}() {}\nfun x() {}", (("component", "fun", "{n}", 2),)),
    ("angular", "@Component({selector: 'x'})\nexport class {n} {}", (("component", "class", "{n}", 2),)), ("eloquent", "class {n} extends Model {}\nclass B extends Job {}", (("component", "class", "{n}", 1),)), ("blade", "@extends('{n}') @include('menu')", (("view", "extends", "{n}", 1), ("view", "include", "menu", 1))),
    ("twig", "{% block {n} %}", (("block", "", "{n}", 1),)), ("tauri", "#[tauri::command]\nfn {n}() {}\nfn b() {}", (("component", "fn", "{n}", 2),)), ("electron", "ipcMain.handle('{n}', f)\nother.handle('z')", (("channel", "handle", "{n}", 1),)), ("env", "A_KEY={n}\n#x\nB=2", (("variable", "", "A_KEY", 1), ("variable", "", "B", 3))),
    ("schema", "Schema::create('{n}', f)", (("table", "create", "{n}", 1),)), ("scss", "${n}: 1px;\n@mixin wide-{n}($a) {}", (("variable", "", "{n}", 1), ("mixin", "", "wide-{n}", 2))), ("css", ":root{--{n}: red;--b:1}", (("property", "", "{n}", 1), ("property", "", "b", 1))),
    ("vue_store", "const s = useCartStore()", (("store", "useCartStore", "useCartStore", 1),)), ("cjs", "const a = require('{n}')", (("module", "require", "{n}", 1),)), ("razor", '@page "/{n}"', (("page", "", "/{n}", 1),)), ("wordpress", "register_rest_route('v1/{n}', '/x')", (("route", "register_rest_route", "v1/{n}", 1),)),
    ("express", "app.get('/{n}', f)\nrouter.post(\"/y\", g)\ndb.get('/no')", (("route", "get", "/{n}", 1), ("route", "post", "/y", 2))), ("fastapi", '@app.get("/{n}")\ndef f(): pass', (("route", "get", "/{n}", 1),)), ("flask", "@bp.route('/{n}')", (("route", "route", "/{n}", 1),)),
    ("spring", '@GetMapping("/{n}")\n@RequestMapping(value = "/b")', (("route", "Get", "/{n}", 1), ("route", "Request", "/b", 2))), ("gin", 'r.GET("/{n}", h)', (("route", "GET", "/{n}", 1),)), ("laravel", "Route::get('/{n}', f);\nRoute::resource('posts', C::class);", (("route", "get", "/{n}", 1), ("route", "resource", "posts", 2))),
    ("rails", "  get '/{n}'\n  post 'b', to: 'c'", (("route", "get", "/{n}", 1), ("route", "post", "b", 2))), ("nest", "@Get('{n}')\nfind() {}", (("route", "Get", "{n}", 1),)), ("aspnet", 'app.MapGet("/{n}", f);', (("route", "Get", "/{n}", 1),)), ("axum", '.route("/{n}", get(f))', (("route", "route", "/{n}", 1),)),
    ("ktor", 'get("/{n}") { }\nget("x")', (("route", "get", "/{n}", 1),)), ("django", "path('{n}/', view)\nre_path(r'^b$', c)", (("route", "path", "{n}/", 1), ("route", "re_path", "^b$", 2))), ("symfony", "#[Route('/{n}', name: 'a')]", (("route", "Route", "/{n}", 1),)),
    ("vue_router", "{ path: '/{n}', component: X }", (("route", "", "/{n}", 1),)), ("view_render", "return View::render('{n}.twig');", (("view", "render", "{n}.twig", 1),)), ("vite_tags", "<?= vite('{n}.js') ?>", (("entry", "vite", "{n}.js", 1),)), ("hmvc_manifest", "'package' => '{n}', 'name' => 'b', 'x' => 'y'", (("config", "", "{n}", 1), ("config", "", "b", 1))),
    ("factory", "$model = {n}::class;\nUser::factory()", (("factory", "factory", "User", 2), ("model", "", "{n}", 1))), ("prime", "import {n} from 'primevue/button'\nimport b from 'c'", (("widget", "", "{n}", 1),)), ("hmvc_routes", "collection('{n}', f); get('/a', [C::class, 'm'])->name('x')", (("route", "collection", "{n}", 1), ("route", "get", "/a", 1), ("action", "name", "x", 1))),
)


@query("SELECT path, framework, kind, verb, name, line FROM (" + expected_sql([(k, DECLARATIONS[k][0], *row) for k, *row in numbered(DECLARATIONS, 2)], "framework", "kind", "verb", "name", "line") + ")")
def overlay_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each framework's sources declare: a text for each part."""
    return O.overlay(filled(spark, sf_dir, DECLARATIONS, "framework", "content"))
