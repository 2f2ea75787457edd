"""What a prompt asks for: its signature, the plan of its query, its steps. Prompts are normalised ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import anchors as A
from tessera.functions.predicates import Rule, says
from tessera.functions.text import col

Cases = Sequence[tuple[str, Sequence[str]]]

# What words of a prompt decide, the first that fits.
INTENTS = (
    ("create", ("build", "create", "scaffold", "generate", "implement", "design", "plan", "architect")), ("fix", ("fix", "bug", "error", "issue", "repair")), ("refactor", ("refactor", "clean up", "restructure")),
    ("optimize", ("optimize", "speed up", "performance")), ("test", ("test", "spec", "typecheck")), ("explain", ("explain", "what is", "how does", "how do")), ("modify", ("make", "update", "change", "add")),
)
TECHNOLOGIES = (
    ("Vue", ("vue",)), ("React", ("react", "next.js", "nextjs", "next/")), ("Rust", ("rust", "cargo")), ("Python", ("python", "django", "fastapi")), ("TypeScript", ("typescript", ".ts")), ("Go", ("golang", " go ")),
    ("Laravel", ("laravel", "eloquent")), ("Vue", ("prime vue",)), ("JavaScript", ("javascript", ".cjs", ".mjs", ".jsx")), ("SQL", (".sql", "create table", "postgres", "mysql")),
)
STYLES = (("SCSS", ("scss", "sass")), ("Less", ("less",)), ("Tailwind", ("tailwind",)), ("CSS", ("css",)))
DOMAINS = (("ecommerce", ("ecommerce", "store", "shop")), ("frontend", ("frontend", "ui", "responsive")), ("backend", ("backend", "api", "database")))
GOALS = (("responsive", ("responsive",)), ("explain", ("explain", "how does", "what is")), ("bug fix", ("fix",)))
RISKS = (
    ("critical", ("auth", "security", "payment", "stripe", "migration", "drop table")), ("high", ("refactor", "delete", "architecture")), ("medium", ("state", "api", "database")),
)
ENTITIES = (
    ("Cart", ("cart",)), ("ProductCard", ("product card",)), ("ProductGrid", ("product grid",)), ("Product", ("product",)), ("Navigation", ("navigation",)), ("Header", ("header",)), ("Checkout", ("checkout",)), ("Auth", ("auth",)),
)
QUERY_INTENTS = (
    ("trace_middleware", ("middleware", "pipeline", "میان", "لوله", "خط أنابيب", "خط انابيب", "中间件", "ミドルウェア", "промежуточн", "ara katman", "next()")),
    ("trace_routing", ("redirect", "route", "router", "endpoint", "مسیر", "مسیریابی", "enrut", "routage", "enrutamiento", "路由", "ルーティング", "маршрут", "yönlendir", "التوجيه", "rotalar")),
    ("trace_session", ("session", "cookie", "cookies", "سشن", "کوکی", "куки", "сессии", "çerez", "oturum", "会话", "セッション", "تعريف الارتباط", "جلسات")),
    ("trace_auth", ("auth", "login", "احراز")),
    ("trace_render", ("render", "template", "view engine", "res.render", "قالب", "渲染", "шаблон", "plantilla", "moteur", "テンプレート")),
    ("trace_static", ("static", "asset", "public/", "استاتیک", "静态", "静的", "статическ", "statiques", "estáticos", "statische", "statik", "الثابتة")),
    ("trace_query", ("req.query", "query string", "querystring", "query", "repository", "database", "model", "کوئری", "запрос", "consulta", "requête", "查询", "クエリ", "sorgu", "استعلام")),
    ("trace_dependency", ("depend", "caller", "callee", "trace", "import chain")),
)
#: What a plan looks for: concepts, kinds of edges, keywords and expansions.
PLANS = {
    "trace_routing": (("routing", "route", "router"), ("Calls", "Imports"), ("Router", "route", "app"), ("routing", "app.all", "app.get")),
    "trace_middleware": (("middleware", "pipeline"), ("Calls", "Imports"), ("app.use", "next", "middleware"), ("middleware", "pipeline", "route")),
    "trace_auth": (("auth", "authentication"), ("Calls", "Imports"), ("session", "cookie", "auth"), ("authentication", "login")),
    "trace_session": (("session", "cookie", "auth"), ("Calls", "Imports"), ("cookie", "session", "cookie-session"), ("sessions", "cookies", "redis")),
    "trace_render": (("render", "template", "view"), ("Calls",), ("res.render", "view", "render", "engine"), ("template", "views", "app.render")),
    "trace_static": (("static", "assets"), ("Calls",), ("express.static", "static", "stat"), ("serve-static", "public", "static-files")),
    "trace_query": (("database", "repository", "query"), ("Imports", "Calls"), ("req.query", "query", "parseurl", "utils"), ("querystring", "request", "parse")),
    "trace_dependency": (("dependency", "import"), ("Calls", "Imports"), (), ()), "explain_symbol": ((), ("Calls",), (), ()), "general": ((), ("Calls",), (), ()),
}
LARGE_TASKS = ("ecommerce", "template", "complete", "production ready", "full app")
#: The steps of a large task: id, title, what they wait for, their files.
STEPS = (
    ("req", "Requirements", (), ("README.md",)), ("arch", "Architecture", ("req",), ("router/index.ts", "stores/")), ("design_tokens", "Design System", ("arch",), ("styles/_variables.scss", "styles/_breakpoints.scss")),
    ("comp_header", "Header & Navigation", ("design_tokens",), ("Header.vue", "Navigation.vue")), ("comp_product_card", "ProductCard Component", ("design_tokens",), ("ProductCard.vue", "types/product.ts")),
    ("comp_product_grid", "ProductGrid Component", ("comp_product_card",), ("ProductGrid.vue",)), ("comp_cart_drawer", "Cart Drawer Component", ("comp_product_card",), ("CartDrawer.vue", "stores/cartStore.ts")),
    ("comp_filters", "Filters & Search", ("comp_product_grid",), ("Filters.vue", "Search.vue")), ("pages_home", "Home & Category Pages", ("comp_product_grid", "comp_header"), ("HomeView.vue", "CategoryView.vue")),
    ("state_pinia", "State Management", ("arch",), ("stores/cartStore.ts", "stores/productStore.ts")), ("responsive_audit", "Responsive Optimization", ("pages_home",), ("styles/main.scss",)),
    ("qa_verify", "QA & Verification", ("responsive_audit",), ("package.json",)),
)
CODE_WORDS = ("next", "use", "Router", "app", "stat")
GENERIC_CONCEPTS = ("render", "static", "test", "config", "refactor", "query", "errors", "error")


def chosen(name: str, cases: Cases, otherwise: str | None) -> Rule:
    """The label of the first case with a word in the text."""

    def build() -> Column:
        column = F.lit(otherwise).cast("string")
        for label, words in reversed(cases):
            column = F.when(says(name, words).column, label).otherwise(column)
        return column

    told = " ".join(f"WHEN {says(name, words).sql} THEN '{label}'" for label, words in cases)
    return Rule(build, f"CASE {told} ELSE {'NULL' if otherwise is None else repr(otherwise)} END")


def labels(p: str = "prompt") -> dict[str, Rule]:
    """What a prompt's words alone decide."""
    return {
        "intent": chosen(p, INTENTS, "query"), "technology": chosen(p, TECHNOLOGIES, "Fullstack"), "style": chosen(p, STYLES, None), "domain": chosen(p, DOMAINS, "general"), "goal": chosen(p, GOALS, "feature delivery"),
        "risk": chosen(p, RISKS, "low"),
    }


def named(df: DataFrame, p: str = "prompt") -> DataFrame:
    """Adds names, files and embedded: what a prompt names. They are columns of their own, so what reads them doesn't scan the text again."""
    held = df.withColumns({"names": A.identifiers(p), "files": A.file_hints(p)})
    return held.withColumn("embedded", A.embedded_names(p, F.col("names")))


def signature(df: DataFrame, p: str = "prompt") -> DataFrame:
    """df with names, files and embedded. Adds the labels, and what the names decide: entity, concepts, identifiers, confidence."""
    names, files = F.col("names"), F.col("files")
    low = lambda *words: says(p, words).column
    first = F.try_element_at(F.filter(names, lambda x: ~((F.length(x) >= 3) & F.lower(x).isin(*A.ASKING_VERBS))), F.lit(1))
    more = [
        F.when(low("responsive", "mobile", "breakpoint"), F.array(F.lit("layout"), F.lit("breakpoints"))), F.when(low("state", "pinia", "store"), F.array(F.lit("state"))),
        F.when(low("token", "mixin", "stylesheet") & low("scss", "sass", "stylesheet", "mixin"), F.array(F.lit("tokens"), F.lit("mixins"))), F.when(low("checkout"), F.array(F.lit("CheckoutView"))),
    ]
    concepts = F.array_sort(F.array_distinct(F.concat(names, *[F.coalesce(m, A.none()) for m in more])))
    others = F.filter("embedded", lambda x: ~F.exists(names, lambda y: F.lower(x) == F.lower(y)))
    held = df.withColumns({name: rule.column for name, rule in labels(p).items()} | {"entity": F.coalesce(first, chosen(p, ENTITIES, "Workspace").column), "concepts": concepts, "identifiers": F.concat(names, others)})
    return held.withColumn("confidence", F.when((F.size(names) > 0) | (F.size(files) > 0), 0.94).when(F.col("entity") != "Workspace", 0.82).otherwise(0.62))


def query_intent(p: str = "prompt") -> Column:
    """What a query with its embedded names traces; a prompt that only names something asks to have it explained."""
    return F.coalesce(chosen(p, QUERY_INTENTS, None).column, F.when(F.size("embedded") > 0, "explain_symbol").otherwise("general"))


def looked_up(intent: Column, at: int) -> Column:
    """An intent's concepts (0), edges (1), keywords (2) or expansions (3)."""
    column = A.none()
    for name, plan in PLANS.items():
        if plan[at]:
            column = F.when(intent == name, F.array(*map(F.lit, plan[at]))).otherwise(column)
    return column


def stands_alone(term: str) -> str:
    """A pattern: the term as a word or a compound's end, not within a longer name. For lower-cased texts without joiners."""
    plain = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term.lower().replace("‌", ""))
    return f"(?<![0-9_]){plain}(?![a-z0-9]|_[a-z0-9])"


def aliases(prompt: Column | str, terms: Mapping[str, Sequence[str]], seeds: Mapping[str, Sequence[str]], precise: Column | None = None, most: int = 12) -> tuple[Column, Column]:
    """The concepts whose terms, of any language, stand in a prompt, and the code names they stand for, each once, so many. precise: the
    prompt names a symbol, so verbs of every trade say nothing. The tables are the caller's; their terms become one pattern a concept."""
    low = F.replace(F.lower(col(prompt)), F.lit("‌"), F.lit(""))
    found = F.array_compact(F.array(*[F.when(low.rlike("|".join(map(stands_alone, words))), concept) for concept, words in terms.items()]))
    if precise is not None:
        found = F.when(precise, F.array_except(found, F.array(*map(F.lit, GENERIC_CONCEPTS)))).otherwise(found)
    named = [F.when(F.array_contains(found, concept), F.array(*map(F.lit, own))).otherwise(A.none()) for concept, own in seeds.items() if own]
    return found, F.slice(once(F.concat(*named)), 1, most)


def once(words: Column) -> Column:
    """Without blanks and words that come before in other letters' case."""
    kept = F.filter(F.transform(words, F.trim), lambda w: w != "")
    return F.filter(kept, lambda w, i: F.array_position(F.transform(kept, F.lower), F.lower(w)) == i + 1)


def is_precise(x: Column) -> Column:
    """A symbol in camel case."""
    return x.rlike("^[A-Za-z0-9_]{4,}$") & x.rlike("[A-Z]") & x.rlike("[a-z]")


def is_code_like(x: Column) -> Column:
    marked = x.rlike("[.(_/]") | (x.rlike("^[A-Za-z0-9]+$") & x.rlike("[0-9]")) | (x.rlike(r"^[a-z]") & x.rlike(r"\p{Lu}"))
    return marked | x.isin(*CODE_WORDS)


def assisted(df: DataFrame, terms: Mapping[str, Sequence[str]], seeds: Mapping[str, Sequence[str]], most: int = 8, p: str = "prompt") -> DataFrame:
    """df with names, files and embedded. Adds keywords and expansions that a prompt in plain words stands for: its plan's, its
    aliases', its own names."""
    concepts, own = aliases(p, terms, seeds, F.exists("embedded", is_precise))
    held = df.withColumns({"intent": query_intent(p), "spoken": concepts, "own": own})
    intent = F.col("intent")
    told = held.withColumns({"keywords": F.concat(looked_up(intent, 2), "own", F.filter("embedded", is_code_like)), "expansions": F.concat(looked_up(intent, 3), "spoken")})
    return told.withColumns({"keywords": F.slice(once(F.col("keywords")), 1, most), "expansions": F.slice(once(F.col("expansions")), 1, most)}).drop("spoken", "own")


def steps(p: str = "prompt") -> Column:
    """An array of (place, step, title, after, files) for a prompt with its entity: twelve steps of a large task, else one."""
    many = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("step"), F.lit(t).alias("title"), listed(after).alias("after"), listed(files).alias("files")) for i, (s, t, after, files) in enumerate(STEPS)])
    title, file = F.concat(F.lit("Execute: "), "entity"), F.concat("entity", F.lit(".vue"))
    one = F.array(F.struct(F.lit(0).alias("place"), F.lit("task_main").alias("step"), title.alias("title"), A.none().alias("after"), F.array(file).alias("files")))
    return F.when(says(p, LARGE_TASKS).column, many).otherwise(one)


def listed(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else A.none()
