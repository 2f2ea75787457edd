"""Each corpus operator against brute force on small fixtures, and on nulls, empties, repeats, long texts and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, cqf, elias_fano, exact_dedup, jaccard_join, language_id, language_model, licenses, mixing, secrets, url_filter
from tessera.llm.queries import tokenizer_path
from tessera.llm.words import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def make_docs(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 20
    rows = []
    for i in range(n):
        words_ = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 80, 200]))]
        if rows and rng.random() < 0.4:
            words_ = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                if words_:
                    words_[rng.randrange(len(words_))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words_), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 1, True))
    text = " ".join(f"base{i}" for i in range(60))
    for i in range(n, n + 25):  # a group of near copies around one text
        w = text.split()
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "a", 1, True))
    k = len(rows)
    rows += [(k, None, None, None, None, None), (k + 1, "", "en", "a", 0, True), (k + 2, " \t\n", "en", "b", 3, True), (k + 3, None, "de", None, 0, True), (k + 4, "Straße ÉCOLE 日本 " * 3, "de", "b", 3, True)]
    rows += [(k + 5, "long " * 30_000 + "end", "en", "a", 1, True), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = exact_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        own = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert exact_dedup.classes(none).count() == 0
    kept = exact_dedup.distinct(docs)
    assert kept.columns == docs.columns and Counter(r.text or "" for r in kept.collect()) == Counter(groups.keys())


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.text_sha256[:2]): r.keep_id for r in exact_dedup.classes(df).collect()}[(None, hashlib.sha256(b"a").hexdigest()[:2])] == 1


@pytest.mark.parametrize(("rows", "kept"), [
    ([(1, "a"), (1, "b"), (2, "a")], [(1, "b"), (2, "a")]),
    ([(None, "a"), (1, "a")], [(1, "a")]),
    ([(None, "a"), (None, "a"), (None, None), (None, "")], [(None, ""), (None, "a")]),
    ([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (2, "c"), (3, "c")], [(1, "a"), (2, "b"), (3, "c")]),
    ([], []),
])
def test_exact_dedup_keeps_one_row_of_each_text(spark, rows, kept):
    """Ids that repeat, null ids, and columns that are named as the operator's own."""
    more = [(i, t, "x", 7, 7, True, "y", 1) for i, t in rows]
    df = spark.createDataFrame(more, "doc_id long, text string, fp string, keep long, size long, kept boolean, text_sha256 string, _again long")
    got = exact_dedup.distinct(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted(kept, key=repr)
    assert all(tuple(r)[2:] == ("x", 7, 7, True, "y", 1) for r in got.collect())


def test_clashing_columns_and_null_ids(spark):
    """Stages keep columns that are named as their own helpers; null ids and repeated rows come through each operator."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "a"), (2, text + " x", "en", "a"), (None, text + " y", "en", "b"), (None, None, None, None), (3, "other words here", "de", "b"), (3, "other words here", "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("gone", "_gone", "size", "row", "_row", "words", "copies", "_copies", "copy", "id", "_id", "k", "_n", "source_of"):
        df = df.withColumn(name, F.lit(99))
    one = jaccard_join.one_of_each(df)
    assert one.columns == df.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 0, 1, 3, 3]
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and all(set(tuple(r)[4:]) == {99} for r in mixed.collect())
    want = sum(r.taken for r in mixing.mix(df).collect())
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == want
    assert len(mixing.mix(df).collect()) == 6
    for out in (bpe.encode_documents(df, tokenizer_path()), language_model.score(df), language_id.predict(df, language_id.train(df)), secrets.scan(df), licenses.scan(df), jaccard_join.join(df)):
        assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 0, 1, 2, 3, 3]
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None), (1, None)], "page_id long, url string")
    assert [r.host for r in url_filter.judge(pages).orderBy(F.col("page_id").asc_nulls_first()).collect()] == ["a.com", "", ""]


def test_quotient_filter_is_lossless():
    rng = np.random.default_rng(1)
    for skip in (0, 6, 14):
        values = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
        if skip:
            values = (values >> np.uint64(skip)) | (np.uint64(3) << np.uint64(64 - skip))
        values = np.concatenate([values, values[:700], values[:20], values[:1].repeat(9)])
        found, counts = cqf.build(values)
        again = cqf.decode(cqf.encode(found, counts, skip))
        assert (again[0] == found).all() and (again[1] == counts).all()
    a, b = cqf.build(values[:3000]), cqf.build(values[3000:])
    merged = cqf.merge([a, b])
    assert (merged[0] == found).all() and (merged[1] == counts).all()
    assert len(cqf.decode(cqf.encode(*cqf.build(np.zeros(0, np.uint64))))[0]) == 0


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(docs, rows, none):
    first, again = (sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(dict(sizes))
    taken, biggest = Counter(), defaultdict(int)
    for _, size, source_size, target, took, source in first:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-9)
        assert 0 <= took <= 2 * size and (size == 0 or took % size == 0)
        taken[source] += took
        biggest[source] = max(biggest[source], size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.select("text").collect()) == sum(taken.values())


def test_mixing_is_near_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * min(4000, int(rng.paretovariate(1.2) * 20)), "en", f"s{i % 4}" if i % 3 else "hot", 1, True) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert all(abs(r.t - r.x) < 0.02 * r.x for r in got)


def test_bpe(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in bpe.encode_documents(docs, tokenizer_path(), with_ids=True).collect()}
    for i, text in {r[0]: r[1] or "" for r in rows}.items():
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == theirs.decode(ids, skip_special_tokens=False) == text
    assert bpe.encode_documents(none, tokenizer_path()).count() == 0


def test_bpe_fuzz():
    tokenizers = pytest.importorskip("tokenizers")
    theirs, ours = tokenizers.Tokenizer.from_file(tokenizer_path()), bpe.load(tokenizer_path())
    rng = random.Random(5)
    letters = "aAbB thetion'sre\n\t 12éİ​\x1c\x85 中日🎉👨‍👩‍👧ßｱ̀"
    for i in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        if i % 7 == 0:
            s += "<|endoftext|>" + s
        if i % 2:
            s += "".join(chr(rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(12))
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert ours.encode(s).tolist() == ids and ours.decode(ours.encode(s)) == theirs.decode(ids, skip_special_tokens=False)
    for s in ("a" * 20_000, "ab" * 9_000 + "ththeth" * 999):
        assert ours.encode(s).tolist() == theirs.encode(s).ids


def brute_scores(rows: list[tuple]) -> dict:
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    texts = [(r[0], [*WORD.findall((r[1] or "").translate(LOW)), "</s>"]) for r in rows]
    uni, bi = Counter(), Counter()
    for i, w in texts:
        if not held[i]:
            uni.update(w)
            bi.update(zip(["<s>", *w], w, strict=False))
    n, v, starts, after, d = sum(uni.values()), len(uni), sum(not held[r[0]] for r in rows), Counter(c for c, _ in bi), 0.75
    out = {}
    for i, w in texts:
        base = score = 0.0
        for c, x in zip(["<s>", *w], w, strict=False):
            u = (uni[x] + 1) / (n + v + 1)
            m = starts if c == "<s>" else uni[c]
            base += math.log10(u)
            score += math.log10((max(bi[c, x] - d, 0) + d * after[c] * u) / m if m else u)
        out[i] = (held[i], len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


@pytest.mark.parametrize(("run_tokens", "hot"), [(2_000_000, 2_000_000), (400, 2_000_000), (400, 60)])
def test_language_model(docs, rows, none, monkeypatch, run_tokens, hot):
    monkeypatch.setattr(language_model, "RUN_TOKENS", run_tokens)
    monkeypatch.setattr(language_model, "HOT", hot)  # contexts of more tokens are spread over shards
    want = brute_scores(rows)
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and abs(r.score - score) < 2e-4 * n
    assert language_model.score(none).count() == 0


def test_language_model_scores_do_not_depend_on_runs(docs, monkeypatch):
    scores = []
    for run_tokens in (2_000_000, 400):
        monkeypatch.setattr(language_model, "RUN_TOKENS", run_tokens)
        frame = docs.coalesce(1) if run_tokens > 400 else docs
        scores.append({r.doc_id: r.score for r in language_model.score(frame).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(scores[0][i], scores[1][i], rel_tol=1e-9, abs_tol=1e-9) for i in scores[0])


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,0)"])
def test_language_model_ids_of_any_type(docs, rows, kind):
    want = brute_scores(rows)
    got = language_model.score(docs.withColumn("doc_id", F.col("doc_id").cast(kind)))
    assert got.schema["doc_id"].dataType.simpleString() == kind
    for r in got.collect():
        assert r.held_out == want[int(r.doc_id)][0] and abs(r.score - want[int(r.doc_id)][5]) < 2e-4 * r.n_tokens


def test_language_model_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.doc_id, r.held_out, r.train_tokens) for r in language_model.score(df.coalesce(1)).collect())
    assert got == [(1, None, False, 8), (3, None, False, 8), (4, None, False, 8)]


def test_elias_fano_trie():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 3000):
        v = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        e = elias_fano.EliasFano(elias_fano.EliasFano.encode(v))
        q = np.concatenate([v, v[:50] + np.uint64(1), rng.integers(0, 1 << 63, 50).astype(np.uint64)])
        place = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]
    c, counts = np.arange(5, 500, 7, dtype=np.uint64), rng.integers(1, 20, 71)
    s = np.concatenate([np.unique(rng.integers(0, 1 << 39, k).astype(np.uint64)) for k in counts])
    logs = -rng.random(len(s)) * 5
    trie = elias_fano.Trie.mapped(elias_fano.Trie.encode(c, counts, s, logs))
    assert np.abs(trie.lookup(c, counts, s) - logs).max() < 2e-4
    start, end = trie.bounds(np.arange(71))
    assert (end - start == counts).all() and np.isnan(trie.lookup(c, np.ones(71, np.int64), np.full(71, 1 << 39, np.uint64))).all()
    # a context's words are found after it alone, the last of the one before and the first of the next ones not
    shifted = np.concatenate([np.setdiff1d(rng.integers(0, 1 << 39, 9).astype(np.uint64), s)[:1] for _ in c])
    assert np.isnan(trie.lookup(c, np.ones(71, np.int64), shifted)).all() and np.isnan(trie.lookup(c + np.uint64(1), counts, s)).all()
    begin = np.cumsum(counts) - counts
    assert np.isnan(trie.lookup(c[:-1], np.ones(70, np.int64), s[begin[1:]])).all()
    e = elias_fano.EliasFano(elias_fano.EliasFano.encode(v))
    assert (e.get(np.arange(len(v))) == v).all()
    none_held = elias_fano.Trie.mapped(elias_fano.Trie.encode(c[:0], counts[:0], s[:0], logs[:0]))
    assert np.isnan(none_held.lookup(c, np.ones(71, np.int64), s[:71])).all()


def test_language_id(spark, none, docs):
    rng = random.Random(2)
    kinds = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "nicht", "schon"], "fr": ["les", "une", "dans", "pour"], "es": ["los", "que", "para", "con"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.choice([3, 20, 200]))), k, None, 1, True) for i, k in enumerate(rng.choice(sorted(kinds)) for _ in range(400))]
    rows += [(1000, None, "en", None, 1, True), (1001, "12 !?", "de", None, 1, True), (1002, "", None, None, 1, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in rows[:400] if got[r[0]].held_out]
    assert len(held) > 40 and all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.accepted(df, language_id.train(df))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in rows[:400] if got[r[0]].score >= 0.5}
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), m.end(), 0))
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets(spark, none):
    rng = random.Random(8)
    bits = ["password", "PassWD", "Secret", "token", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", ' = "', "'", "abc", "abcdefgh12", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é", "日"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))), None, None, 0, None) for i in range(400)] + [(900, None, None, None, 0, None), (901, "x" * 200_000, None, None, 0, None)]
    rows.append((902, "The meeting notes are long enough to hold some words. " * 8 + "credential Zq8RtYp0LmN3xVbKsW5aJd7GhUoTc1 there", None, None, 0, None))
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text, *_ in rows:
        want = brute_spans(text or "")
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), text
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for *_, k in want) for j in range(3)]
        assert set(filter(None, shown.split(","))) <= set(got[i].spans.split(",") if got[i].spans else [])
    assert got[902].n_novel == 1 and secrets.scan(none).count() == 0


def test_secrets_in_lists():
    """Random secrets amid others of their alphabet are found; identifiers amid others, and secrets said before, aren't."""
    rng, novelty = random.Random(4), secrets.Novelty()
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for letters in (digits + "ABCDEF", digits + "abcdef", upper + "234567", lower + digits, upper + lower + digits):
        for size in (24, 40):
            lines = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(100)]
            text = "\n".join(f"credential {x}" for x in lines)
            base = secrets.base_spans(text)
            assert len(secrets.novel_spans(text, base, novelty)) + len(base) >= 90
    names = ["release_notes_version_2", "sha256_of_the_whole_file", "convertUtf8ToUtf16Strings", "user_account_2024_01_15", "parseHttp2FrameHeaderBytes"]
    text = "\n".join(f"credential {x}" for x in names * 4)
    assert secrets.novel_spans(text, [], novelty) == []


def brute_novel(text: str) -> list[tuple[int, int, int]]:
    """Plain restatement: each long token that begins within reach of a sensitive word, is no word, overlaps no base span, and
    costs enough bits with zstandard primed by the dictionary and its surroundings."""
    novelty, base, out = secrets.Novelty(), brute_spans(text), []
    words_ = [m.end() for m in re.finditer(r"(?i)password|passwd|secret|token|api_?key|credential|private_?key|bearer|authorization|access_?key", text, re.ASCII)]
    taken = 0
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        # a token begins where a run does, or where the sensitive word inside the run ends
        for start in sorted({m.start(), *[w for w in words_ if m.start() < w < m.end()]}):
            start = max(start, taken)
            if m.end() - start < 20 or not any(w <= start < min(w + secrets.CONTEXT, len(text)) for w in words_):
                continue
            word, taken = text[start : m.end()], m.end()
            if any(a < m.end() and start < b for a, b, _ in base) or (word.isalpha() and (word[1:].islower() or word.isupper())):
                continue
            around = text[max(0, start - secrets.AROUND) : start] + "\n" + text[m.end() : m.end() + secrets.AROUND] + "\n"
            mixed = secrets.joints(word) >= max(secrets.JOINTS, secrets.JOINTS_EACH * len(word))
            if novelty.bits(around, word) >= secrets.NOVEL_BITS or (mixed and novelty.unmatched(around, word) >= secrets.UNMATCHED):
                out.append((start, m.end(), 3))
    return out


def test_novel_secrets_equal_a_plain_restatement():
    rng = random.Random(6)
    tail = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for _ in range(300):
        bits = ["token", "bearer ", "credential ", " ", "\n", "some words of prose ", "release_notes_version_2", "user_account_2024_01_15 "]
        text = "".join(rng.choice(bits) if rng.random() < 0.7 else "".join(rng.choice(tail) for _ in range(rng.choice([8, 24, 40]))) + rng.choice([" ", "!", ""]) for _ in range(rng.randrange(1, 25)))
        got = secrets.novel_spans(text, secrets.base_spans(text), secrets.Novelty())
        assert got == brute_novel(text), text


def test_many_spans_in_one_text():
    """Thousands of secrets or notices in one text: the work is that of their number, not of its square."""
    rng = random.Random(2)
    text = "\n".join(f"credential {rng.getrandbits(150):x}Zq" for _ in range(3000))
    base = secrets.base_spans(text)
    assert len(base) + len(secrets.novel_spans(text, base, secrets.Novelty())) >= 3000
    index = licenses.Index.of(licenses.TEMPLATES)
    words_ = licenses.name_words(" ".join(["plain words Released under the MIT License"] * 4000).encode())[0]
    hits = [(p, n) for k in (licenses.K, licenses.K - 1) for p, n in index.hits(licenses.shingles(words_, k))]
    found = licenses.spans(index, words_, hits)
    assert len(found) == 4000 and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_ann(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 16))
    x = (centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    x[100:160] = x[100]  # equal vectors: ties go to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] + [1.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [1.0, 2.0], 0), (5100, [float("inf")] + [1.0] * 15, 0)] + [rows[7]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 3000, 20))
    for q, found in got.items():
        score = (y * y[q]).sum(axis=1)
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(score[v] - s) < 1e-12 for _, v, s in found)
        assert [v for _, v, _ in found] == [v for _, v, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        order = [v for v in np.lexsort((np.arange(3000), -score)) if v != q][:20]
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:6], df.schema)
    assert sorted((r.rank, r.query_id) for r in ann.search(few).collect()) == [(i, 0) for i in range(1, 6)]
    assert ann.search(spark.createDataFrame([], df.schema)).count() == 0


def test_ann_parts_large_leaves(spark, monkeypatch):
    """A table far larger than the sample: leaves are parted by trees of their own, and answers stay near brute force."""
    for name, value in (("SAMPLE", 160), ("LEAF_ROWS", 16), ("SPLIT_ROWS", 40), ("SPLIT_SAMPLE", 64), ("ROW_CHUNK", 256)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 12))
    x = centers[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 12)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    entries = df.selectExpr("array(vec_id) AS ids", "embedding AS v")
    base = ann.Tree.fit(x[:160], ann.LEAF_SAMPLE)
    tree = ann.deepened(entries, base, 12, "double")
    sizes = np.bincount(tree.assign(x), minlength=len(tree.leaf))
    assert len(tree.leaf) > 4 * len(base.leaf) and sizes.sum() == 4000 and sizes.max() < np.bincount(base.assign(x)).max()
    assert sorted(tree.walk(x[0])) == list(range(len(tree.leaf)))  # every leaf, once
    inside = tree.centroids[[n for n, c in enumerate(tree.children) if not len(c)]]
    near = np.linalg.norm(x - inside[tree.assign(x)], axis=1).mean()
    assert near < np.linalg.norm(x - base.centroids[[n for n, c in enumerate(base.children) if not len(c)]][base.assign(x)], axis=1).mean()
    hits, total = 0, 0
    for r in ann.search(df).groupBy("query_id").agg({"vec_id": "collect_set"}).collect():
        score = x @ x[r[0]]
        true = [v for v in np.lexsort((np.arange(4000), -score)) if v != r[0]][:20]
        hits, total = hits + len(set(true) & set(r[1])), total + 20
    assert total == 4000 and hits >= 0.9 * total


def test_ann_in_double_precision(spark):
    """Scores are products of the original vectors, also where single precision would round them."""
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1 + 1e-9, 2.0]), (3, [1 - 1e-9, 2.0]), (None, [5.0, 5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1 + 1e-9 + 4), (1, 5.0), (3, 1 - 1e-9 + 4)]
    whole = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id int, embedding array<int>")
    assert [tuple(r) for r in ann.search(whole).collect()] == [(0, 1, 1, 11.0)]


def test_language_id_learns_every_language(spark):
    """More languages than the sample has room for at the full share: each still has its rows, and rows that repeat don't crowd it."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} " * 20, f"l{i % 70}", None, 1, True) for i in range(140)]
    rows += [rows[3]] * 200
    model = language_id.train(spark.createDataFrame(rows, SCHEMA), per_lang=5, most_rows=100)
    trained = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0}
    assert {x for own, _ in model.inside.values() for x in own} == trained and len(trained) > 64


def brute_components(rows: list[tuple]) -> dict:
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_join(docs, rows, none):
    want = brute_components(rows)
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c in want.values()}
    assert jaccard_join.join(none).count() == 0


@pytest.mark.parametrize(("meet", "turn"), [(4096, 4), (40, 2)])
def test_jaccard_join_near_the_threshold(spark, monkeypatch, meet, turn):
    """Copies around one text that link to few of the others: hubs don't join them, lists have to meet, in pieces and turns."""
    monkeypatch.setattr(jaccard_join, "MEET_DOCS", meet)
    monkeypatch.setattr(jaccard_join, "TURN", turn)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(100)] = f"y{rng.randrange(6)}"
        rows.append((i, " ".join(w), "en", "a", 1, True))
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_join_of_ids_with_several_texts(spark):
    """An id with two texts joins their components; rows that repeat an id and its text are alike."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (3, b), (4, c), (4, None), (5, c + " so"), (6, ""), (None, a), (None, b)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 36, 1), (2, 37, 1), (2, 36, 1), (3, 36, 1), (3, 36, 1), (4, 36, 4), (4, 0, 4), (5, 37, 4), (6, 0, 6), (None, 36, None), (None, 36, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_jaccard_join_of_a_shared_passage(spark):
    """Documents that share a passage and have more of their own than similarity allows are in nobody's list; those that have
    less link."""
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(17)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(900)}" for _ in range(3)]), "en", "a", 1, True) for i in range(400)]
    rows += [(1000 + i, " ".join(passage[:12] + [f"t{rng.randrange(3)}" for _ in range(rng.choice([1, 2, 3]))]), "en", "a", 1, True) for i in range(200)]
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_jaccard_candidates_lose_no_link():
    """Bitmaps and sizes let every pair through whose overlap is enough, whatever their sizes."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64)
        sets = []
        for _ in range(25):
            s = base.copy()
            s[rng.random(len(s)) < rng.choice([0, 0.05, 0.1, 0.3])] += np.uint64(rng.integers(1, 4))
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 62, rng.integers(0, 2 + len(s) // 5)).astype(np.uint64)])))
        n = np.array([len(s) for s in sets])
        bits = []
        for s in sets:
            width = max(64, 1 << (len(s) - 1).bit_length())
            bits.append(np.packbits((np.bincount((jaccard_join.mix(s, 55) % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes())
        told = {(min(i, j), max(i, j)) for i, near in jaccard_join.candidates(n, np.ones(25, bool), bits, 4, 5) for j in near.tolist()}
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert 5 * both < 4 * (n[i] + n[j] - both) or (j, i) in told


def test_jaccard_join_of_cut_lists(spark, monkeypatch):
    """A text's exact copies make its tokens so frequent that their lists are cut; the near copies still link to it."""
    monkeypatch.setattr(jaccard_join, "LIST_CHUNK", 40)
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(120):
            w = list(base)
            if i % 40 == 39:
                w[i // 2] = f"n{i}"
            rows.append((rng.randrange(1 << 40), " ".join(w), "en", "a", 1, True))
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA).repartition(12)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_shingles_equal_a_plain_restatement():
    texts = ["a b c d e f", "A  b\tc d e f", "x", "", " ", "one two three four", "é b c d e é b c d e"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, _, first = words(data, np.cumsum([0, *map(len, raw)]))
    sets = shingle_sets(hashes, first)
    assert sets[0].tolist() == sets[1].tolist() and [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 5]


def test_licenses(spark, none):
    long = "Some words. " * 4000
    rows = [
        (1, "Hello there.\nReleased under the MIT License.", "MIT"),
        (2, "é Licensed under the APACHE license, version 2.0! " + long, "Apache-2.0"),
        (3, long + "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (4, "Permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and related documentation files", "MIT"),
        (5, "The license of the driver is a plain card.", ""), (6, None, ""), (7, "", ""), (8, "Licensed under CC BY-NC 4.0. Released under the MIT License.", "CC-BY-NC-4.0,MIT"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t, None, None, 0, None) for i, t, _ in rows], SCHEMA)).collect()}
    assert {i: got[i].licenses for i in got} == {i: x for i, _, x in rows}
    name, a, b, cover = got[2].spans.split(":")
    assert rows[1][1][int(a) : int(b)] == "Licensed under the APACHE license, version 2.0" and float(cover) == 1
    assert 0.8 <= float(got[4].spans.split(":")[3]) < 1 and licenses.scan(none).count() == 0


def test_license_variants_of_one_word(spark):
    """Each template with a word changed, left out or put in is found wherever its alignment reaches the coverage."""
    rows, want = [], {}
    index = licenses.Index.of(licenses.TEMPLATES)
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        words_ = text.split()
        for at in range(len(words_)):
            for new in ([], ["zebra"], ["zebra", words_[at]]):
                doc = " ".join(["plain"] * 9 + words_[:at] + new + words_[at + 1 :] + ["plain"] * 9)
                template, hashes = index.templates[t][1], licenses.name_words(doc.encode())[0]
                want[len(rows)] = licenses.align(template, hashes, -len(template), len(hashes))[0] >= licenses.COVERAGE * len(template)
                rows.append((len(rows), doc, None, None, 0, None))
    got = {r.doc_id: r.n_spans for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in want if want[i] and not got[i]] == [] and sum(want.values()) > 500
    assert licenses.winnow(np.array([4, 1, 3], np.uint64)) == [0, 1, 2]


def test_whole_license_texts(spark):
    """Each whole text, its words changed here and there, is one span of its license; two of them in a document are two."""
    rng = random.Random(8)
    texts = dict(licenses.whole_texts())
    rows, want = [], []
    for name, text in texts.items():
        words_ = [w if rng.random() < 0.97 else "zebra" for w in text.split()]
        rows.append((len(rows), " ".join(["plain text"] * 50 + words_ + ["more text"] * 50), None, None, 0, None))
        want.append(name)
    rows.append((len(rows), texts["MIT"] + " between " * 30 + texts["GPL-2.0"] + " between " * 30 + texts["MIT"], None, None, 0, None))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for i, name in enumerate(want):
        cover = {x.split(":")[0]: float(x.split(":")[3]) for x in got[i].spans.split(",")}
        assert cover.get(name, 0) > 0.9 and got[i].n_spans == 1, (name, got[i].spans)
    assert [x.split(":")[0] for x in got[len(want)].spans.split(",")] == ["MIT", "GPL-2.0", "MIT"]
    npr = np.random.default_rng(1)
    for _ in range(200):
        t, w = npr.integers(0, 6, 30).astype(np.uint64), npr.integers(0, 6, 50).astype(np.uint64)
        low, high = sorted(npr.integers(-30, 50, 2).tolist())
        assert licenses.align_long(t, w, low, high)[0] == licenses.align(t, w, low, high)[0]


def test_license_alignment_equals_plain_lcs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        t, w = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 15)).astype(np.uint64)
        plain = np.zeros((len(t) + 1, len(w) + 1), int)
        for i in range(len(t)):
            for j in range(len(w)):
                plain[i + 1, j + 1] = max(plain[i, j + 1], plain[i + 1, j], plain[i, j] + 1 if t[i] == w[j] else 0)
        assert licenses.align(t, w, -20, 20)[0] == plain[-1, -1]


def test_url_filter(spark):
    hosts = ["example.com", "www.example.com", "a.www.example.com", "com", "xcom", "a.net", "EXAMPLE.org", "my.casino.org", "x.edu", "", "b.cheap-pills.example.net", "user:p@h.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/a?x=/fr/", "/es/x", "/fr/", "#/en/", "?q", "/wp-login.php", "/a.exe", "/a.com/", "/" + "y" * 5000, "/é日"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://") for h in hosts for p in paths] + [None, "", "no scheme.com/", "mailto:x@y.com"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.canonical(u)
        fits = [h + p for _, h, p in url_filter.HOST_RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        globs = [g for _, g in url_filter.GLOBS if re.fullmatch("(?s)" + ".*".join(map(re.escape, g.split("*"))), host + path)]
        glob = max(globs, key=lambda g: (len(g), [-ord(c) for c in g]), default=None) if rule is None else None
        verdict = dict((h + p, v) for v, h, p in url_filter.HOST_RULES).get(rule) or dict((g, v) for v, g in url_filter.GLOBS).get(glob, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].glob_rule, got[i].verdict) == (host, path, rule, glob, verdict), u
    assert url_filter.judge(df.filter("false")).count() == 0
