"""Language ID: family first, then one-versus-one linear support vector machines within it.

Features are byte trigrams of the lower-cased text, hashed into a fixed number of bins and
taken as shares of the text. A one-versus-rest linear SVM per family picks the family; within
it a linear SVM for each pair of languages votes. All machines are linear, so a document's
decision values are means of weights over its trigrams: the whole text is read in one pass.

The machines are fitted on the driver from a bounded sample of labelled rows: of each language
the `per_lang` training documents with the smallest hash of their doc_id, fewer where there are
so many languages that the sample would pass `most_rows`. Every language of the training rows
is learned. The language, source and id of a row never enter its prediction.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled
training rows everything is `und`; a row with a null id is in training; rows that repeat an id,
its text and language are one document of the sample, and give repeated rows of the result; equal
votes go to the language with the wider margin, then to the first by name; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import give_back, pick, small_batches, text_chunks

#: Families of languages by code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
BINS = 1 << 13
_CLASS = np.uint32(2654435761)


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def trigram_bins(data: np.ndarray) -> np.ndarray:
    """The bin of each byte trigram of a run of lower-cased bytes."""
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * _CLASS) >> np.uint32(19)).astype(np.int32)


def folded(text: str) -> np.ndarray:
    """Lower-cased UTF-8 with a blank at both ends."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of trigram shares: unit length, and common trigrams don't drown the rest."""
    counts = np.bincount(trigram_bins(folded(text)), minlength=BINS).astype(np.float64)
    return np.sqrt(counts / max(1.0, counts.sum()))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by dual coordinate descent; y is -1 or 1."""
    n = len(x)
    data = np.hstack([x, np.ones((n, 1))])
    diag = np.einsum("ij,ij->i", data, data) + 0.5 / c
    alpha, w = np.zeros(n), np.zeros(data.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * (w @ data[i]) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * data[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """families: their names; tops: a machine for each (none if there is one); inside: per family (languages, machines by pair)."""

    families: list[str]
    tops: list[tuple[np.ndarray, float]]
    inside: dict[str, tuple[list[str], dict[tuple[int, int], tuple[np.ndarray, float]]]]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        names = sorted(set(langs))
        families = sorted({family_of(n) for n in names})
        of = np.array([family_of(n) for n in langs])
        lang = np.array(langs)
        tops = [fit_svm(x, np.where(of == f, 1.0, -1.0)) for f in families] if len(families) > 1 else []
        inside = {}
        for f in families:
            own = [n for n in names if family_of(n) == f]
            pairs = {}
            for i in range(len(own)):
                for j in range(i + 1, len(own)):
                    rows = (lang == own[i]) | (lang == own[j])
                    pairs[i, j] = fit_svm(x[rows], np.where(lang[rows] == own[i], 1.0, -1.0))
            inside[f] = (own, pairs)
        return cls(families, tops, inside)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = self.families[0], 1.0
        if self.tops:
            values = np.array([x @ w + b for w, b in self.tops])
            at = int(np.argmax(values))
            family, sure = self.families[at], squashed(values[at])
        own, pairs = self.inside[family]
        votes, margin = np.zeros(len(own)), np.full(len(own), np.inf)
        for (i, j), (w, b) in pairs.items():
            value = float(x @ w + b)
            votes[i if value >= 0 else j] += 1
            margin[i], margin[j] = min(margin[i], value), min(margin[j], -value)
        best = max(range(len(own)), key=lambda i: (votes[i], margin[i], -i))
        if pairs:
            sure = min(sure, squashed(margin[best]))
        return own[best], float(sure)


def squashed(value: float) -> float:
    """A decision value as a score from 0 to 1."""
    return float(1.0 / (1.0 + np.exp(-4.0 * np.clip(value, -50, 50))))


def held_out(doc_id: object, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def held_out_column(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, most_rows: int = 16_000) -> Model | None:
    """Fits the machines on training rows (crc32 of the id's text mod 5 not 0, text and language not null)."""
    small_batches(df.sparkSession)
    rows = pick(df, doc_id=id_col, text=text_col, lang=lang_col).filter(~held_out_column() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = rows.select(F.count_distinct("lang")).first()[0]
    if not langs:
        return None
    share = max(1, min(per_lang, most_rows // langs))
    keyed = rows.select("lang", "doc_id", F.xxhash64("text").alias("fp"), "text")
    near = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "fp")
    chosen = keyed.select("lang", "doc_id", "fp").withColumn("n", F.dense_rank().over(near)).filter(F.col("n") <= share).select("lang", "doc_id", "fp").distinct()
    chosen = F.broadcast(chosen.toDF("l", "i", "f"))  # most_rows rows at most, or one a language
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))
    sample = keyed.join(chosen, same, "left_semi").dropDuplicates(["lang", "doc_id", "fp"]).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = [features(t.as_py()).astype(np.float32).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["lang", "x"])

    # bounded: most_rows rows, or one a language, of 32 KB
    got = sorted(((r.lang, bytes(r.x)) for r in sample.mapInArrow(vectors, "lang string, x binary").toLocalIterator()))
    x = np.array([np.frombuffer(v, dtype=np.float32) for _, v in got], dtype=np.float64)
    return Model.fit(x, [lang for lang, _ in got])


def judged(text: str | None, model: Model | None) -> tuple[str, float]:
    if model is None or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    return model.predict(features(text))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, end, _, _ in text_chunks(batch.column(2)):
                langs, scores = [], []
                for value in batch.column(2).slice(first, end - first):
                    lang, score = judged(value.as_py(), model)
                    langs.append(lang)
                    scores.append(score)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = pick(df, doc_id=id_col, text=text_col).select("doc_id", held_out_column().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(df: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df whose language is told with a score of `least` or more, with all their columns; `und` goes."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, end, _, _ in text_chunks(batch.column(at)):
                part = batch.slice(first, end - first)
                kept = [judged(value.as_py(), model)[1] >= least for value in part.column(at)]
                yield part.filter(pa.array(kept))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)
