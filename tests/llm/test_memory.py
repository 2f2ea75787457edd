"""What a worker holds between tasks, and what it is handed at once."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from tessera.llm import bpe, jaccard_join, language_id

#: Bytes that a kernel may get at once.
BATCH_BYTES = 4 << 20
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
HELD = r"""
import re
import numpy as np
import pyarrow as pa
from tessera.llm.common import give_back

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

give_back()
pa.array(["x"] * 3)  # loads what Arrow needs for it
before = held()
for size in (1 << 22, 1 << 23, 1 << 24, 1 << 24):  # a run's arrays grow, and go
    np.ones(size, np.uint8)
arrays, kept = [], []
for _ in range(50):  # results that stay lie between arrays that go
    arrays.append(np.ones(1 << 22, np.uint8))
    kept.append(np.ones(1 << 10, np.uint8))
texts = [pa.array(["x" * (1 << 20)] * 4) for _ in range(20)]
del arrays, texts
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_arrays_that_go_are_given_back():
    """Held some 300 MB before."""
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 20


@pytest.mark.parametrize("operator", [
    lambda df: language_id.accepted(df, None),
    lambda df: jaccard_join.join(df),
    lambda df: bpe.encode_documents(df, "unused"),
])
def test_texts_come_in_small_batches(spark, operator):
    spark.conf.unset(KEY)
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 5000) AS text")
    operator(df)  # names the limit

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    seen = df.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in seen) == 3000 and max(r.bytes for r in seen) < 1.1 * BATCH_BYTES


def test_a_session_keeps_its_own_limit(spark):
    spark.conf.set(KEY, "123456")
    try:
        language_id.accepted(spark.createDataFrame([(1, "a")], "doc_id long, text string"), None)
        assert spark.conf.get(KEY).rstrip("b") == "123456"
    finally:
        spark.conf.unset(KEY)


def test_pairs_that_are_kept_are_bounded(monkeypatch):
    """Ids stay the same when the pairs of tokens that a worker keeps are few."""
    from tessera.llm.queries import tokenizer_path

    texts = ["unbelievable antidisestablishmentarianism 12345x", "Zweigniederlassung größenwahn, übermäßig!", "qwxzjkv" * 20]
    plain = bpe.Bpe(tokenizer_path())
    wanted = [plain.encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "FITS", 5, raising=False)
    tight = bpe.Bpe(tokenizer_path())
    assert [tight.encode(t).tolist() for t in texts] == wanted and len(tight.fit) <= 5 < len(plain.fit)


def test_kernels_give_back(monkeypatch):
    calls = []

    class Kernels:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(jaccard_join, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], ["doc_id", "text"])
    assert list(jaccard_join.signatures(Kernels, 5)(iter([batch]))) and calls
