"""Every registered query over empty tables and over rows with null ids and columns whose names clash with inner ones."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jpeg, toxicity
from tessera.llm import queries as registered

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn int, role string, text string",
}
CLASHING = ("row", "key", "h1", "h2", "id", "digest", "first", "copy", "pack", "size", "place", "least", "stem", "code", "x", "n", "w", "y", "score", "root", "anchor", "slot", "width", "found", "_f", "_d")
NAMES = sorted(n for n in registered.queries() if n != "op1_chat")


def _write(spark, path, rows, extra=False):
    for name, schema in TABLES.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        taken = set(df.columns)
        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING if extra and c not in taken))
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(30 + i), "en", f"s{i % 3}", i) for i in range(40)]
    docs += [(None, text(40), "en", "s1", 1), (None, None, None, None, None), (None, docs[0][1], "en", "s0", 0), (None, "", "en", None, 0), docs[3], (50, None, None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(1, 0, 1), (2, None, 7), (None, 1, 1), (99, -1, 5)]
    talk = [(c, t, "user" if t % 2 else "assistant", text(4) + ".") for c in range(5) for t in range(6)] + [(None, 1, "user", "x"), (1, None, None, None)]
    path = tmp_path_factory.mktemp("odd")
    return _write(spark, path, {"documents": docs, "labels": labels, "conversations": talk, "benchmark": [(0, text(20)), (None, None)]}, extra=True), docs


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert registered.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op4_decontamination", "op11_repair", "pipeline")])
def test_null_ids_and_clashing_columns(spark, odd, name):
    path, docs = odd
    got = registered.queries()[name](spark, path).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)


def test_pipeline_with_clashing_columns(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, odd[0])
    got = rows.select("doc_id", F.col("`_f`").alias("f")).collect()
    assert {r.doc_id for r in got} <= {d[0] for d in odd[1]} and {r.f for r in got} <= {"own _f"}


def test_thumbnails_keep_own_columns(spark):
    media = spark.createDataFrame([(7, "mine", jpeg.encode_payload(bytes(64)))], "width int, _f string, media binary")
    got = jpeg.thumbnail_features(media)
    assert got.columns == ["width", "_f", "media", "width_", "height", "thumb_sha256", "thumb_hash"]
    r = got.first()
    assert r["width"] == 7 and r["_f"] == "mine" and r["width_"] > 0


def test_toxicity_of_very_long_labelled_texts(spark):
    """Labelled texts of megabytes with one toxic passage count whole; the driver gets short pieces alone."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words, n))
    texts = [prose(40) if i % 2 else f"{prose(20)} moronic worthless {prose(20)}" for i in range(120)]
    ids = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    texts[ids[0]] = " ".join([prose(1000)] * 600)
    texts[ids[1]] = "z" * 5_000_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).toPandas().set_index("doc_id").score
    rest = [i for i in range(120) if i not in ids[:2]]
    assert got.between(0, 1).all() and np.mean([(got[i] > 0.5) == (i % 2 == 0) for i in rest]) > 0.95
    assert all(len(w) < toxicity.WINDOW for w in toxicity.cut(b"z" * 1000)) and b"".join(toxicity.cut(b"z" * 1000)) == b"z" * 1000
