"""Rows that differ in which column is null, and rows repeated very often: none is lost or made twice."""

from __future__ import annotations

from collections import Counter

import pytest

from tessera.llm import queries as registered
from tessera.llm.common import repeated, row_hashes
from tessera.llm.mixing import mix_sources, mixed_documents
from tessera.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHIFTED = [
    (1, None, "alpha", "s", 5), (1, "alpha", None, "s", 5), (1, "alpha", "s", None, 5), (1, None, "s", "alpha", 5),
    (2, "b c", None, None, None), (2, None, "b c", None, None), (None, None, None, None, 2), (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shifted"))
    spark.createDataFrame(SHIFTED, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_hashes_tell_null_shifted_rows_apart(spark):
    docs = spark.createDataFrame(SHIFTED, SCHEMA)
    assert docs.select(*row_hashes(docs)).distinct().count() == len(SHIFTED)
    nested = spark.createDataFrame([([None, 1],), ([1, None],), ([1],), (None,)], "a array<int>")
    assert nested.select(*row_hashes(nested)).distinct().count() == 4


def test_no_null_shifted_row_is_lost(spark, shifted):
    docs = spark.read.parquet(f"{shifted}/documents.parquet")
    want = Counter(SHIFTED)
    for name in ("op2_mixing", "op7_sharding"):
        got = registered.queries()[name](spark, shifted).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in SHIFTED), name
    assert Counter(tuple(r)[:5] for r in assign_shards(docs).collect()) == want
    copies = Counter(tuple(r) for r in mixed_documents(docs).collect())
    assert set(copies) <= set(want) and max(copies.values()) <= 3


def test_repeated_in_parts(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 10), (4, 7)], "id int, n long")
    got = sorted(tuple(r) for r in repeated(df, "n", "k", ["id"], part=3).select("id", "k").collect())
    assert got == sorted((i, k) for i, n in ((2, 3), (3, 10), (4, 7)) for k in range(n))


def test_a_row_repeated_ten_million_times(spark):
    """The unit is one row until its copies are counted; they are made in parts."""
    units = spark.createDataFrame([(1, 2, 10_000_000)], "h1 long, h2 long, rows long")
    got = repeated(units, "rows", "at", ["h1", "h2"])
    assert got.selectExpr("count(*)", "sum(at)").first() == (10_000_000, 10_000_000 * 9_999_999 // 2)


def test_hot_units_keep_their_places(spark):
    docs = spark.createDataFrame([(7, "same text")] * 500 + [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = assign_shards(docs, part=64).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(7, "same text")] * 500 + [(i, f"t{i}") for i in range(100)])
    assert len({(r.shard, r.slot) for r in got}) == 600 and max(r.slot for r in got) == 74
    units = mix_sources(docs.withColumn("source", docs.text.substr(1, 1)))
    assert units.agg({"rows": "sum"}).first()[0] == 600
