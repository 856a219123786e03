"""The manifest against a tree in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

from tessera.llm import manifest
from tessera.llm import queries as registered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def path_of(levels, at, arity):
    for level in levels[:-1]:
        first = at - at % arity
        yield level[first:at], level[at + 1 : first + arity]
        at //= arity


def expected(rows, arity=16):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in rows if r[1] == s), key=lambda t: t[:3])
        trees[s] = (mine, levels_of([m[2] for m in mine], arity))
    top = levels_of([trees[s][1][-1][0] for s in sources], arity)
    out = []
    for k, s in enumerate(sources):
        mine, levels = trees[s]
        for at, (*_, leaf, row) in enumerate(mine):
            path = [*path_of(levels, at, arity), *path_of(top, k, arity)]
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for left, right in path:
                node = H(*left, node, *right)
            root = top[-1][0]
            out.append((row[0], leaf, levels[-1][0], root, H(*(x for l, r in path for x in (*l, *r))), node, node == root))
    return sorted(out, key=str)


def documents():
    rows = [(i, "big", "en", i % 7, f"Text {i} É" if i % 3 else f"text {i}") for i in range(600)]
    rows += [(i, f"s{i % 23}", None, None, None if i % 4 == 0 else "ABC") for i in range(600, 700)]
    rows += [(900 + i, None, "de", 1, "Zwei") for i in range(17)] + [(950, "alone", "en", 2, "One"), (951, "", "en", 2, "")]
    rows += [(5, "big", "en", 1, "another text of the id")] * 2 + [(None, "big", "en", None, "No id"), (None, None, None, None, None)]
    rows += [(2000 + i, "sixteen", "en", 1, "x") for i in range(16)] + [(3000 + i, "all256", "en", 1, "Y") for i in range(256)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_query_equals_plain_tree(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", grp string, idx int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.queries()["op12_manifest"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize(("arity", "stride"), [(2, 1), (2, 3), (3, 2)])
def test_other_shapes_of_tree(spark, arity, stride):
    rows = [r for r in documents() if r[0] is None or r[0] < 40 or r[0] > 940]
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.select(
        manifest.group_key(docs.source).alias("grp"), docs.doc_id.alias("key"), manifest.leaf_digest([docs[c] for c in names]).alias("leaf")
    )
    found = manifest.leaf_proofs(manifest.build_manifest(leaves, arity, stride))
    got = found.select("key", "leaf", "subroot", "root", manifest.proof_digest(found.path).alias("p"), manifest.folded(found.leaf, found.path).alias("f"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted((r[:5] for r in expected(rows, arity)), key=str)
    assert all(r.f == r.root for r in got.collect())


def test_one_row_and_no_rows(spark, tmp_path):
    one = [(1, "s", "en", 3, "abc")]
    spark.createDataFrame(one, SCHEMA).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [tuple(r) for r in registered.queries()["op12_manifest"](spark, f"{tmp_path}/one").collect()] == expected(one)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registered.queries()["op12_manifest"](spark, f"{tmp_path}/none").collect() == []


def test_long_texts(spark, tmp_path):
    rows = [(i, f"s{i % 2}", "en", i, "Word é " * 300_000) for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in registered.queries()["op12_manifest"](spark, str(tmp_path)).collect()), key=str) == expected(rows)
