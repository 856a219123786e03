"""Every registered query on one small table with odd rows: columns, one row a document, and values from plain code."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import queries as registered
from tessera.llm import simhash

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    texts = [text(int(n)) for n in rng.integers(1, 150, 60)]
    texts += [texts[0], texts[0], None, "", " \t\n", text(20_000), texts[3] + " x@y.org 10.0.0.1", "É" * 70, texts[5].upper()]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, "another text of the same id", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, [(r[0], r[1] or "", r[3]) for r in rows]


def run(spark, folder, name):
    return registered.queries()[name](spark, folder[0]).toPandas()


def test_op2_columns_and_targets(spark, folder):
    got = run(spark, folder, "op2_mixing")
    sizes = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t, _ in folder[1])
    assert sorted(zip(got.doc_id, got["size"])) == sizes and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum() and abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g.target.iloc[0] <= 2 * g["size"].sum()
    # targets by rounds of resharing
    by = got.groupby("source", dropna=False)["size"].sum()
    order = sorted(by.index, key=lambda s: (not isinstance(s, str), s if isinstance(s, str) else ""))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    left, free, target = 1.5 * by.sum(), set(range(len(order))), {}
    while True:
        total = sum(weight[order[i]] for i in free)
        over = [i for i in free if left * weight[order[i]] / total > 2 * by.iloc[list(by.index).index(order[i])]]
        if not over:
            target |= {i: left * weight[order[i]] / total for i in free}
            break
        for i in over:
            target[i] = 2.0 * by.iloc[list(by.index).index(order[i])]
            left -= target[i]
            free.discard(i)
    want = sorted(round(v, 6) for v in target.values())
    assert sorted(round(v, 6) for v in got.groupby("source", dropna=False).target.first()) == want


def test_op3_digest(spark, folder):
    got = run(spark, folder, "op3_pii")
    assert len(got) == len(folder[1]) and (got[["n_email", "n_ip"]].sum() >= 1).all()
    for r in got.itertuples():
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_op5_fingerprints(spark, folder):
    def print_of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        if not w:
            return "0" * 16
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return format(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), "016x")

    got = run(spark, folder, "op5_simhash")
    assert sorted(zip(got.doc_id, got.fingerprint)) == sorted((i, print_of(t)) for i, t, _ in folder[1])
    assert (got.component_id <= got.doc_id).all() and set(got.component_id) <= set(got.doc_id)
    copies = got[got.doc_id.isin([0, 60, 61])]
    assert copies.component_id.nunique() == 1 and simhash.fingerprint(None) == 0


@pytest.mark.parametrize(("name", "cut"), [("op6_toxicity", 0.5), ("op10_quality", 0.3)])
def test_scores(spark, folder, name, cut):
    got = run(spark, folder, name)
    assert sorted(got.doc_id) == sorted(i for i, _, _ in folder[1]) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and (got.predicted == (got.score >= cut)).all()


def test_op7_law(spark, folder):
    got = run(spark, folder, "op7_sharding")
    want = sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in folder[1])
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == want and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").slot
    assert counts.size().max() - counts.size().min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in counts) and set(got.shard) == set(range(8))


def test_op8_and_op9_columns(spark, folder):
    eight, nine = run(spark, folder, "op8_suffixes"), run(spark, folder, "op9_media")
    assert sorted(zip(eight.doc_id, eight.n_bytes)) == sorted(zip(nine.doc_id, nine.n_bytes)) == sorted((i, len(t.encode())) for i, t, _ in folder[1])
    assert {"n_removed", "n_spans", "kept_sha256"} <= set(eight.columns) and {"payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"} <= set(nine.columns)


def test_components_of_chain_and_hub(spark):
    from tessera.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 61)] + [(7, 7), (101, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 161)}
