"""Brute-force comparisons and edge cases of the corpus operators."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, jpeg, mixing, pii, quality, sharding, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"], n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 120, 40)]
    long = sentence(rng, 3000)
    return [*base, *base[:5], long, long + " end", "", None, "x", "\t \n", "é" * 100, base[3] + " " + base[4]]


def test_sharding_is_even_gapless_and_repeatable(spark, texts):
    docs = docs_of(spark, [*texts, *texts], [*range(len(texts)), *range(len(texts))]).unionByName(docs_of(spark, ["n"] * 9, [None] * 9))
    rows = sharding.assign_shards(docs).toPandas()
    sizes = rows.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    assert sizes["size"].max() - sizes["size"].min() <= 1 and (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["nunique"]).all()
    again = sharding.assign_shards(docs.repartition(7)).toPandas()
    key = lambda d: sorted(map(repr, d[["doc_id", "text", "shard", "slot"]].itertuples(index=False)))
    assert key(rows) == key(again)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_sharding_carries_every_column(spark, texts):
    docs = docs_of(spark, [*texts, *["same"] * 500], [*range(len(texts)), *[7] * 500]).selectExpr("*", "1 as _rank", "2 as shard", "3 as row", "4 as place", "5 as bucket")
    rows = sharding.assign_shards(docs)
    assert sorted(rows.columns) == sorted([*docs.columns, "slot"])
    assert rows.select("shard", "slot").distinct().count() == len(texts) + 500
    assert rows.drop("slot", "shard").exceptAll(docs.drop("shard")).count() == 0 and rows.where("_rank = 1 and row = 3 and place = 4").count() == rows.count()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_is_a_bijection(n):
    assert sorted(sharding.permute(np.arange(n), n, 5)) == list(range(n))


def test_mixing_meets_targets(spark, texts):
    units = mixing.mix_sources(docs_of(spark, texts * 3, range(3 * len(texts)))).toPandas()
    assert (units.copies * units.rows + units.extra <= 2 * units.rows).all() and (units.copies >= 0).all() and (units.extra >= 0).all()
    for _, g in units.groupby("source", dropna=False):
        assert abs(((g.copies * g.rows + g.extra) * g["size"]).sum() - g.target.iloc[0]) <= g["size"].max()
    total = (units["size"] * units["rows"]).sum()
    assert abs(units.drop_duplicates("source").target.sum() - 1.5 * total) < 1e-6 * total
    assert mixing.mix_sources(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert set(mixing.mixed_documents(docs_of(spark, texts)).columns) == set(SCHEMA.replace(" long", "").replace(" string", "").split(", "))


def taken_of(rows, of):
    return sum(len(t.split()) for t, s in rows if s == of)


def test_mixing_merges_levels_and_rounds_repeated_rows(spark):
    rng = np.random.default_rng(3)
    docs = docs_of(spark, [sentence(rng, int(n)) for n in rng.integers(1, 60, 300)])
    units = mixing.mix_sources(docs, group=8, fan=2).toPandas()  # several levels of the tree
    for _, g in units.groupby("source", dropna=False):
        assert abs(((g.copies * g.rows + g.extra) * g["size"]).sum() - g.target.iloc[0]) <= g["size"].max()
    again = mixing.mix_sources(docs.repartition(5), group=8, fan=2).toPandas()
    assert sorted(zip(units.doc_id, units.copies, units.extra)) == sorted(zip(again.doc_id, again.copies, again.extra))
    repeated = spark.createDataFrame([(1, sentence(rng, 10), "en", "s", 0)] * 1000 + [(2, "one", "en", "s", 0)] + [(None, f"{sentence(rng, 9)} {i}", "en", "s", 0) for i in range(50)], SCHEMA)
    extra = repeated.selectExpr("*", "1 as _n", "2 as h1", "3 as rows", "4 as k", "5 as copies")
    got = mixing.mixed_documents(extra)
    assert got.columns == extra.columns
    rows = [(r.text, r.source) for r in got.collect()]
    assert abs(taken_of(rows, "s") - 1.5 * (10 * 1000 + 1 + 10 * 50)) <= 10


def test_pivot_keeps_mass():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 50, 200).astype(float), rng.random(200)
    before = (size * p).sum()
    held = mixing._pivot(size, p, rng)
    assert abs((size * p).sum() - before) < 1e-6
    assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != held)


def brute_pii(t):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if ok[k](m[0])]


def test_pii_base_spans_match_the_patterns():
    rng = np.random.default_rng(0)
    letters = list("0123456789012345678 9..@@+- ()abé%")
    for _ in range(4000):
        t = "".join(rng.choice(letters, rng.integers(0, 60)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == brute_pii(t)


def test_pii_added_kinds():
    t = "see https://a.example/x?y=1, IBAN: GB82 WEST 1234 5698 7654 32 or account no. 12345678; é@b.co"
    found = {k: t[a:b] for k, a, b in pii.spans(t)}
    assert found["address"] == "https://a.example/x?y=1" and found["account"] == "12345678"
    assert any(t[a:b] == "GB82 WEST 1234 5698 7654 32" for k, a, b in pii.spans(t) if k == "account")
    assert pii.redacted("mail a@b.co now") == "mail <email> now" and pii.spans(None) == []


def test_pii_rows(spark, texts):
    rows = pii.find_pii(docs_of(spark, [*texts, "9" * 5000 + " 1.2.3.4"])).toPandas()
    assert len(rows) == len(texts) + 1 and rows.n_ip.sum() == 1


def test_contamination_matches_brute_force(spark, texts):
    rng = np.random.default_rng(4)
    items = [sentence(rng, int(n)) for n in rng.integers(5, 60, 12)] + ["two words", "", None]
    bodies = [*(t for t in texts), *(f"{sentence(rng, 200)} {t} {sentence(rng, 300)}" for t in items if t), (items[0] or "").upper()]

    def grams(t, k):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    want = set()
    for d, t in enumerate(bodies):
        for i, item in enumerate(items):
            n = grams(item, 1)[1]
            if n:
                own, have = grams(item, min(5, n))[0], grams(t, min(5, n))[0]
                if len(own & have) >= 0.8 * len(own):
                    want.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, bodies), bench).collect()}
    assert got == want and len(got) >= 12
    assert decontamination.decontaminate(docs_of(spark, bodies), bench).count() == len(bodies) - len({d for d, _ in want})
    shuffled = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs_of(spark, bodies), bench, broadcast_rows=0).collect()}
    assert shuffled == want
    assert decontamination.contaminated(docs_of(spark, bodies), bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs_of(spark, bodies).limit(0), bench).count() == 0
    odd = docs_of(spark, [None, "", items[0], items[0]], [None, None, None, 5]).selectExpr("*", "1 as _id", "2 as text_hash", "3 as row", "4 as own")
    kept = decontamination.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 2
    long = " ".join(["filler"] * 800_000) + " " + items[1]  # a text of 5 MB is read to its end
    assert {r.item_id for r in decontamination.contaminated(docs_of(spark, [long]), bench).collect()} == {1}


def test_codes_are_perfect_and_anchors_are_complete():
    for code in simhash.CODES:
        e = simhash.errors(code)
        assert (e.upto[:, 0] == 1).all()  # every syndrome has one error pattern within the radius
        assert (code.syndrome(e.pattern) == np.repeat(np.arange(len(e.first)), e.upto[:, -1])).all()
    x = np.random.default_rng(0).integers(0, 2**64, 20, dtype=np.uint64)
    who, anchor, over = simhash.anchors(x)
    assert len(set(zip(who, anchor, strict=True))) == len(who) and over.max() == simhash.THRESHOLD
    assert (anchor[over == 0] == simhash.homes(x)).all()
    seen = set(zip(who, anchor, strict=True))
    for i in range(64):
        for j in range(i, 64):  # every change of one bit (i == j: bit i alone) or two
            flip = np.uint64((1 << i) | (1 << j))
            assert all(p in seen for p in enumerate(simhash.homes(x ^ flip)))


def test_components_match_brute_force(spark, texts):
    rows = simhash.near_duplicates(docs_of(spark, texts)).toPandas()
    fp = {r.doc_id: np.uint64(np.int64(r.fp)) for r in rows.itertuples()}
    root = {i: i for i in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if bin(int(fp[a] ^ fp[b])).count("1") <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.component_id for r in rows.itertuples()} == root
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def check_removed(got, bodies, ids):
    """Rows of repeated_bytes against a table of all 50-byte strings; ids may repeat, None is largest."""
    place = [2**63 if i is None else i for i in ids]
    first: dict[bytes, int] = {}
    for k in sorted(range(len(bodies)), key=lambda k: place[k]):
        b = (bodies[k] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], place[k])
    want = []
    for k, t in enumerate(bodies):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < place[k]:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.append((str(ids[k]), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(want)


def test_suffixes_across_many_packs_and_buckets(spark, texts):
    rng = np.random.default_rng(12)
    shared = [sentence(rng, 15) for _ in range(6)]
    bodies = [" ".join(rng.permutation([sentence(rng, 10), *rng.choice(shared, 2), sentence(rng, 5)])) for _ in range(150)]
    bodies += [*texts, "a" * 300, "b" + "a" * 200, None, bodies[3], bodies[3]]
    ids = [*rng.permutation(len(bodies) - 4).tolist(), 2**63 - 1, None, None, 3]
    docs = docs_of(spark, bodies, ids)
    assert sum(len((t or "").encode()) for t in bodies) > 50 * 1000
    check_removed(suffixes.repeated_bytes(docs, pack_bytes=1000, bucket=500), bodies, ids)


def test_suffixes_match_brute_force(spark, texts):
    rng = np.random.default_rng(9)
    shared = sentence(rng, 60)
    bodies = [*texts, f"{sentence(rng, 20)}{shared}", f"{shared} {sentence(rng, 9)}", "a" * 300, "b" + "a" * 200]
    check_removed(suffixes.repeated_bytes(docs_of(spark, bodies)), bodies, range(len(bodies)))
    assert len({(a - b) % 31 for a in suffixes.COVER for b in suffixes.COVER}) == 31
    assert suffixes.repeated_bytes(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_jpeg_round_trip(spark, texts):
    rows = {r.doc_id: r for r in jpeg.read_back(jpeg.store_payloads(docs_of(spark, texts))).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        assert rows[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[i].n_bytes == len(b)
        assert rows[i].tail_crc32 == zlib.crc32(padded[-64:]) and rows[i].payload_bytes == len(padded)
    assert rows[0].media_sha256 == rows[40].media_sha256 and rows[0].feature == rows[40].feature


def test_jpeg_dc_thumbnail_of_standard_tables(spark):
    """Three grey blocks coded with DC differences and a zero run, no restarts: a stream of another writer."""
    dc = bytes([0, 2, 1, 0] + [0] * 12) + bytes([0, 3, 4])  # codes 00, 01, 100
    ac = bytes([1, 1, 1] + [0] * 13) + bytes([0x00, 0xF0, 0x01])
    bits = "01" + "111" + "0" + "00" + "10" + "110" + "1" + "0" + "100" + "0101" + "0"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    stream = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    f = jpeg.parse(stream)
    c = jpeg.decode_coefficients([stream], [f])[0]
    assert c[:, 0].tolist() == [7, 7, -3] and c[1, 17] == 1
    assert jpeg.thumbnail(c, f).tolist() == [[135, 135, 125]]
    media = spark.createDataFrame([(1, bytearray(stream)), (2, bytearray(b"no image")), (3, None)], "id int, media binary")
    rows = {r.id: r for r in jpeg.thumbnail_features(media).collect()}
    assert (rows[1].width, rows[1].height) == (24, 8) and rows[2].width is None and rows[3].thumb_hash is None


def _bits(values, codes):
    """DC-only blocks: a code by category, the magnitude bits, end of block (code 0)."""
    out = ""
    for v in values:
        size = abs(v).bit_length()
        out += codes[size] + (format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else "") + "0"
    out += "1" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")


def test_jpeg_colour_with_subsampling_and_hostile_sizes(spark):
    seg = jpeg._segment
    dc, codes = bytes([0, 2, 1] + [0] * 13) + bytes([0, 3, 4]), {0: "00", 3: "01", 4: "100"}
    ac = bytes([1] + [0] * 15) + bytes([0])
    parts = bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])

    def stream(width, height, blocks):
        frame = seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + parts)
        return b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([8] * 64)) + frame + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + _bits(blocks, codes) + b"\xff\xd9"

    # two MCUs of four luminance blocks each; DC values are differences to the block before of the same component
    image = stream(32, 16, [5, 0, 4, 0, 0, 0, -9, 0, 0, 0, 4, 0])
    f = jpeg.parse(image)
    assert jpeg.thumbnail(jpeg.decode_coefficients([image], [f])[0], f).tolist() == [[133, 133, 128, 128], [137, 137, 128, 128]]
    hostile = stream(65528, 65528, [5])
    with pytest.raises(ValueError, match="more blocks"):
        jpeg.decode_coefficients([hostile], [jpeg.parse(hostile)])
    media = spark.createDataFrame([(1, bytearray(image)), (2, bytearray(hostile))], "id int, media binary")
    assert {r.id: r.width for r in jpeg.thumbnail_features(media).collect()} == {1: 32, 2: None}


def test_quality_rules_learn_and_survive_edges(spark, texts):
    good = [f"plain words number {i} in a line. and more of them here." for i in range(60)]
    bad = [f"BUY!! NOW!! {i}!! BUY!! NOW!!" for i in range(60)]
    docs = docs_of(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.fit_quality(docs, labels)).select("row.doc_id", "score").toPandas().set_index("doc_id").score
    assert rows[:60].min() > 0.5 > rows[60:120].max() and rows.between(0, 1).all()
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 60").count() == 60 and kept.where("doc_id between 60 and 119").count() == 0
    odd = docs.unionByName(docs.where("doc_id = 5")).selectExpr("*", "'x' as score", "1 as stats", "2 as row")
    assert quality.keep_quality(odd, labels).columns == odd.columns and quality.keep_quality(odd, labels).where("doc_id = 5").count() == 2
    assert quality.keep_quality(docs.limit(0), labels).count() == 0
    none = quality.scored(docs, quality.fit_quality(docs, labels.limit(0)))
    assert none.where("score <> 0.5").count() == 0


def test_toxicity_learns_and_survives_edges(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(600)]  # texts must not look like copies
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    plain = [prose(40) for _ in range(80)]
    toxic = [f"{prose(15)} moronic {prose(15)} worthless {prose(9)}" for _ in range(80)]
    docs = docs_of(spark, [*plain, *toxic, None, ""])
    labels = spark.createDataFrame([(i, 1, int(i >= 80)) for i in range(160)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, toxicity.fit_toxicity(docs, labels)).toPandas().set_index("doc_id").score
    assert (rows[:80] < 0.5).mean() > 0.95 and (rows[80:160] > 0.5).mean() > 0.95 and rows.between(0, 1).all()
    assert toxicity.scored(docs, toxicity.fit_toxicity(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_toxicity_fits_on_every_sampled_row(spark):
    rng = np.random.default_rng(7)
    docs = docs_of(spark, [sentence(rng, 12) for _ in range(400)])
    labels = spark.createDataFrame([(i, 1, int(i % 50 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    toxic = sum(i % 50 == 0 for i in train)
    assert toxic < 8  # too few to train on: the smoothed share of the label, whatever the bound on rows
    model = toxicity.fit_toxicity(docs.unionByName(docs), labels, most=len(train))  # repeated ids count once
    share = (toxic + 1) / (len(train) + 2)
    assert abs(model.intercept - np.log(share / (1 - share))) < 1e-9


def test_pipeline_stages_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    body = [f"{sentence(rng, 80)}. {sentence(rng, 70)}." for _ in range(60)]
    item = "one two three four five six seven eight nine ten eleven twelve"
    bodies = [*body, body[0], *(["BUY!! NOW!! CHEAP!! WIN!!"] * 12), f"{body[1]} {item}"]
    docs = docs_of(spark, bodies)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 61), 0) for i in range(73)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(rows.doc_id)
    assert not ids & {60, *range(61, 73), 73} and ids <= set(range(60))
    assert len(pipeline.STAGES) == 5 and {"shard", "slot"} <= set(rows.columns)
    after = docs.where("doc_id < 60").select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    taken = sum(len(t.split()) for t in rows.text)
    assert abs(taken - 1.5 * after) < 0.1 * after
