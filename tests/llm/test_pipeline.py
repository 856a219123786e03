"""Every stage of the pipeline against a plain version, on all that the stage before it kept."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import quality
from tessera.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def shingles(w, n=5):
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def share(count, of):
    return count / max(of, 1.0)


def plain_statistics(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if x]

    def hits(pattern):
        return len(re.findall(pattern, t))

    return {
        "n_words": float(len(w)), "word_length": share(len(t), len(w)), "distinct_words": share(len(set(w)), len(w)),
        "distinct_lines": share(len(set(lines)), len(lines)), "words_a_line": share(len(w), len(lines)),
        "upper": share(hits("[A-Z]"), len(t)), "digits": share(hits("[0-9]"), len(t)), "symbols": share(hits(r"[#$%&*|^~=<>{}\[\]\\@_+/]"), len(t)),
        "bangs": share(hits("[!?]"), len(t)), "stops": share(hits("[.,;:]"), len(w)), "odd": share(sum(c > "\x7f" and not c.isalpha() for c in t), len(t)),
        "vowels": share(hits("[aeiouAEIOU]"), len(t)),
    }


def plain_score(model, text):
    s = plain_statistics(text)
    held = (w for rule, w in zip(model.rules, model.weights, strict=True) if all((s[model.names[k]] > cut) == above for k, above, cut in rule))
    return 1 / (1 + math.exp(-(model.intercept + sum(held))))


def plain_near_copies(rows):
    """Smallest of each component of texts whose sets of shingles are alike by 0.8 or more, all pairs compared; null ids come last."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingles(words((r[1] or "").lower())) for r in order], list(range(len(order)))
    for b in range(len(order)):
        for a in range(b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [order[r] for r in set(root)]


def plain_clean(rows, items):
    """Rows that hold less than 0.8 of the shingles of every item."""

    def holds(w, item):
        n = min(5, len(item))
        own = shingles(item, n)
        return len(own & shingles(w, n)) >= 0.8 * len(own) if len(w) >= n else False

    items = [words(i.lower()) for i in items if words(i)]
    return [r for r in rows if not any(holds(words((r[1] or "").lower()), i) for i in items)]


def plain_targets(sizes):
    """Weights 3, 1, 2 by code point, null last; what is above twice a source's size is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, free, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    stock = ["".join(rng.choice(list("bcdfghlmnprst")) + rng.choice(list("aeiou")) for _ in range(rng.integers(1, 5))) for _ in range(1500)]

    def text(n):
        w = list(rng.choice(stock, n))
        return ". ".join(" ".join(w[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."

    items = [" ".join(rng.choice(stock, 24)) for _ in range(4)] + ["tiny item", ""]
    rows, label = [], []

    def add(t, good, source=None):
        rows.append((len(rows), t, "en", source or ["web", "books", "code", "news"][int(rng.choice(4, p=[0.6, 0.2, 0.15, 0.05]))], len(t)))
        label.append(good)

    for _ in range(110):
        add(text(int(rng.integers(30, 200))), 1)
    for k in range(0, 40, 2):  # near and far copies
        w = rows[k][1].split(" ")
        for at in rng.choice(len(w), max(1, len(w) // (60 if k % 4 else 12)), replace=False):
            w[at] = "edited"
        add(" ".join(w), 1)
    for k in range(40):  # whole items, items that lack a sixth of their shingles and items that lack half
        item = items[k % 4].split()
        if k % 3:
            item[-3 if k % 3 == 1 else 12] = "other"
        add(f"{text(40)} {' '.join(item)} {text(30)}", 1)
    add(f"{text(30)} Tiny Item {text(30)}", 1)
    for _ in range(60):
        add("\n".join(["BUY!! NOW!! $$$ 100% FREE!!! WIN @ CASH"] * int(rng.integers(1, 5))) + f" {rng.integers(1e6)} ¤¤", 0)
    add(rows[3][1], 1)
    rows += [(None, text(60), "en", "web", 1), (None, text(60), None, None, None), (len(rows), text(90), "en", None, 1), (len(rows) + 1, None, "en", "web", 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(label)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, steps = spark.read.parquet(f"{path}/documents.parquet"), [rows]
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, path))
        steps.append([tuple(r) for r in docs.collect()])
    return path, items, steps


def same(got, want):
    assert Counter(got) == Counter(want)


def test_quality_stage(spark, world):
    path, _, (before, after, *_) = world
    model = quality.fit_quality(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    same(after, [r for r in before if plain_score(model, r[1]) >= 0.3])
    assert 60 <= len(before) - len(after) <= 62 and not any("BUY" in (r[1] or "") for r in after)


def test_near_copy_stage(world):
    *_, before, after = world[2][:3]
    same(after, plain_near_copies(before))
    assert len(after) < len(before) - 5


def test_benchmark_stage(world):
    *_, before, after = world[2][:4]
    same(after, plain_clean(before, world[1]))
    assert 10 < len(before) - len(after) < 40  # half an item is none


def test_mixing_stage(world):
    *_, before, after = world[2][:5]
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
    target, copies, rows = plain_targets(sizes), Counter(after), Counter(before)
    for r in after:
        taken[r[3]] += len(words(r[1]))
    assert set(copies) <= set(rows)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= largest[source]
    for r, n in rows.items():
        due = n * target[r[3]] / sizes[r[3]] if words(r[1]) else 0
        assert math.floor(due + 1e-9) <= copies[r] <= math.ceil(due - 1e-9)


def test_sharding_stage(world):
    *_, before, after = world[2]
    same([r[:5] for r in after], before)
    places = [(slot, shard) for *_, shard, slot in after]
    assert sorted(slot * 8 + shard for slot, shard in places) == list(range(len(before)))


def test_run_is_its_stages(spark, world):
    pipeline = pytest.importorskip("corpus_pipeline")
    same([tuple(r) for r in pipeline.run(spark, world[0]).collect()], world[2][-1])
