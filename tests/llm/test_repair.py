"""Conversation repair against a search over all edit strings, and the query against plain code."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import numpy as np
import pytest

from tessera.llm import queries as registered
from tessera.llm import repair
from tessera.llm.repair import repair_conversations

SEEN = re.compile(r"[^\x20\x09-\x0D]")


def marks(rows):
    """fault of each (role, text), in order."""
    seen, out = set(), []
    for row in rows:
        text = row[1]
        if not SEEN.search(text):
            out.append("blank")
        elif row in seen:
            out.append("duplicate")
        else:
            out.append(None if SEEN.findall(text)[-1] in ".!?" else "truncated")
        seen.add(row)
    return out


def plain(rows):
    """(cost, audit, repaired lines): the least (cost, audit) over all repairs, by memoised search over suffixes."""
    faults = marks(rows)

    @lru_cache(None)
    def best(k, state, inserts):
        found = []
        if k == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if (role == "assistant") == (state == "u"):
                    c, e, lines = best(k, role[0], inserts + 1)
                    found.append((c + 2, "I" + e, (role + ":", *lines)))
        if k < len(rows):
            role, text = rows[k]
            c, e, lines = best(k + 1, state, 0)
            found.append((c + 3, "D" + e, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = int(faults[k] == "truncated")
                new = "assistant" if state == "u" else "user"
                c, e, lines = best(k + 1, new[0], 0)
                found.append((c + 2 + more, "R" + e, (f"{new}:{text}", *lines)))
                first = role[:1]
                if (first == "s" and state == "") or (first == "u" and state != "u") or (first == "a" and state == "u"):
                    c, e, lines = best(k + 1, first, 0)
                    found.append((c + more, "K" + e, (f"{role}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def test_hirschberg_is_the_least_of_all_repairs():
    rng = np.random.default_rng(3)
    for n in list(range(1, 9)) * 40:
        kinds = bytes(int(i) * 4 + int(f) for i, f in zip(rng.integers(0, 4, n), rng.choice([0, 0, 0, 1, 2], n)))
        texts = [("suax"[k // 4] + "ser", "" if k % 4 == 2 else f"t{j}" + ("" if k % 4 == 1 else ".")) for j, k in enumerate(kinds)]
        cost, end = repair.finish(repair.summary(kinds)[:8])
        got = "".join(repair.hirschberg(kinds, 0, end)) + repair.ENDS[end][1]
        assert (cost, got) == plain(tuple(texts))[:2]
        # the same from blocks of three
        blocks = [kinds[k : k + 3] for k in range(0, n, 3)]
        sums = [repair.summary(b) for b in blocks]
        assert repair.finish(repair.merged(sums)) == (cost, end)
        parts = ["".join(repair.hirschberg(b, p, q)) for b, (p, q) in zip(blocks, repair.crossings(sums, 0, end))]
        assert "".join(parts) + repair.ENDS[end][1] == got


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def expected(rows):
    hurt, found = damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in hurt if r[0] == conv]
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
        mine.sort(key=order)
        pairs = tuple((r[2], r[3]) for r in mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = marks(pairs)
        cost, audit, lines = plain(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return found


def conversations():
    rng = np.random.default_rng(11)
    rows = []
    for conv in range(80):
        for turn in range(int(rng.integers(1, 12))):
            role = ["system", "user", "assistant", "tool", None, "", "User"][int(rng.choice(7, p=[0.1, 0.4, 0.4, 0.025, 0.025, 0.025, 0.025]))]
            text = [f"Words {rng.integers(6)}.", f"cut {rng.integers(6)}", "Why? \n", " \t\v", None, "é。", "x!\x1c"][int(rng.choice(7, p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05]))]
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.05 else turn, role, text))
    rows += [(200, 0, "user", "only row dropped?")] + [(300, t, ("user", "assistant")[t % 2], f"long talk {t}.") for t in range(150)]
    rows += [(300, t, "user", "same text.") for t in range(20, 60)] + [(400, None, "user", "a"), (400, None, "assistant", "b.")]
    return rows


@pytest.mark.parametrize(("block", "fan"), [(4096, 1024), (7, 3)])
def test_query_equals_plain_code(spark, tmp_path, monkeypatch, block, fan):
    rows = conversations()
    schema = "conv_id long, turn long, role string, text string, conv string, place int"
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(repair.repair_conversations, "__defaults__", (block, fan))
    got = registered.queries()["op11_repair"](spark, str(tmp_path)).collect()
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in columns) == want[r.conv_id], r.conv_id


def test_messages_are_legal_and_empty_tables_pass(spark, tmp_path):
    schema = "conv_id string, turn int, role string, text string"
    df = spark.createDataFrame([(str(c), t, "user", f"{c} {t} " + "word " * 30_000 + ".") for c in range(3) for t in range(4)], schema)
    counts, messages, _ = repair_conversations(df)
    got = {}
    for r in messages.orderBy("conv", "place", "k").collect():
        got.setdefault(r.conv, []).append(r.role)
    assert set(got) == {"=0", "=1", "=2"} and all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in got.values())
    assert counts.count() == 3
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert registered.queries()["op11_repair"](spark, str(tmp_path)).collect() == []
