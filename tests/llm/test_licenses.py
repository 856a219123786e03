"""Licence scans against plain searches, planted texts and odd rows."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import licenses
from tessera.llm import queries as registered
from tessera.llm.license_texts import APACHE_2, GPL_NOTICE, MIT, TEMPLATES
from tessera.llm.licenses import LEAST, PHRASES, Scanner, pieces, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places_of(words):
    found = []
    for phrase, label in PHRASES:
        p = phrase.split()
        found += [(label, k) for k in range(len(words)) if words[k : k + len(p)] == p]
    return sorted(found)


def stretches(words, template):
    """Maximal common stretches of LEAST words or more: (start, end) in the text, by comparing all positions."""
    longest = [0] * (len(words) + 1)
    for end in range(1, len(words) + 1):
        for t in range(1, len(template) + 1):
            n = 0
            while n < end and n < t and words[end - 1 - n] == template[t - 1 - n]:
                n += 1
            longest[end] = max(longest[end], n)
    return {(e - longest[e], e) for e in range(1, len(words) + 1) if longest[e] >= LEAST and (e == len(words) or longest[e + 1] != longest[e] + 1)}


def test_matching_statistics_equal_all_comparisons():
    rng = random.Random(4)
    alphabet = "a b c d".split()
    for _ in range(150):
        templates = [" ".join(rng.choices(alphabet, k=rng.randint(4, 14))) for _ in range(3)]
        scanner = Scanner([(t, f"t{k}") for k, t in enumerate(templates)], [("a b", "ab"), ("b b c", "bbc")])
        text = rng.choices([*alphabet, "zz"], k=30)
        n, places, matches = scanner.scan(" ".join(text).encode())
        assert n == 30
        want = [(k, i) for k, p in enumerate((["a", "b"], ["b", "b", "c"])) for i in range(30) if text[i : i + len(p)] == p]
        assert sorted(places) == sorted(want)
        for k, t in enumerate(templates, 2):
            assert {(m[1], m[2]) for m in matches if m[0] == k} == stretches(text, t.split())
            for m in matches:
                if m[0] == k:
                    assert t.split()[m[3] : m[4]] == text[m[1] : m[2]]


def test_pieces_never_cut_words():
    text = ("Wörd two,three " * 500).encode()
    for size in (1, 7, 64, 10_000):
        assert [w for p in pieces(text, size) for w in p] == [w.encode() for w in words_of(text.decode())]


def mangled(text, every, rng):
    """Every so many words one is replaced."""
    w = text.split()
    for k in range(every // 2, len(w), every):
        w[k] = "".join(rng.choices("qxz", k=6))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices("the of software is license general public apache mit this under notice granted walrus café".split(), k=n))
    out = [None, "", " \t\n", "MIT License", "mit, LICENSE; mit license", "the MIT-license?", "General  public.License", "mité license", "mit é license"]
    out += [prose(n) for n in (1, 5, 40, 400, 3000)] * 4
    out += [prose(60) + " " + MIT + prose(60), prose(30) + mangled(MIT, 9, rng) + prose(30), APACHE_2, GPL_NOTICE + prose(10) + GPL_NOTICE]
    out += ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "x" * 300_000 + " mit license", "mit license " * 50_000]
    return out


def test_query_equals_plain_search(spark, tmp_path, texts):
    rows = [(None if i == 3 else i, t, "s", 1, 2) for i, t in enumerate(texts)] + [(9, texts[20], "s", 1, 2)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, row string, n_words int, spans int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.queries()["op13_licenses"](spark, str(tmp_path)).collect()
    want = []
    for i, t, *_ in rows:
        w = words_of(t)
        p = places_of(w)
        at = [k for _, k in p]
        want.append((i, len(w), len(p), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in p}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    first = len(texts) - 8
    assert "mit-terms" in by[first].labels and by[first].score == 1.0 and "mit-terms" in by[first + 1].labels.split(",")
    assert "apache-2.0-notice" in by[first + 2].labels and "gpl-notice" in by[first + 3].labels
    assert "mit-release" in by[first + 4].labels and "gpl-3.0" in by[first + 5].labels
    assert by[0].score == 0.0 and by[0].labels == "" and by[1].n_words == 0


def test_spans_stand_where_the_text_is(spark, texts):
    rng = random.Random(1)
    before = " ".join(rng.choices(["walrus", "carpenter"], k=100))
    rows = [(1, f"{before} {MIT} {before} {mangled(MIT, 12, rng)}", "keep")]
    row = scan_licenses(spark.createDataFrame(rows, "id int, body string, spans string"), "body").first()
    n = len(words_of(MIT))
    spans = sorted((s.first, s.last, s.share) for s in row.spans if s.label == "mit-terms" and s.share > 0.6)
    assert row.row.spans == "keep" and [s[:2] for s in spans][0] == (100, 99 + n) and spans[0][2] == 1.0
    assert spans[1][0] >= 200 + n and 0.85 < spans[1][2] < 1.0


def test_templates_are_told_apart():
    scanner = Scanner(TEMPLATES)
    for text, label in TEMPLATES:
        n, _, matches = scanner.scan(text.encode())
        found = {scanner.labels[k]: c / len(scanner.sequences[k]) for k, _, _, c in sorted(scanner.spans(matches), key=lambda s: s[3])}
        assert found[label] == 1.0, label
    assert licenses.COVER > 0.5


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registered.queries()["op13_licenses"](spark, str(tmp_path)).collect() == []
