"""Licence scans: matching statistics on a generalised suffix automaton, chained into template spans.

All templates (short phrases, notices, terms) are one generalised suffix automaton over words.  A text is streamed through
it word by word: for each template the longest stretch of it that ends at this word is known.  A
stretch that can't be continued is a match; matches that follow one another in the text and in the template, with gaps
of GAP words at most, are chained, and a chain that covers enough of its template is a span.
Phrases are found by the same walk: a phrase ends at a word if it is a suffix of what is matched there.

The scan is a map over rows: nothing is shuffled, and a text is read in pieces of PIECE bytes, whatever its length.

Defined results: a null text is an empty one, with no words, no spans and score 0; null ids, repeated rows and other
columns (of any name) are carried along; an empty table gives an empty result; of chains that cover a template
equally the one that ends first is taken; a word is never cut, wherever a piece ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEMPLATES

#: Phrases and their labels, fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BORDER = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 20
#: Shortest stretch of a template that counts, longest gap in a chain, share of a template that makes a span.
LEAST = 4
GAP = 12
COVER = 0.6


class SuffixAutomaton:
    """Of several word sequences: per state its transitions, suffix link, longest length and where it ends in each sequence."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        for s in sequences:
            last = 0
            for word in s:
                last = self._extend(last, word)
        # where each state ends: the prefix of a sequence, and all its suffixes by their links
        self.ends: list[dict[int, set[int]]] = [{} for _ in self.next]
        for n, s in enumerate(sequences):
            state = 0
            for k, word in enumerate(s, 1):
                state = up = self.next[state][word]
                while up > 0:
                    self.ends[up].setdefault(n, set()).add(k)
                    up = self.link[up]

    def _state(self, length: int, link: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p's longest string and `word`; where another state holds longer strings too, it is divided."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # known from another sequence
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Matching statistics: the state and length of the longest match that ends with `word`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    @lru_cache(None)  # noqa: B019 - one automaton a process
    def suffixes(self, state: int) -> tuple[tuple[int, int], ...]:
        """(sequence, state): the longest suffix of a state's strings in each sequence."""
        found: dict[int, int] = {}
        while state > 0:
            for n in self.ends[state]:
                found.setdefault(n, state)
            state = self.link[state]
        return tuple(found.items())


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]] = PHRASES) -> None:
        """`templates` and `phrases`: (text, label).  Words as the contract has them."""
        split = [[w for w in WORDS.findall(t.encode().lower())] for t, _ in (*phrases, *templates)]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for s in split for w in s}))}
        self.sequences = [[self.vocabulary[w] for w in s] for s in split]
        self.labels = [label for _, label in (*phrases, *templates)]
        self.phrases = len(phrases)
        self.automaton = SuffixAutomaton(self.sequences)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int, int]]]:
        """(words, places: (phrase, first word), matches: (template, start, end, start and end in the template))."""
        a, places, matches = self.automaton, [], []
        state = length = at = 0
        running: dict[int, tuple[int, int]] = {}  # template -> (length, state) of the stretch that ends here

        def close(ended: dict[int, tuple[int, int]], end: int) -> None:
            for n, (size, s) in ended.items():
                matches.extend((n, end - size, end, e - size, e) for e in sorted(a.ends[s][n]))

        known = self.vocabulary.get
        previous = -2
        for words in pieces(text):
            ids = np.fromiter((known(w, -1) for w in words), dtype=np.int32, count=len(words))
            for k in np.flatnonzero(ids >= 0).tolist():
                here = at + k
                if here != previous + 1 and (state or running):
                    close(running, previous + 1)
                    state, length, running = 0, 0, {}
                previous = here
                state, length = a.step(state, length, int(ids[k]))
                if length < 2:
                    if running:
                        close(running, here)
                        running = {}
                    continue
                now = {}
                for n, s in a.suffixes(state):
                    size = length if s == state else a.length[s]
                    if n < self.phrases:
                        # the phrase itself ends here if what is known of it is its whole
                        if size >= len(self.sequences[n]) and len(self.sequences[n]) in a.ends[s][n]:
                            places.append((n, here + 1 - len(self.sequences[n])))
                    elif size >= LEAST:
                        now[n] = (size, s)
                if running:
                    close({n: v for n, v in running.items() if now.get(n, (0, 0))[0] != v[0] + 1}, here)
                running = now
            at += len(words)
        close(running, previous + 1)
        return at, places, matches

    def spans(self, matches: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, words covered) of the best chains, none over another of its template."""
        out = []
        for n in sorted({m[0] for m in matches}):
            mine = sorted((m[2], m[1], m[3], m[4]) for m in matches if m[0] == n)
            best: list[tuple[int, int]] = []  # covered, match before
            low = 0
            for k, (end, start, t0, t1) in enumerate(mine):
                while mine[low][0] < start - GAP:
                    low += 1
                found = (end - start, -1)
                for j in range(low, k):
                    e, s, u0, u1 = mine[j]
                    over = max(0, e - start, u1 - t0)
                    if over < end - start and s < start and u0 < t0 and t0 - u1 <= GAP:
                        found = max(found, (best[j][0] + end - start - over, j))
                best.append(found)
            taken: list[tuple[int, int]] = []
            for k in sorted(range(len(mine)), key=lambda k: (-best[k][0], k)):
                first, j = k, best[k][1]
                while j >= 0:
                    first, j = j, best[j][1]
                a, b = mine[first][1], mine[k][0]
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    out.append((n, a, b, best[k][0]))
        return out


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a list for each piece; pieces are cut between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + size < end:
            found = BORDER.search(text, at + size)
            end = found.start() if found else end
        yield WORDS.findall(text[at:end].lower())
        at = end


@lru_cache(1)
def _scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates, phrases)  # one automaton a worker


SPAN = "struct<label:string,first:bigint,last:bigint,covered:bigint,share:double>"
PLACE = "struct<label:string,word:bigint>"


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES
) -> DataFrame:
    """row (all columns of `docs`), n_words, places (of phrases) and spans (of templates, with their share).

    Every best chain is a span, however small its share; callers choose by `share`.
    """
    templates, phrases = tuple(map(tuple, templates)), tuple(map(tuple, phrases))
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for batch in batches:
            counts, places, spans = [], [], []
            for value in batch.column("_text"):
                n, p, m = scanner.scan(value.as_py() or b"")
                counts.append(n)
                places.append([{"label": scanner.labels[k], "word": w} for k, w in p])
                spans.append([
                    {"label": scanner.labels[k], "first": a, "last": b - 1, "covered": c, "share": min(1.0, c / len(scanner.sequences[k]))}
                    for k, a, b, c in (scanner.spans(m) if m else ())
                ])
            arrays = [batch.column("row"), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)]
            yield pa.record_batch(arrays, names=["row", "n_words", "places", "spans"])

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.encode(F.col(text), "UTF-8").alias("_text"))
    return packed.mapInArrow(fn, f"row {docs.schema.simpleString()}, n_words bigint, places array<{PLACE}>, spans array<{SPAN}>")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the text itself is not needed behind the scan
    found = scan_licenses(docs.select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    own = F.transform(F.filter("spans", lambda s: s["share"] >= COVER), lambda s: s["label"])
    words = F.transform("places", lambda p: p["word"])
    shares = F.transform("spans", lambda s: s["share"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), text(base).alias("base_labels"),
        text(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"),
    )
