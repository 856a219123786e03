"""Toxicity: compression distance to two zstandard dictionaries.

A toxic and an ordinary dictionary are trained on whole texts of a bounded sample of labelled
rows (MAX_LABELS documents outside the held-out fold).  Most words of a toxic text are as
ordinary as any, and dictionaries of the plain class texts tell the classes apart badly (see
README).  So either is trained on the words of its class whose share of documents is RATIO
times that of the other class (words under four bytes are never marks); texts that resemble an earlier one train the dictionaries, but
don't count again in the shares.  A text is folded to words
without case or ASCII punctuation and cut into windows of about WINDOW bytes; each window is compressed
with both dictionaries, and the difference of the lengths tells which class it is nearer to.
The mean, largest, third and upper-decile differences of a document, its count of windows at
MARGIN bytes or more and the logarithm of its windows are calibrated by logistic regression on the same
sample, which keeps the classes as frequent as they are.  It is fitted in halves: either half
is scored with dictionaries trained on the other, so that no text is scored by a dictionary
that holds it.

The sampled texts stay in the shared folder: word shares are a Spark aggregate, features are
computed in tasks, and the driver gets a few numbers a text, at most MAX_MARKS hashes and
MAX_PIECES short pieces of marked words a dictionary, however long the texts are.
The dictionaries (DICT_BYTES each) and a handful of weights are all that tasks receive;
scoring is one pass over whole texts without a shuffle.  Labels, lang, source and doc_id are
no inputs.

Defined results: a null or blank text has no window, its features are zero and it gets the
calibrated score of that point; with fewer than LEAST labelled rows of either class every score is
the smoothed share of the label (0.5 without any); labels that are null or not 0/1 are ignored, of
contradictory labels the larger counts; of several texts of a labelled doc_id the smallest is
fitted; rows with a null doc_id are scored, not fitted; equal texts get equal scores; texts of
any length are scored whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD_OUT, fold_of, stored, table, training_labels

MAX_LABELS = 6_000  #: rows of the sample
MAX_MARKS = 100_000  #: vocabulary of a dictionary: the stems with the largest lifts
MAX_PIECES = 100_000  #: pieces of up to eight marked words (below 300 bytes) that train a dictionary
LEAST = 8
DICT_BYTES = 4_096
HEAD = 8
WINDOW = 36  #: below 64 literals, where zstandard would start to code them by their own statistics
LEVEL = 3
STEMS = (4, 5, 6, 7, 8)
RATIO, SURE = 3.0, 3.0
MARGIN = 5
FEATURES = ("mean", "top", "third", "decile", "count", "windows")
#: Ends both dictionaries and opens every window: as a match is always there, each further match counts in full.
PRIME = b"|" + bytes(range(1, 32)) + b"| "
#: ASCII punctuation, removed from words.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def folded(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation, their first HEAD bytes in capitals: beginnings match beginnings only."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()
    return [w[:HEAD].upper() + w[HEAD:] for w in parts]


def cut(word: bytes) -> list[bytes]:
    """A word in pieces below WINDOW bytes."""
    return [word] if len(word) < WINDOW else [word[at : at + WINDOW - 1] for at in range(0, len(word), WINDOW - 1)]


def windows(parts: list[bytes]) -> list[bytes]:
    """All words in pieces of at most WINDOW bytes after PRIME; a longer word is cut."""
    out, size, held = [], 0, []
    for word in parts:
        for w in (word,) if len(word) < WINDOW else cut(word):
            if size + len(w) >= WINDOW:
                out.append(PRIME + b" ".join(held) + b" ")
                held, size = [], 0
            held.append(w)
            size += len(w) + 1
    if held:
        out.append(PRIME + b" ".join(held) + b" ")
    return out


class Distance:
    """Compression lengths of windows under both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.sides = []
        for raw in (toxic, ordinary):
            d = zstd.ZstdCompressionDict(raw + PRIME, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.sides.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def features(self, text: str | None) -> tuple[float, ...]:
        toxic, ordinary = self.sides
        d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(folded(text))])
        if not len(d):
            return (0.0,) * len(FEATURES)
        top = np.sort(d)[::-1]
        third = top[min(2, len(d) - 1)]
        return float(d.mean()), float(min(top[0], 8)), float(third), float(top[: max(1, len(d) // 10)].mean()), float(np.log1p((d >= MARGIN).sum())), float(np.log(len(d)))


def _stems(word: bytes) -> list[int]:
    """Signed XXH64 of a word and of its beginnings of STEMS lengths; a shorter word has none."""
    return [xxhash.xxh64_intdigest(word[:k]) - 2**63 for k in {*STEMS, len(word)} if STEMS[0] <= k <= len(word)]


def _unlike(least: np.ndarray) -> np.ndarray:
    """False for a text that resembles an earlier one: three of its six smallest word hashes (a row each) agree."""
    seen: set[tuple] = set()
    keep = np.ones(len(least), bool)
    for i, row in enumerate(least.tolist()):
        keys = {(t, *(row[j] for j in t)) for t in combinations(range(6), 3)}
        keep[i] = not (keys & seen)
        seen |= keys
    return keep


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary of `samples`, which are repeated until zstandard has enough to train on."""
    if not samples:
        return b""
    times = max(1, -(-16 * DICT_BYTES // sum(map(len, samples))))
    return zstd.train_dictionary(DICT_BYTES, samples * times, k=32, d=6, level=LEVEL).as_bytes()


#: The dictionaries of slot SETS are trained on all texts; those of slot k on the texts of the half that is not k.
SETS = 2


@dataclass
class Halves:
    """What the driver knows of the sample, by doc_id: a few numbers a text."""

    ids: np.ndarray
    y: np.ndarray
    half: np.ndarray
    fresh: np.ndarray  #: resembles no earlier text of the sample
    fresh_half: np.ndarray  #: resembles no earlier text of its half

    def texts(self, k: int) -> np.ndarray:
        """The texts that train the dictionaries of slot k."""
        return np.full(len(self.y), True) if k == SETS else self.half != k

    def counted(self, k: int) -> np.ndarray:
        """Those of them that count in the shares."""
        return self.fresh if k == SETS else self.texts(k) & self.fresh_half


def _halves(sample: DataFrame) -> Halves:
    """Either class is dealt to two halves in turn; six word hashes a text tell which resemble one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [set(folded(t)) for t in b.column(2).to_pylist()]
            least = [[min((zlib.crc32(w, seed) for w in distinct), default=0) for seed in range(6)] for distinct in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "y", "least"])

    rows = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, least array<long>").toPandas().sort_values("doc_id")
    y, least = rows["y"].to_numpy(int), np.array(rows["least"].tolist(), np.int64).reshape(-1, 6)
    half, fresh_half = np.zeros(len(y), int), np.ones(len(y), bool)
    for c in (0, 1):
        half[y == c] = np.arange((y == c).sum()) % 2
    for h in (0, 1):
        fresh_half[half == h] = _unlike(least[half == h])
    return Halves(rows["doc_id"].to_numpy(np.int64), y, half, _unlike(least), fresh_half)


def _marks(sample: DataFrame, halves: Halves) -> dict[tuple[int, int], set[int]]:
    """(slot, class): the stems whose share of the slot's texts is surely RATIO times that of the other class."""
    flags = {(k, c): halves.counted(k) & (halves.y == c) for k in range(SETS + 1) for c in (0, 1)}
    bit = {at: j for j, at in enumerate(flags)}
    code = sum(f.astype(int) << bit[at] for at, f in flags.items())
    codes = dict(zip(halves.ids.tolist(), code.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = list({x for w in set(folded(t)) for x in _stems(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([codes[i]] * len(found), pa.int32())], names=["stem", "code"])

    df = {at: F.col(f"df{bit[at]}") for at in flags}
    counted = sample.select("doc_id", "text").mapInArrow(run, "stem long, code int").groupBy("stem")
    counted = counted.agg(*(F.sum(F.getbit("code", F.lit(j)).cast("long")).alias(f"df{j}") for j in bit.values()))
    made = {}
    for (k, c), own in df.items():
        n, others = flags[k, c].sum() + 1.0, flags[k, 1 - c].sum() + 1.0
        share = (own - SURE * F.sqrt(own)) / float(n)
        bound = RATIO * (df[k, 1 - c] + 1) / float(others)
        made[k, c] = F.when(share > bound, share / bound)
    lifts = stored(counted.select("stem", *(lift.alias(f"lift{bit[at]}") for at, lift in made.items())).where(F.coalesce(*made.values()).isNotNull()))
    best = {at: lifts.where(f"lift{j} is not null").orderBy(F.desc(f"lift{j}"), "stem").limit(MAX_MARKS) for at, j in bit.items()}
    return {at: set(rows.select("stem").toPandas()["stem"].tolist()) for at, rows in best.items()}


def train_dictionaries(sample: DataFrame, halves: Halves) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) dictionaries of every slot.

    Of near copies one counts in the shares, or the chance words of a copied text would pass for marks of its class.
    The driver gets pieces of marked words, at most MAX_PIECES a dictionary by a hash of their place.
    Dictionaries are used as content only, without the entropy tables, so that lengths differ by matches alone.
    """
    marks = _marks(sample, halves)
    slots = {i: [(k, int(c)) for k in (SETS, 1 - int(h))] for i, c, h in zip(halves.ids.tolist(), halves.y, halves.half, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = folded(t)
                stems = {w: _stems(w) for w in set(parts)}
                for k, c in slots[i]:
                    own = {w for w, found in stems.items() if not marks[k, c].isdisjoint(found)}
                    kept = [x for w in parts if w in own for x in cut(w)]
                    rows += [(k * 2 + c, i, at, b" " + b" ".join(kept[at : at + 8]) + b" ") for at in range(0, len(kept), 8)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["slot", "doc_id", "at", "piece"])

    pieces = sample.select("doc_id", "text").mapInArrow(run, "slot int, doc_id long, at long, piece binary")
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at"))
    chosen = pieces.withColumn("place", place).where(F.col("place") <= MAX_PIECES).drop("place").toPandas().sort_values(["doc_id", "at"])
    made = [_trained(chosen.loc[chosen["slot"] == j, "piece"].map(bytes).tolist()) for j in range(2 * (SETS + 1))]
    return [(made[2 * k + 1], made[2 * k]) for k in range(SETS + 1)]


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.intercept, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Newton steps for ridge logistic regression."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


def _calibration(sample: DataFrame, halves: Halves, dictionaries: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The features of every text by the dictionaries that don't hold it, in the order of ids."""
    half = dict(zip(halves.ids.tolist(), halves.half.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [Distance(*d) for d in dictionaries[:SETS]]
        for b in batches:
            x = [by[half[i]].features(t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>").toPandas().sort_values("doc_id")
    return np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> ToxicityModel:
    """Fit on the whole texts of at most `most` labelled documents, which stay in the shared folder."""
    zero = np.zeros(len(FEATURES))
    chosen = stored(training_labels(labels, "toxic", most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    # of several rows of an id one counts
    sample = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    sample = stored(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
    positive, n = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    p = (positive + 1) / (n + 2)
    if min(positive, n - positive) < LEAST:
        return ToxicityModel(b"", b"", zero, zero + 1, zero, float(np.log(p / (1 - p))))
    halves = _halves(sample)
    dictionaries = train_dictionaries(sample, halves)
    x = _calibration(sample, halves, dictionaries)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w, b = fit_logistic((x - mean) / scale, halves.y.astype(float))
    return ToxicityModel(*dictionaries[SETS], mean, scale, w, b)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Distance(model.toxic, model.ordinary) if model.weights.any() else None
        for b in batches:
            x = np.array([d.features(t) if d else (0.0,) * len(FEATURES) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
