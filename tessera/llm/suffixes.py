"""Suffix dedup over a difference cover: bytes that repeat 50-byte strings of earlier documents.

The distributed difference-cover algorithm, stopped where the question stops: only prefixes
of LENGTH = 50 bytes are ever compared, so no order beyond that is made.

1. Sample: positions whose offset mod 31 is in COVER, a perfect difference set.  For any two
   positions there is a shift below 31 that puts both into the sample, so two equal 50-byte
   strings contain equal sampled 20-byte tuples at the same shift.
2. Name the sampled tuples: names are dealt to buckets and sorted there; a name that one
   document alone has tells that no string over it can repeat.
3. Remaining suffixes: the strings within reach of a repeated name are merged by their
   50-byte names, sorted in buckets, and neighbours are compared: the smallest document of
   each run of equal names keeps the bytes.  As 50 = 20 + 30, one level of naming decides,
   and the recursion on names has nothing left to do.

Texts are gathered once into packs of about PACK_BYTES, dealt by a hash of the id.  A pack
sends every name once, however many of its documents share it (a combine before the
shuffle), packed as bytes, and gets one bit a name back.  Exact copies are folded first.

Names are hashes.  Those of step 2 (32 bits within a bucket) may collide: that only adds
candidates.  Those of step 3 have 56 bits plus the bucket, drawn independently, and are not
compared by bytes: n candidate strings have about n x `bucket` / 2^57 pairs of different strings
with one name (see README).  A bucket holds about `bucket` names: step 2 has as many buckets as the
samples fill, step 3 as many as all strings would.  A name that every pack has is one name a
pack in its bucket.

Defined results: a null text is an empty one; documents of one doc_id do not remove each
other; a null doc_id counts as larger than all others and stays null; texts under 50 bytes lose
nothing; equal texts under different ids lose all but the first; texts of any length are
whole (a text above `pack_bytes` fills its pack); an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table

LENGTH = 50
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)
TUPLE = LENGTH - MODULUS + 1
PACK_BYTES = 2_000_000
BUCKET = 3_000_000  #: names a bucket
NULL_ID = 2**63 - 1  #: the place of a null id; an id of this value is told apart by a flag
_M = 0x9E3779B97F4A7C15


def rolling(b: np.ndarray, length: int, key: int) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all strings of `length` bytes, by doubling; mixed at the end."""
    with np.errstate(over="ignore"):
        m = (_M * (2 * key + 1)) % 2**64
        part, width, power = b.astype(np.uint64) + np.uint64(1), 1, m
        whole, have = None, 0
        while True:
            if length & width:
                if whole is None:
                    whole, have = part, width
                else:
                    k = len(b) - have - width + 1
                    whole = whole[:k] * np.uint64(power) + part[have : have + k]
                    have += width
            if 2 * width > length:
                break
            k = len(part) - width
            part = part[:k] * np.uint64(power) + part[width : width + k]
            power, width = power * power % 2**64, 2 * width
        whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return whole ^ (whole >> np.uint64(29))


class Pack:
    """The documents of one pack: bytes on end, names of the sample, strings near repeated names."""

    def __init__(self, pdf: pd.DataFrame, buckets: int):
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        order = sorted(range(len(texts)), key=lambda i: (pdf["doc_id"].iat[i], texts[i]))
        self.ids = pdf["doc_id"].to_numpy(np.int64)[order]
        self.texts = [texts[i] for i in order]
        self.nameless = pdf["nameless"].to_numpy(bool)[order]
        self.n = np.array([len(t) for t in self.texts], np.int64)
        self.bytes = np.frombuffer(b"".join(self.texts) + bytes(LENGTH), np.uint8)
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.buckets = buckets
        at = np.arange(len(self.doc)) - self.starts[self.doc]
        in_cover = np.zeros(MODULUS, bool)
        in_cover[list(COVER)] = True
        self.at = np.nonzero(in_cover[at % MODULUS] & (self.n[self.doc] >= LENGTH) & (at + TUPLE <= self.n[self.doc]))[0]

    def _grouped(self, h: np.ndarray, where: np.ndarray, bits: int):
        """Distinct names by bucket: (bucket, name, rank of the first document, several documents?, index back)."""
        with np.errstate(over="ignore"):
            bucket = ((h * np.uint64(_M)) >> np.uint64(33)) % np.uint64(self.buckets)
        name = h & np.uint64(2**bits - 1)
        if bits + self.buckets.bit_length() <= 64:  # one integer is sorted faster than two columns
            order = np.argsort((bucket << np.uint64(bits)) | name)
        else:
            order = np.lexsort((name, bucket))
        b, x, d = bucket[order], name[order], self.ids[self.doc[where[order]]]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1])
        first = np.nonzero(new)[0]
        back = np.empty(len(b), np.int64)
        back[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(d, first) if len(d) else d
        high = np.maximum.reduceat(d, first) if len(d) else d
        return b[first], x[first], low, high, back

    def names(self):
        return self._grouped(rolling(self.bytes, TUPLE, 1)[self.at], self.at, 32)

    def strings(self, repeated: np.ndarray) -> np.ndarray:
        """Where 50-byte strings start that hold a sampled tuple with a repeated name within reach."""
        reach = np.zeros(len(self.doc) + 1, np.int64)
        p = self.at[repeated]
        np.add.at(reach, np.maximum(p - MODULUS + 1, self.starts[self.doc[p]]), 1)
        np.add.at(reach, p + 1, -1)
        near = np.cumsum(reach[:-1]) > 0
        return np.nonzero(near & (np.arange(len(self.doc)) + LENGTH <= self.ends[self.doc]))[0]

    def string_names(self, where: np.ndarray):
        return self._grouped(rolling(self.bytes, LENGTH, 2)[where], where, 56)


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets present and where each ends in the sorted column."""
    if not len(bucket):
        return bucket, np.zeros(0, np.int64)
    last = np.append(np.nonzero(bucket[1:] != bucket[:-1])[0], len(bucket) - 1)
    return bucket[last], last + 1


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 32-bit names as 3-byte gaps; 4-byte names behind a mark if a gap is too wide."""
    gaps = np.diff(x, prepend=np.uint64(0)).astype(np.uint32)
    if len(gaps) and gaps.max() >= 1 << 24:
        return b"4" + x.astype("<u4").tobytes()
    return b"3" + gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"4":
        return np.frombuffer(data, "<u4", offset=1).astype(np.uint64)
    gaps = np.zeros((len(data) // 3, 4), np.uint8)
    gaps[:, :3] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 3)
    return np.cumsum(gaps.view("<u4").reshape(-1).astype(np.uint64))


WIDE = np.uint64(2**48 - 1)


def _pack_long(x: np.ndarray) -> bytes:
    """Sorted 56-bit names as 6-byte gaps; the few gaps that are too wide stand in front in full."""
    gaps = np.diff(x, prepend=np.uint64(0))
    wide = gaps[gaps >= WIDE]
    short = np.minimum(gaps, WIDE).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return len(wide).to_bytes(4, "little") + wide.astype("<u8").tobytes() + short


def _unpack_long(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    wide = np.frombuffer(data, "<u8", n, 4)
    gaps = np.zeros(((len(data) - 4 - 8 * n) // 6, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(data, np.uint8, offset=4 + 8 * n).reshape(-1, 6)
    gaps = gaps.view("<u8").reshape(-1).copy()
    gaps[gaps == WIDE] = wide
    return np.cumsum(gaps, dtype=np.uint64)


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


SENT = "bucket int, pack long, n int, names binary, flags binary, docs binary"
ANSWER = "pack long, kind int, bucket int, n int, bits binary"


def _send_names(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    pack = Pack(pdf, buckets)
    bucket, name, low, high, _ = pack.names()
    rows, at = [], 0
    for b, end in zip(*_cuts(bucket), strict=True):
        rows.append((int(b), int(pdf["pack"].iat[0]), int(end - at), _pack_sorted(name[at:end]), np.packbits(low[at:end] != high[at:end]).tobytes(), b""))
        at = end
    return pd.DataFrame(rows, columns=["bucket", "pack", "n", "names", "flags", "docs"])


def _answer_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each name sent: more than one document has it."""
    x = np.concatenate([_unpack_sorted(d) for d in pdf["names"]])
    flag = np.concatenate([_bits(d, n) for d, n in zip(pdf["flags"], pdf["n"], strict=True)])
    order = np.argsort(x, kind="stable")
    s = x[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    group = np.cumsum(~again) - 1
    many = np.bincount(group, again | flag[order]) > 0
    repeated = np.empty(len(s), bool)
    repeated[order] = many[group]
    return _answers(pdf, repeated, 0)


def _answers(pdf: pd.DataFrame, bits: np.ndarray, kind: int) -> pd.DataFrame:
    ends = np.cumsum(pdf["n"].to_numpy())
    return pd.DataFrame(
        {"pack": pdf["pack"], "kind": kind, "bucket": pdf["bucket"], "n": pdf["n"], "bits": [np.packbits(p).tobytes() for p in np.split(bits, ends[:-1])]}
    )


def _asked(answers: pd.DataFrame, kind: int) -> np.ndarray:
    """The answers in the order in which the pack sent its names."""
    own = answers[answers["kind"] == kind].sort_values("bucket")
    return np.concatenate([np.zeros(0, bool), *(_bits(d, n) for d, n in zip(own["bits"], own["n"], strict=True))])


def _send_strings(pdf: pd.DataFrame, answers: pd.DataFrame, buckets: int, wide: int) -> pd.DataFrame:
    columns = ["bucket", "pack", "n", "names", "flags", "docs"]
    if not len(pdf):
        return pd.DataFrame([], columns=columns)
    pack = Pack(pdf, buckets)
    back = pack.names()[-1]
    pack.buckets = wide
    bucket, name, low, _, _ = pack.string_names(pack.strings(_asked(answers, 0)[back]))
    rows, at = [], 0
    for b, end in zip(*_cuts(bucket), strict=True):
        ids, rank = np.unique(low[at:end], return_inverse=True)
        ranks = rank.astype("<u2" if len(ids) < 1 << 16 else "<u4").tobytes()
        rows.append((int(b), int(pdf["pack"].iat[0]), int(end - at), _pack_long(name[at:end]), ranks, zstd.compress(ids.astype("<i8").tobytes(), 1)))
        at = end
    return pd.DataFrame(rows, columns=columns)


def _answer_strings(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bit for each string sent: another pack has it in a smaller document."""
    names, docs = [], []
    for n, data, ranks, ids in zip(pdf["n"], pdf["names"], pdf["flags"], pdf["docs"], strict=True):
        names.append(_unpack_long(data))
        docs.append(np.frombuffer(zstd.decompress(ids), "<i8")[np.frombuffer(ranks, "<u2" if len(ranks) == 2 * n else "<u4")])
    x, d = np.concatenate(names), np.concatenate(docs)
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    least = np.minimum.reduceat(d[order], np.nonzero(new)[0])
    smaller = np.empty(len(s), bool)
    smaller[order] = least[np.cumsum(new) - 1] < d[order]
    return _answers(pdf, smaller, 1)


RESULT = "doc_id long, nameless boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(pdf: pd.DataFrame, answers: pd.DataFrame, buckets: int, wide: int) -> pd.DataFrame:
    columns = ["doc_id", "nameless", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not len(pdf):
        return pd.DataFrame([], columns=columns)
    pack = Pack(pdf, buckets)
    where = pack.strings(_asked(answers, 0)[pack.names()[-1]])
    pack.buckets = wide
    _, _, low, _, back = pack.string_names(where)
    gone_at = where[_asked(answers, 1)[back] | (pack.ids[pack.doc[where]] > low[back])]
    cover = np.zeros(len(pack.doc) + LENGTH + 1, np.int64)
    np.add.at(cover, gone_at, 1)
    np.add.at(cover, gone_at + LENGTH, -1)
    gone = np.cumsum(cover)[: len(pack.doc)] > 0
    rows = []
    for i, (a, e) in enumerate(zip(pack.starts, pack.ends, strict=True)):
        g = gone[a:e]
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        kept = pack.bytes[a:e][~g].tobytes() if spans else pack.texts[i]
        rows.append((pack.ids[i], pack.nameless[i], e - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=columns)


def repeated_bytes(docs: DataFrame, pack_bytes: int = PACK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("digest", F.sha2("text", 256))
    size = F.octet_length("text").cast("long")
    groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.max(size).alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    packs = max(1, -(-total // pack_bytes))
    buckets = max(1, -(-(total * len(COVER) // MODULUS) // bucket))
    wide = max(1, -(-total // bucket))
    copied = stored(groups.where("rows > 1").select("digest", "first"))
    marked = rows.join(small(copied), "digest", "left").withColumn("copy", F.col("doc_id") > F.coalesce("first", "doc_id"))

    pack = F.pmod(F.xxhash64("doc_id"), F.lit(packs))
    kept = marked.where("not copy").select("doc_id", "nameless", "text", pack.alias("pack")).repartition("pack")
    own = kept.groupBy("pack")
    # each answer is stored, and its job's shuffle files go, before the next job begins: two shuffles are on disk at most
    sent = own.applyInPandas(lambda pdf: _send_names(pdf, buckets), SENT)
    names = stored(sent.groupBy("bucket").applyInPandas(_answer_names, ANSWER), free=True)
    sent = own.cogroup(names.groupBy("pack")).applyInPandas(lambda a, b: _send_strings(a, b, buckets, wide), SENT)
    strings = stored(sent.groupBy("bucket").applyInPandas(_answer_strings, ANSWER), free=True)
    found = own.cogroup(names.unionByName(strings).groupBy("pack")).applyInPandas(lambda a, b: _remove(a, b, buckets, wide), RESULT)

    long = size >= LENGTH
    copies = marked.where("copy").select(
        "doc_id", "nameless", size.alias("n_bytes"), F.when(long, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        long.cast("long").alias("n_spans"), F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    both = found.unionByName(copies)
    return both.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
