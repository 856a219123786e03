"""Merkle dataset manifest with checkpoint-and-recompute proofs.

Every row of a table is a leaf; the leaves of a group (a source) form a tree of ARITY children a
node, and the subroots of the groups form one more tree like it.  Of a tree only the leaves and every
STRIDE-th level are stored.  A proof needs the other levels too: each aligned subtree between two
stored levels is built anew from its stored descendants, emits the siblings of every descendant,
and is dropped.  A subtree holds ARITY ** STRIDE nodes at most, so any tree is many small rows.

Proofs come down the stored levels: the siblings above a stored node are the same for all that lies below,
so that they are joined once a subtree (a key of one row on each side), not once a leaf.

Defined results: leaves of a group ascend by key, null keys first, equal keys by their leaf; equal rows
are leaves of their own; a null group is a group of its own, first in order; an empty table has no root and no
rows; texts of any length are hashed where they are read and never moved; columns that are not named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

ARITY = 16
STRIDE = 2
#: A proof: for each level the digests left and right of the node, joined as text.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value; integers as decimals."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*map(field, columns))


def group_key(group: Column) -> Column:
    """Text that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """`leaves` (grp, key, leaf and more) stored with idx, the gapless place in its group, and n, the leaves of the group.

    Rows are sorted by ranges; a range knows its rows of each group, and offsets are sums over the ranges of a group.
    """
    order = [F.col("grp"), F.col("key").asc_nulls_first(), F.col("leaf")]
    ranges = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("part", F.shiftright("at", 33))
    counts = ranges.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(
        "grp", "part", (F.sum("here").over(before) - F.col("here") - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("grp")).alias("n"),
    )
    return ranges.join(counts, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _parents(nodes: Column, arity: int) -> Column:
    """The digests one level up of an array of digests."""
    last = F.floor((F.size(nodes) - 1) / arity)
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.sha2(F.array_join(F.slice(nodes, (k * arity + 1).cast("int"), arity), ""), 256))


@dataclass
class Tree:
    """The stored levels: levels[j] has grp, idx, n, node (level j x stride; n nodes in the group).  roots: grp, root."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    stride: int

    def rebuilt(self, j: int) -> DataFrame:
        """Aligned subtrees of stored level j: grp, sub, n, nodes (their digests in order), ups (levels above, list of arrays).

        A group of n nodes goes up one level after the other until one node is left, `stride` levels at most.
        """
        return _subtrees(self.levels[j], self.arity, self.stride)


def _subtrees(level: DataFrame, arity: int, stride: int) -> DataFrame:
    width = arity**stride
    grouped = (
        level.where("n > 1").groupBy("grp", F.expr(f"idx div {width}").alias("sub"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("s"), F.max("n").alias("n"))
        .select("grp", "sub", "n", F.col("s.node").alias("up0"))
    )
    for step in range(1, stride + 1):
        grouped = grouped.withColumn(f"up{step}", F.when(F.col("n") > arity ** (step - 1), _parents(F.col(f"up{step - 1}"), arity)))
    return grouped


def build_tree(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Tree:
    """The checkpoints of the trees of `leaves` (stored: grp, idx, n, node)."""
    levels, done = [leaves], []
    width = arity**stride
    while True:
        level = levels[-1]
        done.append(level.where("n = 1").select("grp", F.col("node").alias("root")))
        if (level.agg(F.max("n")).first()[0] or 1) <= 1:
            break
        top = F.coalesce(*(F.col(f"up{s}")[0] for s in range(stride, 0, -1)))
        up = _subtrees(level, arity, stride).select("grp", F.col("sub").alias("idx"), F.expr(f"(n - 1) div {width} + 1").alias("n"), top.alias("node"))
        levels.append(stored(up))
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    return Tree(levels, stored(roots), arity, stride)


def _siblings(tree: Tree, place: Column) -> Column:
    """The path of the node at `place` (from 0) of a rebuilt subtree through its levels."""
    path = []
    for step in range(tree.stride):
        nodes, at = F.col(f"up{step}"), F.floor(place / tree.arity**step).cast("int")
        first = at - at % tree.arity
        left = F.array_join(F.slice(nodes, first + 1, at - first), "")
        right = F.array_join(F.slice(nodes, at + 2, first + tree.arity - 1 - at), "")
        here = F.struct(left.alias("left"), right.alias("right"))
        path.append(F.when(F.col("n") > tree.arity**step, F.array(here)).otherwise(F.array().cast(PATH)))
    return F.concat(*path)


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """grp, sub, paths: for each lowest subtree the paths of its leaves, in order, to the root.

    `above` (grp, path): what follows the root of a group.  Groups of one leaf have sub 0 and only what follows.
    """
    empty = F.array().cast(PATH)
    upper = tree.roots.select("grp")
    upper = upper.withColumn("path", empty) if above is None else upper.join(above, "grp")
    found = upper.join(tree.levels[-1].select("grp", "idx"), "grp").select("grp", "idx", "path")  # the last level holds roots only
    for j in range(len(tree.levels) - 2, -1, -1):
        subtrees = tree.rebuilt(j).join(found.withColumnRenamed("idx", "sub"), ["grp", "sub"])
        each = F.transform(F.col("up0"), lambda _, k: F.concat(_siblings(tree, k), F.col("path")))
        if j == 0:
            lowest = subtrees.select("grp", "sub", each.alias("paths"))
            break
        below = subtrees.select("grp", "sub", F.posexplode(each).alias("k", "path")).select(
            "grp", (F.col("sub") * tree.arity**tree.stride + F.col("k")).alias("idx"), "path"
        )
        # groups that ended at this level
        ended = tree.levels[j].where("n = 1").select("grp", "idx").join(upper, "grp").select("grp", "idx", "path")
        found = below.unionByName(ended)
    else:
        return found.select("grp", F.col("idx").alias("sub"), F.array("path").alias("paths"))
    single = tree.levels[0].where("n = 1").select("grp").join(upper, "grp")
    return lowest.unionByName(single.select("grp", F.lit(0).cast("long").alias("sub"), F.array("path").alias("paths")))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


@dataclass
class Manifest:
    """leaves: grp, key, leaf, idx, n and the carried columns; subroots: grp, subroot; root: one row.  Trees keep their checkpoints."""

    leaves: DataFrame
    sources: Tree
    top: Tree
    top_leaves: DataFrame


def build_manifest(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """Of `leaves`: grp, key, leaf and any columns to carry along."""
    placed = stored(numbered_leaves(leaves))
    sources = build_tree(placed.select("grp", "idx", "n", F.col("leaf").alias("node")), arity, stride)
    subroots = sources.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("root").alias("leaf"))
    top_leaves = stored(numbered_leaves(subroots))
    top = build_tree(top_leaves.select("grp", "idx", "n", F.col("leaf").alias("node")), arity, stride)
    return Manifest(placed, sources, top, top_leaves)


def leaf_proofs(manifest: Manifest) -> DataFrame:
    """The leaves with subroot, root and path, the siblings of every level up to the root."""
    top, sources = manifest.top, manifest.sources
    width = top.arity**top.stride
    above = proofs(top).select("sub", F.posexplode("paths").alias("k", "path")).withColumn("idx", F.col("sub") * width + F.col("k"))
    above = manifest.top_leaves.join(above, "idx").select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "path")
    above = stored(above.crossJoin(F.broadcast(top.roots.select("root"))))  # one root
    # the leaves of a subtree are packed in order, meet its paths once and are unpacked
    width = sources.arity**sources.stride
    carried = [c for c in manifest.leaves.columns if c not in ("grp", "idx", "n")]
    packs = manifest.leaves.groupBy("grp", F.expr(f"idx div {width}").alias("sub")).agg(F.sort_array(F.collect_list(F.struct("idx", *carried))).alias("rows"))
    joined = packs.join(proofs(sources, above.select("grp", "path")), ["grp", "sub"])
    rows = joined.select("grp", F.explode(F.arrays_zip("rows", F.col("paths").alias("path"))).alias("z"))
    return rows.select("grp", *(F.col(f"z.rows.{c}").alias(c) for c in carried), F.col("z.path").alias("path")).join(above.drop("path"), "grp")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaf = leaf_digest([F.col(c) for c in names])
    tampered = F.when(hit & (lower != F.col("text")), leaf_digest([*map(F.col, names[:-1]), lower]))
    leaves = docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").alias("key"), leaf.alias("leaf"), tampered.alias("tampered"))
    found = leaf_proofs(build_manifest(leaves))
    out = found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
