"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that is never split. Groups larger
than ``1 / SLICES`` of a shard are items of their own: there can be at most
``shards * SLICES`` of them. The other groups are gathered into as many bundles by a
hash of their digest, each about that size, so the number of items is bounded
by the shards alone, not by the corpus. The items, sorted by size, are placed by
best fit: each goes to the shard with the tightest remaining capacity that still
holds it, found in a balanced search tree; an item that fits nowhere (its group
is larger than what any shard has left) opens up the emptiest shard. Only the
items pass through one place; texts, digests and rows stay distributed.

Slots number a shard's rows without gaps: rows are counted per (shard, block of
hashed digests), block counts are summed up, and rows are numbered within blocks.

Defined results: null text is empty; repeated rows belong to one group and each
get a slot; null ids are placed like others; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import attach, materialize, table

SHARDS = 8
#: Items are at least about this part of a shard, or a whole group.
SLICES = 512


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.left, self.right, self.height = key, None, None, 1


class CapacityTree:
    """A height-balanced search tree of (remaining capacity, shard)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _height(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        n.height = 1 + max(self._height(n.left), self._height(n.right))
        lean = self._height(n.left) - self._height(n.right)
        if lean > 1:
            if self._height(n.left.left) < self._height(n.left.right):
                n.left = self._up(n.left, "right")
            return self._up(n, "left")
        if lean < -1:
            if self._height(n.right.right) < self._height(n.right.left):
                n.right = self._up(n.right, "left")
            return self._up(n, "right")
        return n

    def _up(self, n: _Node, side: str) -> _Node:
        """Rotate the child on ``side`` above ``n``."""
        other = "left" if side == "right" else "right"
        child = getattr(n, side)
        setattr(n, side, getattr(child, other))
        setattr(child, other, n)
        for x in (n, child):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut(n: _Node, key: tuple[int, int]) -> _Node | None:
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                low = n.right
                while low.left:
                    low = low.left
                n.key = low.key
                n.right = cut(n.right, low.key)
            return self._fix(n)

        self.root = cut(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest entry with at least ``size`` left."""
        n, found = self.root, None
        while n:
            if n.key >= (size, -1):
                found, n = n.key, n.left
            else:
                n = n.right
        return found

    def largest(self) -> tuple[int, int]:
        n = self.root
        while n.right:
            n = n.right
        return n.key


def best_fit_decreasing(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each item, given (size, item); capacity is the mean, rounded up."""
    capacity = -(-sum(s for s, _ in items) // shards)
    tree = CapacityTree()
    for k in range(shards):
        tree.add((capacity, k))
    placed = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        left, k = at = tree.tightest(size) or tree.largest()
        tree.remove(at)
        tree.add((left - size, k))
        placed[item] = k
    return placed


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slices: int = SLICES) -> DataFrame:
    """Per document: id, size, text_crc32, shard, slot (see the module)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    lean = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    made = lean.select(
        "id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")
    )
    made = materialize(made, "sized")
    groups = materialize(made.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")), "groups")
    total = groups.agg(F.sum("size")).first()[0]
    slice_bytes = max(1, (total or 0) // (shards * slices))
    # small groups: a bundle for each hash cell; sums combine before the shuffle and nothing is sorted
    cell = F.pmod(F.xxhash64("digest"), F.lit(shards * slices))
    small = groups.filter(F.col("size") <= slice_bytes).select("digest", "size", (cell * 2).alias("item"))
    large = groups.filter(F.col("size") > slice_bytes).select("digest", "size", (F.pmod(F.xxhash64("digest"), F.lit(1 << 61)) * 2 + 1).alias("item"))
    dealt = materialize(small.unionByName(large), "items")
    # at most shards * slices large items and as many bundles, whatever the corpus size
    items = [(r["size"], r["item"]) for r in dealt.groupBy("item").agg(F.sum("size").alias("size")).toLocalIterator()]
    placed = best_fit_decreasing(items, shards)
    places = spark.createDataFrame(list(placed.items()), "item long, shard int")
    where = dealt.join(F.broadcast(places), "item").select("digest", "shard")
    # digests with many copies, at most 20 000, are broadcast, so that no group meets in one task
    hot = groups.filter(F.col("copies") > max(1000, made.count() // 20_000)).select("digest")
    rows = attach(made, where, "digest", hot=materialize(hot, "hot"))
    blocks = max(64, spark.sparkContext.defaultParallelism, int((total or 0) >> 25))
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)).cast("int")), "placed")
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    start = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "digest")) - 1
    out = rows.withColumn("within", within).join(start, ["shard", "block"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
