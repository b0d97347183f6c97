"""Near duplicates: MinHash bands for candidates, odd sketches to screen, full sets to confirm.

1. One pass over the texts makes, per document, the size and a digest (128-bit
   BLAKE2) of its whole set of 5-word shingles, ``bands`` MinHash band keys and an
   odd sketch: MinHash samples folded into a parity bitmap. The XOR population
   count of two sketches estimates their similarity.
2. Documents with equal sets form classes; only one document of each class goes
   on, so a large group of copies costs one row per copy.
3. In each band bucket every class is compared with one member only (the smallest
   id); links are confirmed on full sets, and components are found. Classes that are
   not yet in their bucket's component are compared with two members drawn by hash.
   Rows stay linear in the bucket, and with ``bands`` buckets per document that is a
   wide choice of members.
4. Only buckets that still hold two or more components need pairs across them:
   the members outside the bucket's largest component, each with those of other
   components.

Joins on a document, a class or a component that a large part of the rows share go
by broadcast (:func:`shared.attach`).

Two screens drop pairs before full sets are fetched. The XOR population count of
the parity bitmaps of two full sets never exceeds the size of their symmetric
difference, so a count above a seventh of both sizes proves that a pair is below
0.75: nothing is lost by it. The odd sketches of the MinHash samples estimate the
similarity of larger sets too; they drop a pair only far below the bound.

With ``rows`` r and ``bands`` b, a pair at similarity s is missed in all bands with
probability (1 - s**r)**b: below 1e-7 at 0.75 with the defaults, and far less
for a component, which has many such pairs.

Shingles are 64-bit hashes of five word hashes (long words are hashed whole, not by
a rolling sum). Documents without words have an empty set and are
linked with nothing; null text counts as empty; ties take the smallest id;
rows of the same id are one document, linked with whatever one of its texts is
linked with; rows with a null id stay alone; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, mix, pieces, prefix_hash, span_hash, windows, words
from .shared import anti_join_bounded, attach, components, hot_keys, materialize, semi_join_bounded, table, without_rows

U64 = np.uint64
WIDTH = 5
#: Links need 100 * intersection >= BOUND * union.
BOUND = 75
BANDS, ROWS = 30, 3
#: Words of 64 bits of an odd sketch.
SKETCH = 4
#: Words of 64 bits of the parity bitmap of a full set.
PARITY = 16
#: Sets of up to so many shingles may be broadcast, 200 of them at most.
BROADCAST_SHINGLES = 50_000
#: A pair is dropped without confirmation only if its estimate is this far below.
SCREEN = 0.40


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word shingles."""
    low = LOWER[buf]
    start, end, first = words(low, off)
    h = span_hash(prefix_hash(low), start, end, low)
    w = windows(h, width)
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            yield np.unique(w[a : b - width + 1])
        elif b > a:
            yield windows(h[a:b], int(b - a)) + U64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def minhash(sets: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """MinHash samples of one set, all of it, in blocks."""
    x = (sets >> U64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), block):
        np.minimum(out, (x[i : i + block, None] * a + b).min(axis=0), out=out)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: id, n, digest of the set, band keys, odd sketch words, parity bitmap."""
    a, b = _family(bands * rows)
    salts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in pieces(batches, "text"):
            n = len(off) - 1
            size, digest = np.zeros(n, np.int64), [b""] * n
            mins = np.zeros((n, bands * rows), np.uint32)
            full = np.zeros((n, 64 * PARITY), np.uint8)
            for i, s in enumerate(shingle_sets(buf, off)):
                size[i] = len(s)
                if len(s):
                    digest[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    mins[i] = minhash(s, a, b)
                    full[i] = np.bincount((s & U64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
            seeded = mix(mins.astype(np.uint64) ^ salts)
            keys = np.zeros((n, bands), np.uint64)
            for k in range(rows):
                keys = keys * U64(0xFF51AFD7ED558CCD) + seeded[:, k::rows]
            keys = mix(keys)
            bit = (seeded & U64(64 * SKETCH - 1)).astype(np.int64)
            folded = np.zeros((n, 64 * SKETCH), np.uint8)
            np.add.at(folded, (np.arange(n)[:, None], bit), 1)
            made = [part.column(0), pa.array(size), pa.array(digest, pa.binary()), _lists(keys.view(np.int64)), _lists(_bits(folded & 1)), _lists(_bits(full))]
            yield pa.RecordBatch.from_arrays(made, ["id", "n", "digest", "keys", "odd", "parity"])

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return lean.mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, digest binary, keys array<long>, odd array<long>, parity array<long>"
    )


def differing(a: Column, b: Column, size: int) -> Column:
    """Bits in which two bitmaps of ``size`` longs differ."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, size):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def may_link(x: str, y: str, samples: int) -> Column:
    """Whether two sketched sets can be similar enough: sizes, parity bitmaps, odd sketches."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = 100 * F.least(n, m) >= BOUND * F.greatest(n, m)
    # similarity >= BOUND / 100 means a symmetric difference of at most this
    proof = differing(F.col(f"{x}.parity"), F.col(f"{y}.parity"), PARITY) * (100 + BOUND) <= (n + m) * (100 - BOUND)
    bits = 64 * SKETCH
    rest = F.greatest(F.lit(1.0) - 2.0 * differing(F.col(f"{x}.odd"), F.col(f"{y}.odd"), SKETCH) / F.lit(bits), F.lit(1e-6))
    estimate = F.lit(1.0) + F.lit(bits / (4.0 * samples)) * F.log(rest)
    return sizes & proof & (estimate >= SCREEN)


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in pieces(batches, "text"):
            found = list(shingle_sets(buf, off))
            at = np.concatenate(([0], np.cumsum([len(s) for s in found])))
            values = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))], ["id", "set"])

    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = semi_join_bounded(lean, ids, "id").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, set array<long>")
    sets = materialize(sets, f"{name}-sets")
    sets = sets.dropDuplicates(["id", "set"])  # repeated rows; an id with several texts has several sets
    named = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs
    for c, hot in [(c, hot_keys(pairs, [c], share=200)) for c in ("b", "a")]:  # small sets of such documents are broadcast
        both = attach(both, named(c), c, fits=F.size(f"set_{c}") <= BROADCAST_SHINGLES, hot=hot)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select(
        "a", "b", common.alias("i"), (F.size("set_a") + F.size("set_b") - common).alias("u")
    ).filter(100 * F.col("i") >= BOUND * F.col("u")).select("a", "b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: id, n_shingles, component_id, kept (see the module)."""
    made = materialize(sketches(docs, id_col, text_col, bands, rows), "sketches")
    some = made.filter("n > 0 AND id IS NOT NULL")
    classes = materialize(some.groupBy("n", "digest").agg(F.min("id").alias("rep")), "classes")
    members = materialize(attach(some.select("id", "n", "digest"), classes, ["n", "digest"]), "members")
    first = some.join(classes.withColumnRenamed("rep", "id"), ["n", "digest", "id"]).dropDuplicates(["n", "digest"])
    # a class is named by its smallest id; an id with several texts may name several classes
    reps = materialize(first.select(F.col("id").alias("rep"), "n", "keys", "odd", "parity"), "reps")
    sketch = reps.select("rep", "n", "odd", "parity")
    banded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    drawn = F.xxhash64("rep", "band")
    probes = [F.min("rep").alias("first"), F.min_by("rep", drawn).alias("one"), F.max_by("rep", drawn).alias("other")]
    shared = banded.groupBy("band", "key").agg(*probes, F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = materialize(banded.join(shared.drop("members"), ["band", "key"]), "buckets")
    ends = [F.least("rep", "probe").alias("a"), F.greatest("rep", "probe").alias("b")]

    def screened(pairs: DataFrame) -> DataFrame:
        for c, hot in [(c, hot_keys(pairs, [c])) for c in ("a", "b")]:
            pairs = attach(pairs, sketch.select(F.col("rep").alias(c), F.struct("n", "odd", "parity").alias(f"of_{c}")), c, hot=hot)
        return pairs.filter(may_link("of_a", "of_b", bands * rows)).select("a", "b").distinct()

    tried = buckets.select("rep", F.col("first").alias("probe")).filter("rep <> probe").select(*ends).distinct()
    tried = materialize(screened(materialize(tried, "first-pairs")), "first-probes")
    links = confirm(docs, tried, id_col, text_col, "first").unionByName(_classes_of_one_id(members))
    links = materialize(links, "links")
    found = components(links, name="first")

    named = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    again = buckets.select("rep", F.explode(F.array("one", "other")).alias("probe")).filter("rep <> probe").distinct()
    again = again.join(named("rep"), "rep", "left").join(named("probe"), "probe", "left").filter(F.coalesce("rep_in", "rep") != F.coalesce("probe_in", "probe")).select(*ends).distinct()
    # screened pairs are few; written first, as Spark would else take out the tried ones before the screen
    again = materialize(screened(materialize(again, "more-pairs")), "more-screened")
    again = materialize(again.join(tried, ["a", "b"], "left_anti"), "more-probes")
    if not again.isEmpty():
        links = materialize(links.unionByName(confirm(docs, again, id_col, text_col, "more")), "more-links")
        found = components(links, name="more")
    tried = tried.unionByName(again)

    placed = buckets.drop("first", "one", "other").join(
        found.withColumnRenamed("node", "rep"), "rep", "left"
    ).withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed, "placed")
    parts = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("members"))
    mixed = parts.groupBy("band", "key").agg(F.max_by("component", F.struct("members", "component")).alias("major"), F.count(F.lit(1)).alias("parts"))
    mixed = mixed.filter("parts > 1").select("band", "key", "major")
    left = placed.join(mixed, ["band", "key"]).join(sketch, "rep").withColumn("minor", F.col("component") != F.col("major")).drop("major")
    left = materialize(left, "mixed")
    x, y = left.filter("minor").alias("x"), left.alias("y")
    across = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    across &= ~F.col("y.minor") | (F.col("x.rep") < F.col("y.rep"))
    more = x.join(y, across & may_link("x", "y", bands * rows)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    more = materialize(materialize(more.distinct(), "across-pairs").join(tried, ["a", "b"], "left_anti"), "across")
    if not more.isEmpty():
        links = materialize(links.unionByName(confirm(docs, more, id_col, text_col, "across")), "all-links")
        found = components(links, name="all")

    class_of = attach(members, found.withColumnRenamed("node", "rep"), "rep", "left")
    class_of = class_of.select("id", F.coalesce("component", "rep").alias("component_id")).distinct()
    out = made.select("id", F.col("n").alias("n_shingles")).join(class_of, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes_of_one_id(members: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of an id that comes with several texts."""
    ends = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
    return members.join(ends, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns.

    Where an id comes with several texts, each text is a document of its own, so
    that none is lost with another.
    """
    check = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    lean = docs.select(F.col(id_col).alias("id"), check.alias("check"), F.col(text_col).alias("text"))
    several = lean.filter("id IS NOT NULL").groupBy("id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo < hi")
    if several.isEmpty():
        dropped = near_dedup(lean, "id").filter("not kept").select("id")
        return anti_join_bounded(docs, materialize(dropped.distinct().withColumnRenamed("id", id_col), "dropped"), id_col)
    node = F.when(F.col("id").isNotNull(), F.struct("id", "check")).alias("node")
    dropped = near_dedup(lean.select(node, "text"), "node").filter("not kept").select("node.id", "node.check")
    return without_rows(docs, materialize(dropped.distinct(), "dropped"), id_col, check)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
