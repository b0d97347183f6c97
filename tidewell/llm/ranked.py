"""Ranked search for many items at once over a term-document grid held in K2-treaps.

*Index.* Documents are gathered to blocks inside a task. A block is a grid: one row per
term, one column per document, in each filled cell the term's impact there, an integer.
The grid is a compressed quadtree: of every cell of every level only the filled quarters
exist, a cell's four-bit mask says which, and each holds the largest impact below it (as
the difference to that of the cell above). Rows are ordered by the number of their
documents and columns by length, so that neighbours in a cell have like impacts.

*Search.* All rows of an item's terms descend jointly: a candidate is a range of columns
with, per term, the cell that its row and that range meet in. Its bound is the sum of the
cells' maxima, weighted. Candidates are opened best first, many at a time, until no bound
reaches the k-th best score so far; that score goes on from block to block of a task. So
the result is exact, ties included, and a task sends on ``k`` rows an item.

*Score* (the contract's): weight ``floor(1000 ln((2N + 2) / (2df + 1)))`` times impact
``10**9 tf div (1000 tf + 12 m)``, ``m = 75 + 25 n N div L``, over the item's terms.

Documents are all indexed, with all terms. Items are read in portions of bounded size, so
that what a task is told of them is bounded; each portion is one pass over the index.

Defined results: null texts have no term and are no document; documents with null ids are
ranked after equal scores; repeated rows (documents or items) are ranked each for itself;
items without a term that any document holds give no row; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import materialize, table

#: Bounds of a block: documents, distinct (term, document) pairs.
MOST_DOCS, MOST_PAIRS = 4096, 1 << 20
#: Bytes of item texts told to a task at a time.
MOST_ITEM_BYTES = 2 << 20
#: Candidates opened at a time.
WIDTH = 64
#: Bytes of one text that are split into terms at a time.
SLICE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of terms stay, A-Z lower-cased; all others become spaces.
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _WORD[b] else 0x20 for b in range(256))
POPULATION = np.array([bin(i).count("1") for i in range(16)], np.int64)


def term_counts(text: str) -> Counter:
    """The terms of a whole text with their numbers, a slice at a time."""
    data, found, at = text.encode().translate(FOLD), Counter(), 0
    while len(data) - at > SLICE:
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    found.update(data[at:].split())
    return found


def corpus_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for text in b.column(0):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                is_word = _WORD[data]
                terms = int(np.count_nonzero(is_word[1:] & ~is_word[:-1]) + (len(data) > 0 and is_word[0]))
                n, total = n + (terms > 0), total + terms
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(found[0] or 0), int(found[1] or 0)


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 75 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """Levels from the root down to single cells; ``first`` is the number of a cell's first filled quarter."""

    height: int
    masks: np.ndarray
    first: np.ndarray
    maxima: np.ndarray


def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Cells per level, the masks of all levels but the last, and all maxima less than those above them."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    code = spread(rows) << np.uint64(1) | spread(columns)
    order = np.argsort(code, kind="stable")
    code, top = code[order], impacts[order].astype(np.int64)
    counts, masks, maxima = [len(code)], [], [top]
    for _ in range(height):
        above = code >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), starts))
        over = np.maximum.reduceat(top, starts)
        maxima[-1] = np.repeat(over, np.diff(np.append(starts, len(top)))) - top
        code, top = above[starts], over
        counts.append(len(code))
        maxima.append(top)
    return counts[::-1], np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]).astype(np.uint32)


def load(counts: list[int], masks: np.ndarray, less: np.ndarray) -> Treap:
    held = POPULATION[masks]
    first = 1 + np.concatenate([[0], np.cumsum(held)[:-1]])
    maxima = less.astype(np.int64)
    at = 0
    for here, below in zip(counts, counts[1:]):
        maxima[at + here : at + here + below] = np.repeat(maxima[at : at + here], held[at : at + here]) - maxima[at + here : at + here + below]
        at += here
    return Treap(len(counts) - 1, masks, first, maxima)


def search(treap: Treap, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of all documents that may be among the ``k`` best with a score of at least ``least`` (ties kept)."""
    level, column, cells = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)
    bound = np.full(1, int(treap.maxima[0]) * int(weights.sum()))
    best_columns, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(bound):
        if len(bound) > width:
            order = np.argpartition(-bound, width)
            now, rest = order[:width], order[width:]
        else:
            now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
        at, turn = cells[now], ((rows[None, :] >> (treap.height - 1 - level[now])[:, None]) & 1) << 1
        mask = np.where(at >= 0, treap.masks[at], 0)
        new_level, new_column, new_cells, new_bound = [], [], [], []
        for side in (0, 1):
            quarter = turn | side
            filled = (mask >> quarter) & 1 == 1
            below = np.where(filled, treap.first[at] + POPULATION[mask & ((1 << quarter) - 1)], -1)
            reach = np.where(filled, treap.maxima[below], 0) @ weights
            good = reach >= least
            new_level.append(level[now][good] + 1)
            new_column.append(column[now][good] * 2 + side)
            new_cells.append(below[good])
            new_bound.append(reach[good])
        new_level, new_column, new_cells, new_bound = map(np.concatenate, (new_level, new_column, new_cells, new_bound))
        single = new_level == treap.height
        if single.any():
            best_columns, best = np.append(best_columns, new_column[single]), np.append(best, new_bound[single])
            if len(best) > k:
                least = max(least, int(np.partition(best, len(best) - k)[len(best) - k]))
                best_columns, best = best_columns[best >= least], best[best >= least]
        keep, rest = np.flatnonzero(~single & (new_bound >= least)), rest[bound[rest] >= least]
        level, column = np.append(level[rest], new_level[keep]), np.append(column[rest], new_column[keep])
        cells, bound = np.concatenate([cells[rest], new_cells[keep]]), np.append(bound[rest], new_bound[keep])
    return best_columns, best


class Block:
    """Documents gathered for one grid."""

    def __init__(self):
        self.ids, self.lengths, self.vocabulary = [], [], {}
        self.terms, self.tfs, self.sizes = [], [], []

    def add(self, doc_id: object, counts: Counter) -> None:
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        known = self.vocabulary
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int64, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.sizes.append(len(counts))

    def pairs(self) -> int:
        return sum(self.sizes)

    def row(self, docs: int, total: int) -> dict:
        lengths = np.array(self.lengths, np.int64)
        order = np.argsort(lengths, kind="stable")  # columns by length
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        column = np.repeat(place, self.sizes)
        term, tf = np.concatenate(self.terms), np.concatenate(self.tfs)
        df = np.bincount(term, minlength=len(self.vocabulary))
        by_df = np.argsort(-df, kind="stable")
        row_of = np.empty(len(by_df), np.int64)
        row_of[by_df] = np.arange(len(by_df))
        counts, masks, less = build(row_of[term], column, impact(tf, np.repeat(lengths, self.sizes), docs, total))
        words = list(self.vocabulary)
        packed = pa.Codec("zstd")
        return {
            "ids": [self.ids[i] for i in order], "terms": b" ".join(words[i] for i in by_df), "dfs": df[by_df].astype("<i4").tobytes(),
            "cells": counts, "masks": packed.compress(masks.tobytes(), asbytes=True), "maxima": packed.compress(less.astype("<u4").tobytes(), asbytes=True)
        }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = MOST_DOCS, most_pairs: int = MOST_PAIRS) -> tuple[DataFrame, int]:
    """The written index, one row per block, and the number of documents with a term."""
    n_docs, total = corpus_size(docs, text_col)
    kind = docs.schema[id_col].dataType
    out = T.StructType().add("ids", T.ArrayType(kind))
    for name, of in (("terms", "binary"), ("dfs", "binary"), ("cells", "array<int>"), ("masks", "binary"), ("maxima", "binary")):
        out = out.add(T.StructType.fromDDL(f"{name} {of}").fields[0])
    schema = to_arrow_schema(out)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pairs = Block(), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts = term_counts(text.as_py() or "")
                if counts:
                    block.add(doc_id, counts)
                    pairs += len(counts)
                if len(block.ids) >= most_docs or pairs >= most_pairs:
                    yield pa.RecordBatch.from_pylist([block.row(n_docs, total)], schema)
                    block, pairs = Block(), 0
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(n_docs, total)], schema)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(made, out)
    return materialize(found, "ranked-index"), n_docs


def document_counts(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents the wanted terms stand; the terms are those of one portion of items."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for terms, dfs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term, df in zip(terms.split(b" "), np.frombuffer(dfs, "<i4").tolist()):
                    if term in wanted:
                        found[term] += df
        yield pa.record_batch({"term": pa.array(list(found), pa.binary()), "df": pa.array(list(found.values()), pa.int64())})

    counts = index.select("terms", "dfs").mapInArrow(made, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counts.collect()}


def _opened(row: dict) -> tuple[Treap, list, dict[bytes, int]]:
    counts, codec = row["cells"], pa.Codec("zstd")
    masks = np.frombuffer(codec.decompress(row["masks"], sum(counts[:-1]), asbytes=True), np.uint8)
    less = np.frombuffer(codec.decompress(row["maxima"], 4 * sum(counts), asbytes=True), "<u4")
    return load(counts, masks, less), row["ids"], {t: i for i, t in enumerate(row["terms"].split(b" "))}


def best_of_portion(index: DataFrame, items: list[tuple[object, Counter]], n_docs: int, k: int) -> DataFrame:
    """Rows (portion's item number, id, score): the ``k`` best of each task, each item's weights ready."""
    df = document_counts(index, set().union(*(c for _, c in items)))
    weigh = lambda term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
    weights = [{t: n * weigh(t) for t, n in c.items() if t in df} for _, c in items]
    out = T.StructType().add("item", "long").add("id", index.schema["ids"].dataType.elementType).add("score", "long")
    schema = to_arrow_schema(out)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in weights]
        for b in batches:
            for i in range(b.num_rows):
                treap, ids, row_of = _opened(b.slice(i, 1).to_pylist()[0])
                for item, wanted in enumerate(weights):
                    here = [t for t in wanted if t in row_of]
                    if not here:
                        continue
                    least = max(1, -best[item][-1][0]) if len(best[item]) == k else 1
                    rows, w = np.array([row_of[t] for t in here]), np.array([wanted[t] for t in here], np.int64)
                    columns, scores = search(treap, rows, w, k, least)
                    found = [(-int(s), ids[c] is None, ids[c] if ids[c] is not None else 0) for c, s in zip(columns, scores)]
                    best[item] = sorted(best[item] + found)[:k]
        flat = [(item, None if none else i, -s) for item, found in enumerate(best) for s, none, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], f.type) for c, f in enumerate(schema)], schema=schema)

    return index.mapInArrow(made, out)


def portions(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[object, Counter]]]:
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").toLocalIterator():
        held.append((r["id"], term_counts(r["text"])))
        size += len(r["text"])
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    most_item_bytes: int = MOST_ITEM_BYTES
) -> DataFrame:
    """The ``k`` best documents of each item: (item_col, rank, id_col, score)."""
    index, n_docs = build_index(docs, id_col, text_col)
    out = None
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    for portion in portions(items, item_col, item_text, most_item_bytes):
        names = docs.sparkSession.createDataFrame(
            [(n, i) for n, (i, _) in enumerate(portion)], T.StructType().add("item", "long").add(item_col, items.schema[item_col].dataType)
        )
        found = best_of_portion(index, portion, n_docs, k).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        named = found.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")  # one portion's numbers: bounded
        out = named if out is None else out.unionByName(named)
    if out is None:
        empty = T.StructType().add(item_col, items.schema[item_col].dataType).add("rank", "integer").add(id_col, docs.schema[id_col].dataType).add("score", "long")
        return docs.sparkSession.createDataFrame([], empty)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sized
), tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
    FROM benchmark) GROUP BY ALL
), w AS (
  SELECT item_id, term, times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM i JOIN df USING (term), whole
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term), whole GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""
