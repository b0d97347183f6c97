"""Quality rules: hashed n-gram log-likelihood ratio, target against raw corpus.

Multinomials over hashed n-grams are counted over all documents, for the trusted target
(labelled good and not toxic) and for the whole raw corpus:

* byte n-grams by their occurrences (case is not folded, so that shouting differs from prose);
* words, A-Z folded, once per document, so that a junk text's repetitions don't make a word
  common. A word's ratio counts only where it is decisive: smoothed by as many documents as
  ``SMOOTHING`` and ``SMOOTHING_SHARE`` say, it must differ by ``DECISIVE``; else it is 0. So the
  rare words of a text say nothing, and a common word that the target avoids says much.

A document's score is the mean log ratio of its byte n-grams plus ``WEIGHT`` times the mean
of its distinct words' ratios, so it does not depend on its length; every document is
scored and compared with one fixed threshold. The counts are sums, so tasks can be lost and
repeated; the model that is broadcast has ``BUCKETS + WORDS`` floats, whatever the corpus size.

Base rules that need no model come first (see :func:`base_stats`).

Defined results: null text has no words and no n-grams (score 0, fails the
base rules); repeated rows are scored alike; with an empty target every score
is 0; extra columns are ignored; null ids keep their row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import LOWER, mix, pieces, prefix_hash, same_bytes, segment_sums, span_hash, windows, words
from .shared import rows_within, table

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?|", np.uint8))
U64 = np.uint64

#: n-gram orders in bytes.
ORDERS = (3, 4)
#: Size of the hashed multinomials.
BUCKETS = 1 << 16
#: Weight of the raw corpus in the smoothed target, as a share of the target's n-grams.
PRIOR = 0.02
#: Buckets of the words.
WORDS = 1 << 20
#: Documents that stand for "no evidence" in a word's ratio: so many, and this share of the corpus.
SMOOTHING, SMOOTHING_SHARE = 8.0, 0.0006
#: Word ratios (ln) nearer to 0 than this count as 0.
DECISIVE = 1.2
#: Weight of the words' mean beside that of the byte n-grams.
WEIGHT = 50.0
#: Documents that score less go.
THRESHOLD = -0.6
#: Up to so many target ids are broadcast; beyond, the join is shuffled.
TARGET_BROADCAST = 400_000
#: Words a document needs at least, and the largest share of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50


def grams(buf: np.ndarray, off: np.ndarray, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the n-grams, and where each document's begin."""
    codes = buf.astype(np.uint64)
    for n in orders:
        if len(buf) < n:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        key = np.zeros(len(buf) - n + 1, np.uint64)
        for k in range(n):
            key |= codes[k : len(buf) - n + 1 + k] << U64(8 * k)
        whole = np.zeros(len(buf) + 1, bool)  # n-grams that run into the next document don't count
        for k in range(1, n):
            at = off[1:-1] - k
            whole[at[at >= 0]] = True
        ok = ~whole[: len(key)]
        at = np.concatenate(([0], np.cumsum(ok)))[np.minimum(off, len(key))]
        yield (((key * U64(0x9E3779B97F4A7C15) + U64(n)) * U64(0xD6E8FEB86659FD93) >> U64(40)) & U64(buckets - 1)).astype(np.int64)[ok], at


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words (A-Z folded, without one closing mark) of each document, and where each document's begin."""
    low = LOWER[buf]
    start, end, first = words(low, off)
    end = end - (CLOSING[low[end - 1]] & (end - start > 1))
    key = (span_hash(prefix_hash(low), start, end, low) * U64(0x9E3779B97F4A7C15)) >> U64(64 - WORDS.bit_length() + 1)
    of = np.repeat(np.arange(len(off) - 1), np.diff(first))
    found = np.unique(of * np.int64(WORDS) + key.astype(np.int64))
    return found % WORDS, np.searchsorted(found, np.arange(len(off)) * np.int64(WORDS))


@dataclass
class Model:
    """Log ratios per bucket of the byte n-grams, and of the words."""

    ratios: np.ndarray
    words: np.ndarray


def _marked(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """(text, chosen): whether the id is one of ``ids``; ids are broadcast up to a bound."""
    chosen = ids.select("id", F.lit(True).alias("chosen"))
    if rows_within(chosen, TARGET_BROADCAST):
        chosen = F.broadcast(chosen)
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return lean.join(chosen, "id", how).select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def count_grams(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, raw, target): counts over all documents and over the target.

    Buckets up to BUCKETS are byte n-grams, the next WORDS the documents that hold a word, and
    the last one the documents with a word at all. Tasks add up before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + WORDS + 1), np.int64)
        for part, buf, off in pieces(batches, "text"):
            chosen = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for g, at in grams(buf, off):
                total[0, :BUCKETS] += np.bincount(g, minlength=BUCKETS)
                total[1, :BUCKETS] += np.bincount(g[np.repeat(chosen, np.diff(at))], minlength=BUCKETS)
            w, first = distinct_words(buf, off)
            n = np.diff(first)
            total[0, BUCKETS:-1] += np.bincount(w, minlength=WORDS)
            total[1, BUCKETS:-1] += np.bincount(w[np.repeat(chosen, n)], minlength=WORDS)
            total[:, -1] += [(n > 0).sum(), (chosen & (n > 0)).sum()]
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], ["bucket", "raw", "target"])

    marked = _marked(docs, target_ids, id_col, text_col, "left")
    return marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Ratios of byte n-grams, smoothed in proportion to the raw counts and to the target's size, and of words."""
    raw, target = np.zeros(BUCKETS + WORDS + 1), np.zeros(BUCKETS + WORDS + 1)
    counts = count_grams(docs, target_ids, id_col, text_col).toArrow()  # a row per bucket at most
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    grams_, words_ = slice(None, BUCKETS), slice(BUCKETS, -1)
    if not target[-1]:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(WORDS, np.float32))
    return Model(gram_ratios(raw[grams_], target[grams_]), word_ratios(raw[words_], target[words_], raw[-1], target[-1]))


def gram_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    p = (raw + 1) / (raw.sum() + len(raw))
    prior = PRIOR * target.sum() * p
    q = (target + prior) / (target.sum() + prior.sum())
    return np.log(q / p).astype(np.float32)


def word_ratios(raw: np.ndarray, target: np.ndarray, docs: float, target_docs: float) -> np.ndarray:
    """ln of a word's share of the target's words to its share of all words, both smoothed by the same evidence; 0 where not decisive."""
    more = SMOOTHING + SMOOTHING_SHARE * docs
    less = more * target.sum() / raw.sum()
    r = np.log((target + less) / (target.sum() + less * len(raw))) - np.log((raw + more) / (raw.sum() + more * len(raw)))
    return np.where(np.abs(r) < DECISIVE, 0.0, r).astype(np.float32)


def base_stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per document: words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    n = len(off) - 1
    start, end, first = words(buf, off)
    out = {"n_words": np.diff(first)}
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(lead[end] - lead[start])))
    out["word_chars"] = chars[first[1:]] - chars[first[:-1]]
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[buf])))
    out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]
    prefix = prefix_hash(buf)
    # lines with a word that equal an earlier line of the document
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate((off[:-1], breaks + 1)))
    line_start = line_start[line_start < len(buf)]
    of = np.searchsorted(off, line_start, "right") - 1
    line_end = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)], off[of + 1])
    lines = line_end > line_start
    line_start, line_end = line_start[lines], line_end[lines]
    lines = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[lines], line_end[lines]
    of = np.searchsorted(off, line_start, "right") - 1
    key = mix(span_hash(prefix, line_start, line_end, buf) + of.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    doubt = np.zeros(n, bool)  # documents with equal keys of different bytes
    order, same = _equal_keys(key)
    a, b = order[:-1][same], order[1:][same]
    doubt[of[a[~same_bytes(buf, line_start[a], line_start[b], line_end[a] - line_start[a], line_end[b] - line_start[b])]]] = True
    again = np.zeros(len(key), np.int64)
    again[b] = 1
    out["n_dup_lines"] = np.bincount(of, again, n).astype(np.int64)
    # words inside a 3-word window that is found twice or more
    h = span_hash(prefix, start, end, buf)
    of = np.repeat(np.arange(n), np.diff(first))
    w = windows(h, 3)
    repeated = np.zeros(len(h), np.int64)
    if len(w):
        at = np.flatnonzero(of[2:] == of[:-2])
        order, same = _equal_keys(mix(w + of[:-2].astype(np.uint64) * U64(0x9E3779B97F4A7C15))[at])
        a, b = at[order[:-1][same]], at[order[1:][same]]
        for k in range(3):
            doubt[of[a[~same_bytes(buf, start[a + k], start[b + k], end[a + k] - start[a + k], end[b + k] - start[b + k])]]] = True
            repeated[a + k] = 1
            repeated[b + k] = 1
    out["n_repeat_words"] = np.bincount(of, repeated, n).astype(np.int64)
    for i in np.flatnonzero(doubt):
        out["n_dup_lines"][i], out["n_repeat_words"][i] = _repeats(buf[off[i] : off[i + 1]].tobytes())
    return out


def _equal_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, ties by position, and which neighbours in it are equal."""
    order = np.argsort(key, kind="stable")
    return order, key[order[1:]] == key[order[:-1]]


def _repeats(text: bytes) -> tuple[int, int]:
    """Repeated lines and words in repeated windows of one document, told apart by their bytes."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    found = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, x in enumerate(zip(words, words[1:], words[2:])) if found[x] > 1 for k in range(3)}
    return len(lines) - len(set(lines)), len(inside)


def mean_ratios(ratios: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return segment_sums(ratios.take(keys), at), np.diff(at)


def verdicts(buf: np.ndarray, off: np.ndarray, model: Model, threshold: float) -> dict[str, np.ndarray]:
    """Base statistics, base_failed, kept and llr for the documents of one piece."""
    s = {k: v.astype(np.int64) for k, v in base_stats(buf, off).items()}
    n = len(off) - 1
    total, count = np.zeros(n), np.zeros(n)
    for g, at in grams(buf, off):
        one, many = mean_ratios(model.ratios, g, at)
        total, count = total + one, count + many
    of_words, n_words = mean_ratios(model.words, *distinct_words(buf, off))
    llr = np.round(total / np.maximum(count, 1) + WEIGHT * of_words / np.maximum(n_words, 1), 9)
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED * s["n_words"])
    return s | {"base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr}


def score(docs: DataFrame, fitted: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: base statistics, base_failed, kept, llr (the score)."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in pieces(batches, "text"):
            found = verdicts(buf, off, model.value, threshold)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values())], ["id", *found])

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return lean.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the trusted target: labelled quality 1 and never toxic."""
    rated = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return rated.filter("id IS NOT NULL AND quality = 1 AND toxic = 0").select("id")


def keep_good(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; one pass, no join."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, target_ids, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in pieces(batches, text_col):
            yield part.filter(pa.array(verdicts(buf, off, model.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return score(docs, fit(docs, trusted_ids(labels)))
