"""Order-preserving packing of documents into token windows by dynamic programming.

Documents keep the order of their input partition; each partition is packed on
its own, so there is no shuffle. Cuts are chosen at document ends (free), at
sentence ends (small penalty) or, where a sentence is longer than a window, at
fixed steps (large penalty). The plan minimises padding plus penalties:

    best[j] = cost(j) + min(best[i] + padding(j - i))   over  0 < j - i <= window

Padding is window - (j - i), or nothing where the length is a power of two. The
first case is a sliding-window minimum of best[i] + i, kept in a monotone queue,
the second a few direct look-ups, so the time is linear in the cut points.
What is left at the end of a block goes on to the next one; padding that no choice
avoids occurs once per partition.

Tokens: the words between ASCII white space are encoded once by the tokenizers
library (white space never joins tokens in the vocabulary used), kept from block
to block and from task to task of a worker up to a bound, and put together by array
look-ups.

Defined results: null text is empty and has the end token alone; repeated rows
are packed each; ids of any type, null too, are handed through; an empty table gives
no pieces; extra columns are ignored. A partition is worked off in blocks of
``BLOCK`` bytes or one document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import IS_SPACE, LOWER, give_back, pieces, ragged, text_buffer, words
from .shared import table

WINDOW = 4096
#: Token that closes each document.
END_ID = 2
#: Costs in tokens of padding: any sequence, a cut at a sentence end, a cut elsewhere.
PER_SEQUENCE, AT_SENTENCE, ELSEWHERE = 64, 8, 512
#: Bytes of text worked off at a time.
BLOCK = 4 << 20
#: Words whose ids a task keeps from block to block.
KEPT_WORDS = 800_000
_CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_MARK = "\x01"
#: Words that normaliser and split pattern leave as they are: lower-case Latin-1 letters alone.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Token ids of white-space separated words, exactly as the library gives them."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark, self.kept = self.ids(_MARK), kept
        self._plain_merges()
        self.forget()

    def _plain_merges(self) -> None:
        """The vocabulary's merges without normaliser and split pattern, for words both leave as they are."""
        from tokenizers import Tokenizer, pre_tokenizers

        ending = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.has_plain = bool(ending)
        if not ending:
            return
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for word, k in vocabulary.items() if word.endswith(ending)]] = True
        # the characters that byte-level vocabularies write for bytes
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(k) for k in range(256)]
        for k in range(0xDF, 0x100):
            for byte, shown in zip(chr(k).encode(), bytes_of.pre_tokenize_str(chr(k))[0][0]):
                letters[byte] = shown
        self.letters = "".join(letters)

    @classmethod
    def of_worker(cls, path: str, kept: int = KEPT_WORDS) -> WordEncoder:
        """The encoder of this Python worker, whose words serve its next tasks too."""
        if (path, kept) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path, kept] = cls(path, kept)
        return _ENCODERS[path, kept]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, words: list[str], group: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each word's ids."""
        if len(self.mark) != 1:
            return self.one_by_one(words)
        found, sizes = [], []
        for i in range(0, len(words), group):
            some = words[i : i + group]
            ids = np.array(self.ids(f" {_MARK} ".join([*some, ""])), np.int64)
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(some):  # a word holds the mark itself
                ids, offsets = self.one_by_one(some)
                size = np.diff(offsets)
            else:
                size = np.diff(at, prepend=-1) - 1
                ids = np.delete(ids, at)
            found.append(ids)
            sizes.append(size)
        return self._joined(found, sizes)

    def encode_plain(self, words: list[str], group: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case letters (see ``PLAIN``).

        Normalising and splitting leave such a word whole, so the vocabulary's
        merges alone decide. The last id of a word is one that closes a word.
        """
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(words), group):
            text = " ".join(words[i : i + group])
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            found.append(np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64))
        ids = np.concatenate(found)
        return ids, np.concatenate(([0], np.flatnonzero(self.closes[ids]) + 1))

    def lookup(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of these distinct words where its ids start and how many they are.

        Words are kept from block to block; beyond ``kept`` the store starts anew.
        """
        if len(self.known) > self.kept:
            self.forget()
        at = pc.index_in(some, value_set=self.known)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if len(missing):
            new = some.take(pa.array(missing))
            plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False) & self.has_plain
            for mask, encode in ((plain, self.encode_plain), (~plain, self.encode)):
                words = new.filter(pa.array(mask))
                ids, offsets = encode(words.to_pylist())
                at[missing[mask]] = len(self.known) + np.arange(len(words))
                self.start = np.concatenate((self.start, (offsets[:-1] + len(self.store)).astype(np.int32)))
                self.size = np.concatenate((self.size, np.diff(offsets).astype(np.int32)))
                self.store = np.concatenate((self.store, ids.astype(np.int32)))
                self.known = pa.concat_arrays([self.known, words])
        return self.store, self.start[at], self.size[at]

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.store = self.start = self.size = np.zeros(0, np.int32)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(self.ids(w), np.int64) for w in words]
        return self._joined(found, [np.array([len(x) for x in found], np.int64)])

    @staticmethod
    def _joined(found: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(found) if found else np.zeros(0, np.int64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return ids, np.concatenate(([0], np.cumsum(size)))


def _parts(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts that are tokenised apart, and the first part of each document.

    Words between ASCII white space; a single closing mark after a letter is a
    part of its own, as the vocabulary's pattern cuts there too. A-Z are folded,
    which the vocabulary does itself, but not where a special token may stand.
    """
    low = LOWER[buf]
    if (at := np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))).size:
        for k in np.unique(np.searchsorted(off, at, "right") - 1):
            low[off[k] : off[k + 1]] = buf[off[k] : off[k + 1]]
    start, end, _ = words(low, off)
    size = end - start
    last = np.maximum(end - 1, 0)
    before, ahead = low[np.maximum(last - 1, 0)], low[np.maximum(last - 2, 0)]
    letter = (before >= 0x61) & (before <= 0x7A)
    letter |= (size > 2) & (ahead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut = np.flatnonzero(_CLOSING[low[last]] & letter & (size > 1)) if len(start) else np.zeros(0, np.int64)
    inner = last[cut]
    start, end = np.insert(start, cut + 1, inner), np.insert(end, cut, inner)
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    data = low[~IS_SPACE[low]]
    return pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    ), np.searchsorted(start, off)


def tokens(buf: np.ndarray, off: np.ndarray, encoder: WordEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all documents, offsets of the documents, and positions after sentences."""
    parts, first = _parts(buf, off)
    coded = parts.dictionary_encode()
    ids, start, size = encoder.lookup(coded.dictionary)
    ends = pc.match_substring_regex(coded.dictionary, r"[.!?][\"')\]]*$").to_numpy(zero_copy_only=False)
    # the closing token is one more entry behind the known ones
    ids, start, size, ends = np.append(ids, END_ID), np.append(start, len(ids)), np.append(size, 1), np.append(ends, False)
    word = np.insert(coded.indices.to_numpy(zero_copy_only=False), first[1:], len(start) - 1)
    size = size[word]
    after = np.cumsum(size, dtype=np.int64)
    stream = ids[ragged(start[word], size)].astype(np.uint32)
    offsets = np.concatenate(([0], after[first[1:] + np.arange(len(off) - 1)]))
    return stream, offsets, after[ends[word]]


def plan(points: np.ndarray, cost: np.ndarray, window: int = WINDOW, free_end: bool = False) -> np.ndarray:
    """Cut points that minimise padding plus cost; ``points`` start at 0, ascending.

    With ``free_end`` the plan may stop anywhere in the last window; else it ends
    at the last point.
    """
    n = len(points)
    # earlier points at a power of two before a point, in the order of the points
    hits, sources = [], []
    for size in (1 << k for k in range(6, window.bit_length() - 1) if 1 << k < window):
        k = np.searchsorted(points, points - size)
        hit = np.flatnonzero(points[np.minimum(k, n - 1)] == points - size)
        hits.append(hit)
        sources.append(k[hit])
    hit = np.concatenate([*hits, [n]]).astype(np.int64)
    order = np.argsort(hit, kind="stable")
    source = np.concatenate([*sources, [0]]).astype(np.int64)[order].tolist()
    hit = hit[order].tolist()
    p, c = points.tolist(), (cost + PER_SEQUENCE).tolist()
    best, back, ahead = [0.0] * n, [0] * n, [0.0] * n  # ahead: best plus position, the key of the queue
    queue, h, following = deque([0]), 0, hit[0]
    for j in range(1, n):
        at = p[j]
        reach = at - window
        while p[queue[0]] < reach:
            queue.popleft()
        i = queue[0]
        low = ahead[i] - reach
        while following == j:
            k = source[h]
            if best[k] < low:
                i, low = k, best[k]
            h += 1
            following = hit[h]
        low += c[j]
        best[j], back[j] = low, i
        low += at
        while queue and ahead[queue[-1]] >= low:
            queue.pop()
        ahead[j] = low
        queue.append(j)
    j = n - 1
    if free_end:
        j = min(range(int(np.searchsorted(points, points[-1] - window, "right")), n), key=lambda k: (best[k] - p[k] / window * PER_SEQUENCE, -k))
    cuts = []
    while j:
        cuts.append(p[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def cut_points(offsets: np.ndarray, sentences: np.ndarray, end: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may be, and their penalties; no gap is wider than a window."""
    points = np.unique(np.concatenate(([0, end], offsets, sentences)))
    gaps = np.flatnonzero(np.diff(points) > window // 4)
    step = window // 8
    extra = [np.arange(points[g] + step, points[g + 1], step) for g in gaps]
    points = np.unique(np.concatenate((points, *extra)))
    cost = np.full(len(points), float(ELSEWHERE))
    cost[np.searchsorted(points, sentences)] = AT_SENTENCE
    cost[np.searchsorted(points, offsets)] = 0
    cost[-1] = 0
    return points, cost


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK,
    kept_words: int = KEPT_WORDS
) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer_path, kept_words)
        sequence = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        carry = None
        size = 0

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, carry
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                ids = t.column(0).combine_chunks()
                stream, off, sentences = tokens(*text_buffer(t.column(1)), encoder)
            else:
                ids, stream, off, sentences = None, np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)
            held.clear()
            before, whole = np.zeros(len(off) - 1, np.int64), np.diff(off)
            if carry is not None:
                c_ids, c_stream, c_off, c_sentences, c_before, c_whole = carry
                ids = pa.concat_arrays([c_ids, ids]) if ids is not None else c_ids
                sentences = np.concatenate((c_sentences, sentences + len(c_stream)))
                off = np.concatenate((c_off, off[1:] + len(c_stream)))
                stream = np.concatenate((c_stream, stream))
                before, whole = np.concatenate((c_before, before)), np.concatenate((c_whole, whole))
                carry = None
            if not len(stream):
                return
            points, cost = cut_points(off, sentences, len(stream), window)
            cuts = plan(points, cost, window, free_end=not last)
            done = int(cuts[-1]) if len(cuts) else 0
            edges = np.unique(np.concatenate(([0], cuts, off[off <= done])))
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(off, a, "right") - 1
            seq = np.searchsorted(cuts, a, "right")
            first = np.concatenate(([0], cuts))[seq]
            crc = [zlib.crc32(stream[x:y]) for x, y in zip(a.tolist(), b.tolist())]
            out = [
                ids.take(pa.array(doc)), pa.array(before[doc] + a - off[doc]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(whole[doc]),
                pa.array(sequence + seq), pa.array(a - first)
            ]
            yield pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += len(cuts)
            if done < len(stream):
                k = int(np.searchsorted(off, done, "right") - 1)
                rest = np.maximum(off[k:] - done, 0)
                used = np.zeros(len(rest) - 1, np.int64)
                used[0] = done - off[k]
                carry = (ids.slice(k), stream[done:], rest, sentences[sentences > done] - done, before[k:] + used, whole[k:])

        for part, _, off in pieces(batches, "text", block_bytes):
            held.append(part)
            size += int(off[-1])
            if size >= block_bytes:
                yield from work(False)
                size = 0
        yield from work(True)
        give_back()

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return lean.mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
