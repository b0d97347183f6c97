"""Repeated passages by prefix-free parsing, in the sort order of the corpus.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller id. All rows and whole texts take part.

Parsing. A rolling hash over ``GRAM`` bytes sets the triggers: the trigger of a
``LENGTH``-byte string is its smallest gram (leftmost on ties), so it depends on
that string alone. Neighbouring start positions with the same trigger form a
phrase, whose text reaches ``LENGTH - 1`` bytes beyond the last start. Each
start position therefore lies in exactly one phrase, and the phrase holds its
whole string: repetitions are found among the distinct phrases (the
dictionary), and the parse only says where a phrase occurs.

1. Each task parses its texts and deals (trigger, phrase, document) to buckets
   by trigger. A bucket sorts them. Of equal phrases, all but that of the
   smallest document are repeated as a whole: most copies end here.
2. Different phrases with the same trigger may share some strings. Only those
   dictionary phrases are fetched, each once, from its smallest document. Their
   suffixes are sorted (a suffix array to depth ``LENGTH``); neighbours with a
   common prefix of ``LENGTH`` bytes are the repeated strings.
3. Both kinds of findings go back to the documents, which are parsed again to
   turn phrases into byte spans.

A phrase that many documents of one task hold (a licence line in a third of the
corpus) comes to its bucket once per task, with the smallest of those documents; the
list of them waits in a bucket of the task, which gets the phrase's smallest document
as an answer (step 1b). So no bucket grows with the documents that share a passage.

What is moved are few large binary rows. The number of buckets follows from the
bytes of the corpus, so that a bucket stays at about ``BUCKET_BYTES``; texts travel
compressed.

Defined results: null text is empty and has nothing to remove; documents with
the same id (repeated rows) don't remove each other's text; rows with a null id
count as one last document; texts shorter than ``LENGTH`` stay; other columns pass
through unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import give_back, mix, powers, prefix_hash, ragged, span_hash, text_buffer
from .shared import materialize, table

U64 = np.uint64
LENGTH = 50
GRAM = 16
#: Bytes of text per bucket, and the fewest buckets.
BUCKET_BYTES, FEWEST = 4 << 20, 64
#: Bytes parsed at a time (or one document), and texts gathered before dealing.
PIECE, GATHER = 1 << 19, 16 << 20
#: Bytes of one long document parsed at a time; positions have to fit ``_PLACE``.
SLICE = 4 << 20
#: Phrases held before they are dealt, and the documents among them from which a phrase is dealt once for all.
HELD, SHARED = 1_000_000, 64
_PLACE = U64((1 << 28) - 1)
_CODEC = pa.Codec("zstd", compression_level=1)
LAST_ID = np.iinfo(np.int64).max


def parse(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases as (first start, last start, phrase hash, trigger hash).

    A document longer than ``SLICE`` bytes is parsed in slices, so that memory does not
    follow its length. A phrase on the edge of two slices comes in two parts; they
    have its trigger, so what they share with the whole phrase is found like any
    other partial overlap.
    """
    if len(off) != 2 or len(buf) <= SLICE:
        return _parse(buf, off)
    parts = []
    for a in range(0, len(buf) - LENGTH + 1, SLICE):
        own = buf[a : a + SLICE + LENGTH - 1]
        start, end, phrase, trigger = _parse(own, np.array([0, len(own)]))
        parts.append((start + a, end + a, phrase, trigger))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _parse(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    prefix = prefix_hash(buf)
    g = (prefix[GRAM:] - prefix[:-GRAM]) * powers(len(buf) + 1)[1][: len(buf) - GRAM + 1]
    g ^= g >> U64(29)
    g *= U64(0x94D049BB133111EB)
    g ^= g >> U64(32)
    low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    width, step = LENGTH - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    at = (low & _PLACE).astype(np.int64)
    inside = np.ones(n, bool)
    for o in off[1:-1]:
        inside[max(0, o - LENGTH + 1) : o] = False
    turn = at[1:] != at[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= turn | ~inside[:-1]
    last[:-1] &= turn | ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, span_hash(prefix, start, end + LENGTH), g[at[start]]


def _cut(off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j
        i = j


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % U64(buckets)).astype(np.int64)


def _dump(**arrays: np.ndarray | pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], list(arrays))
    return _pack(batch)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _load(blobs: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs.to_pylist()])


def _column(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return t.column(name).to_numpy().astype(kind, copy=False)


def _deal(to: np.ndarray, kind: int, make) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, blob): one blob for the records of each bucket, in their order."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        pick = order[a:b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(to[pick[0]])], pa.int32()), pa.array([kind], pa.int32()), pa.array([make(pick)], pa.binary())], ["bucket", "kind", "blob"]
        )


_ROW = "bucket int, kind int, blob binary"
_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_TEXT, _WHOLE, _FETCH, _PART, _WAITING, _ASKED, _ANSWER, _RECORDS = range(8)


def _rows(parts: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(parts), _ROW_SCHEMA)


def _of_kind(t: pa.Table, kind: int) -> pa.ChunkedArray:
    return t.filter(pc.equal(t.column("kind"), kind)).column("blob")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove repeated passages (see the module).

    ``keep_rows=False``: per document id, n_bytes, n_removed, n_spans, kept_sha256.
    ``keep_rows=True``: the rows of ``docs`` with the passages taken out of the text;
    where a span ends inside a character, that whole character goes too.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(FEWEST, -(-total // bucket_bytes))

    def bucket_of(trigger: np.ndarray) -> np.ndarray:
        return (trigger >> U64(32)).astype(np.int64) % buckets

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        lists = itertools.count(TaskContext.get().partitionId() << 24)

        def deal_shared(doc: np.ndarray, phrase: np.ndarray, trigger: np.ndarray) -> Generator[pa.RecordBatch, None, np.ndarray]:
            """Deal phrases of many documents once, their documents as a waiting list; returns which records remain."""
            order = np.lexsort((doc, phrase))
            d, p = doc[order], phrase[order]
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            fresh = new.copy()
            fresh[1:] |= d[1:] != d[:-1]
            heads = np.flatnonzero(new)
            many = np.add.reduceat(fresh.astype(np.int64), heads) >= SHARED
            inside = np.repeat(many, np.diff(np.append(heads, len(p))))
            keep = np.ones(len(p), bool)
            if many.any():
                keep[order[inside]] = False
                every, least = order[inside & fresh], order[heads[many]]
                number = np.int64(next(lists))
                home = _home(np.array([number]), buckets)[0]
                listed = _dump(number=np.full(len(every), number), phrase=phrase[every], doc=doc[every])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(home)], pa.int32()), pa.array([_WAITING], pa.int32()), pa.array([listed], pa.binary())], ["bucket", "kind", "blob"]
                )
                asked = lambda pick: _dump(number=np.full(len(pick), number), trigger=(trigger[least[pick]]).astype(np.uint32), phrase=phrase[least[pick]], doc=doc[least[pick]])
                yield from _deal(bucket_of(trigger[least]), _ASKED, asked)
            return keep

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, phrase, trigger = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keep = yield from deal_shared(doc, phrase, trigger)
            if not keep.any():
                return
            doc, phrase, trigger = doc[keep], phrase[keep], trigger[keep]

            def blob(pick: np.ndarray) -> bytes:
                d = doc[pick]
                step = np.diff(d, prepend=d[:1])
                kind = np.min_scalar_type(int(np.abs(step).max())) if d.max() < 1 << 62 else np.dtype(np.int64)
                step = step.astype({1: np.int16, 2: np.int32}.get(kind.itemsize, np.int64))
                return np.array(
                    [len(pick), d[0], step.itemsize], np.int64
                ).tobytes() + trigger[pick].astype(np.uint32).tobytes() + phrase[pick].tobytes() + step.tobytes()

            yield from _deal(bucket_of(trigger), _RECORDS, blob)

        count = 0
        give_back()
        for batch in batches:
            ids, (buf, off) = _ids(batch.column(0)), text_buffer(batch.column(1))
            for i, j in _cut(off, PIECE):
                start, _, phrase, trigger = parse(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                held.append((ids[np.searchsorted(off, start + off[i], "right") - 1], phrase, trigger))
                count += len(start)
                if count > HELD:
                    yield from flush()
                    count = 0
        yield from flush()

    def sort_phrases(t: pa.Table) -> pa.Table:
        give_back()
        out = t.filter(pc.equal(t.column("kind"), _WAITING)).to_batches()  # lists wait here for their answers
        found = []
        for b in _of_kind(t, _RECORDS).to_pylist():
            n, base, size = np.frombuffer(b, np.int64, 3)
            trigger, phrase = np.frombuffer(b, np.uint32, n, 24), np.frombuffer(b, np.uint64, n, 24 + 4 * n)
            found.append((trigger, phrase, base + np.cumsum(np.frombuffer(b, f"i{size}", n, 24 + 12 * n).astype(np.int64))))
        asked = _of_kind(t, _ASKED)
        asked = _load(asked) if len(asked) else None
        if asked is not None:
            found.append((_column(asked, "trigger", np.uint32), _column(asked, "phrase", np.uint64), _column(asked, "doc", np.int64)))
        if not found:
            return _rows(iter(out))
        trigger, phrase, doc = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, phrase, trigger))
        trigger, phrase, doc = trigger[order], phrase[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
        heads = np.flatnonzero(new)
        least = doc[heads]
        if asked is not None:
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            number, own = _column(asked, "number", np.int64), place[len(order) - len(asked) :]
            answer = lambda pick: _dump(number=number[pick], phrase=phrase[heads[own[pick]]], least=least[own[pick]])
            out += _deal(_home(number, buckets), _ANSWER, answer)
        whole = doc != least[np.cumsum(new) - 1]
        whole[1:] &= new[1:] | (doc[1:] != doc[:-1])  # one finding for a document
        edge = np.flatnonzero(np.diff(trigger[heads].astype(np.int64), prepend=-1))
        sizes = np.diff(np.append(edge, len(heads)))
        several = np.repeat(np.minimum.reduceat(least, edge) != np.maximum.reduceat(least, edge), sizes)
        d = np.concatenate((doc[whole], least[several]))
        p = np.concatenate((phrase[whole], phrase[heads][several]))
        fetch = np.repeat([False, True], [whole.sum(), several.sum()])
        for kind, mask in ((_WHOLE, ~fetch), (_FETCH, fetch)):
            dk, pk = d[mask], p[mask]
            out += _deal(_home(dk, buckets), kind, lambda pick, dk=dk, pk=pk: _dump(doc=dk[pick], phrase=pk[pick]))
        return _rows(out)

    def release(t: pa.Table) -> pa.Table:
        """Answers for waiting lists: all documents but the smallest have the phrase from another."""
        answers = _of_kind(t, _ANSWER)
        if not len(answers):
            return _rows(iter(()))
        a, w = _load(answers), _load(_of_kind(t, _WAITING))
        key = mix(_column(a, "number", np.int64).view(np.uint64)) ^ _column(a, "phrase", np.uint64)
        order = np.argsort(key)
        doc, phrase = _column(w, "doc", np.int64), _column(w, "phrase", np.uint64)
        at = order[np.searchsorted(key, mix(_column(w, "number", np.int64).view(np.uint64)) ^ phrase, sorter=order)]
        gone = doc != _column(a, "least", np.int64)[at]
        doc, phrase = doc[gone], phrase[gone]
        return _rows(_deal(_home(doc, buckets), _WHOLE, lambda pick: _dump(doc=doc[pick], phrase=phrase[pick])))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        give_back()
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > GATHER:
                yield from deal_texts(held)
                held = []
        if held:
            yield from deal_texts(held)

    def deal_texts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        home = _home(_ids(t.column(id_col).combine_chunks()), buckets)
        return _deal(home, _TEXT, lambda pick: _pack(t.take(pa.array(pick)).combine_chunks().to_batches()[0]))

    def texts_of(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        blobs = _of_kind(t, _TEXT)
        if not len(blobs):
            return
        rows = _load(blobs).combine_chunks()
        ids, (buf, off) = _ids(rows.column(id_col).combine_chunks()), text_buffer(rows.column(text_col))
        for i, j in _cut(off, PIECE):
            yield rows.slice(i, j - i), ids[i:j], buf[off[i] : off[j]], off[i : j + 1] - off[i]

    def fetch_phrases(t: pa.Table) -> pa.Table:
        give_back()
        wanted = _of_kind(t, _FETCH)
        if not len(wanted):
            return _rows(iter(()))
        w = _load(wanted)
        keys = np.unique(mix(_column(w, "doc", np.int64).view(np.uint64)) ^ _column(w, "phrase", np.uint64))
        out = []
        for _, ids, buf, off in texts_of(t):
            start, end, phrase, trigger = parse(buf, off)
            doc = ids[np.searchsorted(off, start, "right") - 1]
            key = mix(doc.view(np.uint64)) ^ phrase
            first = np.zeros(len(key), bool)
            first[np.unique(key, return_index=True)[1]] = True
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at = np.flatnonzero(first & (keys[found] == key))
            size = end[at] - start[at] + LENGTH
            out.append((doc[at], phrase[at], trigger[at], size, buf[ragged(start[at], size)]))
        if not out:
            return _rows(iter(()))
        doc, phrase, trigger, size, text = (np.concatenate(x) for x in zip(*out))
        begin = np.cumsum(size) - size

        def blob(pick: np.ndarray) -> bytes:
            cuts = np.concatenate(([0], np.cumsum(size[pick]))).astype(np.int32)
            own = text[ragged(begin[pick], size[pick])].tobytes()
            return _dump(
                doc=doc[pick], phrase=phrase[pick],
                text=pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(own)])
            )

        return _rows(_deal((trigger >> U64(32)).astype(np.int64) % buckets, 0, blob))

    def sort_suffixes(t: pa.Table) -> pa.Table:
        give_back()
        d = _load(t.column("blob"))
        doc, phrase = _column(d, "doc", np.int64), _column(d, "phrase", np.uint64)
        buf, off = text_buffer(d.column("text").cast(pa.large_binary()).combine_chunks())
        count = np.diff(off) - LENGTH + 1
        at, entry = ragged(off[:-1], count), np.repeat(np.arange(len(doc)), count)
        # strings met once need no sorting
        key = span_hash(prefix_hash(buf), at, at + LENGTH)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at, entry = at[twice], entry[twice]
        if not len(at):
            return _rows(iter(()))
        padded = np.concatenate((buf, np.zeros(8, np.uint8)))
        big = np.lib.stride_tricks.sliding_window_view(padded, 8)
        columns = [np.ascontiguousarray(big[at + k]).view(">u8").reshape(-1).astype(np.uint64) for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]]
        order = np.lexsort((doc[entry], *columns[::-1]))
        at, entry = at[order], entry[order]
        new = np.zeros(len(at), bool)
        new[0] = True
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        covered = doc[entry] != doc[entry[np.flatnonzero(new)]][np.cumsum(new) - 1]
        entry, place = entry[covered], (at - off[entry])[covered]
        order = np.lexsort((place, entry))
        entry, place = entry[order], place[order]
        head = np.ones(len(entry), bool)
        head[1:] = (entry[1:] != entry[:-1]) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(entry)) - 1
        e, lo, hi = entry[heads], place[heads].astype(np.int16), place[tails[: len(heads)]].astype(np.int16)
        return _rows(_deal(_home(doc[e], buckets), _PART, lambda pick: _dump(doc=doc[e[pick]], phrase=phrase[e[pick]], lo=lo[pick], hi=hi[pick])))

    def covered_bytes(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of documents with their bytes and the mask of what goes."""
        whole, part = _of_kind(t, _WHOLE), _of_kind(t, _PART)
        keys, lo, hi = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(whole):
            w = _load(whole)
            keys = mix(_column(w, "doc", np.int64).view(np.uint64)) ^ _column(w, "phrase", np.uint64)
            lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), LENGTH, np.int64)
        if len(part):
            p = _load(part)
            keys = np.concatenate((keys, mix(_column(p, "doc", np.int64).view(np.uint64)) ^ _column(p, "phrase", np.uint64)))
            lo, hi = np.concatenate((lo, _column(p, "lo", np.int64))), np.concatenate((hi, _column(p, "hi", np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, lo, hi = keys[order], lo[order], hi[order]
        for rows, ids, buf, off in texts_of(t):
            gone = np.zeros(len(buf), bool)
            if len(keys):
                start, end, phrase, _ = parse(buf, off)
                doc = ids[np.searchsorted(off, start, "right") - 1]
                key = mix(doc.view(np.uint64)) ^ phrase
                a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                hit = ragged(a, b - a)
                of = np.repeat(np.arange(len(key)), b - a)
                change = np.zeros(len(buf) + 1, np.int32)
                np.add.at(change, start[of] + lo[hit], 1)
                np.add.at(change, np.minimum(start[of] + hi[hit], end[of]) + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
            yield rows, buf, off, gone

    def digest_rows(t: pa.Table) -> pa.Table:
        give_back()
        out = []
        for rows, buf, off, gone in covered_bytes(t):
            head = gone.copy()
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            head[1:] &= ~gone[:-1] | edge[1:-1]
            removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, head))
            sha = [hashlib.sha256((buf[a:b][~gone[a:b]] if removed[b] > removed[a] else buf[a:b]).tobytes()).hexdigest() for a, b in zip(off[:-1], off[1:])]
            out.append(pa.Table.from_arrays([
                rows.column(id_col), pa.array(np.diff(off)), pa.array(removed[off[1:]] - removed[off[:-1]]),
                pa.array(spans[off[1:]] - spans[off[:-1]]), pa.array(sha)
            ], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]))
        return pa.concat_tables(out) if out else digest_schema.empty_table()

    def edited_rows(t: pa.Table) -> pa.Table:
        give_back()
        out = []
        for rows, buf, off, gone in covered_bytes(t):
            lead = (buf & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            if gone.any():
                gone = (np.bincount(char[gone], minlength=int(char[-1]) + 1) > 0)[char]
            kept = np.concatenate(([0], np.cumsum(~gone)))[off].astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(buf[~gone].tobytes())])
            k = rows.schema.get_field_index(text_col)
            nulls = rows.column(k).is_null().combine_chunks()
            text = pc.if_else(nulls, pa.scalar(None, pa.large_string()), text).cast(rows.schema.field(k).type)
            out.append(rows.set_column(k, rows.schema.field(k), text))
        return pa.concat_tables(out) if out else row_schema.empty_table()

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    row_schema = to_arrow_schema(docs.schema)
    digest_schema = pa.schema([
        (id_col, to_arrow_type(docs.schema[id_col].dataType)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string())
    ])
    lean = docs.select(id_col, text_col)
    found = lean.mapInArrow(phrases, _ROW).groupBy("bucket").applyInArrow(sort_phrases, _ROW)
    found = materialize(found, "phrases")
    whole = found.filter(F.col("kind") == _WHOLE)
    if not found.filter(F.col("kind") == _ANSWER).isEmpty():
        listed = found.filter(F.col("kind").isin(_WAITING, _ANSWER)).groupBy("bucket").applyInArrow(release, _ROW)
        whole = whole.unionByName(materialize(listed, "released"))
    fetched = lean.mapInArrow(gather, _ROW).unionByName(found.filter(F.col("kind") == _FETCH)).groupBy("bucket").applyInArrow(fetch_phrases, _ROW)
    parts = materialize(fetched.groupBy("bucket").applyInArrow(sort_suffixes, _ROW), "suffixes")
    last = (docs if keep_rows else lean).mapInArrow(gather, _ROW).unionByName(whole).unionByName(parts).groupBy("bucket")
    if keep_rows:
        return last.applyInArrow(edited_rows, docs.schema)
    return last.applyInArrow(
        digest_rows, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
