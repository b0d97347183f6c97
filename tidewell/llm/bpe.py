"""Byte-level BPE by backtracking over longest matches; decoding by an offset table.

The merges of the vocabulary file give, for each token, its two parts, and, for
each pair of tokens, what they merge into. A sequence of tokens is what the merge
rules produce exactly if every neighbouring pair is: then no merge, at any point of
the merging, would have crossed the border. So the encoder walks through a piece
and takes the longest token that an Aho-Corasick automaton finds at its place; if the
pair with the token before is not allowed it tries the next shorter token, and if
none is left it takes back the token before. Places that failed are marked, so each
is left at most once per token length and time stays linear in the text.

Texts are cut where a non-space is followed by white space, which is always a
border of the vocabulary's pattern. Equal parts are encoded once per task (up to a
bound); ids, their decimal form and decoded bytes are put together by array look-ups.

Defined results: null text is empty; special tokens in a text become their ids, as
the library does by default; repeated rows are encoded each; an empty table gives
an empty result; extra columns are ignored; ids of any type are handed through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import IS_SPACE, pieces, ragged
from .shared import table

#: The pattern that cuts text into pieces before merging, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 2 << 20
#: Parts whose ids a task keeps from block to block.
KEPT_PARTS = 600_000
_CLOSING = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Token pairs whose compatibility a task remembers; beyond, the table starts anew.
PAIRS = 500_000


class Codec:
    """Encoder and decoder of one vocabulary file; made once per task."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.letters = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        words = [b""] * size
        for word, i in ids.items():
            words[i] = bytes(back[c] for c in word)
        for word, i in self.special.items():
            words[i] = word.encode()
        #: decoding: the bytes of token i lie at offset[i]:offset[i + 1]
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        self.length = np.array([len(w) for w in words], np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[a], ids[b]), ids.get(a + b)
            if whole is not None and pair not in self.rank:
                self.rank[pair], self.made[pair] = rank, whole
                self.parts.setdefault(whole, pair)
        self.born = {i: self.rank[p] for i, p in self.parts.items()}
        self.allowed: dict[tuple[int, int], bool] = {}
        self.automaton, self.reached = ahocorasick.Automaton(), {}
        for word, i in ids.items():
            if len(word) == 1 or i in self.parts:
                self.automaton.add_word(word, (len(word), i))
                self.reached[word] = i
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave a border between two tokens.

        The merges at the border happen in the order of their ranks. Going back
        in time, the side whose last merge came later is taken apart; if at some
        moment both border tokens have a merge that comes before the later of the
        two next merges, that merge would have crossed the border.
        """
        known = self.allowed.get((left, right))
        if known is not None:
            return known
        born, parts, a, b = self.born, self.parts, left, right
        # until which rank the present border tokens last
        until = len(self.rank) + 1
        out = True
        while True:
            r = self.rank.get((a, b))
            ra, rb = born.get(a, -1), born.get(b, -1)
            if r is not None and r < until:
                out = False
                break
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until, a = ra, parts[a][1]
            else:
                # of equal merges the left one comes first, so one of the same rank counts as before
                until, b = rb + 1, parts[b][0]
        if len(self.allowed) >= PAIRS:
            self.allowed.clear()
        self.allowed[left, right] = out
        return out

    def merge(self, word: str) -> list[int]:
        """Token ids of one piece, written in the vocabulary's letters."""
        n = len(word)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(word):  # by rising end, so by rising size at each place
            at[end - size + 1].append((size, i))
        blocked = [False] * (n + 1)
        tokens: list[int] = []
        choices: list[int] = []  # the next shorter choice at each place taken
        place, choice = 0, len(at[0]) - 1
        while place < n:
            taken = False
            while choice >= 0:
                size, i = at[place][choice]
                choice -= 1
                if not blocked[place + size] and (not tokens or self.compatible(tokens[-1], i)):
                    tokens.append(i)
                    choices.append(choice)
                    place += size
                    taken = True
                    break
            if taken:
                choice = len(at[place]) - 1 if place < n else -1
            else:
                blocked[place] = True
                place -= int(self.length[tokens.pop()])
                choice = choices.pop()
        return tokens

    def encode(self, text: str) -> list[int]:
        if self.split_special is not None and any(s in text for s in self.special):
            out: list[int] = []
            for k, part in enumerate(self.split_special.split(text)):
                if k % 2:
                    out.append(self.special[part])
                elif part:
                    out += self.encode_plain(part)
            return out
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        letters = self.letters
        if text.removeprefix(" ").isalpha():
            pieces = [text]  # letters alone are one piece
        else:
            pieces = self.pattern.findall(text)
        out = []
        for piece in pieces:
            word = "".join([letters[b] for b in piece.encode()])
            if (i := self.reached.get(word)) is not None:
                out.append(i)  # the longest match is the whole piece
            else:
                out += self.merge(word)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a stream of ids."""
        return self.data[ragged(self.offset[ids], self.length[ids])]


def parts_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the parts of each document that can be encoded apart.

    A part starts where white space follows a byte that surely is no white
    space: printable ASCII or the end of a two-byte letter. A closing mark between
    a letter and white space is a part too: letters and marks never share a piece.
    """
    start = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        space = IS_SPACE[buf]
        letter = (buf | 0x20 >= 0x61) & (buf | 0x20 <= 0x7A)
        two = np.zeros(len(buf), bool)
        two[1:] = (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
        start[1:-1] = space[1:] & ((buf > 0x20) & (buf < 0x7F) | two)[:-1]
        latin = two.copy()
        latin[1:] &= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        start[1:-2] |= _CLOSING[buf[1:-1]] & (letter | latin)[:-2] & space[2:]
    start[off] = True
    return np.flatnonzero(start)


class PartStore:
    """Ids of parts met so far in a task; beyond ``KEPT_PARTS`` it starts anew."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = self.start = self.size = np.zeros(0, np.int64)

    def lookup(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids (in ``self.ids``) of each of these distinct parts."""
        if len(self.known) > KEPT_PARTS:
            self.forget()
        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(at.is_null())
        if len(new):
            made = [self.codec.encode(w) for w in new.to_pylist()]
            size = np.array([len(x) for x in made], np.int64)
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, np.array([i for x in made for i in x], np.int64)))
            self.known = pa.concat_arrays([self.known, new])
            at = pc.index_in(parts, value_set=self.known)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.start[at], self.size[at]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer_path)
        store = PartStore(codec)
        decimal = [f"{i},".encode() for i in range(len(codec.length))]
        digits = np.frombuffer(b"".join(decimal), np.uint8)
        digits_n = np.array([len(x) for x in decimal], np.int64)
        digits_at = np.cumsum(digits_n) - digits_n
        special = [s.encode() for s in codec.special]
        for part, buf, off in pieces(batches, "text", BLOCK):
            raw = buf.tobytes()
            # a special token may hold a space: then documents are not cut
            cuts = np.unique(off) if any(s in raw for s in special) else parts_of(buf, off)
            offsets = np.append(cuts[cuts < len(buf)], len(buf)).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
            start, size = store.lookup(coded.dictionary)
            word = coded.indices.to_numpy(zero_copy_only=False)
            start, size = start[word], size[word]
            after = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(offsets[:-1], off)]
            stream = store.ids[ragged(start, size)]
            decoded = codec.decode(stream)
            reach = np.concatenate(([0], np.cumsum(codec.length[stream])))[after]
            width = digits_n[stream]
            shown = digits[ragged(digits_at[stream], width)]
            upto = np.concatenate(([0], np.cumsum(width)))[after]
            ids_sha = [hashlib.sha256(shown[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            text_sha = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(reach[:-1].tolist(), reach[1:].tolist())]
            out = [part.column(0), pa.array(np.diff(after)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(after, pa.int32()), pa.array(stream)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return lean.mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    ).withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer())
