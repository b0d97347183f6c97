"""Language of a text: averaged hashed subword embeddings and a linear softmax.

Subwords are byte n-grams (A-Z folded) hashed to ``BUCKETS`` embeddings of ``WIDTH``
numbers; a text is the mean of its embeddings, and a linear layer with softmax gives
the language. Embeddings and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows: about ``PER_LANGUAGE`` texts
of each language (``MOST_ROWS`` in all), drawn by a hash of id and text, none longer than
``LONGEST`` bytes.
A part of the sample is kept aside to calibrate on snippets: one temperature makes
the probabilities honest, and the score below which a prediction is not to be trusted
is set so that at most ``REFUSED`` of the right ones fall under it.

Prediction is one pass over whole texts. As the mean is linear, embeddings times
layer fold into one table of ``BUCKETS`` x languages, which is all that is broadcast.

Defined results: a null text or one without a letter is ``und`` with score 0; with
no labelled row every text is ``und``; repeated rows get the same answer; null ids are
handed through (they are never learned from); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import LOWER, pieces, segment_sums, text_buffer
from .quality import grams
from .shared import materialize, table

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
PER_LANGUAGE, LONGEST, REFUSED = 600, 64 << 10, 0.005
#: Rows of the sample over all languages; with very many languages each gets fewer.
MOST_ROWS, LEAST_ROWS = 20_000, 20
EPOCHS, RATE = 4, 4.0


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    accept: float


def in_training(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Ids of the training folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != 0


def sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """A bounded sample of labelled rows: of each language those with the smallest hashes of id and text.

    Rows of one id and text are one row; an id that many texts share is as many rows.
    """
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.octet_length(text_col) <= longest))
    draw = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(17))
    drawn = labelled.select(F.col(label_col).alias("language"), draw.alias("draw")).distinct()
    counts = drawn.groupBy("language").agg(F.count(F.lit(1)).alias("rows"))
    # languages beyond what the sample can hold are those with the fewest rows
    counts = materialize(counts.orderBy(F.col("rows").desc(), "language").limit(MOST_ROWS // LEAST_ROWS), "languages")
    per_language = min(per_language, MOST_ROWS // max(1, counts.count()))
    # a language of n rows has its ``per_language`` smallest hashes well below this share; small ones are taken whole
    share = 2 * per_language + 50
    low = (F.col("draw") / F.lit(float(1 << 63)) + 1) / 2 * F.col("rows") <= share
    few = drawn.join(F.broadcast(counts), "language").filter(low)
    rank = F.row_number().over(Window.partitionBy("language").orderBy("draw"))  # about ``share`` rows
    cut = few.withColumn("rank", rank).filter(F.col("rank") <= per_language).groupBy("language").agg(F.max("draw").alias("cut"))
    cut = materialize(cut, "language-cuts")
    near = labelled.select(F.col(label_col).alias("language"), F.col(text_col).alias("text"), draw.alias("draw"))
    near = near.join(F.broadcast(cut), "language").filter("draw <= cut")
    return near.groupBy("language", "draw").agg(F.first("text").alias("text")).select("language", "text", "draw")


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct buckets and their shares."""
    out = []
    for t in texts:
        buf, off = text_buffer(pa.array([t]))
        found = np.concatenate([g for g, _ in grams(LOWER[buf], off, BUCKETS, ORDERS)])
        bucket, n = np.unique(found, return_counts=True)
        out.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """Fit on (language, text) rows in the order given."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    texts = [r[1] for r in rows]
    made = features(texts)
    target = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(seed)

    def snippet(text: str) -> str:
        """A few neighbouring words, so that short texts are learned and calibrated too."""
        parts = text.split()
        k = int(rng.integers(0, max(1, len(parts) - 1)))
        return " ".join(parts[k : k + int(rng.integers(1, 9))])

    aside = np.arange(len(rows)) % 5 == 4
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    b = np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~aside)
    steps, step = 2 * EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        short = dict(zip(learn.tolist(), features([snippet(texts[i]) for i in learn])))
        for i in rng.permutation(np.concatenate((learn, -learn - 1))):
            bucket, share = made[i] if i >= 0 else short[-i - 1]
            i = i if i >= 0 else -i - 1
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ e[bucket]
            g = _softmax(hidden @ w + b)
            g[target[i]] -= 1
            back = w @ g
            w -= (rate * 0.1) * np.outer(hidden, g)
            b -= (rate * 0.01) * g
            e[bucket] -= rate * share[:, None] * back
    logits = e @ w
    check = np.flatnonzero(aside) if aside.any() else learn
    z = np.stack([share @ logits[bucket] + b for bucket, share in features([snippet(texts[i]) for i in check])])
    scales = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(z * s)[np.arange(len(check)), target[check]] + 1e-12).mean() for s in scales]
    scale = float(scales[int(np.argmin(loss))])
    p = _softmax(z * scale)
    right = p.argmax(axis=1) == target[check]
    accept = float(np.quantile(p.max(axis=1)[right], REFUSED)) if right.any() else 0.0
    return Model(languages, (logits * scale).astype(np.float32), b * scale, accept)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    found = sample(docs, id_col, text_col, label_col).collect()
    return train([(r["language"], r["text"]) for r in sorted(found, key=lambda r: (r["draw"], r["text"]))])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, buf, off in pieces(batches, "text"):
            n = len(off) - 1
            known = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, score, accepted = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if m is not None:
                total, count = np.zeros((n, len(m.languages))), np.zeros(n)
                for g, at in grams(LOWER[buf], off, BUCKETS, ORDERS):
                    count += np.diff(at)
                    total += segment_sums(m.logits.take(g, axis=0), at)
                p = _softmax(total / np.maximum(count, 1)[:, None] + m.bias)
                best = p.argmax(axis=1)
                names[known] = np.array(m.languages, object)[best[known]]
                score[known] = np.round(p.max(axis=1)[known], 9)
                accepted = known & (score >= m.accept)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], ["id", "lang_pred", "score", "accepted"]
            )

    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    return lean.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.filter(in_training())))
    return out.withColumn("held_out", F.coalesce(~in_training(), F.lit(False)))
