"""Ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in TERM.findall(text or ""))


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in terms(text).items() if t in c
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeñ") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(words[: rng.choice([10, 300])]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 80))) for i in range(700)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(150)]  # many ties
    docs += [(2000, None), (2001, ""), (2002, " -;!\t"), (2003, text(20000)), (2004, "a" * 300_000), (None, docs[0][1]), (None, docs[0][1]), (5, docs[0][1])]
    items = [(i, text(rng.randint(1, 40)).upper()) for i in range(30)] + [(90, None), (91, ""), (92, "zzzzzzzz"), (93, "a a a ñ"), (94, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("bounds", [(ranked.MOST_DOCS, ranked.MOST_PAIRS, ranked.MOST_ITEM_BYTES), (37, 1 << 20, 500), (4096, 900, 1)])
def test_ranked_search(spark, corpus, bounds, monkeypatch):
    docs, items = corpus
    items = items if bounds[2] > 1 else items[-6:]
    build = ranked.build_index
    monkeypatch.setattr(ranked, "build_index", lambda d, i, t: build(d, i, t, bounds[0], bounds[1]))
    left = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, item int").repartition(3)
    right = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in ranked.ranked(left, right, most_item_bytes=bounds[2]).collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert ranked.ranked(docs.limit(0), items).count() == 0
    assert ranked.ranked(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.ranked(docs.filter("text IS NULL"), items).count() == 0


def test_repeated_items_are_ranked_each(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "item_id long, text string")
    found = defaultdict(list)
    for r in ranked.ranked(docs, items, k=4).collect():
        found[r["item_id"]].append(r["rank"])
    assert sorted(found[1]) == [1, 1, 2, 2, 3, 3, 4, 4] and sorted(found[None]) == [1, 2, 3, 4]


@pytest.mark.parametrize("shape", [(1, 1), (3, 50), (60, 5), (64, 64)])
def test_treap_holds_the_grid(shape):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 1000, shape) * (rng.random(shape) < 0.3)
    grid[-1, -1] = 7
    rows, columns = np.nonzero(grid)
    treap = ranked.load(*ranked.build(rows, columns, grid[rows, columns]))
    assert treap.maxima[0] == grid.max()
    for k, width in ((1, 1), (4, 2), (10**6, 64)):
        wanted = np.unique(rng.integers(0, shape[0], 5))
        weights = rng.integers(0, 9, len(wanted))
        scores = weights @ grid[wanted]
        found, best = ranked.search(treap, wanted, weights, k, 1, width)
        least = max(1, sorted(scores)[-min(k, len(scores))])
        assert dict(zip(found.tolist(), best.tolist())) == {c: s for c, s in enumerate(scores.tolist()) if s >= least}


def test_terms_in_slices(monkeypatch):
    text = "Aa bÑ,c-1\x7f " * 500
    whole = ranked.term_counts(text)
    monkeypatch.setattr(ranked, "SLICE", 37)
    assert ranked.term_counts(text) == whole == {t.encode(): n for t, n in terms(text).items()}
