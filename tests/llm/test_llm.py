"""The corpus operators against brute force, exact round trips and held-out accuracy, with the awkward rows."""

from __future__ import annotations

import hashlib
import html as html_lib
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact_dedup, html_text, language, near_dedup, packing, quality, sharding, shared, suffix_dedup, warc

random.seed(4)
NO_MODEL = quality.Model(np.zeros(quality.BUCKETS, np.float32), np.zeros(quality.WORDS, np.float32))
VOCAB = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, passage = prose(300), prose(70)
    words = base.split()
    near = []
    for _ in range(12):
        w = list(words)
        for _ in range(random.randint(1, 9)):
            w[random.randrange(len(w))] = random.choice(VOCAB)
        near.append(" ".join(w))
    out = [
        None, "", " \t\n ", "x", "Élan. ça va! ñ", base, base, base.upper(), *near, prose(200) + passage + prose(30), passage, prose(10) + passage,
        "aaaa" * 200, "aaaa" * 200, "ab " * 300, prose(6000), "line one\nline two\nline one\n\nline two", "a # b * c $$ | d"
    ]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", i * 2, "en") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, keep_id long, lang string").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, texts):
    got = by_id(exact_dedup.exact_dedup(docs))
    fold = {i: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for i, t in texts}
    for i in fold:
        same = [j for j in fold if fold[j] == fold[i]]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert bytes(got[i]["digest"]) == hashlib.sha256(fold[i].encode()).digest()
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.keep_first_copies(docs).columns == docs.columns


def test_exact_dedup_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "q")], "doc_id long, text string")
    rows = sorted(exact_dedup.exact_dedup(df).collect(), key=str)
    assert [r["group_size"] for r in rows].count(3) == 3 and sum(r["kept"] for r in rows) == 3


def shingles(t):
    w = [x.decode() for x in (t or "").encode().lower().split()]
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_dedup(docs, texts):
    got = by_id(near_dedup.near_dedup(docs))
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0
    kept = near_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in sets})


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a, b = near_dedup._family(90)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    y = np.concatenate((x[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    same = (near_dedup.minhash(x, a, b) == near_dedup.minhash(y, a, b)).mean()
    assert abs(same - 800 / 1200) < 0.2


def brute_passages(texts):
    rows, first, out = sorted((i, (t or "").encode()) for i, t in texts), {}, {}
    for i, b in rows:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, b in rows:
        mask = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                mask[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mask) if not m)
        out[i] = (len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 500])
def test_suffix_dedup(docs, texts, bucket_bytes):
    got = by_id(suffix_dedup.repeated_passages(docs, bucket_bytes=bucket_bytes))
    want = brute_passages(texts)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_suffix_dedup_keeps_rows_and_characters(spark):
    p = "äöüß" * 20
    df = spark.createDataFrame([(1, "x" + p, 5), (2, p + "y", 6), (3, None, 7), (None, "x" + p, 8)], "doc_id long, text string, extra int")
    got = sorted(((r["doc_id"], r["text"], r["extra"]) for r in suffix_dedup.repeated_passages(df, keep_rows=True).collect()), key=lambda r: r[2])
    assert got[0] == (1, "x" + p, 5) and got[1] == (2, "y", 6) and got[2] == (3, None, 7) and got[3] == (None, "", 8)


def test_quality_base_rules(docs, texts):
    got = by_id(quality.score(docs, NO_MODEL))
    for i, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        mark = [0] * len(w)
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                mark[j] = mark[j + 1] = mark[j + 2] = 1
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(mark))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 50 or 100 * sum(mark) > 50 * len(w)
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_quality_model_rejects_what_is_unlike_the_target(spark):
    good = [(i, prose(120) + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(f"{w}%%%" for w in prose(120).split())) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(60)], "id long")
    got = by_id(quality.score(df, quality.fit(df, target)))
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    assert quality.keep_good(df, target).count() == len(good)
    assert (quality.fit(df, target.limit(0)).ratios == 0).all()


def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_is_an_exact_cover(docs, texts):
    t = tokenizer(packing.default_tokenizer())
    rows = packing.pack(docs, packing.default_tokenizer(), block_bytes=4000).collect()
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in texts}
    for i, x in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= packing.WINDOW
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0


def test_packing_plan_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(20):
        points = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 60, 25)))))
        cost = rng.integers(0, 20, len(points)).astype(float)
        cuts = packing.plan(points, cost, 128)
        best = [0.0] + [np.inf] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                size = int(points[j] - points[i])
                if size <= 128:
                    pad = 0 if size in (64, 128) else 128 - size
                    best[j] = min(best[j], best[i] + pad + cost[j] + packing.PER_SEQUENCE)
        got, last = 0.0, 0
        for c in cuts:
            size = int(c - last)
            got += (0 if size in (64, 128) else 128 - size) + cost[np.searchsorted(points, c)] + packing.PER_SEQUENCE
            last = c
        assert last == points[-1] and got == pytest.approx(best[-1])


def test_word_parts_encode_as_whole_texts():
    t, e = tokenizer(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    odd = ["Don't, stop. it's", "naïve É, è. × y", "<|endoftext|> <|ENDOFTEXT|> a\x01b \x01", "1,2.3 a.b c... d,", "ΑΣ ΣΑΣ. İstanbul", "  é ́x", "日本語。テスト,"]
    import pyarrow as pa

    from tidewell.llm.bytescan import text_buffer

    stream, off, _ = packing.tokens(*text_buffer(pa.array(odd)), e)
    for k, x in enumerate(odd):
        assert stream[off[k] : off[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids + [2]


def test_bpe_equals_the_library(docs, texts):
    t = tokenizer(bpe.default_tokenizer())
    got = by_id(bpe.encode_documents(docs, bpe.default_tokenizer(), with_ids=True))
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_random_strings():
    t, c = tokenizer(bpe.default_tokenizer()), bpe.Codec(bpe.default_tokenizer())
    rng = random.Random(2)
    for _ in range(1500):
        x = "".join(rng.choice("ab \n aaé.,'s<|1" if rng.random() < 0.8 else [chr(rng.randint(1, 0x3000))]) for _ in range(rng.randint(0, 40)))
        assert c.encode(x) == t.encode(x, add_special_tokens=False).ids if x else c.encode(x) == []
    x = "a<|endoftext|> b"
    assert c.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_sharding(docs, texts):
    got = by_id(sharding.shard_by_bytes(docs, shards=4))
    text = {i: t or "" for i, t in texts}
    place = {}
    for i, r in got.items():
        assert r["size"] == len(text[i].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[i].encode())
        assert place.setdefault(text[i], r["shard"]) == r["shard"]
    for k in range(4):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(3)
    items = [(rng.randint(1, 500), k) for k in range(800)]
    placed, load = sharding.best_fit_decreasing(items, 7), [0] * 7
    for size, k in items:
        load[placed[k]] += size
    assert max(load) - min(load) < 0.01 * sum(load) / 7
    tree, kept = sharding.CapacityTree(), set()
    for _ in range(2000):
        key = (rng.randint(0, 300), rng.randint(0, 5))
        if key in kept:
            tree.remove(key)
            kept.discard(key)
        else:
            tree.add(key)
            kept.add(key)
        want = rng.randint(0, 300)
        assert tree.tightest(want) == min((k for k in kept if k[0] >= want), default=None)
    assert tree.root.height <= 15


@pytest.mark.parametrize("force64", [False, True])
def test_warc_round_trip(spark, force64):
    big = "x" * 1500
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "small"), (4, "u4", "small"), (5, None, None), (6, "u6", "é" * 900), (7, "u7", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = warc.write_packages(pages, shared.scratch_path(spark, "warc-test"), force64=force64)
    for r in packages.collect():
        assert zipfile.ZipFile(r["package"].removeprefix("file:")).testzip() is None
    got = {r["id"]: r for r in warc.read_records(warc.read_index(packages), with_payload=True).collect()}
    for i, url, x in rows:
        data = (x or "").encode()
        r = got[i]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url or "", len(data), hashlib.sha1(data).hexdigest())
        winner = {1: 2, 6: 7}.get(i)
        assert (r["record_type"], r["refers_to"], r["payload"]) == (("revisit", winner, None) if winner else ("response", None, x or ""))
    assert warc.write_packages(pages.limit(0), shared.scratch_path(spark, "warc-test")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header">Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Big &amp; small</h1></header><p>First <b>bo</b>ld&nbsp;text.<br>Next<p>Second<script>var x="</p>";</script> part</p><aside>Related</aside><div id="comments"><p>Nice!</p></div></article>
<form><input value="x">Search</form><!-- hidden <p>no</p> --><footer>&copy; 2024</footer></body>"""


def test_html_extraction(spark):
    loose = [f"<body><p>Welcome to our big site with many pages</p><p>{prose(12)}</p><p>{w} alone here</p></body>" for w in ("red", "green", "blue", "grey")]
    rows = [
        (1, "http://h.example/a", PAGE), (2, "http://h.example/b", None), (3, None, "plain text"),
        *((10 + k, "http://www.l.example/x", x) for k, x in enumerate(loose))
    ]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Big & small First bold text. Next Second part" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["text"] == "plain text"
    for k, w in enumerate(("red", "green", "blue", "grey")):
        assert "Welcome" not in got[10 + k]["text"] and f"{w} alone here" in got[10 + k]["text"]
    again = spark.createDataFrame([(1, "u", "<p>" + html_lib.escape("a<b") * 3000)], "page_id long, url string, html string")
    assert html_text.main_text(again).first()["n_chars"] == 9000
    assert html_text.main_text(again.limit(0)).count() == 0


def test_html_boilerplate_counts_distinct_pages(spark):
    """Repeated rows and copies are one page; null ids count; articles keep lines that others have too."""
    line = "Read more stories like this one every single day"
    story = lambda k, tag: f"<body><{tag}><p>{prose(30)} {k}</p><p>{line}</p></{tag}></body>"
    one = story("one", "div")
    rows = [(1, "http://a.example/1", one), (2, "http://a.example/2", story("two", "div")), (None, "http://a.example/3", story("three", "div"))]
    rows += [(10 + i, "http://b.example/x", one) for i in range(5)] + [(20, "http://b.example/y", story("y", "div"))]
    rows += [(30 + i, "http://c.example/y", story(str(i), "article")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "key": F.lit(1), "row": F.lit(2)})
    got = html_text.main_text(df.unionByName(df.filter("page_id = 20"))).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (line in r["text"]) == (r["host"] != "a.example") and r["n_chars"] > 60
        assert (r["removed"] > 0) == (r["host"] == "a.example")


def test_html_suffix_array_by_ranges(spark):
    """Suffixes come in order over all ranges; intervals cut by them are whole again, as against a naive count."""
    rng = random.Random(5)
    parsed = []
    for i in range(60):
        words = lambda n: " ".join(rng.choice("ab\u00e9") for _ in range(n))
        loose = [words(rng.randint(0, 9)) for _ in range(rng.randint(1, 3))] + ["one line on all of the pages"]
        parsed.append((rng.choice("xxy"), html_text.LOOSE if rng.random() < 0.8 else html_text.ARTICLE, loose, [words(8)], rng.randint(1, 25), i))
    df = spark.createDataFrame(parsed, "host string, place int, texts array<string>, others array<string>, digest long, row long")
    seen, places = {}, []
    for host, place, texts, others, digest, row in parsed:
        for t, inside in ((texts, True), (others, False)):
            w = " ".join(t).split()
            for i in range(len(w) - html_text.RUN + 1) if place == html_text.LOOSE or not inside else ():
                seen.setdefault((host, tuple(w[i : i + html_text.RUN])), set()).add(digest)
                places += [(row, i, host, tuple(w[i : i + html_text.RUN]))] if inside else []
    want = sorted((row, i) for row, i, *key in places if len(seen[tuple(key)]) >= 3)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for ranges in ("1", "9", "60"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            array = html_text.suffix_array(html_text.suffixes(df))
            ordered = [tuple(r) for p in array.rdd.glom().collect() for r in p]
            assert [(h, s.encode(), d, r) for h, s, d, r, _ in ordered] == sorted((h, s.encode(), d, r) for h, s, d, r, _ in ordered)
            assert sorted((r["row"], r["at"]) for r in html_text.repeated(df).collect()) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert 0 < len(want) < len(places)


def test_language_id(spark):
    words = {
        "en": "the and of to ship house water light".split(), "de": "der und das schön haus wasser licht über".split(),
        "fr": "le et la être maison eau lumière où".split()
    }
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(4, 60))), k) for i, k in enumerate(rng.choices(list(words), k=400))]
    df = spark.createDataFrame(
        [*rows, (9001, None, "en"), (9002, "", "en"), (9003, "123 !?", "en"), (9004, "the house", None)], "doc_id long, text string, lang string"
    )
    model = language.fit(df.filter(language.in_training()))
    got = by_id(language.predict(df, model))
    held = {r["doc_id"] for r in df.filter(~language.in_training()).collect()}
    right = [got[i]["lang_pred"] == k for i, _, k in rows if i in held]
    assert len(right) > 40 and sum(right) / len(right) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (9001, 9002, 9003))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.predict(df, language.fit(df.limit(0))).collect()} == {"und"}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in shared.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, prose(150), "en", "s", 0) for i in range(60)]
    copy = (100, rows[3][1], "en", "s", 0)
    near = (101, rows[4][1].rsplit(" ", 2)[0], "en", "s", 0)
    junk = (102, "junk " * 200, "en", "s", 0)
    docs = spark.createDataFrame([*rows, copy, near, junk], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        d = shared.materialize(stage(spark, d, str(tmp_path)), "test")
        assert d.columns == docs.columns
    kept = {r["doc_id"] for r in d.collect()}
    assert kept == (set(range(60)) - {3}) | {100}
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} == kept


def test_every_operator_is_registered():
    from tidewell.llm import registry

    names = registry.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14)) and "pipeline" in names
    assert set(registry.oracles()) <= set(names)


@pytest.mark.parametrize("column", ["doc_id", "text"])
def test_operators_take_all_null_columns(spark, column):
    df = spark.createDataFrame(
        [(1, "a b c d e f", "en"), (2, "x", "en")], "doc_id long, text string, lang string"
    ).withColumn(column, F.lit(None).cast("long" if column == "doc_id" else "string"))
    assert near_dedup.near_dedup(df).count() == 2
    assert suffix_dedup.repeated_passages(df).count() == 2
    assert sharding.shard_by_bytes(df).count() == 2
    assert bpe.encode_documents(df, bpe.default_tokenizer()).count() == 2
    assert quality.score(df, NO_MODEL).count() == 2
    assert packing.pack(df, packing.default_tokenizer()).agg(F.sum("length")).first()[0] >= 2


def test_quality_rejects_prose_with_a_word_the_target_avoids(spark):
    clean = [(i, prose(150)) for i in range(600)]
    toxic = [(1000 + i, f"{prose(75)} Idiot, {prose(75)}") for i in range(200)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(400)], "id long")
    got = by_id(quality.score(df, quality.fit(df, target)))
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in toxic)
    assert quality.keep_good(df, target).count() == len(clean)


def test_quality_scores_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(VOCAB[: 40 if i % 3 else 400]) + rng.choice(["", ".", ","]) for _ in range(60))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "ab"), (203, "Aa aA, aa. aa.."), (204, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = {i for i, _ in rows if i % 3}
    model = quality.fit(df, spark.createDataFrame([(i,) for i in target], "id long"))
    gram = lambda g: (((int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 + len(g)) * 0xD6E8FEB86659FD93 % 2**64) >> 40) % quality.BUCKETS
    grams = {i: [b[j : j + n] for b in [(t or "").encode()] for n in (3, 4) for j in range(len(b) - n + 1)] for i, t in rows}
    strip = lambda w: w[:-1] if len(w) > 1 and w[-1:] in b".,;:!?|" else w
    found = {i: {strip(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())} for i, t in rows}

    raw, good = (Counter(gram(g) for i, found_ in grams.items() if i in ids for g in found_) for ids in (set(grams), target))
    n_raw, n_good = raw.total(), good.total()
    p = lambda b: (raw[b] + 1) / (n_raw + quality.BUCKETS)
    gram_ratio = {b: np.log((good[b] + quality.PRIOR * n_good * p(b)) / (n_good + quality.PRIOR * n_good) / p(b)) for b in raw}

    raw, good = (Counter(w for i, found_ in found.items() if i in ids for w in found_) for ids in (set(found), target))
    more = quality.SMOOTHING + quality.SMOOTHING_SHARE * sum(1 for x in found.values() if x)
    less = more * good.total() / raw.total()
    ratio = {w: np.log((good[w] + less) / (good.total() + less * quality.WORDS)) - np.log((raw[w] + more) / (raw.total() + more * quality.WORDS)) for w in raw}
    ratio = {w: r if abs(r) >= quality.DECISIVE else 0.0 for w, r in ratio.items()}
    got = by_id(quality.score(df, model))
    for i, t in rows:
        want = sum(gram_ratio[gram(g)] for g in grams[i]) / max(1, len(grams[i])) + quality.WEIGHT * sum(ratio[w] for w in found[i]) / max(1, len(found[i]))
        assert got[i]["llr"] == pytest.approx(want, abs=1e-5)
        assert got[i]["kept"] == (not got[i]["base_failed"] and want >= quality.THRESHOLD)


# --- odd rows, for every operator ------------------------------------------------------


def thue_morse(n: int) -> tuple[str, str]:
    s = "a"
    while len(s) < n:
        s += s.translate({97: "b", 98: "a"})
    return s, s.translate({97: "b", 98: "a"})


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated ids with equal and with different texts, null ids, ties, a long text without spaces, clashing names."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    x, y = thue_morse(1024)
    base = prose(90)
    rows = [(5, base), (5, base), (5, prose(80)), (9, base), (None, base), (None, prose(60)), (None, None), (7, ""), (8, None), (1, x), (2, y)]
    rows += [(20, long), (21, long[500_000:] + " tail"), (30, f"{x}\n{y}\n{x}"), (31, " ".join([x, "q", "r", y, "q", "r", y]))]
    names = "id n row check digest bucket kind blob host key item shard rep node start size"
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names.split()})
    return rows, df


def test_odd_rows_exact_dedup(odd):
    rows, df = odd
    fold = [(i, (t or "").lower()) for i, t in rows]
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows)
    best = {t: max((i for i, u in fold if u == t and i is not None), default=None) for _, t in fold}
    size = Counter(t for _, t in fold)
    want = Counter((i, best[t], size[t], i == best[t]) for i, t in fold)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    kept = exact_dedup.keep_first_copies(df)
    assert kept.columns == df.columns
    assert {r["text"] or "" for r in kept.collect()} == {t or "" for _, t in rows}  # no text is lost with another


def test_odd_rows_near_dedup(spark, odd):
    rows, df = odd
    got = near_dedup.near_dedup(df).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of[1] == 1 and of[2] == 2 and of[9] == 5 and of[7] == 7 and of[8] == 8
    kept = near_dedup.keep_one_each(df.filter("doc_id IS NOT NULL"))
    assert kept.columns == df.columns
    assert {t for i, t in rows if i == 5} <= {r["text"] for r in kept.collect()}
    assert near_dedup.near_dedup(spark.createDataFrame(
        [(i, x) for i, x in enumerate(thue_morse(2048))], "doc_id long, text string"
    )).filter("kept").count() == 2


def test_odd_rows_quality(odd):
    rows, df = odd
    got = Counter((r["doc_id"], r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.score(df, NO_MODEL).collect())
    want = Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), *quality._repeats((t or "").encode())) for i, t in rows)
    assert got == want and (30, 3, 1, 0) in got


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    import pyarrow as pa

    from tidewell.llm.bytescan import text_buffer

    some = ["a b c a b c", "k1\nk2\nk1", "ab cd ef gh ij kl ab cd ef", "", "x"]
    monkeypatch.setattr(quality, "span_hash", lambda p, a, b, buf=None: (b - a).astype(np.uint64))
    got = quality.base_stats(*text_buffer(pa.array(some)))
    assert list(zip(got["n_dup_lines"], got["n_repeat_words"])) == [quality._repeats(t.encode()) for t in some]


def test_odd_rows_suffix_dedup(spark, odd):
    rows, df = odd
    got = suffix_dedup.repeated_passages(df).collect()
    assert len(got) == len(rows)
    removed = {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] in (20, 21, 1, 2)}
    assert removed[20] == 0 and removed[21] == 500_000
    edited = suffix_dedup.repeated_passages(df, keep_rows=True)
    assert edited.columns == df.columns and edited.count() == len(rows)
    small = [(i, t) for i, t in rows if i in (1, 2, 30, 31, 7, 8, 9)]
    some = by_id(suffix_dedup.repeated_passages(spark.createDataFrame(small, "doc_id long, text string")))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in some.items()} == brute_passages(small)


def test_long_documents_are_parsed_in_slices(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    buf = np.frombuffer(prose(2000).encode(), np.uint8)
    start, end, _, _ = suffix_dedup.parse(buf, np.array([0, len(buf)]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(start, end)])
    assert (np.sort(covered) == np.arange(len(buf) - suffix_dedup.LENGTH + 1)).all()


def test_odd_rows_sharding(odd):
    rows, df = odd
    got = sharding.shard_by_bytes(df).collect()
    assert len(got) == len(rows)
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    home = {}
    for r in got:
        assert home.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]


def test_odd_rows_tokens(odd):
    rows, df = odd
    t = tokenizer(packing.default_tokenizer())
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows)
    pieces = packing.pack(df, packing.default_tokenizer()).filter("start = 0").collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in pieces) == want
    b = tokenizer(bpe.default_tokenizer())
    ids = Counter((i, hashlib.sha256(",".join(map(str, b.encode(x or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, x in rows)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in bpe.encode_documents(df, bpe.default_tokenizer()).collect()) == ids


def test_odd_rows_pages(spark):
    page = "<article><p>" + "x" * 2000 + "</p></article>"
    rows = [(1, "u", page), (1, "u", page + "<p>other"), (2, "u", page), (3, "u", page + "<p>other"), (None, None, page), (None, "u\r\nv", None), (4, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in (
        "id", "n", "digest", "winner", "host", "row", "package"
    )})
    packages = warc.write_packages(df, shared.scratch_path(spark, "odd"))
    got = Counter((r["id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(warc.read_index(packages)).collect())
    n, m = len(page), len(page) + 8
    assert got == Counter([
        (1, n, "revisit", 2), (1, m, "revisit", 3), (2, n, "response", None), (3, m, "response", None), (None, n, "revisit", 2),
        (None, 0, "response", None), (4, 0, "response", None)
    ])
    assert html_text.main_text(df).count() == len(rows)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as cp

    rows, df = odd
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for name, d, l in (("odd", docs, labels), ("none", docs.limit(0), labels.limit(0))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        l.write.parquet(str(tmp_path / name / "labels.parquet"))
    made = cp.run(spark, str(tmp_path / "odd")).collect()
    assert made and cp.run(spark, str(tmp_path / "none")).count() == 0
    stage = docs
    for _, f in cp.STAGES[:-1]:
        stage = shared.materialize(f(spark, stage, str(tmp_path / "odd")), "stage")
        assert stage.columns == docs.columns
    assert {i for i, t in rows if i == 5} <= {r["doc_id"] for r in stage.collect()}


def test_suffix_dedup_of_a_passage_that_most_documents_share(spark):
    """Its phrases go through waiting lists; every document but the smallest loses it."""
    line = prose(40)
    rows = [(i * 7 % 501, f"{prose(8)} {i} {line} {prose(3)}") for i in range(300)] + [(900 + i, prose(30)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_passages(rows)
    for parts in (1, 3):
        got = by_id(suffix_dedup.repeated_passages(df.repartition(parts), bucket_bytes=2000))
        assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_attach_spreads_a_key_of_a_third_of_all_rows(spark):
    left = shared.materialize(spark.range(0, 30_000, 1, 8).selectExpr("IF(id % 3 = 0, 7, IF(id % 5 = 0, NULL, id)) AS k", "id"), "left")
    right = shared.materialize(spark.range(20_000).selectExpr("id AS k", "id * 2 AS v"), "right")
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        most = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        for how in ("inner", "left"):
            spread, plain = shared.attach(left, right, "k", how), left.join(right, "k", how)
            assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))
        assert most(shared.attach(left, right, "k")) < 5000 < 10_000 <= most(left.join(right, "k"))
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_segment_sums():
    from tidewell.llm.bytescan import segment_sums

    x = np.arange(10, dtype=np.float32)
    assert segment_sums(x, np.array([0, 0, 3, 3, 10, 10])).tolist() == [0, 3, 0, 42, 0]
    assert segment_sums(np.stack([x, -x], 1), np.array([0, 4, 10])).tolist() == [[6, -6], [39, -39]]
    assert segment_sums(x[:0], np.array([0, 0])).tolist() == [0]


def test_merged_runs_are_sorted_and_merged_by_key(spark):
    """The plan of the exact deduplication: sorted runs, folded and merged by sort aggregates in every round."""
    found = exact_dedup.digests(spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string"))
    merged = exact_dedup.merge_runs(found, runs=8)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate(key=[digest") >= 2 * 4 and plan.count("Exchange hashpartitioning(digest") == 4
    assert "HashAggregate(key=[digest" not in plan.replace("SortAggregate", "")
    assert {r["keep_id"] for r in merged.collect()} == set(range(43, 50))
