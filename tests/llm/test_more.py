"""Odd rows of the operators on languages, pages and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, html_text, language, shared, warc

WORDS = {"en": "the and of to ship house water light".split(), "de": "der und das schön haus wasser licht über".split()}


def said(rng, lang):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 30)))


@pytest.mark.parametrize("shared_id", [7, 8, 9, 11, 13])
def test_a_language_under_one_id_is_learned(spark, shared_id):
    rng = random.Random(shared_id)
    rows = [(shared_id, said(rng, "en"), "en") for _ in range(900)] + [(1000 + i, said(rng, "de"), "de") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r["language"]: r["n"] for r in language.sample(df, "doc_id", "text", "lang", 200).groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"en": 200, "de": 200}
    model = language.fit(df)
    got = language.predict(spark.createDataFrame([(1, "the ship of light", None), (2, "das haus und licht", None)], df.schema), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "en", 2: "de"}


def test_copies_are_one_row_of_the_sample(spark):
    rng = random.Random(2)
    rows = [(1, "the very same words", "en")] * 2000 + [(i, said(rng, "en"), "en") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(df, "doc_id", "text", "lang").collect()
    assert 45 < len(got) <= 51 and sum(r["text"] == "the very same words" for r in got) == 1


def test_language_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, said(rng, lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(None, said(rng, "en"), "en"), (5, "the ship", None), (5, "the ship", None), (900, None, "de"), (901, "1 2 3", "en"), (902, "the " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"language": F.lit(1), "draw": F.lit("x"), "cut": F.lit(2)})
    model = language.fit(df)
    got = language.predict(df, model).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] in (900, 901)} == {"und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] in (5, 902)].count("en") >= 3
    for column in ("doc_id", "text", "lang"):
        gone = df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
        assert {r["lang_pred"] for r in language.predict(gone, language.fit(gone)).collect()} == {"und"}


def test_pages_and_digests_of_null_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>one two"), (2, None, None), (None, "u", "<article>three")], "page_id long, url string, html string")
    for column in pages.columns:
        gone = pages.withColumn(column, F.lit(None).cast(pages.schema[column].dataType))
        assert html_text.main_text(gone).count() == 3
        assert warc.read_records(warc.read_index(warc.write_packages(gone, shared.scratch_path(spark, "odd")))).count() == 3
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (None, None)], "doc_id long, text string")
    for column in docs.columns:
        gone = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
        assert exact_dedup.exact_dedup(gone).count() == 3 and exact_dedup.keep_first_copies(gone).count() >= 1


def foreign_record(uri: str, payload: bytes, kind: str = "response") -> bytes:
    block = (b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" if kind == "response" else b"") + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_packages_of_other_writers(spark, tmp_path):
    """Two archives, one of them plain; index lines with a key and a time, offsets as text."""
    members, lines = {}, [b'!meta 0 {"format": "cdxj"}']
    for name, pack in (("a.warc.gz", gzip.compress), ("b.warc", lambda x: x)):
        data = b""
        for i in range(3):
            record = pack(foreign_record(f"http://h/{name}/{i}", f"page {name} {i} \u00f1".encode(), "resource" if i == 2 else "response"))
            entry = {"url": f"http://h/{name}/{i}", "filename": name, "offset": str(len(data)), "length": str(len(record))}
            lines.append(f"h)/{i} 20240101000000 {json.dumps(entry)}".encode())
            data += record
        members[f"archive/{name}"] = data
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for name, data in members.items():
            z.writestr(name, data)
        z.writestr("indexes/one.cdxj", b"\n".join(lines))
        z.writestr("indexes/empty.cdxj", b"")
    packages = spark.createDataFrame([(path.as_uri(), 6)], "package string, records long")
    got = {r["url"]: r for r in warc.read_records(warc.read_index(packages), with_payload=True).collect()}
    assert len(got) == 6 and all(r["id"] is None for r in got.values())
    for name in ("a.warc.gz", "b.warc"):
        for i in range(3):
            text = f"page {name} {i} \u00f1"
            r = got[f"http://h/{name}/{i}"]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
            assert (r["record_type"], r["payload"]) == (("resource", None) if i == 2 else ("response", text))


def test_packages_that_are_broken(spark, tmp_path):
    for name, kind, line in (("packed", zipfile.ZIP_DEFLATED, b""), ("lost", zipfile.ZIP_STORED, b'{"filename": "no.warc", "offset": 0, "length": 1}')):
        path = tmp_path / f"{name}.wacz"
        with zipfile.ZipFile(path, "w", kind) as z:
            z.writestr("archive/a.warc", b"x" * 100)
            z.writestr("indexes/i.cdxj", line)
        with pytest.raises(Exception, match="stored|no archive"):
            warc.read_index(spark.createDataFrame([(path.as_uri(), 1)], "package string, records long")).collect()
