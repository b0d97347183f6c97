"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one
gzip member per record, and ``indexes/index.cdxj``, one JSON line per record with
its place. Readers find the end-of-central-directory record in the last bytes of
the file (following the ZIP64 locator where sizes or counts need 64 bits), parse
the central directory, look up where a stored member's bytes begin, read the
index, and then fetch single records by byte range; neighbouring ranges are read
together up to a bound. Whole archives are never loaded.

Every task writes its own packages (a new one after ``PACKAGE_BYTES``), first under
a name of its own; a repeated task writes other files, and only the packages that
the written list names are read, so lost executors do no harm. Files are reached
through pyarrow's file systems, by URI.

Defined results: a null payload is an empty one; repeated rows become records each
(with the same id, they are told apart by their place only), and rows of one id with
different payloads are decided apart; null ids are written and read back as null, and
are responses only where no copy has an id; an empty table makes no package; extra
columns are ignored. Ids are whole numbers (longs). Packages of other writers are read too:
archives and indexes are found by their names in the directory, ids that are not numbers
of this writer come back null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, hot_keys, materialize, rows_within, scratch_path, table

PACKAGE_BYTES = 256 << 20
#: Payloads from this size on are written once; later copies become revisits.
REVISIT_BYTES = 1000
#: Ranges closer than this are read together, up to so many bytes.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Record bytes that one reading task fetches.
TASK_BYTES = 16 << 20
#: Up to so many repeated payloads are broadcast.
WINNERS = 400_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Members that readers look for.
ARCHIVES, INDEXES = re.compile(r"archive/.+\.warc(\.gz)?$"), re.compile(r"indexes/.+\.cdxj$")
#: Fixed values of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- writing -----------------------------------------------------------------


class PackageWriter:
    """Writes one package as a stream; the central directory comes last."""

    def __init__(self, uri: str, force64: bool = False) -> None:
        files, path = _open(uri)
        if isinstance(files, fs.LocalFileSystem):
            files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.entries, self.lines, self.force64 = files.open_output_stream(path), 0, [], [], force64
        self._begin(DATA)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _begin(self, name: str) -> None:
        self.name, self.header, self.crc = name, self.at, 0
        # sizes follow in a data descriptor (flag bit 3), as the member is streamed
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45, 8, 0, 0, 33, 0, 0, 0, len(name), 0) + name.encode())
        self.start = self.at

    def _end(self) -> None:
        size = self.at - self.start
        wide = self.force64 or size >= FULL32
        self._put(struct.pack("<4sI" + ("QQ" if wide else "II"), b"PK\x07\x08", self.crc, size, size))
        self.entries.append((self.name, self.crc, size, self.header))

    def record(self, record: bytes, line: dict) -> None:
        data = gzip.compress(record, 1, mtime=0)
        self.lines.append(json.dumps(line | {"offset": self.at - self.start, "length": len(data)}))
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def close(self) -> None:
        self._end()
        self._begin(INDEX)
        data = "".join(x + "\n" for x in self.lines).encode()
        self.crc = zlib.crc32(data)
        self._put(data)
        self._end()
        begin, wide = self.at, self.force64 or self.at >= FULL32
        for name, crc, size, header in self.entries:
            big = wide or max(size, header) >= FULL32
            extra = struct.pack("<2H3Q", 1, 24, size, size, header) if big else b""
            s, h = (FULL32, FULL32) if big else (size, header)
            self._put(struct.pack("<4s6H3I5H2I", ENTRY, 45, 45, 8, 0, 0, 33, crc, s, s, len(name), len(extra), 0, 0, 0, 0, h) + name.encode() + extra)
        size, n = self.at - begin, len(self.entries)
        if wide:
            at = self.at
            self._put(struct.pack("<4sQ2H2I4Q", END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, at, 1))
            n, size, begin = FULL16, FULL32, FULL32
        self._put(struct.pack("<4s4H2IH", END, 0, 0, n, n, size, begin, 0))
        self.out.close()


def _plain_uri(url: str) -> str:
    """White space and control characters would break the header: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record_bytes(kind: str, record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header (with the payload's length) only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {_plain_uri(url)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}"
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def plan_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """All rows (id, digest, n, and the other columns of ``pages``) with refers_to: the response a row points to, or null.

    Of equal payloads the largest id is the response; each row is decided by its own
    payload, so an id may come with several. Digests are grouped, not payloads, with
    partial aggregation. The winners of repeated payloads are broadcast up to
    ``WINNERS`` rows; beyond, the join is shuffled, frequent digests apart.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.withColumns({"digest": F.unhex(F.sha1(payload)), "n": F.octet_length(payload)})
    big = materialize(rows.select(F.col(id_col).alias("id"), "digest", "n").filter(F.col("n") >= REVISIT_BYTES), "payloads")
    winner = big.groupBy("digest", "n").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    winner = materialize(winner, "winners")
    if rows_within(winner, WINNERS):
        rows = rows.join(F.broadcast(winner), ["digest", "n"], "left")
    else:
        rows = attach(rows, winner, ["digest", "n"], "left", hot=hot_keys(big, ["digest", "n"]))
    return rows.withColumn("refers_to", F.when(~F.col(id_col).eqNullSafe(F.col("winner")), F.col("winner")))


def write_packages(
    pages: DataFrame, out_uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", force64: bool = False
) -> DataFrame:
    """Write all rows as WARC records; returns the list of packages (package, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, count = None, "", 0

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["package", "records"])

        for batch in batches:
            for page, url, html, target in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name, count = f"{out_uri}/{uuid.uuid4().hex}.wacz", 0
                    writer = PackageWriter(name, force64)
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                kind = "response" if target is None else "revisit"
                line = {"id": page, "digest": digest, "type": kind, "refers_to": target}
                writer.record(record_bytes(kind, f"urn:row:{page}", url or "", payload, digest, None if target is None else f"urn:row:{target}"), line)
                count += 1
                if writer.at >= PACKAGE_BYTES:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    lean = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    rows = plan_revisits(lean, "id", "html").select("id", "url", "html", "refers_to")
    return materialize(rows.mapInArrow(run, "package string, records long"), "packages")


# --- reading -----------------------------------------------------------------


def central_directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """Members of a package as {name: (local header, stored size, method)}; ``read(offset, length)`` reads bytes."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, length, begin = struct.unpack_from("<H2I", tail, k + 10)
    if FULL16 == n or FULL32 in (length, begin):
        where = k - 20
        locator = tail[where : where + 20] if where >= 0 else read(tail_at + where, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        (at,) = struct.unpack_from("<Q", locator, 8)
        end64 = read(at, 56)
        if end64[:4] != END64:
            raise ValueError("ZIP64 end of central directory is missing")
        n, length, begin = struct.unpack_from("<3Q", end64, 32)
    data, at, members = read(begin, length), 0, {}
    for _ in range(n):
        if data[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", data, at + 10)
        packed, plain = struct.unpack_from("<2I", data, at + 20)
        name_n, extra_n, note_n = struct.unpack_from("<3H", data, at + 28)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + name_n].decode()
        e, stop = at + 46 + name_n, at + 46 + name_n + extra_n
        while e + 4 <= stop:
            tag, width = struct.unpack_from("<2H", data, e)
            if tag == 1:  # 64-bit values, present for those fields that are full, in this order
                f = e + 4
                values = []
                for field in (plain, packed, header):
                    if field == FULL32:
                        values.append(struct.unpack_from("<Q", data, f)[0])
                        f += 8
                    else:
                        values.append(field)
                plain, packed, header = values
            e += 4 + width
        members[name] = (header, packed, method)
        at = stop + note_n
    return members


def member_start(read, header: int) -> int:
    """Where a member's bytes begin, from its local header."""
    head = read(header, 30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack_from("<2H", head, 26)
    return header + 30 + name_n + extra_n


def _fields(lines: str) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.split("\r\n") if ": " in line)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record; a block that is no HTTP message is all payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head.decode())
    block = rest[: int(warc["Content-Length"])]
    if not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http.decode("latin-1")), payload


def index_entry(line: bytes, archives: dict[str, int]) -> dict | None:
    """An entry of an index line: a JSON object, alone or behind a sort key and a time; other lines are none.

    ``filename`` names the archive member that the offset is in; it may be left out if there is one.
    """
    at = line.find(b"{")
    if at < 0 or line.startswith(b"!"):
        return None
    r = json.loads(line[at:])
    if "offset" not in r:
        return None
    name = str(r.get("filename") or next(iter(archives), "")).rpartition("/")[2]
    if name not in archives or "filename" not in r and len(archives) > 1:
        raise ValueError(f"index entry of no archive in the package: {name}")
    return {"id": r.get("id"), "type": r.get("type"), "refers_to": r.get("refers_to"), "start": archives[name] + int(r["offset"]), "length": int(r["length"])}


def read_index(packages: DataFrame) -> DataFrame:
    """Rows (package, id, type, refers_to, start, length) of all records that the packages' indexes list.

    Archives and indexes are found by their names in the central directory. Ids, types and
    references are null where an index of another writer doesn't name them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = _open(uri)
                with files.open_input_file(path) as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    members = {k: m for k, m in central_directory(read, f.size()).items() if ARCHIVES.match(k) or INDEXES.match(k)}
                    if any(method for _, _, method in members.values()):
                        raise ValueError(f"{uri}: members must be stored, not compressed")
                    archives = {k.rpartition("/")[2]: member_start(read, m[0]) for k, m in members.items() if ARCHIVES.match(k)}
                    for name in sorted(k for k in members if INDEXES.match(k)):
                        left = at = member_start(read, members[name][0])
                        size, rest = members[name][1], b""
                        while left < at + size:  # the index in blocks, too
                            block = rest + read(left, min(READ_BYTES, at + size - left))
                            left = min(left + READ_BYTES, at + size)
                            lines, end, rest = block.rpartition(b"\n")
                            if left == at + size:
                                lines, rest = lines + end + rest, b""
                            rows = [r for r in (index_entry(x, archives) for x in lines.splitlines()) if r]
                            yield pa.RecordBatch.from_pydict({
                                "package": [uri] * len(rows), "id": pa.array([r["id"] for r in rows], pa.int64()),
                                "type": pa.array([r["type"] for r in rows], pa.string()), "refers_to": pa.array([r["refers_to"] for r in rows], pa.int64()),
                                "start": pa.array([r["start"] for r in rows], pa.int64()), "length": pa.array([r["length"] for r in rows], pa.int64())
                            })

    return packages.select("package").repartition("package").mapInArrow(run, "package string, id long, type string, refers_to long, start long, length long")


def hex_digest(label: str | None) -> str | None:
    """A SHA-1 label in hex; other writers put it in base 32. None for other digests or none."""
    kind, _, digest = (label or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else digest.lower()


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Fetch the records of an index by byte range (see the module).

    Returns id, url, payload_bytes, payload_digest, record_type, refers_to, and
    the payload (null for revisits) if asked for. Stored digests are checked.
    """

    def ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for r in rows:
            if group and (r[0] != group[0][0] or r[1] - group[-1][1] - group[-1][2] > GAP or r[1] + r[2] - group[0][1] > READ_BYTES):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            for group in ranges(list(zip(*(batch.column(n).to_pylist() for n in ("package", "start", "length"))))):
                if opened != group[0][0]:
                    opened = group[0][0]
                    files, path = _open(opened)
                    f = files.open_input_file(path)
                first = group[0][1]
                data = f.read_at(group[-1][1] + group[-1][2] - first, first)
                out = []
                for _, start, length in group:
                    record = data[start - first : start - first + length]
                    warc, http, payload = parse_record(gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record)
                    kind = warc["WARC-Type"]
                    digest = hex_digest(warc.get("WARC-Payload-Digest"))
                    if kind == "response":
                        found = hashlib.sha1(payload).hexdigest()
                        if digest not in (None, found):
                            raise ValueError(f"{opened}: digest of {warc['WARC-Record-ID']} differs")
                        digest = found
                    row = [
                        warc["WARC-Record-ID"][1:-1], warc.get("WARC-Target-URI"), int(http.get("Content-Length", len(payload))), digest, kind,
                        warc.get("WARC-Refers-To", "<>")[1:-1]
                    ]
                    out.append([*row, payload.decode(errors="replace") if kind == "response" and with_payload else None])
                ids, urls, sizes, digests, kinds, refers, payloads = zip(*out)
                number = lambda x: int(x[8:]) if x.startswith("urn:row:") and x != "urn:row:None" else None
                columns = [
                    pa.array(map(number, ids), pa.int64()), pa.array(urls, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()),
                    pa.array(map(number, refers), pa.int64())
                ]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(payloads, pa.string())] * with_payload)], names)

    # what a task reads is weighed by record bytes, not by the size of the index
    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = min(TASK_BYTES, max(1 << 20, total // (4 * index.sparkSession.sparkContext.defaultParallelism)))
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] * with_payload)]
    placed = index.select("package", "start", "length").repartition(
        -(-total // stretch) or 1, "package", F.floor(F.col("start") / F.lit(stretch))
    ).sortWithinPartitions("package", "start")
    return placed.mapInArrow(
        run, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    out = read_records(materialize(read_index(packages), "index"))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages
), w AS (SELECT payload, max(page_id) AS winner FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN w.winner <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
FROM p LEFT JOIN w ON p.payload = w.payload
"""
