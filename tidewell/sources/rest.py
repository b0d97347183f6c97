"""REST source: a Python data source with one partition per start address.

    spark.dataSource.register(RestSource)
    spark.read.format("rest_json").option("urls", "http://..,http://..").load()

Options: method, headers (JSON), auth (bearer:TOKEN, api-key:NAME:VALUE,
basic:USER:PASSWORD), body, json_path (dots and list indexes), next_field
(dotted path of the next page's address), max_pages (none: all pages; a source that
goes beyond a given number fails rather than being cut in silence).
Rows are (url, payload): one JSON record each, parsed by :func:`records`.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.parse import urljoin
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

def extract(value: object, path: str | None) -> object:
    """Follow a dotted path through objects and lists; null where it ends early."""
    for part in (path or "").split("."):
        if not part:
            continue
        if isinstance(value, list):
            value = value[int(part)] if part.lstrip("-").isdigit() and -len(value) <= int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def auth_headers(auth: str | None) -> dict[str, str]:
    kind, _, rest = (auth or "").partition(":")
    if kind == "bearer":
        return {"Authorization": f"Bearer {rest}"}
    if kind == "api-key":
        key, _, value = rest.partition(":")
        return {key: value}
    if kind == "basic":
        return {"Authorization": "Basic " + base64.b64encode(rest.encode()).decode()}
    return {}


class _Start(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [_Start(u.strip()) for u in self.options["urls"].split(",") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        o, url = self.options, partition.url
        headers = json.loads(o.get("headers", "{}")) | auth_headers(o.get("auth"))
        body = o.get("body")
        most, seen = int(o["max_pages"]) if o.get("max_pages") else None, 0
        while True:
            if seen == most:
                raise ValueError(f"{partition.url}: more than max_pages={most} pages")
            seen += 1
            request = Request(url, data=body.encode() if body else None, headers=headers, method=o.get("method", "GET").upper())
            with urlopen(request, timeout=float(o.get("timeout", "30"))) as answer:
                page = json.load(answer)
            found = extract(page, o.get("json_path"))
            for record in found if isinstance(found, list) else [found]:
                if record is not None:
                    yield url, json.dumps(record)
            following = extract(page, o.get("next_field")) if o.get("next_field") else None
            if not following:
                return
            url = urljoin(url, str(following))


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_json"

    def schema(self) -> str:
        return "url string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def paged(df: DataFrame, rows: int) -> Iterator[list]:
    """The rows of a table page by page, as a service would send them; the driver holds one page."""
    page: list = []
    for r in df.toLocalIterator():
        page.append(r)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page


def records(payloads: DataFrame, schema: str | None = None) -> DataFrame:
    """Records as flat columns; without a schema it is inferred from the payloads."""
    from tidewell.sources.io import flatten

    if schema is None:
        found = payloads.select(F.schema_of_variant_agg(F.try_parse_json("payload"))).first()[0]
        schema = found.replace("OBJECT<", "STRUCT<")
    return flatten(payloads.select(F.from_json("payload", schema).alias("r")).select("r.*"))
