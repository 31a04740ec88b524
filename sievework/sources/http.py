"""A bounded HTTP source: one partition for each approved request, no redirects, capped bytes.

    spark.dataSource.register(BoundedHttp)
    spark.read.format("bounded_http").option("urls", json.dumps(urls)).option("host", "api.example.org").load()
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from urllib.parse import parse_qs, urlencode, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sievework.schemas import struct
from sievework.sources.documents import SourceError

MAX_BYTES = 2 << 20
CHUNK_BYTES = 64 << 10


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def export_url(base: str, lo: str, hi: str, size: int, limit: int = 100_000) -> str:
    """The request of one shard's rows, in the order of their creation."""
    if not 1 <= size < limit:
        raise SourceError("count_invalid", count=size)
    return f"{base}?" + urlencode({"date_received_min": lo, "date_received_max": hi, "format": "json", "has_narrative": "true", "no_aggs": "true", "no_highlight": "true", "size": size, "sort": "created_date_asc"})


def check_url(url: str, host: str, path: str | None = None, query: dict[str, str] | None = None, scheme: str = "https") -> None:
    """Refuse any URL but the approved one: scheme, host, path, default port, exact query."""
    parts = urlsplit(url)
    try:
        port = parts.port
    except ValueError as error:
        raise SourceError("url_refused") from error
    sound = parts.scheme == scheme and parts.hostname == host and parts.username is None and parts.password is None and not parts.fragment
    sound &= scheme != "https" or port in (None, 443)
    sound &= path is None or parts.path == path
    sound &= query is None or parse_qs(parts.query, keep_blank_values=True) == {k: [v] for k, v in query.items()}
    if not sound:
        raise SourceError("url_refused")


def body(url: str, host: str, *, scheme: str = "https", seconds: float = 600) -> Iterator[bytes]:
    """The chunks of one response that is JSON and not redirected; nothing is held."""
    check_url(url, host, scheme=scheme)
    request = urllib.request.Request(url, headers={"Accept": "application/json"})
    try:
        with urllib.request.build_opener(_NoRedirect()).open(request, timeout=seconds) as response:
            if response.status != 200 or response.headers.get_content_type() not in ("application/json", "text/json"):
                raise SourceError("response_refused", status=response.status)
            while chunk := response.read(CHUNK_BYTES):
                yield chunk
    except OSError as error:
        raise SourceError("response_interrupted") from error


class _Request(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads(options["urls"])
        self.host, self.scheme = options["host"], options.get("scheme", "https")
        self.limit, self.seconds = int(options.get("maxbytes", MAX_BYTES)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        for url in self.urls:
            check_url(url, self.host, scheme=self.scheme)
        return [_Request(url) for url in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        request = urllib.request.Request(partition.url, headers={"Accept": "application/json"})
        with urllib.request.build_opener(_NoRedirect()).open(request, timeout=self.seconds) as response:
            kind = response.headers.get_content_type()
            if response.status != 200 or not (kind == "application/json" or kind.endswith("+json")):
                raise SourceError("response_refused", status=response.status)
            raw = response.read(self.limit + 1)
        if len(raw) > self.limit:
            raise SourceError("response_byte_limit_exceeded", limit=self.limit)
        yield partition.url, response.status, len(raw), hashlib.sha256(raw).hexdigest(), raw.decode()


class BoundedHttp(DataSource):
    """url, status, byte_count, sha256 and document of each response."""

    @classmethod
    def name(cls) -> str:
        return "bounded_http"

    def schema(self) -> StructType:
        return struct("url string, status int, byte_count long, sha256 string, document string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
