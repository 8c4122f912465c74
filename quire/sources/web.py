"""Pages over HTTP, as a data source: spark.read.format("quire_web").

    spark.dataSource.register(WebSource)
    spark.read.format("quire_web").option("urls", "https://a.example/\\nhttps://b.example/x").load()

Options: urls (one on each line; for a table of addresses use ``fetch``, which gives the same rows), timeout, size_cap (bytes), per_host,
waits (seconds before each new try, comma-separated) and private ("true" to allow addresses of local networks).

Hosts are partitions; of one host no more than per_host requests run at once.  Answers 429, 502, 503 and 504 and
broken connections are tried again after each of the waits, or as long as Retry-After says, up to LONGEST_WAIT.  Redirects are
followed up to REDIRECTS times, and every hop's address is judged before it is asked.  Every address gives a row; what fails has its error.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, content_type string, final_url string, body binary, tries int, error string"
# How the web is asked.
SIZE_CAP, TIMEOUT, PER_HOST, REDIRECTS, WAITS, LONGEST_WAIT = 20_000_000, 30.0, 4, 10, (1.0, 2.0), 15.0
AGAIN, MOVED = frozenset((429, 502, 503, 504)), frozenset((301, 302, 303, 307, 308))
AGENT = "Mozilla/5.0 (compatible; quire)"


class Refused(ValueError):
    """An address that must not be asked, or an answer that can't be taken."""


class Fetcher:
    def __init__(self, timeout: float = TIMEOUT, size_cap: int = SIZE_CAP, waits: tuple[float, ...] = WAITS, private: bool = False):
        self.timeout, self.size_cap, self.waits, self.private = timeout, size_cap, waits, private

    def judged(self, url: str) -> tuple[str, str, int, str, str]:
        """Scheme, host, port, path and the one network address that will be asked; private networks are refused."""
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise Refused(f"not an address of the web: {url[:200]}")
        port = parts.port or (443 if parts.scheme == "https" else 80)
        found = socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)
        for *_, at in found:
            if not self.private and not ipaddress.ip_address(at[0].partition("%")[0]).is_global:
                raise Refused(f"{parts.hostname} is in a private network")
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        return parts.scheme, parts.hostname, port, path, found[0][4][0]

    def ask(self, url: str) -> tuple[int, dict[str, str], bytes]:
        scheme, host, port, path, at = self.judged(url)
        # the judged address is connected to, so a second look-up can't give another one
        link = http.client.HTTPConnection(host, port, timeout=self.timeout)
        link.sock = socket.create_connection((at, port), self.timeout)
        if scheme == "https":
            link.sock = ssl.create_default_context().wrap_socket(link.sock, server_hostname=host)
        try:
            link.request("GET", path, headers={"User-Agent": AGENT, "Accept": "*/*", "Connection": "close"})
            answer = link.getresponse()
            body = answer.read(self.size_cap + 1)
            if len(body) > self.size_cap:
                raise Refused(f"larger than {self.size_cap} bytes")
            return answer.status, {k.lower(): v for k, v in answer.getheaders()}, body
        finally:
            link.close()

    def patient(self, url: str, tries: list[int]) -> tuple[int, dict[str, str], bytes]:
        """One address, again after each wait where the server is busy or the connection breaks."""
        for wait in (*self.waits, None):
            tries[0] += 1
            try:
                status, headers, body = self.ask(url)
            except (OSError, http.client.HTTPException):
                if wait is None:
                    raise
            else:
                if status not in AGAIN or wait is None:
                    return status, headers, body
                told = headers.get("retry-after", "")
                wait = min(float(told), LONGEST_WAIT) if told.isdigit() else wait
            time.sleep(wait)
        raise AssertionError("unreachable")

    def row(self, url: str | None) -> dict:
        out = {"url": url, "status": None, "content_type": None, "final_url": None, "body": None, "tries": 0, "error": None}
        tries, here = [0], url or ""
        try:
            for _ in range(REDIRECTS + 1):
                status, headers, body = self.patient(here, tries)
                if status not in MOVED or not headers.get("location"):
                    break
                here = urljoin(here, headers["location"])
            else:
                raise Refused(f"more than {REDIRECTS} redirects")
            out |= {"status": status, "content_type": headers.get("content-type"), "final_url": here, "body": body}
            if status >= 400:
                out |= {"body": None, "error": f"HTTP {status}"}
        except (Refused, OSError, http.client.HTTPException, ValueError) as e:
            out["error"] = f"{type(e).__name__}: {e}"
        return out | {"tries": tries[0]}

    def rows(self, urls: list[str | None], per_host: int) -> Iterator[dict]:
        with ThreadPoolExecutor(per_host) as pool:
            yield from pool.map(self.row, urls)


def _fetcher(options: dict) -> tuple[Fetcher, int]:
    waits = options.get("waits")
    waits = WAITS if waits is None else tuple(float(w) for w in waits.split(",") if w.strip())
    made = Fetcher(float(options.get("timeout", TIMEOUT)), int(options.get("size_cap", SIZE_CAP)), waits, str(options.get("private", "")).lower() == "true")
    return made, int(options.get("per_host", PER_HOST))


class Host(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Host]:
        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(u.strip() for u in self.options.get("urls", "").split("\n")):
            if url:
                hosts.setdefault((urlsplit(url).hostname or "").lower(), []).append(url)
        return [Host(urls) for urls in hosts.values()] or [Host([])]

    def read(self, partition: Host) -> Iterator[tuple]:
        fetcher, per_host = _fetcher(self.options)
        for row in fetcher.rows(partition.value, per_host):
            yield tuple(row.values())


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def fetch(pages: DataFrame, url: str = "url", **options) -> DataFrame:
    """The rows of quire_web for a table of addresses: each address once, all of a host in one task, so that the limit by host holds."""
    from quire.functions.url import site_key
    from quire.runtime import ship

    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        fetcher, per_host = _fetcher(options)
        kinds = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("final_url", pa.string()), ("body", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])
        for batch in batches:
            urls = batch["url"].to_pylist()
            for at in range(0, len(urls), per_host * 4):  # bodies of a few pages at a time
                yield pa.RecordBatch.from_pylist(list(fetcher.rows(urls[at : at + per_host * 4], per_host)), kinds)

    dealt = pages.select(F.col(url).alias("url")).distinct().repartition(F.coalesce(site_key(F.col("url")), F.lit("")))
    return dealt.sortWithinPartitions("url").mapInArrow(run, SCHEMA)
