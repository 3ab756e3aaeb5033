"""Where payloads go and come from. A transport has three calls; the one here keeps them as Parquet in a folder."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.sources import files


@dataclass(frozen=True)
class Endpoints:
    """Addresses that a connection string stands for."""

    check: str
    upload: str
    authentication: str | None

    def with_token(self, token: str) -> Endpoints:
        """The same addresses with a token in place of what there was; it is never written to a file."""
        return replace(self, authentication=f"token={token}")

    def with_apikey(self, key: str) -> Endpoints:
        return replace(self, authentication=f"apikey={key}")


def endpoints(connection: str, site_id: bytes, prefix: str = "v1/changes", default_port: str = "443", legacy_port: str = "8860", aliases: tuple[str, ...] = ()) -> Endpoints:
    """scheme://host[:port]/database[?apikey=...|token=...] to the check and upload addresses of a site; aliases are schemes that mean https."""
    for alias in aliases:
        if connection.startswith(f"{alias}://"):
            connection = "https://" + connection.removeprefix(f"{alias}://")
    parts = urlsplit(connection)
    if not parts.scheme or not parts.hostname or not parts.path.strip("/"):
        raise ValueError("a connection string is scheme://host[:port]/database")
    port = str(parts.port or default_port)
    port = default_port if port == legacy_port else port
    check = f"{parts.scheme}://{parts.hostname}:{port}/{prefix}{parts.path}/{site_id.hex()}"
    query = dict(parse_qsl(parts.query))
    secret = next((f"{k}={query[k]}" for k in ("apikey", "token") if k in query), None)
    return Endpoints(check, f"{check}/upload", secret)


class Transport(ABC):
    """What carries payloads between replicas."""

    @abstractmethod
    def upload(self, payloads: DataFrame, site_id: bytes) -> None:
        """Publish payloads (a column ``payload``, with cursors) of a site as one batch, wholly or not at all."""

    @abstractmethod
    def pending(self, site_id: bytes, last: dict[str, int]) -> list[tuple[str, int]]:
        """(site, number) of the complete batches of other sites beyond the last number of each, in order."""

    @abstractmethod
    def download(self, batches: list[tuple[str, int]]) -> DataFrame:
        """Payloads of those batches."""


class FolderTransport(Transport):
    """Batches as Parquet folders ``<number>-<site>`` on any file system that Spark reads; a batch counts once it is complete.

    Each site numbers its own batches, and uploads one after another, so a reader's cursor for each site misses none, whichever
    site's upload ends first.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[tuple[str, int, str]]:
        names = [n for n in files.names(self.spark, self.path) if n.split("-")[0].isdigit()]
        return sorted((n.split("-")[1], int(n.split("-")[0]), n) for n in names)

    def upload(self, payloads: DataFrame, site_id: bytes) -> None:
        number = max([0, *(n for site, n, _ in self._batches() if site == site_id.hex())]) + 1
        payloads.write.parquet(f"{self.path}/{number:012d}-{site_id.hex()}")

    def pending(self, site_id: bytes, last: dict[str, int]) -> list[tuple[str, int]]:
        beyond = [(site, n, name) for site, n, name in self._batches() if site != site_id.hex() and n > last.get(site, 0)]
        return [(site, n) for site, n, name in beyond if files.exists(self.spark, f"{self.path}/{name}/_SUCCESS")]

    def download(self, batches: list[tuple[str, int]]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{number:012d}-{site}" for site, number in batches)).select(F.col("payload"))
