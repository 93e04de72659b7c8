"""Live positions, one partition for each line, and snapshots that outlive a failing feed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

ATTEMPTS, BACKOFF_S, TIMEOUT_S = 2, 0.25, 10.0


class FeedError(RuntimeError):
    """A feed's answer that is no answer; status 0 where the network failed."""

    def __init__(self, url: str, status: int):
        super().__init__(f"{url}: {status}")
        self.status = status


def fetch(url: str, attempts: int = ATTEMPTS, pause: float = BACKOFF_S, opened: Callable = urllib.request.urlopen) -> object:
    """The JSON at an address; tried again after a pause, but not where the request itself was refused."""
    for attempt in range(1, attempts + 1):
        try:
            with opened(url, timeout=TIMEOUT_S) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            error = FeedError(url, e.code)
            if 400 <= e.code < 500:
                raise error from e
        except (OSError, ValueError) as e:
            error = FeedError(url, 0)
            error.__cause__ = e
        if attempt < attempts:
            time.sleep(pause * attempt)
    raise error


class Line(InputPartition):
    def __init__(self, route_id: str):
        super().__init__(route_id)


class PositionsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.routes = options["url"], [r for r in options["routes"].split(",") if r]

    def partitions(self) -> list[InputPartition]:
        return [Line(r) for r in self.routes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        answer = fetch(self.url.replace("{route}", partition.value))
        for v in (answer or {}).get("data") or []:
            plate = (v.get("Name") or "").strip() or f"{partition.value}:{v.get('Lat')},{v.get('Lon')}"
            yield partition.value, plate, v.get("Lat"), v.get("Lon"), v.get("Status")


class Positions(DataSource):
    """Options: url, with {route} in it, and routes, comma-separated; each line is asked for by its own task."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def schema(self) -> str:
        return "route_id string, plate string, lat double, lon double, status int"

    def reader(self, schema) -> DataSourceReader:
        return PositionsReader(self.options)


def positions(spark: SparkSession, url: str, routes: list[str]) -> DataFrame:
    spark.dataSource.register(Positions)
    return spark.read.format("positions").option("url", url).option("routes", ",".join(routes)).load()


class Snapshots:
    """Versions of a table in a shared folder. A version is good for a while; where a new one fails the last good one stands."""

    def __init__(self, spark: SparkSession, folder: str, ttl_s: float, failed_ttl_s: float = 5.0):
        self.spark, self.folder, self.ttl_s, self.failed_ttl_s = spark, folder, ttl_s, min(ttl_s, failed_ttl_s)
        self.failed: tuple[float, Exception] | None = None

    def versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/index")
        except AnalysisException:
            return None

    def newest(self) -> tuple[float, str] | None:
        index = self.versions()
        row = index.orderBy(F.col("at").desc()).first() if index is not None else None
        return (row["at"], row["path"]) if row else None

    def load(self, make: Callable[[], DataFrame], now: float) -> DataFrame:
        """The table as of now; ``make`` is called only where no version is fresh and it has not just failed."""
        last = self.newest()
        if last and now - last[0] < self.ttl_s:
            return self.spark.read.parquet(last[1])
        if not (self.failed and now - self.failed[0] < self.failed_ttl_s):
            path = f"{self.folder}/v-{int(now * 1000):015d}"
            try:
                make().write.mode("overwrite").parquet(path)
                self.spark.createDataFrame([(float(now), path)], "at double, path string").coalesce(1).write.mode("append").parquet(f"{self.folder}/index")
                self.failed = None
                return self.spark.read.parquet(path)
            except Exception as e:  # noqa: BLE001  (whatever the feed does, the last good version stands)
                self.failed = (now, e)
        if last:
            return self.spark.read.parquet(last[1])
        raise self.failed[1]
