"""Raw documents: whole files keyed by name, pages, id lists, and a data source over an injected fetcher."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, modified, value) of every file under `path`; name is the file's without its extension."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), r"\.[^.]*$", "")
    return files.select(F.col("_metadata.file_path").alias("path"), name.alias("name"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def fresh_files(files: DataFrame, now, ttl_days: int) -> DataFrame:
    """Cached files that are younger than the time to live."""
    return files.where(F.col("modified") >= F.date_sub(now, ttl_days))


def lookup(files: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """Each wanted key with its file's text, null where there is none."""
    return wanted.join(files.select(key, "value"), key, "left")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) per line of a text file, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' and not startswith(id, '#')")


class FetchedDocuments(DataSource):
    """`spark.read.format("fetched").option(...)`: documents by id through a callable given at registration.

    The ids are dealt over partitions; a failed fetch gives a row with `error` instead of failing the job.
    """

    fetch: Callable[[str], str] = staticmethod(lambda ident: "")

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return "id string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FetchReader(self.options, type(self).fetch)


class _FetchReader(DataSourceReader):
    def __init__(self, options, fetch) -> None:
        self.ids = [x for x in options.get("ids", "").split(",") if x]
        self.parts, self.tries, self.fetch = int(options.get("partitions", "4")), int(options.get("tries", "3")), fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(min(self.parts, max(1, len(self.ids))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for ident in self.ids[partition.value :: self.parts]:
            error = ""
            for _ in range(self.tries):
                try:
                    yield ident, self.fetch(ident), None
                    break
                except Exception as problem:  # noqa: BLE001  any fetcher's failure is data here
                    error = f"{type(problem).__name__}: {problem}"
            else:
                yield ident, None, error


def register_fetcher(spark: SparkSession, fetch: Callable[[str], str]) -> None:
    """Makes `fetch` the source of format "fetched"."""
    spark.dataSource.register(type("FetchedDocuments", (FetchedDocuments,), {"fetch": staticmethod(fetch)}))
