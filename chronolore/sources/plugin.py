"""Episode readers as Spark data sources: a reader in Python becomes spark.read.format(name)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolore import schemas


class Part(InputPartition):
    def __init__(self, value: str) -> None:
        self.value = value


def register_reader(spark: SparkSession, name: str, parts: Callable[[dict], list[str]], read: Callable[[str, dict], Iterator[tuple]]) -> None:
    """Registers utterances (schemas.UTTERANCES) from a source of one's own: parts lists what tasks read independently, read yields its rows."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def partitions(self) -> list[Part]:
            return [Part(p) for p in parts(self.options)]

        def read(self, partition: Part) -> Iterator[tuple]:
            yield from read(partition.value, self.options)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schemas.UTTERANCES

        def reader(self, schema) -> Reader:
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
