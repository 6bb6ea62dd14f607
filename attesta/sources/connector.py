"""A Spark data source over recorded service answers.

``spark.read.format("recorded").option("path", folder).option("kind", "summary").load()`` gives id and
payload of every ``<kind>-<id>.json`` or ``.xml`` in a folder, a partition per file. A live fetcher
has the same shape; it would pace its calls and retry them where this one opens files.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, WAIT_S = 3, 0.5
PACE_S, KEYED_PACE_S = 0.35, 0.12


def pace(has_key: bool) -> float:
    """Seconds between calls to a service."""
    return KEYED_PACE_S if has_key else PACE_S


def with_retry(call: Callable[[], str], attempts: int = ATTEMPTS, wait: float = WAIT_S) -> str:
    """The call's result; a failure is tried again after a growing wait."""
    for attempt in range(attempts):
        try:
            return call()
        except OSError:
            if attempt == attempts - 1:
                raise
            time.sleep(wait * (attempt + 1))
    raise AssertionError


class _File(InputPartition):
    def __init__(self, id: str, path: str):
        super().__init__(id)
        self.id, self.path = id, path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str):
        self._folder, self._kind = folder, kind

    def partitions(self) -> list[InputPartition]:
        start = f"{self._kind}-"
        names = sorted(n for n in os.listdir(self._folder) if n.startswith(start) and n.endswith((".json", ".xml")))
        return [_File(os.path.splitext(n)[0][len(start) :], os.path.join(self._folder, n)) for n in names]

    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        def fetch() -> str:
            with open(partition.path, encoding="utf-8") as file:
                return file.read()

        yield partition.id, with_retry(fetch)


class RecordedSource(DataSource):
    """Answers of a literature service, recorded as files in a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind", "summary"))


def register(spark) -> None:
    spark.dataSource.register(RecordedSource)
