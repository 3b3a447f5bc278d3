"""User-defined sources and sinks: an initializer decides the splits at run time and readers run one split
each; writers stage what they write and a committer makes all of it visible, or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomflow.runtime import open_path, ship


class TermSplit(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class TermReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.rows, self.splits = int(options.get("rows", "20")), max(1, int(options.get("splits", "2")))

    def partitions(self) -> list[TermSplit]:
        step = -(-self.rows // self.splits) or 1
        return [TermSplit(a, min(a + step, self.rows)) for a in range(0, max(self.rows, 1), step)]

    def read(self, partition: TermSplit) -> Iterator[tuple[str]]:
        for i in range(partition.first, partition.last):
            yield (f"term{i}",)


class TermSource(DataSource):
    """``spark.read.format('terms').option('rows', n).option('splits', k)``: term0, term1, ..."""

    @classmethod
    def name(cls) -> str:
        return "terms"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: object) -> TermReader:
        return TermReader(self.options)


class Staged(WriterCommitMessage):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows


class LineWriter(DataSourceWriter):
    """Each task writes a file of lines into a staging folder; ``commit`` moves the files of the tasks that count,
    so files of attempts that were given up never show."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, rows: Iterator) -> Staged:
        files, at = open_path(f"{self.path}.__staged-{self.job}")
        files.create_dir(at, recursive=True)
        name, n = f"{at}/part-{uuid.uuid4().hex}.txt", 0
        with files.open_output_stream(name) as out:
            for row in rows:
                out.write(("" if row[0] is None else str(row[0])).encode() + b"\n")
                n += 1
        return Staged(name, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, at = open_path(self.path)
        if self.overwrite and files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)
        files.create_dir(at, recursive=True)
        for i, m in enumerate(x for x in messages if x is not None and x.rows):
            files.move(m.path, f"{at}/part-{self.job}-{i:05}.txt")
        self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, at = open_path(f"{self.path}.__staged-{self.job}")
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_dir(at)


class LineSink(DataSource):
    """``df.write.format('lines').mode('append').save(path)``: the first column as lines of text."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: object, overwrite: bool) -> LineWriter:
        return LineWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TermSource)
    spark.dataSource.register(LineSink)
