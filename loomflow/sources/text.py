"""Text sources: lines with their file, and with their byte offset."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomflow.operators.running import carried
from loomflow.runtime import open_path, ship

#: Bytes of a file that are read at once.
RANGE_BYTES = 32 << 20


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line, file) of text files, split as Spark splits them."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_lines_with_offsets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, offset, line): ``offset`` is the byte at which a line starts in its file.

    Files of any size are read in ranges of RANGE_BYTES by as many tasks; a line is of the range that it
    starts in. Lines end at LF or CRLF; bytes that aren't UTF-8 are replaced. Empty files
    give no rows.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("begin"))
    width = RANGE_BYTES
    default = spark.conf.get("spark.hadoop.fs.defaultFS", None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                system, at = open_path(path, default)
                starts, lines = [], []
                with system.open_input_file(at) as source:
                    # A line that starts before the range is of the range before: one byte back, its end is skipped.
                    source.seek(max(begin - 1, 0))
                    reader = io.BufferedReader(source, 1 << 20)
                    here = begin if begin == 0 else begin - 1 + len(reader.readline())
                    while here < begin + width and (raw := reader.readline()):
                        starts.append(here)
                        lines.append(raw.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                        here += len(raw)
                        if len(lines) >= 10_000:
                            yield rows_of(path, starts, lines)
                            starts, lines = [], []
                if lines:
                    yield rows_of(path, starts, lines)

    def rows_of(path: str, starts: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], names=["file", "offset", "line"])

    spread = ranges.repartition("path", "begin")  # a task has few ranges, also of one large file
    return spread.mapInArrow(read, "file string, offset long, line string")


def read_sequence_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) strings of sequence files. The format has no columnar reader, so rows pass
    through Python one by one; convert such inputs to Parquet once."""
    pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (str(kv[0]), str(kv[1])))
    return spark.createDataFrame(pairs, "key string, value string")


def split_container_log(lines: DataFrame, order: Sequence[str], header: str = r"^Container: (\S+) on (\S+)$", file_header: str = r"^LogType:(\S+)$") -> DataFrame:
    """Splits an aggregated container log: each line with the container, node and log type of the
    headers before it. ``lines`` has ``file``, ``line`` and the ``order`` columns, which
    number the lines of a file; lines ahead of a header have nulls; header lines are left out. A file
    too large for one task is cut into ranges; see ``running``."""
    found = lambda pattern, k: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k))
    out = lines.withColumns({"container": found(header, 1), "node": found(header, 2), "log_type": found(file_header, 1)})
    is_header = F.col("line").rlike(header) | F.col("line").rlike(file_header)
    return carried(out, ["file"], order, ["container", "node", "log_type"]).where(~is_header)
