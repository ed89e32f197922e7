"""Symbol extraction over frames of source files, in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.extract import extract

UNIT_ROWS = "file_path string, language string, name string, kind string, signature string, doc string, content string, parent string, line_start int, line_end int, position int, error string"
_NAMES = [f.strip().split()[0] for f in UNIT_ROWS.split(",")]
_TYPES = {"int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _TYPES[f.strip().split()[1]]) for n, f in zip(_NAMES, UNIT_ROWS.split(","), strict=True)])


def extract_rows(files: DataFrame) -> DataFrame:
    """Units of files (file_path, language, content), and one row with ``error`` for each file that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, language, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    for place, unit in enumerate(extract(content or b"", language)):
                        out.append({"file_path": path, "language": language, "position": place, "error": None, **vars(unit)})
                except (UnicodeDecodeError, KeyError, RecursionError) as failed:
                    out.append({"file_path": path, "language": language, "error": f"{type(failed).__name__}: {failed}"})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return files.select("file_path", "language", F.col("content").cast("binary").alias("content")).mapInArrow(run, UNIT_ROWS)


def extract_units(files: DataFrame) -> DataFrame:
    """The units of all files that could be read."""
    return extract_rows(files).where("error is null").drop("error")
