"""The cells table: the grid of every sheet in long form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.schemas import CELLS
from vintagebook.sources.discovery import listed_workbooks, scheme_of, uri_of, without_temporary

Cell = tuple[str, int, int, int, str, float | None]
_DECODED = CELLS + ", status string, error string"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELLS).parquet(path)


def _rows_of(decoder: Callable[[bytes], Iterable[Cell]]) -> Callable[[str, Callable[[], bytes]], pd.DataFrame]:
    """What makes the cells of a file, or one error row where it can't be read or decoded; it travels to the tasks itself."""
    names = [field.strip().split(" ")[0] for field in _DECODED.split(",")]

    def rows_of(path: str, content: Callable[[], bytes]) -> pd.DataFrame:
        try:
            rows = [(path, *cell, "ok", None) for cell in decoder(content())]
        except Exception as problem:  # noqa: BLE001 - any failure of a file is a result, not a crash
            rows = [(path, None, None, None, None, None, None, "error", repr(problem))]
        return pd.DataFrame(rows, columns=names)

    return rows_of


def decoded_files(files: DataFrame, decoder: Callable[[bytes], Iterable[Cell]]) -> DataFrame:
    """Decode (path, content) rows to cells; a file that fails becomes one error row and the rest goes on."""
    rows_of = _rows_of(decoder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield rows_of(path, lambda content=content: content)

    return files.select("path", "content").mapInPandas(decode, _DECODED)


def decoded_workbooks(
    spark: SparkSession, root: str, decoder: Callable[[bytes], Iterable[Cell]]
) -> DataFrame:
    """Decode every workbook below ``root``, a folder that all executors share.

    Folders are listed and files read by tasks, one file at a time, so that the driver holds none of
    them; a file that can't be read is an error row like one that can't be decoded.
    """
    rows_of, base, start = _rows_of(decoder), uri_of(root), len(scheme_of(root))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(base)

        def content(path: str) -> bytes:
            with store.open_input_stream(path[start:], compression=None) as file:
                return file.read()

        for batch in batches:
            for path in batch["path"]:
                yield rows_of(path, lambda path=path: content(path))

    files = without_temporary(listed_workbooks(spark, root)).select("path")
    # paths are short and the work behind them long, so they are dealt by number
    dealt = files.repartition(4 * max(8, spark.sparkContext.defaultParallelism), "path")
    return dealt.mapInPandas(decode, _DECODED)


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, errors)."""
    cells = decoded.where(F.col("status") == "ok").drop("status", "error")
    return cells, decoded.where(F.col("status") == "error").select("source_file", "error")
