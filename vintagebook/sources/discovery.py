"""Finding the publications: one row per workbook with edition, portfolio and agency."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.functions import fixed as V
from vintagebook.functions.names import base_name, clean_agency, edition_from_path, portfolio_from_path
from vintagebook.functions.years import budget_year_of
from vintagebook.operators.lookups import salted_lookup
from vintagebook.session import stored


def uri_of(root: str) -> str:
    return root if ":/" in root else Path(root).absolute().as_uri()


def scheme_of(root: str) -> str:
    """What stands before the store's own path in the paths of files listed below ``root``."""
    from pyarrow import fs

    base = uri_of(root)
    _, top = fs.FileSystem.from_uri(base)
    return base[: len(base) - len(top)] if base.endswith(top) else "file://"


def _children() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What lists the workbooks and folders directly in each folder; hidden names are passed over, as Spark's readers do.

    It is made anew for each call, so that it travels to the tasks itself and they need no package of this library.
    """
    endings = tuple(f".{e}" for e in V.WORKBOOK_EXTENSIONS)

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch["path"]:
                store, top = fs.FileSystem.from_uri(folder)
                scheme = folder[: len(folder) - len(top)] if folder.endswith(top) else "file://"
                rows = []
                for info in store.get_file_info(fs.FileSelector(top)):
                    inner = info.type == fs.FileType.Directory
                    hidden = info.base_name.startswith(".") or (info.base_name.startswith("_") and "=" not in info.base_name)
                    if not hidden and (inner or info.base_name.endswith(endings)):
                        rows.append((quote(info.path) if inner and scheme == "file://" else info.path, None if inner else info.size, inner))
                yield pd.DataFrame([(scheme + path, size, inner) for path, size, inner in rows], columns=["path", "length", "is_folder"]).astype({"length": "Int64"})

    return children


def listed_workbooks(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every workbook below ``root``. File contents are not read.

    Folders are listed by tasks, level by level; the driver only learns whether there is
    another level, and never holds the files.
    """
    base = uri_of(root)
    folders, found = spark.createDataFrame([(base,)], "path string"), None
    while not folders.isEmpty():
        dealt = folders.repartition(max(8, spark.sparkContext.defaultParallelism), "path")
        level = stored(dealt.mapInPandas(_children(), "path string, length long, is_folder boolean"))
        files = level.where("not is_folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_folder").select("path")
    return found


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below ``root``, a folder that all executors share; how many there are.

    A file gets its name only when it is whole, and a task that runs again writes the same
    files again. The folder may be in any store that Arrow's file systems open.
    """
    base = uri_of(root)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = posixpath.join(top, path)
                store.create_dir(posixpath.dirname(target), recursive=True)
                partial = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(partial) as out:
                    out.write(content)
                store.move(partial, target)
            yield pd.DataFrame({"n": [len(batch)]})

    done = files.select("path", "content").mapInPandas(written, "n long").agg(F.sum("n")).first()[0]
    return int(done or 0)


def below(files: DataFrame, root: str) -> DataFrame:
    """Listed files with their paths as they are below ``root``."""
    name = root.rstrip("/").split("/")[-1]
    return files.withColumn("path", F.substring_index("path", f"/{name}/", -1))


def without_temporary(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(~base_name(F.col(path)).rlike("^(~\\$|\\.)"))


def with_context(files: DataFrame, path: str = "path") -> DataFrame:
    """Add edition, budget_year, portfolio and agency from <edition>/<portfolio>/<workbook>."""
    column = F.col(path)
    return without_temporary(files, path).withColumns({
        "edition": edition_from_path(column),
        "portfolio": portfolio_from_path(column),
        "agency": clean_agency(column),
    }).withColumn("budget_year", budget_year_of(F.col("edition"), any_dash=True))


def borrowed_portfolios(flat_files: DataFrame, other: DataFrame) -> DataFrame:
    """Portfolios for files without a portfolio folder, from the same year's other publication.

    ``flat_files`` has (budget_year, agency), ``other`` also a portfolio; an agency the
    other publication does not have gets "".
    """
    index = other.groupBy("budget_year", "agency").agg(F.max("portfolio").alias("__portfolio"))
    joined = salted_lookup(flat_files, index, ["budget_year", "agency"])
    return joined.withColumn("portfolio", F.coalesce("__portfolio", F.lit(""))).drop("__portfolio")
