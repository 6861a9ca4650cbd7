"""Tables rebuilt in whole steps: generations of folders, and a pointer that moves last.

    root/generation=<id>/edition=<edition>/part files
    root/manifests/<number>.json    which generation holds each edition, and the columns

A rebuild writes the affected editions into a new generation and then one new manifest,
under a temporary name that is changed last. Readers follow the manifest of the highest
number, so they see the table before or after the rebuild and nothing between; what a
failed rebuild left behind is in no manifest. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vintagebook.sources.store import PARTITION, rebuilt_rows

GENERATION = "generation"


def _place(root: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":/" in root else Path(root).absolute().as_uri())


def _newest(root: str) -> dict | None:
    from pyarrow import fs

    store, top = _place(root)
    listed = store.get_file_info(fs.FileSelector(f"{top}/manifests", allow_not_found=True))
    names = sorted(i.base_name for i in listed if i.is_file and i.base_name.endswith(".json"))
    if not names:
        return None
    with store.open_input_stream(f"{top}/manifests/{names[-1]}") as file:
        return json.loads(file.read())


def _publish(root: str, manifest: dict) -> None:
    """Make a manifest the current one: it gets its name when it is whole."""
    store, top = _place(root)
    store.create_dir(f"{top}/manifests", recursive=True)
    partial = f"{top}/manifests/{uuid.uuid4().hex}.partial"
    with store.open_output_stream(partial) as out:
        out.write(json.dumps(manifest).encode())
    store.move(partial, f"{top}/manifests/{manifest['number']:012d}.json")


def _write_generation(df: DataFrame, root: str, generation: str) -> list[str]:
    """Write rows by edition into a new generation; the names of its edition folders."""
    from pyarrow import fs

    df.hint("rebalance", PARTITION).write.partitionBy(PARTITION).parquet(f"{root}/{GENERATION}={generation}")
    store, top = _place(root)
    return [i.base_name for i in store.get_file_info(fs.FileSelector(f"{top}/{GENERATION}={generation}")) if i.base_name.startswith(f"{PARTITION}=")]


def _edition(folder: str) -> str:
    return unquote(folder.split("=", 1)[1])


def create_table(df: DataFrame, root: str) -> None:
    """The whole table as one generation."""
    generation, before = uuid.uuid4().hex, _newest(root)
    folders = _write_generation(df, root, generation)
    _publish(root, {"number": before["number"] + 1 if before else 1, "schema": df.schema.jsonValue(), "parts": dict.fromkeys(folders, generation)})


def _read(spark: SparkSession, root: str, manifest: dict, editions: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{root}/{GENERATION}={g}/{f}" for f, g in sorted(manifest["parts"].items()) if editions is None or _edition(f) in editions]
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(StructType([*schema.fields, StructField(GENERATION, StringType())])).option("basePath", root).parquet(*paths)
    return found.select(*schema.names)


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The table as its newest manifest says; a frame read before a rebuild keeps showing the table before."""
    manifest = _newest(root)
    if manifest is None:
        raise FileNotFoundError(f"no table at {root}")
    return _read(spark, root, manifest)


def rebuild(spark: SparkSession, root: str, fresh: DataFrame, editions: Sequence[str] = (), files: DataFrame | None = None) -> None:
    """Rebuild some editions or files; other editions are neither read nor written.

    Only the names of affected editions, a few dozen at most, reach the driver.
    """
    manifest = _newest(root)
    if manifest is None:
        raise FileNotFoundError(f"no table at {root}")
    columns, listed = StructType.fromJson(manifest["schema"]).names, set(editions)
    if files is not None:
        names = files.select("source_file").distinct()
        rows = _read(spark, root, manifest).select(PARTITION, "source_file").unionByName(fresh.select(PARTITION, "source_file"))
        listed |= {r[PARTITION] for r in rows.join(names, "source_file", "left_semi").select(PARTITION).distinct().collect()}
    if not listed:
        return
    replaced = rebuilt_rows(_read(spark, root, manifest, listed), fresh.select(*columns), editions, files)
    generation = uuid.uuid4().hex
    folders = _write_generation(replaced, root, generation)
    kept = {f: g for f, g in manifest["parts"].items() if _edition(f) not in listed}
    _publish(root, {**manifest, "number": manifest["number"] + 1, "parts": kept | dict.fromkeys(folders, generation)})


def drop_unused(root: str) -> int:
    """Delete generations and manifests that the newest manifest doesn't need, once nobody reads them; how many generations went."""
    from pyarrow import fs

    manifest = _newest(root)
    store, top = _place(root)
    used = {f"{GENERATION}={g}" for g in manifest["parts"].values()}
    idle = [i.path for i in store.get_file_info(fs.FileSelector(top)) if i.base_name.startswith(f"{GENERATION}=") and i.base_name not in used]
    for path in idle:
        store.delete_dir(path)
    for i in store.get_file_info(fs.FileSelector(f"{top}/manifests")):
        if i.base_name != f"{manifest['number']:012d}.json":
            store.delete_file(i.path)
    return len(idle)
