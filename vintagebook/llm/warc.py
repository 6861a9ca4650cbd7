"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page, every task writes its range as files that roll by
compressed size, with one gzip member per record and headers and digests made anew
from the payload. A file is written under a temporary name of its attempt and moved
to its final name when whole; the files that count are those in the manifest, written
last. A task that is run again writes the same files again.

Of equal payloads of ``LEAST`` bytes or more that of the smallest page is stored, the
others refer to it.

Defined cases: a null html is an empty payload; a null url leaves the target header
out; a null page id sorts first and is written as an empty header; rows that repeat
the smallest page id of a payload are all responses; an empty table gives an empty
manifest. The shared folder may be in any store that Arrow's file systems open.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintagebook.llm.common import bounded_batches
from vintagebook.session import ensure_checkpoint_dir

#: Payloads shorter than this are never revisits.
LEAST = 100
#: Compressed size at which a file is closed.
ROLL = 32 << 20
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller page stores. No payload is shuffled for it."""
    own = pages.select("page_id", F.sha2(_payload(), 256).alias("digest")).where(F.octet_length(_payload()) >= LEAST)
    first = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = own.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return found.select("page_id", "digest", "refers_to").distinct()


def _line(name: str, value: object) -> bytes:
    return f"{name}: {value}\r\n".encode("utf-8", "surrogatepass")


def record_bytes(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record, uncompressed, a revisit if it refers to a page; its digests and lengths come from the payload."""
    record_type = "response" if refers_to is None else "revisit"
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", len(payload)) + b"\r\n"
    block = http if record_type == "revisit" else http + payload
    lines = [b"WARC/1.1\r\n", _line("WARC-Type", record_type)]
    lines.append(_line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}|{url}|{digest}|{record_type}')}>"))
    lines.append(_line("WARC-Date", DATE))
    if url is not None:
        lines.append(_line("WARC-Target-URI", " ".join(url.split())))
    lines.append(_line("WARC-Payload-Digest", f"sha256:{digest}"))
    lines.append(_line("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    if record_type == "revisit":
        lines.append(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.append(_line("X-Refers-To-Page", refers_to))
    lines.append(_line("X-Page", "" if page_id is None else page_id))
    lines.append(_line("Content-Type", "application/http; msgtype=response"))
    lines.append(_line("Content-Length", len(block)))
    return b"".join([*lines, b"\r\n", block, b"\r\n\r\n"])


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` as archives in ``folder`` and commit its manifest (file, records, bytes, sha256), which is returned.

    A page that is a revisit has a row of its own that says so and sorts just before it,
    so that payloads are moved once, by the sort.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _opened(folder)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        state: dict = {"n": 0, "told": None}

        def close() -> pd.DataFrame:
            state["out"].close()
            name = f"part-{shard:06d}-{state['n']:06d}.warc.gz"
            store.move(state["temporary"], f"{root}/{name}")
            row = {"file": [name], "records": [state["records"]], "bytes": [state["bytes"]], "sha256": [state["sha"].hexdigest()]}
            state.pop("out")
            state["n"] += 1
            return pd.DataFrame(row)

        for batch in batches:
            for page_id, digest, url, payload, refers_to in zip(*(batch[c] for c in ("page_id", "digest", "url", "payload", "refers_to"))):
                if payload is None:
                    state["told"] = (page_id, digest, refers_to)
                    continue
                told = state["told"]
                refers_to = told[2] if told and told[:2] == (page_id, digest) else None
                data = _member(record_bytes(page_id, url, payload, refers_to))
                if "out" not in state:
                    temporary = f"{root}/_temporary/{shard}-{attempt}-{state['n']}-{uuid.uuid4().hex}"
                    state |= {"temporary": temporary, "out": store.open_output_stream(temporary, compression=None), "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                state["out"].write(data)
                state["sha"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= roll:
                    yield close()
        if "out" in state:
            yield close()

    spark = pages.sparkSession
    store, root = _opened(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    stored_ones = pages.select("page_id", F.sha2(_payload(), 256).alias("digest"), "url", _payload().alias("payload"), F.lit(None).cast("long").alias("refers_to"))
    told = revisits(pages).select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), F.col("refers_to").cast("long"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["page_id", "digest", F.col("payload").isNotNull(), "url"]
    ordered = stored_ones.unionByName(told).repartitionByRange(shards, "page_id", "digest").sortWithinPartitions(*order)
    # ids travel as text, so that a null among them doesn't make numbers of floats
    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    manifest = bounded_batches(ordered.select(*as_text, "digest", "url", "payload")).mapInPandas(written, "file string, records long, bytes long, sha256 string")
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest.new")
    store.move(f"{root}/manifest.new", f"{root}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def records_in(data: Iterator[bytes]) -> Iterator[bytes]:
    """The members of a gzip stream, one record each."""
    unpacker, parts = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = b""
            if unpacker.eof:
                yield b"".join(parts)
                chunk, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("an archive ends within a record")


def parsed(record: bytes) -> dict:
    """Fields of one record; raises if its lengths or digests don't hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(rest) != len(block) + 4 or hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("a block doesn't match its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its header")
    return {
        "page_id": headers["X-Page"] or None, "url": headers.get("WARC-Target-URI"), "payload": payload if headers["WARC-Type"] == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": headers.get("X-Refers-To-Page"),
    }


_FIELDS = {"page_id": "string", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "string"}


def read_archives(spark: SparkSession, folder: str, columns: tuple[str, ...] = tuple(_FIELDS)) -> DataFrame:
    """The records of the archives that the folder's manifest names; a file is read by one task, in pieces."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _opened(folder)
        for batch in batches:
            for name in batch["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for record in records_in(iter(lambda: file.read(1 << 20), b"")):
                        row = parsed(record)
                        rows.append({c: row[c] for c in columns})
                        held += len(record)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=list(columns))
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=list(columns))

    manifest = spark.read.parquet(f"{folder}/manifest").select("file")
    # a number of its own: file names are so few bytes that they would be read by one task
    manifest = manifest.repartition(max(1, manifest.count()), "file")
    schema = ", ".join(f"{c} {_FIELDS[c]}" for c in columns)
    found = bounded_batches(manifest).mapInPandas(read, schema)
    for c in ("page_id", "refers_to"):
        if c in columns:
            found = found.withColumn(c, F.col(c).cast("long"))
    return found


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = folder or f"{as_uri(ensure_checkpoint_dir(spark))}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return read_archives(spark, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
