"""WARC archives through a chunked record table.

`chunks` turns payloads into rows (record, number, data, last), CHUNK bytes each, JVM-side, so that nothing downstream allocates a
whole record. `digests` streams them in order and carries one incremental SHA-1 per record. `write` streams header and chunks into
WARC/1.1 files, a zstd frame per record, through a filesystem that all executors share; a file has a name of its own for each attempt and
counts only if the manifest, written by Spark, lists it, so lost or repeated tasks leave no trace in the result. `read` streams
the files back block by block and recomputes lengths and digests.

Of records with equal payloads of at least LEAST bytes the one with the largest id is the response, the others are revisits that
refer to it and hold headers alone; smaller payloads are always responses.

Defined results: a null payload is empty; null ids stand last among equal payloads and are written as an empty id (read back as
null); repeated rows give one record each, alike in everything. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import settle
from ledgerscope.sources import scratch

CHUNK, LEAST = 1 << 16, 1000
#: Fixed date of the records, so that reruns write the same bytes.
DATE = "2020-01-01T00:00:00Z"



def chunks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record, copy, page_id, url, size, number, data): the payload of each row in chunks, in order within its task. An empty payload is one empty chunk."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("_payload"))
    # the record id follows from the row, so both passes over the pages name it alike; repeated rows are told apart by copy
    named = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5("_payload")))
    rows = rows.withColumn("record", F.regexp_replace(named, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    rows = rows.withColumns({"copy": F.monotonically_increasing_id(), "size": F.octet_length("_payload").cast("long")})
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / CHUNK) - 1).cast("int"))
    rows = rows.withColumn("number", F.explode(numbers))
    return rows.select("record", "copy", "page_id", "url", "size", "number", F.expr(f"substring(_payload, number * {CHUNK} + 1, {CHUNK})").alias("data"))


def digests(table: DataFrame) -> DataFrame:
    """(record, page_id, size, digest), one row per record, from chunk rows that stand in order within their task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for b in batches:
            out = []
            for record, page, size, number, data in zip(b["record"], b["page_id"].astype(object).where(b["page_id"].notna(), None), b["size"], b["number"], b["data"], strict=True):
                if number == 0:
                    state = hashlib.sha1()
                state.update(data)
                if (number + 1) * CHUNK >= size:
                    out.append((record, page, size, state.hexdigest()))
            yield pd.DataFrame(out, columns=["record", "page_id", "size", "digest"])

    kind = table.schema["page_id"].dataType.simpleString()
    sums = table.select("record", "page_id", "size", "number", "data").mapInPandas(run, f"record string, page_id {kind}, size bigint, digest string")
    return sums.groupBy("record").agg(F.first("page_id").alias("page_id"), F.first("size").alias("size"), F.first("digest").alias("digest"))


def classify(records: DataFrame, least: int = LEAST) -> DataFrame:
    """records: (record, page_id, size, digest). Adds record_type, refers_to and target (the response's record)."""
    best = records.filter(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max(F.struct("page_id", "record")).alias("_best")
    )
    # a third of all rows may share one payload: the group is one row here, and the join can be split
    joined = records.join(best, ["digest", "size"], "left")
    revisit = F.col("_best").isNotNull() & (F.col("_best.record") != F.col("record"))
    return joined.select(
        *records.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_best.page_id")).alias("refers_to"), F.when(revisit, F.col("_best.record")).alias("target"),
    )


def header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{row['record']}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(row['url'] or '').replace(chr(13), ' ').replace(chr(10), ' ')}", f"WARC-Page-ID: {row['page_text'] or ''}",
        f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Payload-Length: {row['size']}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:uuid:{row['target']}>", f"WARC-Refers-To-Page: {row['refers_text'] or ''}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else row['size']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(table: DataFrame, classified: DataFrame, folder: str) -> DataFrame:
    """Manifest (path, records, bytes) of the archives written under folder."""
    heads = classified.select(
        "record", "digest", "record_type", "target", F.col("page_id").cast("string").alias("page_text"), F.col("refers_to").cast("string").alias("refers_text")
    )
    rows = table.join(heads, "record").filter("record_type = 'response' or number = 0")
    rows = rows.sortWithinPartitions("record", "copy", "number")  # the join leaves a record in one task

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = file = path = None
        records = 0
        for b in batches:
            for row in b.to_dict("records"):
                if out is None:
                    system, base = fs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    file = system.open_output_stream(path)
                    out = zstandard.ZstdCompressor(level=1).stream_writer(file, closefd=False)
                if row["number"] == 0:
                    out.write(header(row))
                    records += 1
                if row["record_type"] == "response":
                    out.write(row["data"])
                if row["record_type"] == "revisit" or (row["number"] + 1) * CHUNK >= row["size"]:
                    out.write(b"\r\n\r\n")
                    out.flush(zstandard.FLUSH_FRAME)  # a frame per record
        if out is not None:
            out.close()
            size = file.tell()
            file.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    return settle(rows.mapInPandas(run, "path string, records bigint, bytes bigint"))


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(record, page_text, payload_bytes, payload_digest, record_type, target, refers_text) of every archived record, recomputed from the bytes of responses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"]:
                with system.open_input_stream(path, buffer_size=CHUNK) as raw:
                    out = []
                    for r in records_of(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)):
                        out.append(r)
                        if len(out) == 5000:
                            yield pd.DataFrame(out)
                            out = []
                    if out:
                        yield pd.DataFrame(out)

    files = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")
    return files.mapInPandas(
        run, "record string, page_text string, payload_bytes bigint, payload_digest string, record_type string, target string, refers_text string"
    )


def records_of(stream) -> Iterator[dict]:
    """Records of one archive, CHUNK bytes in memory at a time."""
    held = b""

    def more() -> bytes:
        return stream.read(CHUNK)

    while True:
        while b"\r\n\r\n" not in held:
            got = more()
            if not got:
                if held.strip():
                    raise ValueError("archive ends inside a header")
                return
            held += got
        head, held = held.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        left, digest = int(fields["Content-Length"]), hashlib.sha1()
        while left:
            if not held:
                held = more()
                if not held:
                    raise ValueError("archive ends inside a payload")
            part = held[:left]
            digest.update(part)
            left -= len(part)
            held = held[len(part):]
        while len(held) < 4:
            got = more()
            if not got:
                raise ValueError("archive ends inside a record")
            held += got
        held = held[4:]
        revisit = fields["WARC-Type"] == "revisit"
        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and declared != digest.hexdigest():
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
        name = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">") if x else None
        yield {
            "record": name(fields["WARC-Record-ID"]), "page_text": fields["WARC-Page-ID"] or None,
            "payload_bytes": int(fields["WARC-Payload-Length"] if revisit else fields["Content-Length"]),
            "payload_digest": declared, "record_type": fields["WARC-Type"], "target": name(fields.get("WARC-Refers-To")),
            "refers_text": fields.get("WARC-Refers-To-Page") or None,
        }


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """Write all rows as archives; returns the manifest and the folder."""
    spark = pages.sparkSession
    folder = folder or f"{scratch.folder(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    table = chunks(pages, key, url, html)
    records = digests(table)
    return write(table, settle(classify(records)), folder), folder


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from the archives."""
    manifest, folder = archive(pages, None, key, url, html)
    kind = pages.schema[key].dataType
    back = read(pages.sparkSession, manifest, folder)
    return back.select(
        F.col("page_text").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_text").cast(kind).alias("refers_to")
    )
