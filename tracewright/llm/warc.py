"""WARC archives: a writer with revisit records, and a splittable reader.

Writer. Each page is one gzip member that holds one WARC record. Of pages with
equal payloads of at least ``MIN_REVISIT`` bytes, the one with the largest
page_id is a response; the others are revisits that name it.

Reader. Files are cut into byte ranges, one row of a DataFrame each. A task
looks in its range for the gzip magic (1f 8b 08); a candidate counts if the
member decodes, begins with a WARC version line and ends with a right CRC and as
many bytes as its Content-Length says. A task owns the records that start inside
its range and reads past its end to finish the last; the magic inside compressed
data fails these tests. After a valid member the search goes on at its end.

Scale. Pages are shuffled once, to meet the narrow table of duplicates, so that
a payload shared by a third of all pages is only counted by partial sums. Each
task streams its pages to one file, written under a temporary name and moved,
so a task that runs again leaves one whole file. Ranges have a fixed size; a
task holds one range and one member. Any file system that pyarrow.fs knows will do.

Defined cases: a null html is an empty payload, a null url has no target, a null
page_id is kept as null; of rows with the same payload and the same largest
page_id each is a response; empty tables give no files and no rows; repeated rows
each give a record; other columns are ignored; a payload of any length is one
record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import n_partitions, shared_folder

MIN_REVISIT = 1000
RANGE_BYTES = 4 << 20
_MAGIC = re.compile(rb"\x1f\x8b\x08")
_STEP = 256 << 10
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long"


def _member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compress_level: int) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}")
    head += [f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    body = payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        body = b""
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(compress_level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse(record: bytes) -> dict | None:
    """The row of a decoded member, None if it is no whole WARC record."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not field.get("content-length", "").isdigit() or len(rest) != int(field["content-length"]) + 4:
        return None
    number = lambda k: int(field[k]) if k in field else None
    body, kind = rest[:-4], field.get("warc-type")
    whole = kind != "revisit"
    return {
        "page_id": number("x-page-id"),
        "url": field["warc-target-uri"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if "warc-target-uri" in field else None,
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "payload": body if whole else None,
        "payload_digest": hashlib.sha1(body).hexdigest() if whole else field.get("warc-payload-digest", "").removeprefix("sha1:"),
        "payload_bytes": len(body) if whole else number("x-payload-length"),
    }


def duplicates(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another one."""
    narrow = pages.where(F.length("payload") >= MIN_REVISIT).select("page_id", "digest").where("page_id is not null")
    most = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(most, "digest").where("page_id < refers_to").distinct()


def write(pages: DataFrame, folder: str, compress_level: int = 6) -> int:
    """Write one archive a task under folder; the number of records."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    rows = full.join(duplicates(full).hint("merge"), ["page_id", "digest"], "left")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}"
        n, out, draft = 0, None, f"{path}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*[batch[c] for c in batch], strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(draft)
                as_int = lambda x: None if pd.isna(x) else int(x)
                out.write(_member(as_int(page_id), url, bytes(body), digest, as_int(refers_to), compress_level))
                n += 1
        if out is not None:
            out.close()
            system.move(draft, f"{name}.warc.gz")
        yield pd.DataFrame({"n": [n]})

    # ids beyond 2**53 must not pass through floating point, as a nullable column of pandas would
    narrow = rows.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return narrow.mapInPandas(store, "n long").agg(F.sum("n")).first()[0] or 0


def ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, first, last): byte ranges of all archives under folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    return files.select("path", "length", first.alias("first")).select("path", "first", F.least(F.col("first") + range_bytes, "length").alias("last"))


def owned_records(file, first: int, last: int) -> Iterator[dict]:
    """Records whose member starts in [first, last) of an open file."""
    file.seek(first)
    data = file.read(last - first + 2)
    at = 0
    while (m := _MAGIC.search(data, at)) and m.start() < last - first:
        if len(data) - m.start() < _STEP:
            # a member's first bytes may need all of its code tables to decode
            file.seek(first + len(data))
            data += file.read(_STEP)
        z = zlib.decompressobj(31)
        parts, ok = [], True
        try:
            start = z.decompress(data[m.start() : m.start() + _STEP], 64)
            ok = start[:5] == b"WARC/"
            if ok:
                parts = [start, z.decompress(z.unconsumed_tail)]
                fed = min(m.start() + _STEP, len(data))
                while not z.eof:
                    if fed == len(data):
                        # past the range: the member goes on there
                        file.seek(first + len(data))
                        more = file.read(_STEP)
                        if not more:
                            break
                        data += more
                    piece = data[fed : fed + _STEP]
                    parts.append(z.decompress(piece))
                    fed += len(piece)
        except zlib.error:
            ok = False
        row = parse(b"".join(parts)) if ok and z.eof else None
        if row is None:
            at = m.start() + 1
        else:
            yield row
            at = fed - len(z.unused_data)


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """All records under folder. Without payloads only their lengths and digests leave the tasks."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, last in zip(batch["path"], batch["first"], batch["last"], strict=True):
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                rows: list[dict] = []
                with system.open_input_file(name) as file:
                    for row in owned_records(file, int(first), int(last)):
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) == 500:
                            yield _frame(rows)
                            rows = []
                if rows:
                    yield _frame(rows)

    cut = ranges(spark, folder, range_bytes)
    cut = cut.repartition(4 * n_partitions(spark), "path", "first")
    return cut.mapInPandas(scan, _RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in rows[0]})
    return out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})


def archive_and_read(pages: DataFrame) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if re.match(r"\w+:/", folder) else f"file://{folder}"
    if not write(pages, folder):
        return spark.createDataFrame([], _RECORDS).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB, over the same table.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS most FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < most THEN most END AS refers_to
FROM m
"""
