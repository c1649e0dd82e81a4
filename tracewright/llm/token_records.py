"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A folder holds shards. ``part-N.records`` is a row of records, each framed as

    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of the payload

(little-endian; the mask turns the checksum right by 15 bits and adds a constant,
so that a checksum over data that holds checksums stays sound). A payload is
``i64 doc_id | u8 1 if doc_id is null | u8 width | ids of width bytes``; the width is
two where every id of the vocabulary fits, else four. ``part-N.index`` has 16 bytes a
record, ``u64 offset of the record | u64 ids of the shard before it``, and one more such
entry for the end, so record k is found without reading others.

Documents are in ascending doc_id order over all shards, by range partitions: the text
is shuffled once, ties are dealt by the text and then by place, so that no id can make a
partition too large. A task streams its documents into one shard, under names of its
attempt that are moved at the end; a task that runs again writes the same bytes. A text
is cut before white space, where a byte-level vocabulary's pattern cuts anyway, and each
piece is encoded by the tokenizers library once a worker while it stays in a bounded
table; other vocabularies, and texts with white space other than ASCII's, take whole texts.

Defined cases: null and empty texts have the end id alone; a null doc_id is kept as
null and comes first; rows that share a doc_id are each a record, ordered by a hash of
their texts; a text of any length is one record; strings of special tokens in a text are
ordinary text; other columns are ignored; an empty table gives no shards and no rows.
A record whose frame or checksum is wrong stops the read with an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import n_partitions, shared_folder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Pieces of text that a worker keeps encoded, and the longest of them in characters.
KNOWN_PIECES = 1_200_000
KNOWN_CHARS = 64
#: Characters of text encoded, and bytes of records read, at a time.
CHUNK_CHARS = 1 << 20
RANGE_BYTES = 8 << 20

#: Cuts are before white space, and between Latin letters and what ASCII has of other signs (an apostrophe begins pieces of its own).
_PIECE = re.compile(r"[\t-\r ]*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[!-&(-/:-@\[-`{-~\t-\r ])|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_OTHER_GAPS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_DOC = struct.Struct("<qBB")
_ENTRY = np.dtype([("at", "<u8"), ("ids", "<u8")])


# checksums


def _table(bits: int) -> np.ndarray:
    """CRC-32C (reflected polynomial 0x82F63B78) of every value of so many bits."""
    x = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Of two bytes; and of a state after _LANE zero bytes, by each of its bytes."""
    two = _table(16)
    shift = []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_LANE // 2):
            state = two[state & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
        shift.append(state)
    return two, shift


_LANE = 256


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each blob. All blobs are cut into lanes that numpy takes side by side.

    The checksum is linear: zeros before a blob leave a zero state, the initial state is
    added to its first four bytes, and a blob's lanes join by shifting over one lane.
    """
    if not blobs:
        return np.zeros(0, np.uint32)
    two, shift = _tables()
    size = np.array([max(len(b), 4) for b in blobs])
    lanes = -(-size // _LANE)
    last = np.cumsum(lanes)
    data = np.zeros(int(last[-1]) * _LANE, np.uint8)
    begin = last * _LANE - size
    for b, at in zip(blobs, begin.tolist(), strict=True):
        data[at : at + len(b)] = np.frombuffer(b, np.uint8)
    head = begin[:, None] + np.arange(4)
    data[head] ^= np.uint8(255)
    cells = np.ascontiguousarray(data.view("<u2").reshape(-1, _LANE // 2).T)
    state = np.zeros(cells.shape[1], np.uint32)
    for row in cells:
        state = two[(state ^ row) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    order = np.argsort(-lanes, kind="stable")
    out = np.zeros(len(blobs), np.uint32)
    first, many = (last - lanes)[order], lanes[order]
    for k in range(int(lanes.max())):
        n = int(np.searchsorted(-many, -k, side="left"))
        x = out[:n]
        out[:n] = shift[0][x & 255] ^ shift[1][(x >> 8) & 255] ^ shift[2][(x >> 16) & 255] ^ shift[3][x >> 24] ^ state[first[:n] + k]
    result = np.empty_like(out)
    result[order] = out ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > np.array([len(b) for b in blobs])):
        # a blob below four bytes has no place for the initial state
        c = 0xFFFFFFFF
        for byte in blobs[k]:
            c = int(_small()[(c ^ byte) & 255]) ^ (c >> 8)
        result[k] = c ^ 0xFFFFFFFF
    return result


@lru_cache(1)
def _small() -> np.ndarray:
    return _table(8)


def masked(checksum: np.ndarray) -> np.ndarray:
    c = checksum.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


# encoding


class Encoder:
    """Texts as little-endian ids. vocabulary is a file's path, or the name of one of public_tokenizers."""

    def __init__(self, vocabulary: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.isabs(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            # every piece comes once: the library's own table of words only costs time
            model._resize_cache(0)
            self.tokenizer.model = model
        # cuts are sound for this pattern of byte-level vocabularies alone
        parts = json.loads(self.tokenizer.to_str())
        rule = parts["pre_tokenizer"] or {}
        self.cuts = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space") and not parts["normalizer"]
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.code, self.width = ("H", 2) if top < 1 << 16 else ("I", 4)
        self.end = b"" if end_id is None else self._bytes([end_id])
        self.known: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _pieces(self, text: str) -> list[str]:
        return _PIECE.findall(text) if self.cuts and not _OTHER_GAPS.search(text) else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        met: set[str] = set()
        for pieces in cut:
            met.update(pieces)
        new = [p for p in met if p not in self.known]
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = self._bytes(found.ids)
        out = [b"".join(map(self.known.__getitem__, pieces)) + self.end for pieces in cut]
        for piece in new:
            if len(piece) > KNOWN_CHARS:
                del self.known[piece]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        return out


@lru_cache(2)
def encoder(vocabulary: str, end_id: int | None) -> Encoder:
    return Encoder(vocabulary, end_id)


# writing


def frames(doc_ids: list[int | None], ids: list[bytes], width: int) -> list[bytes]:
    payloads = [_DOC.pack(d or 0, d is None, width) + x for d, x in zip(doc_ids, ids, strict=True)]
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(sizes)).tolist(), masked(crc32c(payloads)).tolist()
    return [n + struct.pack("<I", h) + p + struct.pack("<I", t) for n, h, p, t in zip(sizes, heads, payloads, tails, strict=True)]


def _in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t or "")
            size += len(texts[-1])
            if size > CHUNK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int | None = END_ID) -> int:
    """Write the shards of docs(doc_id, text) under folder, in doc_id order; the number of records."""

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, draft = f"{path}/part-{task.partitionId():06d}", f"{path}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        at, before, index, out = 0, 0, [], None
        for doc_ids, texts in _in_chunks(batches):
            if out is None:
                code = encoder(vocabulary, end_id)
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{draft}.records")
            ids = code.encode(texts)
            framed = frames(doc_ids, ids, code.width)
            size, count = np.array([len(f) for f in framed]), np.array([len(x) // code.width for x in ids])
            entries = np.empty(len(framed), _ENTRY)
            entries["at"], entries["ids"] = at + np.cumsum(size) - size, before + np.cumsum(count) - count
            index.append(entries.tobytes())
            at, before = at + int(size.sum()), before + int(count.sum())
            out.write(b"".join(framed))
        if out is not None:
            out.close()
            index.append(np.array([(at, before)], _ENTRY).tobytes())
            with system.open_output_stream(f"{draft}.index") as file:
                file.write(b"".join(index))
            for kind in ("records", "index"):
                system.move(f"{draft}.{kind}", f"{name}.{kind}")
        yield pd.DataFrame({"n": [sum(map(len, index)) // _ENTRY.itemsize - 1 if index else 0]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids beyond 2**53 must not pass through floating point, as a nullable column of pandas would
    return rows.select(F.col("doc_id").cast("string"), "text").mapInPandas(store, "n long").agg(F.sum("n")).first()[0] or 0


# reading


def _open(path: str):
    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(name)


def _entries(path: str, first: int, n: int) -> np.ndarray:
    with _open(path) as file:
        file.seek(first * _ENTRY.itemsize)
        return np.frombuffer(file.read(n * _ENTRY.itemsize), _ENTRY)


def unframed(data: bytes, at: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the records that start at at[:-1] and end at at[1:], all checksums checked."""
    bounds = at.tolist()
    heads = [data[a : a + 8] for a in bounds[:-1]]
    bodies = [data[a + 12 : b - 4] for a, b in zip(bounds, bounds[1:], strict=False)]
    said = [struct.unpack_from("<I", data, a + 8)[0] for a in bounds[:-1]], [struct.unpack_from("<I", data, b - 4)[0] for b in bounds[1:]]
    if [struct.unpack("<Q", h)[0] for h in heads] != [len(b) for b in bodies]:
        raise ValueError("a record's length is not that of its place in the index")
    if masked(crc32c(heads)).tolist() != said[0] or masked(crc32c(bodies)).tolist() != said[1]:
        raise ValueError("a record's checksum is wrong")
    for b in bodies:
        doc_id, missing, width = _DOC.unpack_from(b)
        yield None if missing else doc_id, np.frombuffer(b, f"<u{width}", offset=_DOC.size)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n, bytes, first_id): the shards under folder, how many records and bytes each has, and the ids in all shards before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.index").load(folder).select("path", "length")

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["length"] // _ENTRY.itemsize - 1
            end = [_entries(p, int(k), 1)[0] for p, k in zip(batch["path"], n, strict=True)]
            yield pd.DataFrame({"path": batch["path"], "n": n, "bytes": [int(e["at"]) for e in end], "ids": [int(e["ids"]) for e in end]})

    found = files.mapInPandas(tail, "path string, n long, bytes long, ids long")
    # one row a shard: a single task adds them up
    before = F.coalesce(F.sum("ids").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.select("path", "n", "bytes", before.alias("first_id"))


def _cut(found: DataFrame, range_bytes: int) -> DataFrame:
    """(path, first_id, first, last): ranges of records of about range_bytes."""
    step = F.greatest(F.floor(F.col("n") * range_bytes / F.greatest("bytes", F.lit(1))), F.lit(1)).cast("long")
    cut = found.where("n > 0").select("path", "first_id", "n", step.alias("step"))
    cut = cut.select("path", "first_id", "n", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("step"))).alias("first"))
    return cut.select("path", "first_id", "first", F.least(F.col("first") + F.col("step"), "n").alias("last"))


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every record; without ids only their number and checksum leave the tasks."""
    schema = "doc_id string, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first_id, first, last in zip(*[batch[c] for c in ("path", "first_id", "first", "last")], strict=True):
                entries = _entries(path, int(first), int(last - first) + 1)
                with _open(path.removesuffix("index") + "records") as file:
                    k = 0
                    while k + 1 < len(entries):
                        # so many records as range_bytes hold, one at least
                        m = max(k + 1, int(np.searchsorted(entries["at"], entries["at"][k] + np.uint64(range_bytes), side="right")) - 1)
                        at = entries["at"][k : m + 1].astype(np.int64)
                        file.seek(int(at[0]))
                        found = list(unframed(file.read(int(at[-1] - at[0])), at - at[0]))
                        out = {
                            "doc_id": pd.Series([None if d is None else str(d) for d, _ in found], dtype=object),
                            "start": int(first_id) + entries["ids"][k:m].astype(np.int64),
                            "n_tokens": [len(x) for _, x in found],
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for _, x in found],
                        }
                        yield pd.DataFrame(out | ({"ids": [x.astype(np.int32) for _, x in found]} if with_ids else {}))
                        k = m

    cut = _cut(shards(spark, folder), range_bytes)
    rows = cut.repartition(n_partitions(spark), "path", "first").mapInPandas(scan, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_shuffled(spark: SparkSession, folder: str, seed: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(place, doc_id, ids) of every record in an order that depends on the seed alone: only entries of the index are shuffled."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first, last in zip(batch["path"], batch["first"], batch["last"], strict=True):
                at = _entries(path, int(first), int(last - first) + 1)["at"].astype(np.int64)
                yield pd.DataFrame({"path": path, "at": at[:-1], "until": at[1:]})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            taken: dict[int, tuple] = {}
            rows = {c: batch[c].tolist() for c in batch}
            # each file is opened once a batch, and read at ascending places
            by_path = sorted(range(len(batch)), key=lambda k: (rows["path"][k], rows["at"][k]))
            name, file = None, None
            for k in by_path:
                if rows["path"][k] != name:
                    name = rows["path"][k]
                    if file is not None:
                        file.close()
                    file = _open(name.removesuffix("index") + "records")
                file.seek(rows["at"][k])
                size = rows["until"][k] - rows["at"][k]
                taken[k] = next(unframed(file.read(size), np.array([0, size])))
            if file is not None:
                file.close()
            order = range(len(batch))
            doc_id = pd.Series([None if taken[k][0] is None else str(taken[k][0]) for k in order], dtype=object)
            yield pd.DataFrame({"place": batch["place"], "doc_id": doc_id, "ids": [taken[k][1].astype(np.int32) for k in order]})

    cut = _cut(shards(spark, folder), range_bytes * 64)
    found = cut.repartition(n_partitions(spark), "path", "first").mapInPandas(entries, "path string, at long, until long")
    name = F.element_at(F.split("path", "/"), -1)
    found = found.withColumn("place", F.xxhash64(F.lit(seed), name, "at"))
    found = found.repartitionByRange("place", name, "at").sortWithinPartitions("place", name, "at")
    return found.mapInPandas(fetch, "place long, doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def write_and_read(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs written as shards in the shared folder and read back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if re.match(r"\w+:/", folder) else f"file://{folder}"
    if not write(docs, folder, vocabulary):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, with_ids=False)
