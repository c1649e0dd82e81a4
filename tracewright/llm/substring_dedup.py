"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``width`` consecutive words gets a rolling 64-bit hash. The
hashes meet in Spark, bucketed by hash range; a window that also starts in a
document with a smaller doc_id is repeated. Repeated windows of a document are
merged into maximal intervals of words to remove.

Scale. A chunk of documents ships each of its distinct windows once, for the
smallest doc_id of the chunk that has it: all other documents of the chunk
already know that a smaller one exists. A passage in a third of all rows thus
costs one posting a chunk, and no bucket holds more than its share of hashes
plus that. Postings are about nine bytes; the number of buckets follows the
bytes of text. Documents are shuffled once, to meet their intervals.

Defined cases: a null or empty text has no words and loses none; a text shorter
than the window loses nothing; rows with a null doc_id are neither removed from
nor counted; rows that share a doc_id do not remove from each other (they are
the same document), wherever they lie; other columns, of any name, are ignored;
an empty table gives no rows; a text of any length is read whole. Two different
windows have the same hash with probability 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from .shared import n_buckets_for
from .words import U64, chunk_key, chunks, key_bucket

WIDTH = 13
_META, _WINDOWS, _FOUND = 0, 1, 2
_SHIP = "bucket long, chunk long, kind int, data binary"
_BACK = "chunk long, kind int, data binary"


def _ship(width: int, n_buckets: int):
    """Tasks over documents: for each chunk its document table and its windows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(batch.column(1)):
                doc_id, mark = ids[chunk.rows], prints[chunk.rows]
                seen += 1
                key = chunk_key(seen)
                count = np.maximum(chunk.n_words - (width - 1), 0)
                h, doc, _ = chunk.gram_hashes(chunk.word_hashes(), width)
                order = np.argsort(h)
                h, of = h[order], doc_id[doc[order]]
                starts = pk.group_starts(h)
                sizes = np.diff(np.append(starts, len(h)))
                least = np.repeat(np.minimum.reduceat(of, starts), sizes) if len(h) else of
                local = order[of > least]
                ours = of == least
                h, place = h[ours], order[ours]
                base = np.concatenate(([0], np.cumsum(count)))
                meta = pk.planes(count) + doc_id.tobytes() + mark.tobytes() + pk.rising(np.sort(local))
                buckets = pk.bucket_of(h, n_buckets)
                rows = [(key_bucket(key, n_buckets), key, _META, meta)]
                for a, b in pk.runs(buckets):
                    at = place[a:b]
                    docs, which = np.unique(np.searchsorted(base, at, side="right") - 1, return_inverse=True)
                    # the document of a posting follows from its place: only the documents' first places are sent
                    data = pk.rising(h[a:b]) + pk.planes(at) + pk.rising(base[docs]) + _ids(doc_id[docs])
                    rows.append((int(buckets[a]), key, _WINDOWS, data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    names=["bucket", "chunk", "kind", "data"],
                )

    return run


def _ids(ids: np.ndarray) -> bytes:
    """Document ids in byte planes; the sign goes to the lowest bit so that small ids are short."""
    return pk.planes(((ids << 1) ^ (ids >> 63)).view(U64))


def _read_ids(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    z, at = pk.read_planes(blob, at)
    return ((z >> U64(1)) ^ (U64(0) - (z & U64(1)))).view(np.int64), at


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which windows also start in a document with a smaller id, by chunk."""
    out = [(r.chunk, _META, r.data) for r in pdf.itertuples() if r.kind == _META]
    hashes, owners, places, froms, keys = [], [], [], [], []
    for r in pdf.itertuples():
        if r.kind == _WINDOWS:
            h, at = pk.read_rising(r.data)
            place, at = pk.read_planes(r.data, at)
            first, at = pk.read_rising(r.data, at)
            ids, _ = _read_ids(r.data, at)
            hashes.append(h)
            places.append(place)
            owners.append(ids[np.searchsorted(first, place, side="right") - 1])
            froms.append(np.full(len(h), len(keys), dtype=np.int32))
            keys.append(r.chunk)
    if keys:
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        place, where = np.concatenate(places), np.concatenate(froms)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        starts = pk.group_starts(h)
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(h)))) if len(h) else owner
        hit = order[owner > least]
        hit = hit[np.lexsort((place[hit], where[hit]))]
        for a, b in pk.runs(where[hit]):
            out.append((keys[where[hit[a]]], _FOUND, pk.rising(place[hit[a:b]])))
    return pd.DataFrame(out, columns=["chunk", "kind", "data"])


def _intervals(width: int):
    """One chunk: its repeated windows, merged into maximal intervals of words a document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pk.only(pdf.data[pdf.kind == _META])
        count, at = pk.read_planes(meta)
        n = len(count)
        ids = np.frombuffer(meta, np.int64, n, at)
        marks = np.frombuffer(meta, np.int64, n, at + 8 * n)
        found = [pk.read_rising(meta, at + 16 * n)[0], *(pk.read_rising(x)[0] for x in pdf.data[pdf.kind == _FOUND])]
        place = np.unique(np.concatenate(found)).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(count.astype(np.int64))))
        doc = np.searchsorted(base, place, side="right") - 1
        pos = place - base[doc]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width))) if len(doc) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(doc))[: len(begin)] - 1
        rows = {}
        for d, a, b in zip(doc[begin], pos[begin], pos[last] + width, strict=True):
            rows.setdefault(d, []).append((a, b))
        return pd.DataFrame(
            [(ids[d], marks[d], [int(a) for a, _ in v], [int(b) for _, b in v]) for d, v in rows.items()],
            columns=["doc_id", "mark", "starts", "ends"],
        )

    return run


def repeated_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, starts, ends): maximal word intervals to remove, for documents that have any."""
    n_buckets = n_buckets_for(docs)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("doc_id is not null")
    base = base.select(F.col("doc_id").cast("long"), "text", "mark")
    shipped = base.mapInArrow(_ship(width, n_buckets), _SHIP)
    met = shipped.repartition(n_buckets // 2, "bucket").groupBy("bucket").applyInPandas(_meet, _BACK)
    spans = met.groupBy("chunk").applyInPandas(_intervals(width), "doc_id long, mark long, starts array<long>, ends array<long>")
    return spans.dropDuplicates(["doc_id", "mark"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their intervals: the words that stay."""
    for batch in batches:
        ids = batch.column(0)
        starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for chunk in chunks(batch.column(1)):
            raw, out = chunk.raw.tobytes(), []
            for d, row in enumerate(chunk.rows):
                a, b = chunk.first[d], chunk.first[d + 1]
                keep = np.ones(b - a, dtype=bool)
                for s, e in zip(starts[row] or (), ends[row] or (), strict=True):
                    keep[s:e] = False
                at = a + np.flatnonzero(keep)
                kept = b" ".join([raw[s:e] for s, e in zip(chunk.starts[at].tolist(), chunk.ends[at].tolist(), strict=True)])
                out.append((int(b - a), int(b - a - len(at)), kept.decode()))
            n, gone, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(chunk.rows)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every document without its repeated windows."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    spans = repeated_intervals(docs, width)
    joined = base.join(spans.hint("merge"), ["doc_id", "mark"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return remove_repeats(docs, width).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB, over the same tables.
SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS p)),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
hit AS (SELECT g.doc_id, g.p FROM g JOIN m USING (g) WHERE m.least < g.doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM hit) GROUP BY doc_id),
pos AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS q FROM w),
gq AS (SELECT doc_id, unnest(qs) AS q FROM gone),
kept AS (
  SELECT pos.doc_id, coalesce(string_agg(pos.w[pos.q], ' ' ORDER BY pos.q) FILTER (WHERE gq.q IS NULL AND pos.q > 0), '') AS kept
  FROM pos LEFT JOIN gq ON pos.doc_id = gq.doc_id AND pos.q = gq.q GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.qs), 0) AS BIGINT) AS n_removed, sha256(kept.kept) AS kept_sha256
FROM w JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
