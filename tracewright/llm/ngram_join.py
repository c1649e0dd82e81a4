"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

1. Count. The distinct n-grams of every document are shipped as 48-bit hashes,
   bucketed by hash range, and counted over all documents. The global order of
   n-grams is (document count, hash): rare ones first. N-grams of a single
   document go no further, they cannot be shared.
2. Survive. A document that shares fewer n-grams than the threshold needs of its
   own set has no partner. Documents with equal sets become one class.
3. Candidates. Two linked sets share an n-gram among the first
   ``n - ceil(t * n) + 1`` of both in the global order (prefix filter), their
   sizes are within the threshold, and enough n-grams follow the first they
   share. Groups that share a prefix n-gram give their pairs if they are small.
   The members of large groups are dealt to blocks, and pairs of blocks are
   compared; each gives a spanning forest of its links, so no link between
   components is lost and no group gives all its pairs.
4. Vertical partitioning. The global order is cut into fragments; the overlap of
   a pair is counted fragment by fragment, and summed per pair.
5. Components of the links, by the smallest doc_id.

Scale. Postings are about six bytes; only n-grams that occur twice come back.
No group is collected: hot n-grams are last in the order, so prefixes avoid
them. False equalities of 48-bit hashes only admit candidates or change the
order; inside one compared pair they have a chance of n * n / 2**48.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; a text of fewer words than the n-gram has one n-gram, its
whole sequence; rows with a null doc_id are left out; of rows that share a
doc_id the one with the largest set decides; other columns are ignored; an empty
table gives no rows; a text of any length is read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from .components import components
from .shared import let, n_buckets_for, written
from .words import U64, chunk_key, chunks, key_bucket, mix

N_WORDS, PERCENT = 5, 80
#: Groups of up to so many give their pairs; larger ones are compared in blocks of about BLOCK documents.
SMALL_GROUP = 8
BLOCK = 256
FAMILY = 4096
FRAGMENT_COLUMNS = 4096
_META, _GRAMS = 0, 1
_BITS = 48
_SHIP = "bucket long, chunk long, kind int, data binary"
_BACK = "chunk long, kind int, data binary"
_SETS = "doc_id long, n long, sig binary, n_shared long, grams array<long>, counts array<long>"


def _per_doc(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of values by document; doc ascends."""
    total = np.zeros(n, dtype=U64)
    if len(doc):
        at = pk.group_starts(doc)
        total[doc[at]] = np.add.reduceat(values, at)
    return total


def _ship(n_words: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(batch.column(1)):
                doc_id = ids[chunk.rows]
                n_docs = len(doc_id)
                words = chunk.word_hashes(fold_case=True)
                h, doc, _ = chunk.gram_hashes(words, n_words)
                short = np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < n_words))
                h = np.concatenate((h, chunk.whole_hashes(words)[short]))
                doc = np.concatenate((doc, short))
                once = np.unique(mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
                h, doc = h[once], doc[once].astype(np.int32)
                by_doc = np.argsort(doc, kind="stable")
                n = np.bincount(doc, minlength=n_docs)
                sig = [_per_doc(doc[by_doc], mix(h[by_doc] ^ U64(k)), n_docs) for k in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                order = np.argsort(h)
                h, doc = h[order] >> U64(64 - _BITS), doc[order]
                seen += 1
                key = chunk_key(seen)
                meta = pk.planes(n) + doc_id.tobytes() + sig[0].tobytes() + sig[1].tobytes()
                rows = [(key_bucket(key, n_buckets), key, _META, meta)]
                buckets = pk.bucket_of(h, n_buckets, _BITS)
                rows += [(int(buckets[a]), key, _GRAMS, pk.rising(h[a:b]) + pk.planes(doc[a:b])) for a, b in pk.runs(buckets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                    names=["bucket", "chunk", "kind", "data"],
                )

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the n-grams of two documents or more, with their counts, back to their chunks."""
    out = [(r.chunk, _META, r.data) for r in pdf.itertuples() if r.kind == _META]
    hashes, docs, froms, keys = [], [], [], []
    for r in pdf.itertuples():
        if r.kind == _GRAMS:
            h, at = pk.read_rising(r.data)
            hashes.append(h)
            docs.append(pk.read_planes(r.data, at)[0].astype(np.int32))
            froms.append(np.full(len(h), len(keys), dtype=np.int32))
            keys.append(r.chunk)
    if keys:
        h, doc, where = np.concatenate(hashes), np.concatenate(docs), np.concatenate(froms)
        order = np.argsort(h)
        starts = pk.group_starts(h[order])
        size = np.diff(np.append(starts, len(h)))
        count = np.repeat(size, size)
        order, count = order[count > 1], count[count > 1]
        back = np.argsort(where[order], kind="stable")
        order, count = order[back], count[back]
        for a, b in pk.runs(where[order]):
            at = order[a:b]
            out.append((keys[where[at[0]]], _GRAMS, pk.rising(h[at]) + pk.planes(doc[at]) + pk.planes(count[a:b])))
    return pd.DataFrame(out, columns=["chunk", "kind", "data"])


def _sets(percent: int):
    """One chunk: a row per document, with its shared n-grams in global order if it may have a partner."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pk.only(pdf.data[pdf.kind == _META])
        n, at = pk.read_planes(meta)
        k = len(n)
        ids = np.frombuffer(meta, np.int64, k, at)
        sigs = [np.frombuffer(meta, np.uint8, 8 * k, at + 8 * k * j).reshape(k, 8) for j in (1, 2)]
        sig = np.hstack(sigs)
        grams, docs, counts = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, U64)]
        for data in pdf.data[pdf.kind == _GRAMS]:
            h, at = pk.read_rising(data)
            d, at = pk.read_planes(data, at)
            grams.append(h)
            docs.append(d)
            counts.append(pk.read_planes(data, at)[0])
        g, d, c = np.concatenate(grams), np.concatenate(docs).astype(np.int64), np.concatenate(counts)
        shared = np.bincount(d, minlength=k)
        n = n.astype(np.int64)
        may = (n > 0) & (100 * shared >= percent * n)
        keep = may[d]
        g, d, c = g[keep].astype(np.int64), d[keep], c[keep].astype(np.int64)
        order = np.lexsort((g, c, d))
        g, d, c = g[order], d[order], c[order]
        g_of, c_of = [None] * k, [None] * k
        for a, b in pk.runs(d):
            g_of[d[a]], c_of[d[a]] = g[a:b], c[a:b]
        return pd.DataFrame({"doc_id": ids, "n": n, "sig": [x.tobytes() for x in sig], "n_shared": shared, "grams": g_of, "counts": c_of})

    return run


def document_sets(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """A written row per doc_id: the size and signature of its n-gram set, and the shared n-grams of survivors."""
    n_buckets = n_buckets_for(docs)
    base = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    shipped = base.mapInArrow(_ship(n_words, n_buckets), _SHIP)
    met = shipped.repartition(n_buckets // 2, "bucket").groupBy("bucket").applyInPandas(_count, _BACK)
    sets = written(met.groupBy("chunk").applyInPandas(_sets(percent), _SETS), "sets")
    if sets.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets
    best = F.max(F.struct("n", "sig", "n_shared", "grams", "counts")).alias("x")
    return written(sets.groupBy("doc_id").agg(best).select("doc_id", "x.*"), "sets")


def _fragment(c: Column, g: Column) -> Column:
    """The fragment of an n-gram g of count c: the cuts ascend in (count, hash), the global order."""
    return F.when(c == 2, F.shiftright(g, _BITS - 2)).when(c == 3, F.lit(4)).when(c < 8, F.lit(5)).when(c < 32, F.lit(6)).otherwise(F.lit(7)).cast("int")


def _segments(sets: DataFrame) -> DataFrame:
    """(doc_id, fragment, grams): each set cut into its fragments, within its row."""
    pairs = F.arrays_zip(F.col("grams").alias("g"), F.col("counts").alias("c"))
    part = lambda x, f: F.transform(F.filter(x, lambda y: _fragment(y["c"], y["g"]) == f), lambda y: y["g"])
    cut = let(pairs, lambda x: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda f: F.struct(f.alias("fragment"), part(x, f).alias("grams"))))
    return sets.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*").where(F.size("grams") > 0)


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the threshold: partial overlaps counted by fragment, then summed."""
    a = segments.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga"))
    b = segments.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb"))
    part = pairs.join(a, "a").join(b, ["b", "fragment"]).withColumn("part", F.size(F.array_intersect("ga", "gb")))
    both = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _may_link(percent: int) -> Column:
    """Sizes and places of the n-gram that p and q share: what follows it must suffice, if it is the first they share."""
    after = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    return (100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")) & ((100 + percent) * after >= percent * (F.col("p.n") + F.col("q.n")))


def links(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between class representatives that join all linked classes, and the classes (doc_id, rep)."""
    survivors = sets.where("grams is not null and n > 0")
    rep = survivors.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    classes = written(survivors.select("doc_id", "sig").join(rep, "sig").select("doc_id", "rep"), "classes", narrow=True)
    reps = survivors.join(classes.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    reps = written(reps.select("doc_id", "n", "n_shared", "grams", "counts"), "reps")

    need = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - n_shared)")
    prefix = reps.withColumn("k", need).where("k > 0")
    # place: how many n-grams of the document stand before this one in the global order
    postings = prefix.select("doc_id", "n", (F.col("n") - F.col("n_shared")).alias("alone"), F.posexplode(F.expr("slice(grams, 1, int(k))")).alias("at", "gram"))
    postings = postings.select("gram", "doc_id", "n", (F.col("alone") + F.col("at")).alias("place"))
    group = postings.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1")
    postings = written(postings.join(group, "gram"), "postings", narrow=True)

    small = postings.where(F.col("size") <= SMALL_GROUP)
    p, q = small.alias("p"), small.alias("q")
    pairs = p.join(q, (F.col("p.gram") == F.col("q.gram")) & (F.col("p.doc_id") < F.col("q.doc_id")) & _may_link(percent))
    pairs = pairs.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).distinct()
    pairs = written(pairs, "pairs", narrow=True)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    segments = _segments(reps.join(wanted, "doc_id", "left_semi"))
    found = _overlaps(pairs, segments, percent)

    large = postings.where(F.col("size") > SMALL_GROUP)
    if not large.isEmpty():
        found = found.union(_compared_in_blocks(large, reps, percent))
    return written(found.distinct(), "found", narrow=True), classes


def _compared_in_blocks(large: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links inside large groups: members are dealt to blocks, and pairs of blocks are compared.

    Groups that overlap are first joined to one family, so that documents with many
    n-grams in common are compared once; a family of more than FAMILY documents
    is taken group by group instead. A block has documents of one size class, at
    most about BLOCK of them; only equal or neighbouring classes can hold a link.
    Of each pair of blocks comes a forest: no more links than documents, which
    join all that are linked.
    """
    first = large.groupBy("gram").agg(F.min("doc_id").alias("first"))
    star = large.join(first, "gram").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    family = components(star).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    big = family.groupBy("family").agg(F.count("*").alias("members"))
    family = written(family.join(big, "family"), "families", narrow=True)
    whole = large.select("doc_id", "n").distinct().join(family.where(F.col("members") <= FAMILY), "doc_id")
    whole = whole.select(F.lit(0).alias("kind"), F.col("family").alias("key"), "doc_id", "n", F.col("members").alias("size"))
    split = large.join(family.where(F.col("members") > FAMILY).select("doc_id"), "doc_id", "left_semi")
    split = split.select(F.lit(1).alias("kind"), F.col("gram").alias("key"), "doc_id", "n", "size")
    step = math.log(100 / percent) if percent < 100 else 1e-3
    size_class = F.when(F.col("size") <= BLOCK, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("long")
    member = written(whole.unionByName(split).withColumn("class", size_class), "members", narrow=True)
    width = member.groupBy("kind", "key", "class").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k"))
    at = ["kind", "key", "class"]
    near = lambda name, d: width.select("kind", "key", (F.col("class") + d).alias("class"), F.col("k").alias(name))
    member = member.join(near("k", 0), at).join(near("above", -1), at, "left").join(near("below", 1), at, "left")
    member = member.withColumn("own", F.pmod(F.xxhash64("doc_id"), "k"))
    # blocks are compared as (class, i) with (class, j >= i), and with (class + 1, j)
    box = lambda c, i, d, j, side: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"), F.lit(side).alias("side"))
    c, own = F.col("class"), F.col("own")
    until = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    inside = F.transform(until(F.col("k")), lambda j: F.when(j >= own, box(c, own, c, j, 0)).otherwise(box(c, j, c, own, 1)))
    up = F.transform(until(F.col("above")), lambda j: box(c, own, c + 1, j, 0))
    down = F.transform(until(F.col("below")), lambda j: box(c - 1, j, c, own, 1))
    dealt = member.select("kind", "key", "doc_id", "n", F.explode(F.concat(inside, up, down)).alias("box")).select("kind", "key", "doc_id", "n", "box.*")
    pair = ["kind", "key", "c", "i", "d", "j"]
    rows = dealt.join(reps.select("doc_id", "grams"), "doc_id").select(*pair, "side", "doc_id", "n", "grams")
    return rows.groupBy(*pair).applyInPandas(_forest(percent), "a long, b long")


def _forest(percent: int):
    """One pair of blocks: overlaps fragment by fragment, summed, then a spanning forest of the links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "doc_id"], kind="stable")
        n, ids = pdf["n"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64)
        side = pdf["side"].to_numpy()
        rows = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["grams"]])
        grams = np.concatenate(pdf["grams"].to_numpy())
        own = pdf["c"].iloc[0] == pdf["d"].iloc[0] and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = (np.arange(len(pdf)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        names, column, count = np.unique(grams, return_inverse=True, return_counts=True)
        often = count[column] > 1
        rows, column = rows[often], np.unique(column[often], return_inverse=True)[1]
        both = np.zeros((len(left), len(right)), dtype=np.int64)
        by_column = np.argsort(column, kind="stable")
        rows, column = rows[by_column], column[by_column]
        width = int(column[-1]) + 1 if len(column) else 0
        for first in range(0, width, FRAGMENT_COLUMNS):
            a, b = np.searchsorted(column, (first, first + FRAGMENT_COLUMNS))
            cells = np.zeros((len(pdf), min(FRAGMENT_COLUMNS, width - first)), dtype=np.float32)
            cells[rows[a:b], column[a:b] - first] = 1
            both += np.rint(cells[left] @ cells[right].T).astype(np.int64)
        total = n[left][:, None] + n[right][None, :]
        linked = (100 * both >= percent * (total - both)) & (ids[left][:, None] != ids[right][None, :])
        if own:
            linked = np.triu(linked, 1)
        root = list(range(len(pdf)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            x, y = int(left[x]), int(right[y])
            if (p := top(x)) != (q := top(y)):
                root[q] = p
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every doc_id; linked documents share a component."""
    sets = document_sets(docs, n_words, percent)
    found, classes = links(sets, percent)
    label = classes.join(components(found), F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    gone = near_duplicates(docs, n_words, percent).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


#: DuckDB, for the parameters of the registered query: three words, 90 percent.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
df AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM g a JOIN df USING (g) JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
l AS (SELECT x, y FROM overlap WHERE 100 * c >= 90 * (nx + ny - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
"""


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 90)
