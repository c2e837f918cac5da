"""Near-duplicate documents by SuperMinHash signatures over word shingles.

Each element (shingle) of a document draws one pseudo-random permutation of the signature's
positions and one fraction per rank; position ``p`` of the signature is the smallest rank +
fraction that any element puts there. The ranks of one element are correlated (no two of its
values share a position or an integer part), which lowers the variance against independent
minima. A document stops as soon as no later rank can lower any of its positions.

Results for odd input: texts that are null, empty or blank have no shingles and link with
nothing; rows that repeat a doc_id are one document (compared by the
smallest of their texts); a null doc_id is never linked and is
kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causeway.llm.common import (
    MIX, Work, compare_with_pivots, components, mixed, shingle_set, smallest_connected, unit,
)

BANDS = 24
BAND_ROWS = 4
# Elements handled at once; a document with more is handled alone.
CHUNK = 1 << 18
# Members of a bucket that are compared with one another in one table.
BLOCK = 512


def signatures(elements: np.ndarray, owner: np.ndarray, documents: int, size: int) -> np.ndarray:
    """SuperMinHash signatures; element i belongs to document ``owner[i]``, all have some.

    The ranks are walked in step for all elements, so that each rank is a few array operations.
    """
    lowest = np.full(documents * size, np.inf)
    active = np.arange(len(elements))
    permuted = np.zeros((0, size), np.uint8 if size <= 256 else np.uint32)
    with np.errstate(over="ignore"):
        for rank in range(size):
            draw = mixed(elements[active] + MIX * np.uint64(2 * rank + 1))
            chosen = rank + (mixed(draw + MIX) % np.uint64(size - rank)).astype(np.int64)
            rows = np.arange(len(active))
            if rank == 0:
                position, first = chosen, chosen
            else:
                position = permuted[rows, chosen].astype(np.int64)
                permuted[rows, chosen] = permuted[rows, rank]
            np.minimum.at(lowest, owner[active] * size + position, rank + unit(draw))
            open_ = lowest.reshape(documents, size).max(axis=1) >= rank + 1
            keep = open_[owner[active]]
            if rank == 0:
                active = active[keep]
                permuted = np.tile(np.arange(size, dtype=permuted.dtype), (len(active), 1))
                permuted[np.arange(len(active)), first[keep]] = 0
            elif not keep.all():
                active, permuted = active[keep], permuted[keep]
            if not len(active):
                break
    return lowest.reshape(documents, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
        for i in range(rows):
            key = mixed(key * MIX + bits[:, :, i])
    return key.view(np.int64)


def _sketch(width: int, bands: int, rows: int):
    """Batches of (doc_id, text as binary) to (doc_id, n_shingles, f1, f2, bands)."""

    def flush(ids, sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        filled = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if filled:
            place = np.zeros(len(sets), np.int64)
            place[filled] = np.arange(len(filled))
            made = band_keys(signatures(np.concatenate(sets), place[owner], len(filled), bands * rows), bands, rows)
            for i, row in zip(filled, made):
                keys[i] = row
        with np.errstate(over="ignore"):
            first = [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            second = [int(mixed(s ^ MIX).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()),
             pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    def run(batches):
        ids, sets, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                sets.append(shingle_set(batch.column(1)[i].as_py() or b"", width))
                size += len(sets[-1])
                if size >= CHUNK or len(ids) >= 4096:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield flush(ids, sets)

    return run


def _similar(width: int, percent: int):
    """Batches of (a, b, ta, tb) to the pairs whose full shingle sets are similar enough."""

    def run(batches):
        last, left = None, None
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if a != last:
                    last, left = a, shingle_set(batch.column(2)[i].as_py() or b"", width)
                right = shingle_set(batch.column(3)[i].as_py() or b"", width)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    found.append((a, b))
            yield pa.record_batch([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())],
                                  names=["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix product over the shingles that more than one set has."""
    elements, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    used = shared[column]
    row, column = row[used], place[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width, total = max(1, (1 << 22) // len(sets)), np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), width):
        begin, end = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), min(width, int(shared.sum()) - low)), np.float32)
        part[row[begin:end], column[begin:end] - low] = 1
        total += part @ part.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _compare(width: int, percent: int):
    """Members of buckets, sorted by (bucket, low, high), to edges (a, b) that connect what is linked."""

    def settle(ids, components_, texts):
        if len(set(components_)) < 2:
            return []
        sets = [shingle_set(t, width) for t in texts]
        common, size = common_counts(sets).astype(np.float64), np.array([len(s) for s in sets], np.float64)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        a, b = np.nonzero(np.triu(linked, 1))
        names = np.array(ids)
        root = smallest_connected(a, b, len(ids))
        return [(int(names[i]), int(names[r])) for i, r in enumerate(root) if i != r]

    def run(batches):
        last, held = None, []
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                group = tuple(batch.column(c)[i].as_py() for c in range(3))
                if group != last and held:
                    found += settle(*zip(*held))
                    held = []
                last = group
                held.append(tuple(batch.column(c)[i].as_py() for c in range(3, 6)))
            yield pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())],
                                  names=["a", "b"])
        if held:
            found = settle(*zip(*held))
            yield pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())],
                                  names=["a", "b"])

    return run


def _in_blocks(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect all linked members of each bucket.

    A bucket is cut into blocks of about ``BLOCK`` members; each two blocks, and each block alone,
    meet in one table of bounded size, where all sets are compared by a matrix product. Only
    a spanning forest of the links leaves a table, no list of pairs.
    """
    sizes = open_.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.withColumn("other", every).select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "id", "c")
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = met.join(texts, "id").select("bucket", "low", "high", "id", "c", "text")
    tables = tables.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return tables.mapInArrow(_compare(width, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |common shingles| >= percent * |all shingles|; a component
    is named by its smallest doc_id, which alone is kept. Documents with equal sets are one
    class first; classes that share a band are compared by their full sets, unless they are
    known to be connected. A pair at similarity 0.8 shares none of the 24 bands of 4
    with a probability of 3 in a million.
    """
    work = Work(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketches = work.cut(slim.mapInArrow(
        _sketch(width, bands, rows), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"))
    shown = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = work.cut(shown.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id")))
    banded = (shown.join(classes.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
              .select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")).distinct())
    banded = work.cut(banded)
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = work.cut(banded.join(shared.select("bucket"), "bucket", "left_semi").select("bucket", "id"))
    work.release(banded)
    texts = work.cut(slim.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
                     .groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")))

    def verify(pairs: DataFrame) -> DataFrame:
        right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(_similar(width, percent), "a bigint, b bigint")

    # First each bucket's smallest member with the others, which settles most buckets; then the rest in blocks.
    labels = work.spark.createDataFrame([], "node bigint, component bigint")
    if not members.isEmpty():
        links, labels, open_ = compare_with_pivots(members.withColumn("c", F.col("id")), 1, verify, None, work)
        if not open_.isEmpty():
            labels = work.cut(components(links.union(_in_blocks(open_, texts, width, percent)), work))
    named = (classes.join(labels.withColumnRenamed("node", "id"), "id", "left")
             .select("n_shingles", "f1", "f2", F.coalesce("component", "id").alias("component_id")))
    rest = sketches.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = shown.join(named, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    return grouped.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose document is kept, each once; rows without doc_id all stay."""
    kept = near_duplicates(docs, **settings).where("kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("__kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    known = rows.join(kept, F.col("row.doc_id") == F.col("__kept"), "left_semi")
    same: Column = F.xxhash64(F.col("row.text"))
    known = known.withColumn("key", F.col("row.doc_id")).withColumn("same", same).dropDuplicates(["key", "same"])
    return known.select("row.*").union(rows.where("row.doc_id IS NULL").select("row.*"))
