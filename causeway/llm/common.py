"""Helpers shared by the operators: intermediate tables, word hashes, links and components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from causeway.session import Scratch

MIX = np.uint64(0x9E3779B97F4A7C15)
# Pivots per bucket in the second round of ``linked_components``.
PIVOTS = 256


class Work(Scratch):
    """Intermediate tables of one operator call; a table is removed once it is released."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.spark = spark
        self._paths: dict[int, str] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count}"
        made = super().cut(df)
        self._paths[id(made)] = path
        return made

    def release(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            path = self._paths.pop(id(frame), None) if frame is not None else None
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def mixed(values: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unit(values: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from mixed 64-bit values."""
    return (values >> np.uint64(11)).astype(np.float64) * 2.0**-53


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct word shingles; a shorter text is one shingle."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    with np.errstate(over="ignore"):
        rolled = np.full(len(hashes) - width + 1, np.uint64(width))
        for i in range(width):
            rolled = mixed(rolled * MIX + hashes[i:len(hashes) - width + 1 + i])
    return np.unique(rolled)


def components(edges: DataFrame, work: Work) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, component), component the smallest node.

    Distributed union-find by alternating large-star and small-star steps: every node is hooked
    to the smallest node it knows until the edges form stars. A hub's edges are never brought
    together: its minimum is a combining aggregate and the join on it can be split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.cut(edges)
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                   F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        following = work.cut(large.join(lowest, "a").select(hooked).select("e.*").where("a <> b").distinct())
        work.release(edges)
        edges = following
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node on the larger end has one smaller neighbour, which itself is a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def compare_with_pivots(placed: DataFrame, count: int, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None,
                        work: Work) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: compare ``count`` pivots of each bucket with its members of other components.

    ``placed`` has (bucket, id, c) with c the component so far. Returns all links, the components, and
    the members of buckets that are not finished, without the pivots, which are done with.
    """
    order = Window.partitionBy("bucket").orderBy("id") if count == 1 else (
        Window.partitionBy("bucket").orderBy(F.xxhash64("id", F.lit(count)), "id"))
    pivots = work.cut(placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)
                      .select("bucket", F.col("id").alias("p"), F.col("c").alias("pc")))
    pairs = (placed.join(pivots, "bucket").where("c <> pc")
             .select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct())
    found = verify(pairs).select("a", "b")
    grown = work.cut(found if links is None else links.union(found))
    labels = work.cut(components(grown, work))
    rest = placed.drop("c").join(pivots.select("bucket", F.col("p").alias("id")), ["bucket", "id"], "left_anti")
    open_ = work.cut(unfinished(rest, labels))
    work.release(pivots)
    return grown, labels, open_


def unfinished(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, c) of the buckets whose members are not all in one component."""
    known = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("c"))
    open_ = known.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return known.join(open_.select("bucket"), "bucket", "left_semi")


def linked_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], work: Work) -> DataFrame:
    """Components of the links among rows that share a bucket: (node, component) of linked nodes.

    ``members`` holds distinct (bucket, id); ``verify`` returns those of the pairs (a, b) that are
    links. Instead of all pairs of a bucket, each round compares some pivots of the bucket with
    its other members. A pivot is then done with, members already in one component need no
    further comparison, and a bucket whose members are all in one component is finished. The
    number of pivots doubles from round to round, so the rounds are logarithmic, and every pair
    left out is one whose ends are connected: the components are those of the full set of links.
    From the second round on there are at least ``PIVOTS`` pivots, which finishes the small buckets.
    """
    links: DataFrame | None = None
    labels: DataFrame | None = None
    count = 1
    placed = work.cut(members.withColumn("c", F.col("id")))
    while not placed.isEmpty():
        grown, found, following = compare_with_pivots(placed, count, verify, links, work)
        work.release(links, labels, placed)
        links, labels, placed = grown, found, following
        count = max(PIVOTS, 2 * count)
    if labels is None:
        return work.spark.createDataFrame([], "node bigint, component bigint")
    return labels


def smallest_connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected place for each of n places, by hooking and jumping over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[a], label[b]):
            return label
