"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its share of all words by weight, at most ``LIMIT`` times its own words;
what it can't take goes to the others by weight. Every document of a source then has the same
expected number of copies, target / size. The documents of a source are put in order of size,
their expected copies are summed up along that order, one random offset per source is added, and
a document is emitted once for each whole number that its stretch of the sum crosses. The order by
size spreads the choice evenly over short and long documents, so the words taken come within
about one document of the target.

Results for odd input: null and empty texts have size 0 and are taken 0 times in words; a null
source is a source of its own, the last in order; rows that repeat doc_id, source and size stand
one behind the other, each with a place in the sum of its own (which of them is which is decided by their other
columns); an empty table gives an empty result; a source without words has target 0 and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from causeway.llm.common import Work
from causeway.operators.ordered import RANGE, range_blocks, with_rank

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) with one row per source to (source, source_size, target).

    A target is least(limit * size, weight * level); the level is found by going through the
    sources from the smallest limit per weight on. The windows run over one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = weighted.withColumn("level", left / onward)
    reached = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
    levels = levels.withColumn("at", reached.over(everything)["level"])
    return levels.select("source", "source_size", F.least("cap", F.col("w") * F.coalesce("at", F.lit(float("inf")))).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 20 bits, from the md5 of the seed and the source."""
    digest = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; ``rows`` repeat these three, and this is the ``nth``.

    The sum along the order is a count, as all documents of a source expect the same. It is made
    without bringing a source together: distinct rows are sorted by ranges, rows are counted
    inside each range, and the ranges' totals are summed up apart.
    """
    work = Work(docs.sparkSession)
    units = work.cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
                     .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    goal = targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, limit)
    goal = work.cut(goal)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "size", "doc_id"]
    placed = units.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits hold the range, the lower 33 the place in it.
    placed = work.cut(placed.withColumn("at", F.monotonically_increasing_id()))
    work.release(units)
    placed = placed.withColumn("piece_at", F.shiftright("at", 33))
    inside = Window.partitionBy("piece_at", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("here", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    ranges = placed.groupBy("source", F.col("piece_at").alias("piece")).agg(F.sum("rows").alias("n"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranges = ranges.withColumnRenamed("source", "of").withColumn("u", offset(F.col("of"), seed))
    here = placed.join(ranges, (F.col("piece_at") == F.col("piece")) & F.col("source").eqNullSafe(F.col("of")))
    here = here.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("here") + F.col("nth") - 1
    crossed = F.floor((rank + 1) * rate + F.col("u")) - F.floor(rank * rate + F.col("u"))
    # Rounding must not add a copy beyond the limit.
    return here.select("doc_id", "source", "size", "rows", "nth", "source_size", "target",
                       F.least(crossed, F.lit(limit)).cast("bigint").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each repeated as often as the mix takes it."""
    work = Work(docs.sparkSession)
    drawn = work.cut(draw(docs, **settings).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"),
                                                   "rows", "nth", "copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("n"))
    same = (F.col("row.doc_id").eqNullSafe(F.col("__d")) & F.col("row.source").eqNullSafe(F.col("__s"))
            & (F.col("n") == F.col("__n")))
    taken = rows.join(drawn.where("rows = 1 AND copies > 0"), same).select("row", "copies")
    repeated = drawn.where("rows > 1")
    if not repeated.isEmpty():
        # Only rows that repeat are numbered; equal ones may stand in any order.
        among = rows.join(repeated.select("__d", "__s", "__n").distinct(), same, "left_semi")
        among = among.select("row", "n", F.xxhash64(F.to_json("row")).alias("h"), F.monotonically_increasing_id().alias("id"),
                             F.col("row.doc_id").alias("__d"), F.col("row.source").alias("__s"))
        keys, order = ["__d", "__s", "n"], ["h", "id"]
        ranked = with_rank(range_blocks(among, keys, order, work), keys, order, F.col(RANGE), "place").select("row", "n", "place")
        taken = taken.union(ranked.join(repeated.where("copies > 0"), same & (F.col("place") == F.col("nth"))).select("row", "copies"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
