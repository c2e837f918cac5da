"""Exact top-k by inner product, with k-d trees per shard.

Shards are the cells of a k-d split of the space that is fitted on a bounded sample, cut further
so that none is larger than ``SHARD_ROWS``. Each shard is one row: its vectors in the order of
a tree of median splits, and the tight box of every node. A query is first answered by its own
shard; its kth score so far then goes with it to those shards whose box can still hold as good a
score, where the tree is walked best first by the boxes' bounds. The best k of all shards are
merged by a combining aggregate. Every vector is a candidate, whatever the sample was.

Results for odd input: vectors that are null, empty or hold null or non-finite components, and
rows without vec_id, take no part; a shorter vector counts as filled up with zeros; rows that
repeat vec_id are candidates each, but as a query only the smallest of their vectors counts; a
table without queries or candidates gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from causeway.llm.common import Work

SHARD_ROWS = 4096
SAMPLE = 8192
LEAF = 64
QUERY_BLOCK = 256


def split_space(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Median splits as a heap: node i has the children 2i + 1 and 2i + 2."""
    splits: list[tuple[int, float]] = []
    parts = [np.arange(len(sample))]
    for _ in range(depth):
        following = []
        for rows in parts:
            if len(rows):
                points = sample[rows]
                axis = int((points.max(axis=0) - points.min(axis=0)).argmax())
                cut = float(np.median(points[:, axis]))
            else:
                axis, cut = 0, 0.0
            splits.append((axis, cut))
            right = sample[rows, axis] > cut
            following += [rows[~right], rows[right]]
        parts = following
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if not splits:
        return node
    axes, cuts = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
    for _ in range(depth):
        axis = np.minimum(axes[node], points.shape[1] - 1)
        node = 2 * node + 1 + (points[np.arange(len(points)), axis] > cuts[node])
    return node - len(splits)


class Tree:
    """A k-d tree over one shard: nodes as (begin, end, left, right) with boxes, vectors in tree order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        nodes, low, high = [], [], []
        # (begin, end, parent, side): split at the median of the widest axis until small.
        pending = [(0, len(ids), -1, 0)]
        while pending:
            begin, end, parent, side = pending.pop()
            inside = points[order[begin:end]]
            at = len(nodes)
            nodes.append([begin, end, -1, -1])
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            if parent >= 0:
                nodes[parent][2 + side] = at
            width = high[at] - low[at]
            if end - begin > LEAF and width.max() > 0:
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(inside[:, int(width.argmax())], half)]
                pending += [(begin, begin + half, at, 0), (begin + half, end, at, 1)]
        self.ids, self.points = ids[order], points[order]
        self.nodes, self.low, self.high = np.array(nodes, np.int32), np.stack(low), np.stack(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
        """Per query up to k (score, vec_id) that beat or equal its kth score so far."""
        bounds = self.bounds(queries)
        for q in range(len(queries)):
            best: list[tuple[float, int]] = []  # (score, -vec_id), the worst first
            open_ = [(-bounds[q, 0], 0)]
            while open_:
                bound, node = heapq.heappop(open_)
                worst = best[0][0] if len(best) == k else -np.inf
                if -bound < max(worst, kth[q]):
                    break
                begin, end, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(open_, (-bounds[q, left], int(left)))
                    heapq.heappush(open_, (-bounds[q, right], int(right)))
                    continue
                scores = self.points[begin:end] @ queries[q]
                good = np.flatnonzero(scores >= max(worst, kth[q]))
                for i in good:
                    name = int(self.ids[begin + i])
                    if name == query_ids[q]:
                        continue
                    entry = (float(scores[i]), -name)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            yield q, sorted(best, reverse=True)


def _matrix(cells: list[bytes]) -> np.ndarray:
    """Vectors as rows, filled up with zeros to one length."""
    rows = [np.frombuffer(c) for c in cells]
    width = max(map(len, rows), default=0)
    made = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        made[i, :len(row)] = row
    return made


def _widen(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _place(splits: list[tuple[int, float]], depth: int):
    """(vec_id, asked, point as list) to (vec_id, asked, point as binary, cell)."""

    def run(batches):
        for batch in batches:
            packed = [np.array(p, np.float64).tobytes() for p in batch.column(2).to_pylist()]
            if packed:
                cell = cell_of(_matrix(packed), splits, depth)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(cell)],
                                      names=["vec_id", "asked", "point", "cell"])

    return run


_SHARD = "cell bigint, part bigint, ids binary, points binary, nodes binary, low binary, high binary, width int"


def _build(table: pa.Table) -> pa.Table:
    tree = Tree(np.array(table.column("vec_id")), _matrix(table.column("point").to_pylist()))
    values = [tree.ids.astype(np.int64), tree.points, tree.nodes, tree.low, tree.high]
    return pa.table([table.column("cell").slice(0, 1), table.column("part").slice(0, 1),
                     *[pa.array([v.tobytes()]) for v in values], pa.array([tree.points.shape[1]], pa.int32())],
                    names=["cell", "part", "ids", "points", "nodes", "low", "high", "width"])


def _load(row: dict) -> Tree:
    tree = Tree.__new__(Tree)
    tree.ids, tree.nodes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nodes"], np.int32).reshape(-1, 4)
    for name in ("points", "low", "high"):
        setattr(tree, name, np.frombuffer(row[name]).reshape(-1, row["width"]))
    return tree


_FOUND = "query_id bigint, vec_id bigint, score bigint"


def _answers(trees: pa.Table, asked, k: int) -> pa.Table:
    """Walk one shard for blocks of (ids, points, kth scores)."""
    out: tuple[list, list, list] = ([], [], [])
    if trees.num_rows:
        tree = _load(trees.select(["ids", "points", "nodes", "low", "high", "width"]).to_pylist()[0])
        width = tree.points.shape[1]
        for ids, points, kth in asked:
            if points.shape[1] > width:
                points = points[:, :width]  # the shard's vectors are zero there
            elif points.shape[1] < width:
                points = np.pad(points, ((0, 0), (0, width - points.shape[1])))
            for q, best in tree.search(ids, points, kth, k):
                out[0].extend([int(ids[q])] * len(best))
                out[1].extend(-b[1] for b in best)
                out[2].extend(int(b[0]) for b in best)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def _route(batches):
    """Query blocks beside blocks of shard boxes to, per shard, the queries that it may still serve."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            points, kth = _matrix(row["points"]), np.array(row["kth"])
            homes = np.array(row["home"], np.int64)
            out: dict[str, list] = {"cell": [], "part": [], "ids": [], "qpoints": [], "kth": []}
            for box in row["boxes"]:
                high, queries = _widen(np.frombuffer(box["high"])[None, :], points)
                low = _widen(np.frombuffer(box["low"])[None, :], points)[0]
                bound = (np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)[:, 0]
                go = np.flatnonzero((bound >= kth) & ((homes[:, 0] != box["cell"]) | (homes[:, 1] != box["part"])))
                if len(go):
                    out["cell"].append(box["cell"])
                    out["part"].append(box["part"])
                    out["ids"].append([row["ids"][g] for g in go])
                    out["qpoints"].append([row["points"][g] for g in go])
                    out["kth"].append([float(kth[g]) for g in go])
            yield pa.record_batch(
                [pa.array(out["cell"], pa.int64()), pa.array(out["part"], pa.int64()),
                 pa.array([row["chunk"]] * len(out["cell"]), pa.int64()), pa.array(out["ids"], pa.list_(pa.int64())),
                 pa.array(out["qpoints"], pa.list_(pa.binary())), pa.array(out["kth"], pa.list_(pa.float64()))],
                names=["cell", "part", "chunk", "ids", "points", "kth"])


def top_k(rows: DataFrame, asked, k: int = 5, scale: int = 256) -> DataFrame:
    """For the rows where ``asked`` holds, the k other rows of largest inner product.

    ``rows`` has vec_id and embedding; components count as floor(scale * x). Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id. Scores are exact up to 2^53.
    """
    spark = rows.sparkSession
    work = Work(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"),
                        F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", finite)
    points = given.where(sound).select(
        "vec_id", "asked", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("point"))
    total = points.count()
    sample = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(total, 1))))
    taken = [np.array(r["point"]).tobytes() for r in sample.select("point").limit(2 * SAMPLE).collect()]
    depth = max(0, min(int(np.ceil(np.log2(max(total, 1) / SHARD_ROWS))), int(np.log2(SAMPLE)) - 5)) if taken else 0
    splits = split_space(_matrix(taken), depth) if depth else []
    placed = work.cut(points.mapInArrow(_place(splits, depth), "vec_id bigint, asked boolean, point binary, cell bigint"))
    per_cell = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("parts"))
    placed = placed.join(per_cell, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts")
    shards = work.cut(placed.select("cell", "part", "vec_id", "point").groupBy("cell", "part").applyInArrow(_build, _SHARD))
    queries = work.cut(placed.where("asked").groupBy(F.col("vec_id").alias("query_id"))
                       .agg(F.min(F.struct("point", "cell", "part")).alias("q")).select("query_id", "q.*"))

    def at_home(trees: pa.Table, asked_: pa.Table) -> pa.Table:
        ids = np.array(asked_.column("query_id"), np.int64)
        return _answers(trees, [(ids, _matrix(asked_.column("point").to_pylist()), np.full(len(ids), -np.inf))]
                        if len(ids) else [], k)

    first = work.cut(shards.groupBy("cell", "part").cogroup(queries.groupBy("cell", "part")).applyInArrow(at_home, _FOUND))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    asked_ = queries.join(kth, "query_id", "left").withColumn(
        "kth", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = asked_.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("query_id", "point", "kth", "cell", "part")).alias("q"))
    packed = packed.select(F.col("q.query_id").alias("ids"), F.col("q.point").alias("points"), F.col("q.kth").alias("kth"),
                           F.transform("q", lambda x: F.array(x["cell"], x["part"])).alias("home"),
                           F.floor(F.col("block") / 64).alias("chunk"))
    box_blocks = max(1, -(-shards.count() // 512))
    boxes = (shards.select("cell", "part", "low", "high")
             .groupBy(F.pmod(F.xxhash64("cell", "part"), F.lit(box_blocks)).alias("box_block"))
             .agg(F.collect_list(F.struct("cell", "part", "low", "high")).alias("boxes")))
    beside = packed.withColumn("box_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(box_blocks - 1).cast("bigint"))))
    routed = work.cut(beside.join(boxes, "box_block").select("chunk", "ids", "points", "kth", "home", "boxes").mapInArrow(
        _route, "cell bigint, part bigint, chunk bigint, ids array<bigint>, points array<binary>, kth array<double>"))

    def elsewhere(trees: pa.Table, asked_: pa.Table) -> pa.Table:
        return _answers(trees, ((np.array(r["ids"], np.int64), _matrix(r["points"]), np.array(r["kth"]))
                                for r in asked_.select(["ids", "points", "kth"]).to_pylist()), k)

    asked_of = routed.select("cell", "part", F.col("chunk").alias("of")).distinct()
    copies = shards.join(asked_of, ["cell", "part"])
    second = (copies.groupBy("cell", "part", "of").cogroup(routed.groupBy("cell", "part", "chunk"))
              .applyInArrow(elsewhere, _FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = first.union(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
