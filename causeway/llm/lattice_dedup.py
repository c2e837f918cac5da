"""Near-duplicate embeddings by lattice hashing.

Several tables of random projections map a unit vector to ``LATTICES`` blocks of eight numbers;
each block is decoded to its nearest point of the E8 lattice, and the points together name the
vector's cell in that table. A vector is stored under its cell and looks into that cell and the
neighbouring ones that lie nearest to it; what it finds is verified by the exact cosine.

Members of a cell meet in blocks of bounded size, as matrix products; a pair that several tables
bring together counts in the first one only, so no list of pairs is ever made: a block gives the
number of links of each member and a spanning forest.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components, and
those whose label is null, link with nothing; vectors of different length never meet; rows that
repeat label and vector are copies of one class, all linked with one another, and rows that repeat
vec_id besides are one vector (vectors that share an id but not a class count apart); a null
vec_id takes no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causeway.llm.common import MIX, Work, components, mixed, smallest_connected

TABLES = 6
LATTICES = 2
SCALE = 1.6
PROBES = 6
# Members of a cell that meet in one matrix product.
BLOCK = 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    made = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    made.append(v)
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.concatenate((made, signs[signs.prod(axis=1) == 1] / 2))


_ROOTS = _roots()


def decode(points: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer one of D8 and D8 shifted by one half."""

    def d8(x):
        near = np.rint(x)
        off = x - near
        odd = near.sum(axis=1) % 2 != 0
        worst = np.abs(off).argmax(axis=1)
        rows = np.flatnonzero(odd)
        near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(points), d8(points - 0.5) + 0.5
    nearer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _point_keys(points: np.ndarray, salt: int) -> np.ndarray:
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.full(len(points), mixed(np.array([salt + 1], np.uint64))[0])
        for i in range(8):
            key = mixed(key * MIX + doubled[:, i])
    return key


def cells(vectors: np.ndarray, labels: np.ndarray, tables: int, lattices: int, scale: float, probes: int) -> np.ndarray:
    """Keys (vectors x tables x (1 + probes)); the first of a table is the vector's own cell."""
    n, width = vectors.shape
    out = np.empty((n, tables, 1 + probes), np.uint64)
    with np.errstate(over="ignore"):
        base = mixed(labels.astype(np.int64).view(np.uint64) * MIX + np.uint64(width))
    for t in range(tables):
        spread = np.random.default_rng((t, width)).standard_normal((width, 8 * lattices)) / scale
        projected = vectors @ spread
        keys = np.empty((lattices, n, probes + 1), np.uint64)
        costs = np.empty((lattices, n, probes + 1))
        for b in range(lattices):
            block = projected[:, 8 * b:8 * b + 8]
            own = decode(block)
            cost = 2.0 - 2.0 * (block - own) @ _ROOTS.T  # farther than the own point by this, squared
            order = np.argpartition(cost, probes, axis=1)[:, :probes]
            keys[b, :, 0], costs[b, :, 0] = _point_keys(own, b), 0.0
            for j in range(probes):
                keys[b, :, j + 1] = _point_keys(own + _ROOTS[order[:, j]], b)
            costs[b, :, 1:] = np.take_along_axis(cost, order, axis=1)
        with np.errstate(over="ignore"):
            key = np.broadcast_to((base + np.uint64(t))[:, None], (n, 1))
            cost = np.zeros((n, 1))
            for b in range(lattices):
                # All pairs of choices so far and choices of this block, the cheapest ones kept.
                key = mixed(key[:, :, None] * MIX + keys[b][:, None, :]).reshape(n, -1)
                cost = (cost[:, :, None] + costs[b][:, None, :]).reshape(n, -1)
                order = np.argsort(cost, axis=1, kind="stable")[:, :probes + 1]
                key, cost = np.take_along_axis(key, order, axis=1), np.take_along_axis(cost, order, axis=1)
        out[:, t] = key
    return out


def unit_vectors(rows: list) -> np.ndarray:
    made = np.array(rows, np.float64)
    made /= np.abs(made).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def _features(settings: tuple):
    """(cid, label, copies, embedding) to (cid, copies, unit as binary, keys)."""

    def run(batches):
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            for i, size in enumerate(pa.compute.list_value_length(batch.column(3)).to_pylist()):
                by_width.setdefault(size, []).append(i)
            for rows in by_width.values():
                for start in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[start:start + 2048]))
                    vectors = unit_vectors(part.column(3).to_pylist())
                    keys = cells(vectors, np.array(part.column(1).to_pylist()), *settings).reshape(len(vectors), -1)
                    yield pa.record_batch(
                        [part.column(0), part.column(2), pa.array([v.tobytes() for v in vectors]),
                         pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], names=["cid", "copies", "unit", "keys"])

    return run


def _meet(threshold: float, tables: int, width: int):
    """Members of cells, sorted by (cell, bh, bl), to (cid, n, root): links of a member, and whom it hangs together with."""

    def earlier(x, y, upto, keys):
        """Whether x looks into the cell of y in a table before ``upto``."""
        met = np.zeros(len(x), bool)
        for t in range(tables):
            look = np.flatnonzero((upto > t) & ~met)
            if len(look):
                met[look] = (keys[x[look], t, :] == keys[y[look], t, :1]).any(axis=1)
        return met

    def settle(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        cell, high, low, t, home, look = (np.array(table.column(c)) for c in ("cell", "bh", "bl", "t", "home", "look"))
        cid, copies = np.array(table.column("cid")), np.array(table.column("copies"))
        units = [np.frombuffer(u) for u in table.column("unit").to_pylist()]
        keys = table.column("keys").chunk(0).flatten().to_numpy().reshape(len(cid), tables, width)
        edge = (np.diff(cell) != 0) | (np.diff(high) != 0) | (np.diff(low) != 0)
        bounds = np.concatenate(([0], np.flatnonzero(edge) + 1, [len(cid)]))
        homes, lookers = [], []
        for begin, end in zip(bounds[:-1], bounds[1:]):
            h, k = begin + np.flatnonzero(home[begin:end]), begin + np.flatnonzero(look[begin:end])
            if not len(h) or not len(k):
                continue
            # Members of a cell have one length, except for a clash of hashes.
            size = len(units[h[0]])
            h, k = (np.array([i for i in side if len(units[i]) == size], int) for side in (h, k))
            if not len(k):
                continue
            cosine = np.stack([units[i] for i in h]) @ np.stack([units[i] for i in k]).T
            i, j = np.nonzero(cosine >= threshold)
            i, j = h[i], k[j]
            other = cid[i] != cid[j]
            homes.append(i[other])
            lookers.append(j[other])
        y, x = (np.concatenate(side) if side else np.zeros(0, int) for side in (homes, lookers))
        at = t[y].astype(int)
        first = ~earlier(x, y, at, keys) & ~earlier(y, x, at, keys)
        y, x, at = y[first], x[first], at[first]
        mutual = (keys[y, at, :] == keys[x, at, :1]).any(axis=1)
        counted = ~mutual | (cid[y] < cid[x])
        y, x = y[counted], x[counted]
        members, place = np.unique(cid, return_inverse=True)
        n = np.zeros(len(members), np.int64)
        np.add.at(n, place[y], copies[x])
        np.add.at(n, place[x], copies[y])
        root = members[smallest_connected(place[x], place[y], len(members))]
        used = n > 0
        return pa.record_batch([pa.array(members[used]), pa.array(n[used]), pa.array(root[used])], names=["cid", "n", "root"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last, rows = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(start, 2 * BLOCK)
                group = list(zip(*(np.array(part.column(c)) for c in ("cell", "bh", "bl"))))
                if rows >= 4 * BLOCK:
                    # Cut where a group ends; what belongs to the last group goes with what is held.
                    same = 0
                    while same < len(group) and group[same] == last:
                        same += 1
                    if same < len(group):
                        if same:
                            held.append(part.slice(0, same))
                        yield settle(held)
                        held, rows, part = [], 0, part.slice(same)
                held.append(part)
                rows += part.num_rows
                last = group[-1]
        if held:
            yield settle(held)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.98, tables: int = TABLES, lattices: int = LATTICES,
                    scale: float = SCALE, probes: int = PROBES) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    work = Work(rows.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
             & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    marked = given.withColumn("sound", F.coalesce(sound, F.lit(False)))
    named = marked.withColumn("f1", F.xxhash64("embedding")).withColumn("f2", F.xxhash64(F.lit(1), F.col("embedding")))
    ids = named.where("sound").select("vec_id", "label", "f1", "f2").distinct()
    classes = work.cut(ids.groupBy("label", "f1", "f2").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies")))
    key = ["label", "f1", "f2"]
    first = (named.where("sound").join(classes.withColumnRenamed("cid", "vec_id"), [*key, "vec_id"])
             .select("vec_id", "label", "copies", "embedding", "f1", "f2"))
    # A class has one row here unless its first row is repeated.
    first = first.dropDuplicates(["vec_id", "label", "f1", "f2"]).select(
        F.col("vec_id").alias("cid"), "label", "copies", "embedding")
    features = work.cut(first.mapInArrow(_features((tables, lattices, scale, probes)),
                                         "cid bigint, copies bigint, unit binary, keys array<bigint>"))
    width = 1 + probes
    seen = features.select("cid", F.posexplode("keys").alias("at", "cell"))
    seen = seen.select("cid", "cell", (F.floor(F.col("at") / width)).cast("int").alias("t"),
                       (F.col("at") % width == 0).alias("home"))
    seen = work.cut(seen)
    shared = (seen.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("lived_in"),
                                       F.min("cid").alias("low"), F.max("cid").alias("high"))
              .where("lived_in AND low <> high").select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    met = seen.join(shared, "cell").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # In a cell of one block a row is at home and looks; else it goes to its row of blocks and to its column.
    single = met.where("blocks = 1").select("cell", F.lit(0).alias("bh"), F.lit(0).alias("bl"), "t", "cid", "home",
                                            F.lit(True).alias("look"))
    lived = met.where("blocks > 1 AND home").select("cell", F.col("b").alias("bh"), F.explode(every).alias("bl"), "t", "cid",
                                                    F.lit(True).alias("home"), F.lit(False).alias("look"))
    looking = met.where("blocks > 1").select("cell", F.explode(every).alias("bh"), F.col("b").alias("bl"), "t", "cid",
                                             F.lit(False).alias("home"), F.lit(True).alias("look"))
    meetings = single.union(lived).union(looking).join(features, "cid")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = meetings.repartition(parts, "cell", "bh", "bl").sortWithinPartitions("cell", "bh", "bl")
    found = work.cut(dealt.mapInArrow(_meet(threshold, tables, width), "cid bigint, n bigint, root bigint"))
    totals = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), work)
    grouped = (classes.join(totals, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
               .select(*key, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "cid").alias("component_id")))
    linked = named.where("sound").select("vec_id", *key).join(grouped, key).select("vec_id", "n_links", "component_id")
    alone = marked.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
