import math
import random

import numpy as np
import pytest
from llm_plain import groups
from pyspark.sql import functions as F

from causeway.llm import kdtree_topk as kd, lattice_dedup as ld

SCHEMA = "vec_id bigint, embedding array<float>, label int, cid string, copies string, kept string"


def vectors(n=120, width=16):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((8, width))
    rows = []
    for i in range(n):
        v = centres[i % 8] + rng.standard_normal(width) * rng.choice([0.02, 0.1, 0.3, 1.0])
        rows.append((i * 2, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(30)]  # copies
    rows += [(1100, [2 * x for x in rows[5][1]], rows[5][2]), (1101, rows[5][1], 7), (1102, rows[5][1], None), (1103, None, 1),
             (1104, [], 1), (1105, [0.0] * width, 1), (1106, [0.0] * width, 1), (1107, [1.0, None] * 8, 1), (1108, [1.0, None] * 8, 1),
             (1109, [math.nan] * width, 1), (1110, [math.inf] * width, 1), (1111, [1.0, 2.0], 1), (1112, [1.0, 2.0], 1), (None, rows[5][1], 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def plain_links(rows):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    good = [r for r in rows if sound(r)]
    links = []
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((a[0], b[0]))
    return links


def test_links_equal_all_pairs(spark):
    rows = vectors()
    links = plain_links(rows)
    ids = [r[0] for r in rows if r[0] is not None]
    component = groups(ids, links)
    degree = {i: sum(i in pair for pair in links) for i in ids}
    want = {i: (degree[i], component[i], component[i] == i) for i in ids} | {None: (0, None, True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ld.near_duplicates(frame(spark, rows)).collect()} == want
    assert ld.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_hot_cells_meet_in_blocks(spark, monkeypatch):
    """A cell with many members, none equal, cut into blocks: every link counts once."""
    monkeypatch.setattr(ld, "BLOCK", 8)
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (centre + rng.standard_normal(16) * 0.12)], 0) for i in range(150)]
    links = plain_links([(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows])
    got = {r.vec_id: r.n_links for r in ld.near_duplicates(frame(spark, rows)).collect()}
    found = sum(got.values()) / 2
    assert found <= len(links) and found >= 0.995 * len(links) and len(links) > 3000


def test_recall_at_the_threshold():
    rng = np.random.default_rng(12)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal(a.shape)
    d -= (d * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    label = np.zeros(len(a), int)
    ka, kb = (ld.cells(x, label, ld.TABLES, ld.LATTICES, ld.SCALE, ld.PROBES) for x in (a, b))
    met = ((ka[:, :, :1] == kb).any(axis=2) | (kb[:, :, :1] == ka).any(axis=2)).any(axis=1)
    assert met.mean() > 0.98


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(13)
    points = rng.standard_normal((500, 8)) * 2
    found = ld.decode(points)
    assert ((found.sum(axis=1) % 2) == 0).all()
    assert (np.isclose(found % 1, 0).all(axis=1) | np.isclose(found % 1, 0.5).all(axis=1)).all()
    own = ((points - found) ** 2).sum(axis=1)
    others = ((points[:, None, :] - found[:, None, :] - ld._ROOTS[None]) ** 2).sum(axis=2)
    assert (own[:, None] <= others + 1e-9).all() and len(ld._ROOTS) == 240


def plain_top(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, p in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(p, o)), i) for i, o in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, leaf", [(4096, 64), (20, 4)])
def test_top_k_equals_all_pairs(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(kd, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(kd, "LEAF", leaf)
    rows = vectors()
    got = kd.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain_top(rows)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, -0.5], 1), (1, [0.3, 0.3], 1), (2, [0.3, 0.3], 1), (50, [5.0], None)]
    assert sorted(map(tuple, kd.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect())) == plain_top(rows)
    assert kd.top_k(frame(spark, rows).where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert kd.top_k(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0
    assert kd.top_k(frame(spark, rows), F.col("vec_id") == 77).count() == 0
    many = [(i, [float(i % 3), 1.0], 1) for i in range(100)]
    assert sorted(map(tuple, kd.top_k(frame(spark, many), F.col("vec_id") % 50 == 0).collect())) == plain_top(many)


def test_tree_bounds_hold_and_prune():
    rng = random.Random(14)
    points = np.array([[rng.randint(-200, 200) for _ in range(6)] for _ in range(1000)], float)
    tree = kd.Tree(np.arange(1000), points)
    queries = points[:20]
    bounds = tree.bounds(queries)
    for node, (begin, end, *_) in enumerate(tree.nodes):
        assert (tree.points[begin:end] @ queries.T <= bounds[:, node] + 1e-9).all()
    for q, best in tree.search(np.arange(20), queries, np.full(20, -np.inf), 3):
        scores = sorted(((points[i] @ queries[q], -i) for i in range(1000) if i != q), reverse=True)[:3]
        assert best == scores
