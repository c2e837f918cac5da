import random

import pytest
from llm_plain import mix, targets

from causeway.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, copies int, row string"


def documents():
    rng = random.Random(4)
    rows = []
    for source, n, longest in (("a", 300, 40), ("b", 40, 9), ("B", 60, 200), (None, 30, 20), ("é", 5, 4), ("z", 3, 0)):
        for _ in range(n):
            rows.append((len(rows), source, " \x0b".join(["w"] * rng.randint(0, longest)) or rng.choice(["", None, "\t"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "r") for r in rows], SCHEMA)


def test_equals_plain_version(spark):
    rows = documents()
    want = mix(rows)
    got = mixing.draw(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        size, target, copies = want[r.doc_id]
        assert (r.size, r.copies) == (size, copies) and r.target == pytest.approx(target)
    made = mixing.mix(frame(spark, rows))
    assert made.columns == ["doc_id", "source", "text", "copies", "row"]
    counts = {}
    for r in made.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: c for d, (_, _, c) in want.items() if c}


def test_taken_words_come_near_the_targets(spark):
    got = mixing.draw(frame(spark, documents())).collect()
    source = {r[0]: r[1] for r in documents()}
    for name in {r[1] for r in documents()}:
        of = [r for r in got if source[r.doc_id] == name]
        taken, longest = sum(r.copies * r.size for r in of), max(r.size for r in of)
        assert abs(taken - of[0].target) <= 2 * longest + 1
        assert all(r.copies <= 3 for r in of)


def test_targets_share_the_excess_again():
    got = targets({"a": 10, "b": 1000, "c": 1, None: 5})
    assert got["a"] == 30 and got["c"] == 3 and got[None] == 15 and got["b"] == pytest.approx(968)


def test_odd_rows(spark):
    rows = [(1, "s", "one two"), (1, "s", "one two"), (None, None, None), (2, None, "")]
    got = mixing.draw(frame(spark, rows)).collect()
    assert {(r.doc_id, r.rows, r.size) for r in got} == {(1, 2, 2), (None, 1, 0), (2, 1, 0)}
    assert [(r.doc_id, r.text) for r in mixing.mix(frame(spark, rows)).collect()] == [(1, "one two")] * 2
    assert mixing.draw(frame(spark, rows).limit(0)).count() == mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_partitions_do_not_change_the_draw(spark):
    rows = documents()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(sorted((r.doc_id, r.copies) for r in mixing.draw(frame(spark, rows).repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_repeated_rows_come_near_the_target(spark):
    """A row that is there many times is taken as often as its place in the sum says, not all or none."""
    rows = [(i, "a", "w " * 10) for i in range(30)] + [(99, "a", "w " * 10)] * 40 + [(500 + i, "b", "w " * 50) for i in range(20)]
    drawn = mixing.draw(frame(spark, rows)).collect()
    assert len(drawn) == len(rows) and len([r for r in drawn if r.doc_id == 99]) == 40
    target = next(r.target for r in drawn if r.source == "a")
    assert abs(sum(r.copies * r.size for r in drawn if r.source == "a") - target) <= 10
    # Rows of one id and size that differ in a further column are numbered as well.
    mixed = mixing.mix(spark.createDataFrame([(*r, n, "r") for n, r in enumerate(rows)], SCHEMA)).collect()
    taken = {}
    for r in mixed:
        taken[r.copies] = taken.get(r.copies, 0) + 1
    assert len(mixed) == sum(r.copies for r in drawn) and max(taken.values()) <= 3
    assert abs(10 * sum(r.source == "a" for r in mixed) - target) <= 10


def test_no_python_in_the_plan(spark):
    for made in (mixing.draw(frame(spark, documents())), mixing.mix(frame(spark, documents()))):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
