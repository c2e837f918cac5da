import random

import numpy as np
import pytest
from llm_plain import groups, near_documents
from pyspark.sql import functions as F

from causeway.llm import minhash_dedup as mh
from causeway.llm.common import Work, components, linked_components, shingle_set

SCHEMA = "doc_id bigint, text string, kept string, component_id string"


def texts():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 80, 200, 40, 12)]
    docs = {}
    for words in base:
        for changes in (0, 0, 1, 1, 2, 3, 6):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs[len(docs) * 3] = " ".join(copy)
    docs[1000], docs[1001], docs[1002], docs[1003] = None, "", " \t\n", "Two words"
    docs[1004], docs[1005] = "two  WORDS", "x " * 30000
    docs[1006] = "y " + "x " * 30000
    return docs


@pytest.mark.parametrize("width", [4, 5])
def test_equals_all_pairs(spark, width):
    docs = texts()
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in docs.items()], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in mh.near_duplicates(frame, width=width).collect()}
    assert got == near_documents(docs, width)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "", ""), (None, None, "", ""), (7, "a b c d e f", "", ""), (7, "a b c d e f", "", ""),
            (3, "A b c d e f", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(mh.near_duplicates(frame).collect(), key=str)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (7, 3, False), (3, 3, True)}
    assert len(got) == 5
    kept = mh.keep_one_each(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [
        (3, "A b c d e f"), (None, "a b c d e f"), (None, None)]
    twice = spark.createDataFrame([(9, "only once", "", "")] * 2, SCHEMA)
    assert mh.keep_one_each(twice).count() == 1
    empty = frame.limit(0)
    assert mh.near_duplicates(empty).count() == mh.keep_one_each(empty).count() == 0


def test_signatures_estimate_similarity_and_stop_early():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    elements = np.concatenate((common, a, common, b))
    signature = mh.signatures(elements, np.repeat([0, 1], 900), 2, 256)
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.1
    alone = mh.signatures(elements[:900], np.zeros(900, np.int64), 1, 256)
    assert (alone[0] == signature[0]).all()
    # One element puts each rank at one position.
    single = mh.signatures(elements[:1], np.zeros(1, np.int64), 1, 64)
    assert sorted(single[0].astype(int)) == list(range(64))


def test_shingle_sets():
    assert len(shingle_set(b"", 4)) == 0 and len(shingle_set(b"one two", 4)) == 1
    assert len(shingle_set(b"a a a a a a", 4)) == 1 and len(shingle_set(b"A b\x0bc d e", 4)) == 2
    assert (shingle_set(b"a b c", 3) != shingle_set(b"c b a", 3)).all()


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    names = rng.sample(range(10000), 60)
    edges = list(zip(names, names[1:])) + [(20001, 20002), (5, 5)]
    work = Work(spark)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), work).collect()}
    want = groups({n for e in edges[:-1] for n in e}, edges[:-1])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), work).count() == 0
    work.drop()


def test_rounds_find_all_links_of_a_large_bucket(spark):
    """One bucket of 90 members whose links form chains that no single pivot sees."""
    links = [(i, i + 3) for i in range(0, 87)] + [(200, 201)]
    members = [(1, i) for i in range(90)] + [(2, 200), (2, 201), (3, 200), (3, 7)]
    work = Work(spark)
    known = spark.createDataFrame(links, "a bigint, b bigint")
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.join(known, ["a", "b"], "left_semi")

    found = linked_components(spark.createDataFrame(members, "bucket bigint, id bigint"), verify, work)
    assert {r.node: r.component for r in found.collect()} == groups([*range(90), 200, 201], links)
    assert len(compared) <= 8  # rounds grow with the logarithm of the bucket
    none = spark.createDataFrame([], "bucket bigint, id bigint")
    assert linked_components(none, verify, work).select(F.col("node")).count() == 0
    work.drop()
