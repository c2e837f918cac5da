import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_plain import WORD, lower

from causeway.llm import hidden_markov as hm

SCHEMA = "doc_id bigint, text string, held string, h string, block string"


def block_of(lengths, distinct=500, seed=0):
    rng = np.random.default_rng(seed)
    words = np.unique(np.append(rng.integers(0, 2**64, distinct, dtype=np.uint64), hm.END))
    token = rng.integers(0, len(words), sum(lengths)).astype(np.uint32)
    return hm._Block({"block": 3, "doc_id": list(range(len(lengths))), "held": [False] * len(lengths), "length": list(lengths),
                      "words": words.tobytes(), "token_low": token.astype(np.uint16).tobytes(),
                      "token_high": (token >> np.uint32(16)).astype(np.uint16).tobytes()})


def chain(states, seed=1):
    rng = np.random.default_rng(seed)
    emit = rng.random((hm.CLASSES + 1, states))
    return hm.Chain(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit / emit.sum(axis=0))


def plain_forward(c, sequence):
    log, alphas, alpha = 0.0, [], c.start
    for t, x in enumerate(sequence):
        alpha = (alpha if t == 0 else alpha @ c.move) * c.emit[x]
        log += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
        alphas.append(alpha)
    return log, alphas


@pytest.mark.parametrize("states", [1, 4])
def test_recursions_equal_plain_ones(states, monkeypatch):
    monkeypatch.setattr(hm, "CHUNK_TOKENS", 400)
    lengths = [1, 2, 63, 64, 65, 128, 300, 1, 700]
    block, c = block_of(lengths), chain(states)
    classes = block.classes()
    sequences = [classes[s:s + n] for s, n in zip(block.start, block.length)]
    assert c.likelihoods(block) == pytest.approx([plain_forward(c, s)[0] for s in sequences])
    rows = np.array([0, 2, 4, 6, 8])
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(c.emit)
    total = c.expected(block, rows, start, move, emit)
    want = [np.zeros_like(x) for x in (start, move, emit)]
    for r in rows:
        sequence, (_, alphas) = sequences[r], plain_forward(c, sequences[r])
        beta = np.ones(states)
        for t in range(len(sequence) - 1, -1, -1):
            here = alphas[t] * beta / (alphas[t] * beta).sum()
            want[2][sequence[t]] += here
            if t == 0:
                want[0] += here
            else:
                carried = c.emit[sequence[t]] * beta
                pair = alphas[t - 1][:, None] * c.move * carried[None, :]
                want[1] += pair / pair.sum()
                beta = c.move @ carried
                beta /= beta.sum()
    assert total == pytest.approx(sum(plain_forward(c, sequences[r])[0] for r in rows))
    for got, plain in zip((start, move, emit), want):
        assert np.allclose(got, plain)
    assert emit.sum() == pytest.approx(sum(lengths[r] for r in rows))


def documents():
    """Two kinds of text, each with words of its own and some shared ones."""
    rng = random.Random(9)
    kinds = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]]
    rows = []
    for i in range(150):
        words = [rng.choice(kinds[i % 2] + ["the", "of"]) for _ in range(rng.choice([0, 1, 5, 60, 200]))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words), "x", "y", "z"))
    return rows + [(500, None, None, None, None), (501, "never seen words", "", "", ""), (None, "a1 a2", "", "", ""),
                   (502, "a1 " * 20000, "", "", ""), (3, "repeated row", "", "", ""), (3, "repeated row", "", "", "")]


def test_scores_against_plain_counts(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = hm.score_texts(frame.repartition(3), states=3, iterations=4).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    tokens = [(r[0], [*WORD.findall(lower(r[1] or "")), None]) for r in rows]
    count = Counter()
    for d, t in tokens:
        if not held(d):
            count.update(t)
    n, v = sum(count.values()), len(count)
    want = sorted(
        ((d, held(d), len(t), sum(count[w] > 0 for w in t), n,
          round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for d, t in tokens), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == want
    # The states tell the two kinds apart, which single words can't.
    long = [r for r in got if r.n_tokens > 50 and r.doc_id is not None and r.doc_id < 500]
    assert all(r.score > r.base_score for r in long) and any(r.held_out for r in long)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_training_raises_the_likelihood(spark):
    from pyspark.sql import functions as F

    from causeway.llm.common import Work

    work = Work(spark)
    frame = spark.createDataFrame(documents(), SCHEMA).select("doc_id", F.col("text").cast("binary").alias("text"),
                                                               F.lit(False).alias("held"))
    blocks = work.cut(frame.mapInArrow(hm._pack, hm._BLOCK))
    words = blocks.mapInArrow(hm._count_words, "block bigint, h bigint, c bigint")
    vocabulary = work.cut(words.groupBy("h").agg(F.sum("c").alias("c")))
    model = hm._train(blocks, vocabulary, 3, 5)
    assert all(b > a - 1 for a, b in zip(model.history, model.history[1:]))
    assert np.allclose(model.chain.move.sum(axis=1), 1) and np.allclose(model.chain.emit.sum(axis=0), 1)
    work.drop()


def test_no_training_rows_and_no_rows(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    nothing = hm.score_texts(frame.limit(0), states=2, iterations=1)
    assert nothing.count() == 0
    held = frame.where("crc32(coalesce(cast(doc_id as string), '')) % 10 = 0")
    got = hm.score_texts(held, states=2, iterations=1).collect()
    assert got and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 and math.isfinite(r.score) for r in got)
