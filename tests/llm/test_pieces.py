import pyarrow as pa
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from causeway.llm import piece_sampling as ps

SCHEMA = "doc_id bigint, text string, seed string, piece_ids string"


@pytest.fixture(scope="module")
def vocabulary():
    return ps.Vocabulary(ps._model(ps.MODEL))


def paths(word, vocabulary):
    """All segmentations of a word with their weights, by plain recursion."""
    log = {}
    for node, piece in enumerate(vocabulary.node_piece):
        if piece >= 0:
            log[vocabulary.spelling[piece].decode()] = (int(piece), float(vocabulary.node_log[node]))
    done = []

    def go(at, ids, weight):
        if at == len(word):
            done.append((tuple(ids), weight))
            return
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in log:
                piece, more = log[word[at:end]]
                go(end, [*ids, piece], weight + more)
        if word[at] not in log:
            spelt = [int(vocabulary.byte_ids[b]) for b in word[at].encode()]
            go(at + 1, [*ids, *spelt], weight + vocabulary.spelt_log)

    go(0, [], 0.0)
    return done


@pytest.mark.parametrize("word", ["then", "a▁é", "\n"])
def test_segmentations_have_their_probabilities(vocabulary, word):
    n = 20000
    drawn = Counter(tuple(int(p) for p in ids) for ids in ps.sample_pieces(
        [word] * n, ps.mixed(np.arange(n, dtype=np.uint64)), ps._Tables(vocabulary)))
    # The space in front is cut from the line end, which no piece holds.
    known = [paths(w, vocabulary) for w in vocabulary.word.findall(" " + word)]
    chance = {(): 1.0}
    for options in known:
        total = sum(math.exp(w) for _, w in options)
        chance = {a + ids: p * math.exp(w) / total for a, p in chance.items() for ids, w in options}
    assert set(drawn) <= set(chance)
    for ids, p in chance.items():
        assert abs(drawn[ids] / n - p) < 0.02


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(vocabulary, text):
    ids = ps.sample_pieces([text], np.array([5], np.uint64), ps._Tables(vocabulary))[0]
    assert ps.join_pieces(ids, vocabulary.spelling) == text


def test_agrees_with_the_library_on_decoding(vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=ps.MODEL)
    text = "hello  wörld, this is 你好 a test\nof it"
    ids = ps.sample_pieces([text], np.array([1], np.uint64), ps._Tables(vocabulary))[0]
    assert library.decode([int(i) for i in ids]) == text
    assert ps.join_pieces(library.encode(text), vocabulary.spelling) == text


def test_tables_made_anew_give_the_same(vocabulary, monkeypatch):
    texts = [f"some words {i} and an end{i * 7}" for i in range(50)]
    seeds = ps.mixed(np.arange(50, dtype=np.uint64))
    whole = ps.sample_pieces(texts, seeds, ps._Tables(vocabulary))
    monkeypatch.setattr(ps, "EDGES", 10)
    tables = ps._Tables(vocabulary)
    for text, seed, ids in zip(texts, seeds, whole):
        assert list(ps.sample_pieces([text], np.array([seed]), tables)[0]) == list(ids)


def test_rows(spark):
    rows = [(1, "hello world", "s", "p"), (1, "hello world", "s", "p"), (2, None, "s", "p"), (None, "", "s", "p"),
            (3, "long " * 50000, None, None), (4, "x" * 5000, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    one = ps.sampled(frame)
    assert one.columns == ["doc_id", "text", "seed", "piece_ids"]
    got = {r.doc_id: r.piece_ids for r in one.collect()}
    assert got[2] is None and got[None] == []
    assert len({tuple(r.piece_ids) for r in one.where("doc_id = 1").collect()}) == 1
    other = {r.doc_id: r.piece_ids for r in ps.sampled(frame.repartition(4)).collect()}
    assert got == other
    decoded = ps.decode(one).collect()
    assert all(r.decoded == r.row.text for r in decoded) and len(decoded) == 6
    assert ps.sampled(frame.limit(0)).count() == 0


def test_texts_of_many_lists_at_once(monkeypatch):
    spelling = ps.spellings(ps._model(ps.MODEL))
    assert spelling == ps.Vocabulary(ps._model(ps.MODEL)).spelling
    tables = ps._Tables(ps.Vocabulary(ps._model(ps.MODEL)))
    texts = ["", "a", " two  words ", "é日本\U0001f600 x", None, "\n\n", "", None, "end " * 50]
    seeds = ps.mixed(np.arange(len(texts)).astype(np.uint64))
    pieces = ps.sample_pieces([t or "" for t in texts], seeds, tables)
    lists = pa.array([None if t is None else p.tolist() for t, p in zip(texts, pieces)], pa.list_(pa.int32()))
    speller = ps.Speller(spelling)
    for part in (lists, lists.slice(2, 4), lists.slice(4, 1), lists.slice(0, 0), lists.slice(5)):
        assert speller.texts(part).to_pylist() == [None if x is None else ps.join_pieces(x, spelling) for x in part.to_pylist()]
    assert speller.texts(lists).to_pylist() == texts
    monkeypatch.setattr(ps, "CHUNK", 3)
    assert speller.texts(lists).to_pylist() == texts
