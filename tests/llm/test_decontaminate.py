import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_plain import lower

from causeway.llm import decontaminate as dc
from causeway.llm.queries import op12_decontamination

DOCS = "doc_id bigint, text string, row string, items string, hits string, n_words string"
ITEMS = "item_id bigint, text string, name string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def plain(docs, items, window=10):
    """Per document the number of words, the hit places and the names of the items."""
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i:i + size]))
                if found:
                    names |= found
                    hit |= set(range(i, i + size))
        out.append((doc, len(w), sorted(hit), sorted(names)))
    return out


def tables():
    rng = random.Random(12)
    vocabulary = ["the", "of", "Über", "x9", "ñu", "日本"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([12, 25, 40]))) for i in range(20)]
    items += [(20, items[3][1]), (21, "of the x9"), (22, "ñu, ÑU"), (23, None), (24, ""), (25, "?!"), (None, items[5][1]), (7, line(11)), (26, "the " * 30)]
    docs = []
    for d in range(120):
        parts = [line(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items[:21])[1].split()
            a = rng.randrange(len(w))
            parts += [rng.choice([" ", "\n", "--"]).join(w[a:a + rng.randint(5, 30)]).upper(), line(rng.randint(0, 5))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (502, "?"), (None, items[1][1]), (503, items[2][1]), (503, items[2][1]), (504, "the " * 5000),
             (505, line(3000) + " " + items[0][1])]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS))


def spans(places):
    out = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block, shard", [(dc.BLOCK, dc.SHARD), (60, 700), (500, 64)])
def test_equals_plain_version(spark, monkeypatch, block, shard):
    """In one block and in several, also with shards that cut texts."""
    monkeypatch.setattr(dc, "SHARD", shard)
    docs, items = tables()
    found = dc.find(*frames(spark, docs, items), block=block)
    got = sorted(((r.row.doc_id, r.n_words, r["items"], [tuple(x) for x in r.hits], r.n_hit) for r in found.collect()), key=str)
    want = sorted(((d, n, names, spans(hit), len(hit)) for d, n, hit, names in plain(docs, items)), key=str)
    assert got == want and sum(bool(x[4]) for x in want) > 30 and sum(not x[4] for x in want) > 5


def test_query(spark, tmp_path):
    docs, items = tables()
    for frame, name in zip(frames(spark, docs, items), ("documents", "benchmark")):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = op12_decontamination(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = [(d, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)) for d, n, hit, names in plain(docs, items)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_affected_documents_go(spark):
    docs, items = tables()
    stay = dc.remove(*frames(spark, docs, items))
    assert stay.columns == ["doc_id", "text", "row", "items", "hits", "n_words"]
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == sorted((d, docs[i][1]) for i, (d, _, hit, _) in enumerate(plain(docs, items)) if not hit)


def test_longest_matches(spark, monkeypatch):
    monkeypatch.setattr(dc, "SHARD", 500)
    docs, items = tables()
    docs = [d for d in docs if d[0] is not None]
    texts = {d: words(t) for d, t in docs}
    by_name = {}
    for name, text in items:
        by_name.setdefault("" if name is None else str(name), []).append(words(text))
    got = {(r.name, r["at"]): (r.length, r.doc, r.doc_at) for r in dc.longest_matches(*frames(spark, docs, items), block=300).collect()}
    joined = [" " + " ".join(t) + " " for t in texts.values()]
    for name, rows in by_name.items():
        for at in range(max(map(len, rows))):
            best = max(next((n for n in range(len(w) - at, 0, -1) if any(f" {' '.join(w[at:at + n])} " in t for t in joined)), 0) for w in rows)
            assert got.get((name, at), (0,))[0] == best
            if best:
                length, doc, doc_at = got[name, at]
                assert any(texts[doc][doc_at:doc_at + length] == w[at:at + length] for w in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
def test_suffix_array_is_in_order(ids, depth):
    ids = np.array(ids + [0], np.int64)
    order = dc.suffix_array(ids, depth)

    def head(p):
        found = ids[p:p + depth].tolist()
        return found[:found.index(0)] if 0 in found else found

    assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()
    heads = [head(p) for p in order.tolist()]
    assert heads == sorted(heads)


def test_empty_tables(spark):
    docs, items = frames(spark, *tables())
    assert dc.find(docs.limit(0), items).count() == 0
    rows = dc.find(docs, items.limit(0)).collect()
    assert len(rows) == docs.count() and not any(r.n_hit or r["items"] or r.hits for r in rows) and any(r.n_words for r in rows)
    assert dc.longest_matches(docs, items.limit(0)).count() == dc.longest_matches(docs.limit(0), items).count() == 0
