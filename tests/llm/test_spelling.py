import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from causeway.llm import spelling as sp
from causeway.llm.common import Work
from causeway.llm.queries import op11_spelling
from llm_plain import lower

SCHEMA = "doc_id bigint, text string, word string, n bigint, key string"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            counts[run if h % 199 else run[:at] + run[at + 1:]] += 1
    return counts


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        good = others and -others[0][0] >= 5 * n
        out[w] = [others[0][1] if good else None, None, n, len(others), -others[0][0] if good else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def documents():
    rng = random.Random(3)
    syllables = ["ka", "té", "mo", "ÿl", "ri", "ss", "aa", "ab"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))) for _ in range(60)]
    words = []
    for i, w in enumerate(base):
        words += [w] * rng.choice([5, 30, 200])
        for _ in range(3):  # variants of variants, so that there are chains
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + "e" + w[at + 1:]])
            words += [w.upper() if rng.random() < 0.3 else w] * rng.choice([1, 5, 6, 30])
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50]) + "Ā×÷ sep1word") for i in range(50)]
    return rows + [(None, None), (None, "kakaka kakaka"), (7, ""), (8, "…"), (9, "a" * 100000), (9, "a" * 100000)] + [(60, "zzzzzzz " * 3)] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA)


def test_equals_all_pairs(spark, tmp_path):
    rows = documents()
    counts = plain_counts(rows)
    got = {r.word: r.n for r in sp.count_words(frame(spark, rows)).collect()}
    assert got == counts
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_spelling(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = found.collect()
    assert {r.word: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert any(r.form and r.form != r.root for r in found) and any(r.n_near > 2 for r in found)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=11), st.data())
def test_one_edit_leaves_a_common_key(word, data):
    """Whatever the edit and the order of bigrams, a pivot of one word is looked up by the other."""
    at = data.draw(st.integers(0, len(word)))
    other = data.draw(st.sampled_from([word[:at] + word[at + 1:], word[:at] + "a" + word[at:], word[:at] + "b" + word[at + 1:]]))
    if len(other) < 6 or not near(word, other):
        return
    grams = [a + b for a in "abc" for b in "abc"]
    seen = dict(zip(grams, data.draw(st.lists(st.integers(0, 3), min_size=9, max_size=9))))
    met = False
    for p, q in ((word, other), (other, word)):
        (places, chosen, last), (others, _, end) = sp._grams(p, seen), sp._grams(q, seen)
        keys = {k for i in chosen for k in sp.pivot_keys(p, places[i])}
        met |= last <= end and bool(keys & {k for i in others for k in sp.prefix_keys(q, i)})
    assert met


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=3, max_size=6, unique=True).map(sorted), st.data())
def test_pivots_are_the_cheapest_disjoint_two(places, data):
    costs = data.draw(st.lists(st.integers(0, 5), min_size=len(places), max_size=len(places)))
    i, j = sp.choose_pivots(places, costs)
    assert places[i] + 2 <= places[j]
    assert costs[i] + costs[j] == min(costs[a] + costs[b] for b in range(len(places)) for a in range(b) if places[a] + 2 <= places[b])


def test_unknown_bigrams_change_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(w, n) for w, n in plain_counts(documents()).items() if len(w) >= 6], "word string, n bigint")
    whole = sorted(map(tuple, sp.variants(words).collect()), key=str)
    monkeypatch.setattr(sp, "GRAMS", 5)
    assert sorted(map(tuple, sp.variants(words).collect()), key=str) == whole


def test_long_chains_end_in_their_roots(spark):
    words = [("aaaaaa" + "b" * i, 5 ** (i + 1)) for i in range(12)]
    got = {r.word: r.root for r in sp.variants(spark.createDataFrame(words, "word string, n bigint")).collect()}
    assert set(got.values()) == {words[-1][0]}


def test_long_words(spark):
    """Around the length from which words no longer go along with their keys, with bigrams that repeat."""
    rng = random.Random(9)
    words = {}
    for size in (sp.LONG - 2, sp.LONG - 1, sp.LONG, sp.LONG + 1, 3000):
        for base in ("a" * size, "".join(rng.choice("abÿ") for _ in range(size))):
            words[base] = 7
            for _ in range(4):
                at = rng.randrange(size + 1)
                words[rng.choice([base[:at] + base[at + 1:], base[:at] + rng.choice("ac") + base[at:], base[:at] + "c" + base[at + 1:]])] = 40
    words["a" * 200_000] = 5
    words["a" * 200_001] = 50
    want = plain_variants({w: n for w, n in words.items() if len(w) < 10_000})
    got = {r.word: tuple(r)[1:] for r in sp.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert {w: r for w, r in got.items() if len(w) < 10_000} == want and sum(r[3] for r in want.values()) > 30
    assert got["a" * 200_000][0] == "a" * 200_001


def test_short_words_and_ties(spark):
    words = spark.createDataFrame([("ab", 50), ("abc", 5), ("kalxmu", 50), ("kalymu", 50), ("kalzmu", 10)], "word string, n bigint")
    got = {r.word: (r.form, r.n_near) for r in sp.variants(words).collect()}
    assert got == {"ab": (None, 0), "abc": (None, 0), "kalxmu": (None, 2), "kalymu": (None, 2), "kalzmu": ("kalxmu", 2)}


def test_empty_tables(spark):
    docs = frame(spark, documents())
    assert sp.variants_of(docs.limit(0)).count() == 0
    assert sp.variants_of(frame(spark, [(1, None), (2, "")])).count() == 0
    assert sp.near_words(spark.createDataFrame([], "word string, n bigint"), Work(spark)).count() == 0


@pytest.mark.parametrize("text", ["Straße naïve ÀÉ", "ǅ ß×ÿ", "퟿\U0001f600ab́c"])
def test_runs_are_those_of_the_pattern(spark, text):
    got = {r.word: r.n for r in sp.count_words(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()}
    assert got == plain_counts([(1, text)])
