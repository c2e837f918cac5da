"""Spelling variants by pivotal grams.

Words are near if they differ by exactly one inserted, deleted or replaced code point. Every word
is cut into bigrams, put in one order of all bigrams, the rarest first. A word's *prefix* are its
three first bigrams (and all equal to the third), its *pivots* two disjoint ones of the prefix,
chosen by dynamic programming for the least total number of words that hold them. One edit touches
at most one of two disjoint bigrams, so of two near words the one whose prefix ends first in the
order has a pivot that is untouched, and this bigram lies in the prefix of the other (a bigram of
the other that comes no later than the end of its own prefix is in it). So pivots are looked up
among prefixes only.

Position limits: the edit lies on one side of the untouched pivot, so the other side is equal to
the end of the word, and of the edited side, cut in two, one half is equal. A pivot is
therefore indexed under four keys (edit to the right or left, outer or inner half equal), each the
text that must agree and its place, and a gram of a prefix looks up the same four for every length
the other word may have. What meets is verified by the edit distance.

The order may be any; its frequencies are those of the ``GRAMS`` most frequent bigrams, rarer ones count
as never seen and come first by their code points. So nothing here grows in one place but the table
of bigrams, up to that bound, and results don't depend on the bound.

A word's form is its near word of largest n (ties: the smallest), if n is at least ``TIMES`` the word's; its
root is the end of the chain of forms, found by doubling: n grows by ``TIMES`` at each step, so a chain has at
most log n words.

Results for odd input: a null or empty text has no words; a null doc_id counts as the empty text
where words are damaged; repeated rows count again; a run of any length is a word; the tables may be
empty and may hold further columns, also with the names used here.
"""

from __future__ import annotations

import heapq
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causeway.llm.common import MIX, Work, mixed

TIMES = 5
LEAST_LENGTH = 6
LEAST_COUNT = 5
DAMAGED = 199
# Bigrams whose frequencies are known to all tasks.
GRAMS = 1 << 16
# Distinct words counted in a task before the counts are sent on.
COUNTED = 1 << 18
# Code points from which on a word does not go along with its keys.
LONG = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# Code points that can be part of a word, as bytes of Latin-1: letters A-Z become a-z, all others a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def damaged(run: str, crc: int, modulus: int = DAMAGED) -> str:
    """The run without one code point if ``modulus`` divides its checksum."""
    if crc % modulus:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, key: str = "doc_id", column: str = "text", modulus: int = DAMAGED) -> DataFrame:
    """(word, n) of the lower-cased runs of letters up to U+00FF, damaged by key and run."""
    slim = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(column).alias("text")).where(
        "text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        # Decoded words and their bytes in UTF-8, of which checksums are made.
        known: dict[bytes, tuple[str, bytes]] = {}

        def counted() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                words = Counter(text.as_py().encode("latin-1", "replace").translate(_LETTERS).split())
                crc = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in words.items():
                    both = known.get(word)
                    if both is None:
                        decoded = word.decode("latin-1")
                        both = known[word] = decoded, decoded.encode()
                    mark = zlib.crc32(both[1], crc)
                    counts[both[0] if mark % modulus else damaged(both[0], mark, modulus)] += n
                if len(known) > COUNTED:
                    known.clear()
                if len(counts) > COUNTED:
                    yield counted()
                    counts.clear()
        yield counted()

    return slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_bigrams(words: DataFrame) -> DataFrame:
    """(gram, n): the number of words that hold each bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for word in batch.column(0):
                word = word.as_py()
                counts.update({word[i:i + 2] for i in range(len(word) - 1)})
            yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced: what follows the first difference is equal."""
    if len(a) > len(b):
        a, b = b, a
    at = len(os.path.commonprefix([a, b]))
    return at < len(b) and (a[at + 1:] if len(a) == len(b) else a[at:]) == b[at + 1:]


def choose_pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Indices of two bigrams that share no code point, of least total cost; places are ascending.

    Dynamic programming from left to right: ``best`` is the cheapest bigram that ends before the present one begins.
    """
    best, ready, chosen, least = -1, 0, (-1, -1), math.inf
    for j, place in enumerate(places):
        while places[ready] + 2 <= place:
            if best < 0 or costs[ready] < costs[best]:
                best = ready
            ready += 1
        if best >= 0 and costs[best] + costs[j] < least:
            chosen, least = (best, j), costs[best] + costs[j]
    return chosen


def _grams(word: str, seen: dict[str, int]) -> tuple[list[int], tuple[int, int], tuple[int, str]]:
    """Places of the prefix, indices of the pivots in it, and the order of the prefix's last bigram."""
    cut = [word[i:i + 2] for i in range(len(word) - 1)]
    order = [(seen.get(g, 0), g) for g in cut]
    last = heapq.nsmallest(3, order)[2]
    places = [i for i, o in enumerate(order) if o <= last]
    return places, choose_pivots(places, [order[i][0] for i in places]), last


def pivot_keys(word: str, at: int) -> list[str]:
    """The four keys of a pivot: what is equal in a near word whose edit lies to the right, and to the left, of it."""
    size, end = len(word), at + 2
    right, left = (size - end) // 2, at // 2
    return [_key("inner right", at, word[:end + right]), _key("outer right", end, word[:end], word[end + right:]),
            _key("inner left", size - at, word[at - left:]), _key("outer left", size - at, word[:at - left], word[at:])]


def prefix_keys(word: str, at: int) -> list[str]:
    """The keys under which a word at one edit has its pivot, if that is the bigram at ``at`` of this word."""
    size, end = len(word), at + 2
    rest, keys = size - end, []
    for other in (rest - 1, rest, rest + 1):
        inner, outer = other // 2, other - other // 2
        if 0 <= inner <= rest:
            keys.append(_key("inner right", at, word[:end + inner]))
        if 0 <= outer <= rest:
            keys.append(_key("outer right", end, word[:end], word[size - outer:]))
    for other in (at - 1, at, at + 1):
        inner, outer = other // 2, other - other // 2
        if 0 <= inner <= at:
            keys.append(_key("inner left", size - at, word[at - inner:]))
        if 0 <= outer <= at:
            keys.append(_key("outer left", size - at, word[:outer], word[at:]))
    return keys


def _key(kind: str, place: int, *equal: str) -> str:
    return f"{kind} {place} {''.join(equal)}"


def _keyed(words: DataFrame, seen: dict[str, int]) -> DataFrame:
    """(key, pivot, word, n, last): each word under the keys of its pivots and, for looking up, of its prefix."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys, pivots, rows, lasts = [], [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    places, chosen, last = _grams(word, seen)
                    own = dict.fromkeys(k for i in chosen for k in pivot_keys(word, places[i]))
                    sought = dict.fromkeys(k for at in places for k in prefix_keys(word, at))
                    for pivot, made in ((True, own), (False, sought)):
                        keys += map(xxhash.xxh64_intdigest, made)
                        pivots += [pivot] * len(made)
                        rows += [row] * len(made)
                        lasts += [f"{last[0]:020d}{last[1]}"] * len(made)
                taken = part.take(pa.array(rows, pa.int64()))
                yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(pivots, pa.bool_()), taken.column(0),
                                       taken.column(1), pa.array(lasts, pa.string())], names=["key", "pivot", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(run, "key bigint, pivot boolean, word string, n bigint, last string")


def _long_keys(word: str, places: np.ndarray, rests: np.ndarray, lefts: np.ndarray) -> np.ndarray:
    """Hashes of the keys at ``places``, for words whose keys are too long to be written out.

    Of the edited side, which the other word has ``rests`` long to the right and ``lefts`` to the left, half must agree.
    Hashes of stretches are differences of one running sum, so each key takes the same time.
    """
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = len(points)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE))))
        inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE_INVERSE))))
        total = np.concatenate(([np.uint64(0)], np.cumsum((points + np.uint64(1)) * power[:-1])))

        def stretch(begin, end):
            return mixed((total[end] - total[begin]) * inverse[begin])

        def key(kind, place, *hashes):
            found = mixed(place.astype(np.uint64) * MIX + np.uint64(kind))
            for h in hashes:
                found = mixed(found * MIX + h)
            return found

        start, end, last = np.zeros_like(places), places + 2, np.full_like(places, size)
        inner, outer = rests // 2, rests - rests // 2
        right = (rests >= 0) & (inner <= size - end), (rests >= 0) & (outer <= size - end)
        near, far = lefts // 2, lefts - lefts // 2
        left = (lefts >= 0) & (near <= places), (lefts >= 0) & (far <= places)
        made = []
        for kind, fits, place, stretches in (
                (1, right[0], places, ((start, end + inner),)), (2, right[1], end, ((start, end), (last - outer, last))),
                (3, left[0], last - places, ((places - near, last),)), (4, left[1], last - places, ((start, far), (places, last)))):
            made.append(key(kind, place[fits], *[stretch(a[fits], b[fits]) for a, b in stretches]))
    return np.unique(np.concatenate(made))


def _keyed_long(words: DataFrame, seen: dict[str, int]) -> DataFrame:
    """(key, pivot, id, size, last) of long words; their texts do not go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, word in zip(batch.column(0).to_pylist(), batch.column(1)):
                word = word.as_py()
                places, chosen, last = _grams(word, seen)
                places = np.array(places, np.int64)
                pivots = places[list(chosen)]
                own = _long_keys(word, pivots, len(word) - pivots - 2, pivots)
                shifts = [(places, len(word) - places - 2 + d, places + d) for d in (-1, 0, 1)]
                sought = np.unique(np.concatenate([_long_keys(word, *s) for s in shifts]))
                n = len(own) + len(sought)
                yield pa.record_batch(
                    [pa.array(np.concatenate((own, sought)).view(np.int64)), pa.array(np.arange(n) < len(own)), pa.array([id_] * n, pa.int64()),
                     pa.array([len(word)] * n, pa.int64()), pa.array([f"{last[0]:020d}{last[1]}"] * n, pa.string())],
                    names=["key", "pivot", "id", "size", "last"])

    return words.select("id", "word").mapInArrow(run, "key bigint, pivot boolean, id bigint, size bigint, last string")


def _met(words: DataFrame, seen: dict[str, int], work: Work) -> DataFrame:
    """(p, np, q, nq) of words of usual length: they go along with their keys and are verified where they meet."""
    keyed = work.cut(_keyed(words, seen))
    pivots = keyed.where("pivot").select("key", F.col("word").alias("p"), F.col("n").alias("np"), F.col("last").alias("lp"))
    prefixes = keyed.where("NOT pivot").select("key", F.col("word").alias("q"), F.col("n").alias("nq"), F.col("last").alias("lq"))
    met = pivots.join(prefixes, "key").where("lp <= lq AND p <> q AND abs(length(p) - length(q)) <= 1")
    return met.where(F.levenshtein("p", "q", 1) == 1).select("p", "np", "q", "nq")


def _met_long(words: DataFrame, seen: dict[str, int], work: Work) -> DataFrame:
    """(p, np, q, nq) of long words: numbers meet, the words are fetched for the pairs to verify."""
    words = words.withColumn("id", F.xxhash64("word"))
    keyed = work.cut(_keyed_long(words, seen))
    pivots = keyed.where("pivot").select("key", F.col("id").alias("i"), F.col("size").alias("si"), F.col("last").alias("li"))
    prefixes = keyed.where("NOT pivot").select("key", F.col("id").alias("j"), F.col("size").alias("sj"), F.col("last").alias("lj"))
    met = pivots.join(prefixes, "key").where("li <= lj AND i <> j AND abs(si - sj) <= 1").select("i", "j").distinct()
    for id_, word, n in (("i", "p", "np"), ("j", "q", "nq")):
        met = met.join(words.select(F.col("id").alias(id_), F.col("word").alias(word), F.col("n").alias(n)), id_)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_edit(p.as_py(), q.as_py()) for p, q in zip(batch.column(0), batch.column(2))], pa.bool_()))

    return met.select("p", "np", "q", "nq").mapInArrow(verified, "p string, np bigint, q string, nq bigint")


def near_words(words: DataFrame, work: Work) -> DataFrame:
    """Distinct pairs (a, na, b, nb) with a < b of the words (word, n) that differ by one edit.

    Words must be distinct. Those of less than four code points have not the three bigrams and are near to none.
    """
    words = words.where(F.length("word") >= 4)
    seen = {r["gram"]: r["n"] for r in count_bigrams(words).orderBy(F.desc("n"), "gram").limit(GRAMS).collect()}
    # Words at the border of both lengths go both ways, so that they meet those on either side.
    met = _met(words.where(F.length("word") <= LONG), seen, work)
    met = met.union(_met_long(words.where(F.length("word") >= LONG), seen, work))
    return met.select(F.least("p", "q").alias("a"), F.when(F.col("p") < F.col("q"), F.col("np")).otherwise(F.col("nq")).alias("na"),
                      F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("nq")).otherwise(F.col("np")).alias("nb")).distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words (word, n)."""
    work = Work(words.sparkSession)
    words = work.cut(words.select("word", "n"))
    pairs = near_words(words, work)
    pairs = work.cut(pairs)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = (-F.col("best.m")) >= F.col("n") * times
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))
    found = work.cut(found)
    # A chain of forms has at most as many steps as n can grow by ``times``; each round doubles the steps taken.
    most = max(2, words.agg(F.max("n")).first()[0] or 2)
    steps = work.cut(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(1 + math.log(most, times))) if times > 1 else 0):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = work.cut(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Variants among the words of ``docs`` that are long and frequent enough."""
    words = count_words(docs, key, column).where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return variants(words)
