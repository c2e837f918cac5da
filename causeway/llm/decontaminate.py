"""Benchmark decontamination with suffix arrays of the training texts.

The documents are the training side. Each task cuts its texts into words and makes a suffix array of
every shard of about ``SHARD`` words: the places of the shard in the order of the words that follow
them. Every suffix of every test item is then searched in it: the range of the places whose
words agree is narrowed word by word, by binary search, until it is empty. That gives the longest
verbatim match of the suffix and where it is, and, at the length of a window, all occurrences
of that window.

Words are numbered by the test items' vocabulary. A word of no item has a number that matches nothing;
a suffix that begins with one is not in the array, as its longest match has length 0. Suffixes are
ordered as far as the longest item reaches, first by their first words as one number, then
by doubling the sorted length among those that are still equal. A text longer than a shard is cut
into shards that overlap by the longest item, so no match is lost.

The items go to all tasks in blocks of at most ``BLOCK`` words, counted before they are sent, each
block with a pass over the documents, so nothing that is sent grows with the data. Documents are never
shuffled but to bring the results of several blocks together.

Results for odd input: null and empty texts, and texts without words, have no words and no hit, items
without words match nothing; repeated documents are rows of their own, rows that repeat an item_id
are one item with the windows of all; a null item_id is the item with the empty name; texts may
be of any length; an empty table of items finds nothing, an empty table of documents gives an
empty result; further columns of the documents are kept, also with the names used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from causeway.llm.common import Work

WINDOW = 10
# Words of a shard, and of the test items that are searched at once.
SHARD = 1 << 20
BLOCK = 1 << 22

# Lower-cased ASCII letters, digits and all bytes of other characters; anything else separates words.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
                    for c in range(256))


def cut_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass
class Items:
    """Test items as numbers: ``ids`` one after the other, each ended by 0; suffix i begins at ``start[i]``."""

    names: list[str]
    vocabulary: dict[bytes, int]
    ids: np.ndarray
    start: np.ndarray  # of each suffix
    at: np.ndarray  # the same, counted from the first word of its text
    length: np.ndarray  # words from there to the end of the text
    item: np.ndarray  # place in ``names``
    window: np.ndarray  # length of the window that begins there, 0 if none does

    @property
    def depth(self) -> int:
        return int(self.length.max()) if len(self.length) else 0


def number_items(rows: list[tuple[str, str | None]], window: int = WINDOW) -> Items:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    ids, start, at, length, item, size = [], [], [], [], [], []
    for name, text in rows:
        words = cut_words(text)
        place, n = names.setdefault(name, len(names)), len(words)
        start += range(len(ids), len(ids) + n)
        at += range(n)
        length += range(n, 0, -1)
        item += [place] * n
        wide = min(window, n)
        size += [wide if n - i >= wide else 0 for i in range(n)]
        ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words] + [0]
    whole = [np.array(x, np.int64) for x in (ids, start, at, length, item, size)]
    return Items(list(names), vocabulary, *whole)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` that hold no 0, ordered by the ``depth`` numbers from there; 0 and the end come before all others.

    What follows a 0 does not count: places whose numbers are equal up to a 0 are in any order.
    """
    places = np.flatnonzero(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    width = max(1, min(63 // bits, depth))
    # The first ``width`` numbers as one; past the end there are zeros.
    padded = np.concatenate((ids, np.zeros(width, np.int64)))
    head = np.zeros(len(places), np.int64)
    for i in range(width):
        head = (head << bits) | padded[places + i]
    by = np.argsort(head)
    order, head = places[by], head[by]
    new = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1]))) if len(head) else np.zeros(0, np.int64)
    # A place's rank is where its group of equals begins; groups of several are sorted on by the ranks further along.
    sizes = np.diff(np.append(new, len(order)))
    rank = np.full(len(ids) + 1, -1, np.int64)
    rank[order] = np.repeat(new, sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
    reach = width
    while reach < depth and len(open_):
        places = order[open_]
        group, following = rank[places], rank[np.minimum(places + reach, len(ids))]
        by = np.argsort(group * (len(order) + 1) + following)
        places, group, following = places[by], group[by], following[by]
        order[open_] = places
        at = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (following[1:] != following[:-1]))))
        sizes = np.diff(np.append(at, len(places)))
        rank[places] = np.repeat(open_[at], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return order


def _bound(ids: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, sought: np.ndarray, after: bool) -> np.ndarray:
    """In each range of the array, where the ``at``-th numbers begin to be ``sought`` or more, or, with ``after``, more than that."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        here = ids[np.minimum(array[middle] + at, len(ids) - 1)]
        right = here <= sought[open_] if after else here < sought[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


def search(ids: np.ndarray, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every suffix of the items: the length of its longest match, one place of it in the array, and the range of its window.

    ``ids`` must end with a 0. The range is empty if the suffix has no window or the window does not occur.
    """
    n = len(items.start)
    longest, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, len(array))
    at = 0
    while len(alive):
        sought = items.ids[items.start[alive] + at]
        narrow = _bound(ids, array, low, high, at, sought, False)
        high = _bound(ids, array, narrow, high, at, sought, True)
        found = narrow < high
        alive, low, high = alive[found], narrow[found], high[found]
        at += 1
        longest[alive], place[alive] = at, low
        whole = items.window[alive] == at
        from_[alive[whole]], to[alive[whole]] = low[whole], high[whole]
        more = items.length[alive] > at
        alive, low, high = alive[more], low[more], high[more]
    return longest, place, from_, to


def _numbered(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time: (rows, the numbers of their words with a 0 after each row, where each row's numbers begin)."""
    get = items.vocabulary.get
    for batch in batches:
        texts, begin = batch.column(1), 0
        parts, starts, size = [], [], 0
        for i in range(batch.num_rows):
            words = cut_words(texts[i].as_py())
            starts.append(size)
            size += len(words) + 1
            numbers = [get(w, 0) for w in words]
            numbers.append(0)
            parts.append(np.array(numbers, np.int64))
            if size >= SHARD or i + 1 == batch.num_rows:
                yield batch.slice(begin, i + 1 - begin), np.concatenate(parts), np.array([*starts, size], np.int64)
                parts, starts, size, begin = [], [], 0, i + 1


def _shards(ids: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards of the numbers: (place of the first, numbers ended by a 0, suffix array of those of the shard itself)."""
    cuts = np.linspace(0, len(ids), max(1, round(len(ids) / SHARD)) + 1).astype(np.int64).tolist()
    for first, last in zip(cuts, cuts[1:]):
        part = np.append(ids[first:last + depth], 0)
        array = suffix_array(part, depth)
        yield first, part, array[array < last - first]


def _named(items: DataFrame) -> DataFrame:
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").alias("text"))
    # Words are a character at least and are separated, so a text has no more of them than this.
    return named.where("text IS NOT NULL").withColumn("most", F.floor(F.length("text") / 2) + 1)


def blocks(items: DataFrame, window: int = WINDOW, most: int = BLOCK) -> Iterator[Items]:
    """The items (item_id, text) as numbers, so many at a time that a block has ``most`` words, or is one item."""
    named = _named(items)
    parts = -(-(named.agg(F.sum("most")).first()[0] or 0) // most)
    for part in range(parts):
        rows = named if parts == 1 else named.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        held, size = [], 0
        for row in rows.toLocalIterator():
            if held and size + row["most"] > most:
                yield number_items(sorted(held), window)
                held, size = [], 0
            held.append((row["name"], row["text"]))
            size += row["most"]
        if held:
            yield number_items(sorted(held), window)


def _mark(ids: np.ndarray, starts: np.ndarray, items: Items, change: np.ndarray) -> np.ndarray:
    """Add the occurrences of windows to ``change``, +1 where they begin and -1 after their end; (row, item) pairs as numbers."""
    pairs = [np.zeros(0, np.int64)]
    for first, part, array in _shards(ids, items.depth):
        _, _, from_, to = search(part, array, items)
        some = np.flatnonzero(from_ < to)
        # Equal windows have one range, which is marked once, and counts for each of their items.
        distinct, at = np.unique(np.stack((from_[some], items.window[some]), axis=1), axis=0, return_inverse=True)
        by = some[np.argsort(at.ravel(), kind="stable")]
        cuts = np.append(0, np.cumsum(np.bincount(at.ravel(), minlength=len(distinct)))).tolist()
        for (low, size), a, b in zip(distinct.tolist(), cuts, cuts[1:]):
            places = first + array[low:to[by[a]]]
            np.add.at(change, places, 1)
            np.add.at(change, places + size, -1)
            rows, item = np.unique(np.searchsorted(starts, places, side="right") - 1), np.unique(items.item[by[a:b]])
            pairs.append(np.repeat(rows, len(item)) * len(items.names) + np.tile(item, len(rows)))
    return np.unique(np.concatenate(pairs))


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _search_block(docs: DataFrame, items: Items) -> DataFrame:
    """(row, text, items, hits) with what is found for the block added: (row, n_words, n_hit, items, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, starts in _numbered(batches, items):
            change = np.zeros(len(ids) + 1, np.int64)
            pairs = _mark(ids, starts, items, change)
            names = [set(x) for x in batch.column(2).to_pylist()]
            for row, item in zip(*(x.tolist() for x in divmod(pairs, max(1, len(items.names))))):
                names[row].add(items.names[item])
            for row, spans in enumerate(batch.column(3).to_pylist()):
                for span in spans:
                    change[starts[row] + span["first"]] += 1
                    change[starts[row] + span["last"] + 1] -= 1
            hit = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
            opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            which = np.searchsorted(opens, starts).tolist()
            spans = [[{"first": a - s, "last": b - s - 1} for a, b in zip(opens[x:y].tolist(), closes[x:y].tolist())]
                     for s, x, y in zip(starts.tolist(), which, which[1:])]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(starts) - 1), pa.array(np.add.reduceat(hit.astype(np.int64), starts[:-1])),
                 pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                names=["row", "n_words", "n_hit", "items", "hits"])

    found = "n_words bigint, n_hit bigint, items array<string>, hits array<struct<first:bigint,last:bigint>>"
    return docs.mapInArrow(run, T.StructType([docs.schema["row"], *T._parse_datatype_string(found).fields]))


def find(docs: DataFrame, items: DataFrame, column: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` as one struct ``row``, with n_words, n_hit, ``items`` and ``hits``.

    ``items`` has the names of the items of which a window occurs in the text, in order, ``hits`` the stretches of
    words inside windows, as places of their first and last words.
    """
    work = Work(docs.sparkSession)
    nothing = number_items([], window)
    empty = F.array().cast("array<string>"), F.array().cast("array<struct<first:bigint,last:bigint>>")
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(column).alias("text"), empty[0].alias("items"), empty[1].alias("hits"))
    made = None
    for some in blocks(items, window, block):
        made = _search_block(found if made is None else work.cut(made).select("row", F.col(f"row.`{column}`"), "items", "hits"), some)
    return _search_block(found, nothing) if made is None else made


def remove(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    return find(docs, items, **settings).where("n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", column: str = "text", block: int = BLOCK) -> DataFrame:
    """Per item name and place in its words: the length of the longest match of the words from there, and where it is.

    (name, at, length, doc, doc_at); of several places one is given. Suffixes of which not even the first word
    occurs have no row; of rows that repeat an item_id the longer match counts.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(column).alias("text"))
    made = None
    for some in blocks(items, most=block):
        found = _longest(rows, some)
        made = found if made is None else made.union(found)
    if made is None:
        return docs.sparkSession.createDataFrame([], "name string, at bigint, length bigint, doc bigint, doc_at bigint")
    best = made.groupBy("name", "at").agg(F.min(F.struct((-F.col("length")).alias("m"), "doc", "doc_at")).alias("best"))
    return best.select("name", "at", (-F.col("best.m")).alias("length"), "best.doc", "best.doc_at")


def _longest(rows: DataFrame, items: Items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, starts in _numbered(batches, items):
            docs = batch.column(0).to_pylist()
            for first, part, array in _shards(ids, items.depth):
                longest, place, _, _ = search(part, array, items)
                some = np.flatnonzero(longest)
                where_ = array[place[some]]
                of = np.searchsorted(starts, first + where_, side="right") - 1
                yield pa.record_batch([pa.array([items.names[x] for x in items.item[some].tolist()], pa.string()), pa.array(items.at[some]),
                                       pa.array(longest[some]), pa.array([docs[x] for x in of.tolist()], pa.int64()),
                                       pa.array(first + where_ - starts[of])], names=["name", "at", "length", "doc", "doc_at"])

    return rows.mapInArrow(run, "name string, at bigint, length bigint, doc bigint, doc_at bigint")
