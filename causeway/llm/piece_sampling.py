"""Sampled encoding into the pieces of a SentencePiece model, and lossless decoding.

All segmentations of a text into pieces form a lattice; a segmentation is drawn with probability in
proportion to the product of its pieces' weights to the power ``alpha``. Forward filtering sums up
the weights of all ways to each position, backward sampling draws the last piece first, each
in proportion to the ways it ends. No piece of these vocabularies crosses the start of a run of
spaces, so the lattice of a text is the chain of the lattices of its words, and a word's table is
made once for all its occurrences. The draws depend on the row's key and the place in the text
only, so a rerun, another partitioning or another executor gives the same pieces.

A model of merge ranks has no probabilities; its piece of rank r weighs 1 / (r + 2). Characters
without a piece are spelt in byte pieces, and a literal U+2581 as well, so decoding gives back
every text exactly.

Results for odd input: a null text has null pieces, the empty text has none; null keys draw alike,
repeated rows get equal pieces; a very long text or word takes time and memory in proportion; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from causeway.llm.common import MIX, mixed, unit

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Characters handled at once, and edges kept before the tables of words are made anew.
CHUNK = 1 << 20
EDGES = 1 << 22


class Vocabulary:
    """Pieces with spaces as spaces, their weights, and the byte pieces."""

    def __init__(self, model: bytes, alpha: float = 1.0):
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = read.get_piece_size()
        self.spelling: list[bytes] = [b""] * self.size
        self.byte_ids = np.full(256, -1, np.int64)
        ids, scores, texts = [], [], []
        for i in range(self.size):
            piece = read.id_to_piece(i)
            if read.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.spelling[i] = bytes([int(piece[1:-1], 16)])
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                ids.append(i)
                scores.append(read.get_score(i))
                texts.append(piece.replace(SPACE, " "))
                self.spelling[i] = texts[-1].encode()
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so it can't spell every text")
        scores = np.array(scores)
        ranked = bool((scores == np.rint(scores)).all() and (scores <= 0).all())
        log_weight = -np.log(np.minimum(-scores, self.size) + 2) if ranked else scores
        # The trie of all pieces: node and character to the next node, as one sorted array of keys.
        nodes, found, log = {"": 0}, [-1], [0.0]
        steps: dict[int, int] = {}
        for i, text, weight in zip(ids, texts, (alpha * log_weight).tolist()):
            for end in range(1, len(text) + 1):
                at = nodes.setdefault(text[:end], len(nodes))
                if at == len(found):
                    found.append(-1)
                    log.append(0.0)
                    steps[(nodes[text[:end - 1]] << 21) + ord(text[end - 1])] = at
            found[nodes[text]], log[nodes[text]] = i, weight
        order = sorted(steps)
        self.step_key, self.step_to = np.array(order, np.int64), np.array([steps[k] for k in order], np.int32)
        self.node_piece, self.node_log = np.array(found, np.int32), np.array(log)
        self.spelt_log = float(self.node_log.min()) - 5.0
        self.longest = max(map(len, texts), default=1)
        crossing = any(re.search("[^ ] ", text) for text in texts)
        lines = any("\n" in text for text in texts)
        self.word = re.compile("(?s:.+)" if crossing else " *[^ ]+| +" if lines else "\n| *[^ \n]+| +")


class _Tables:
    """Per word, for each position the pieces that can end there, with cumulative probabilities.

    The positions of all words are numbered; the edges of position s begin at ``start[s]``, and the
    last of them has the cumulative probability 1.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}
        self.states = self.edges = 0
        self.cumulative, self.previous = np.empty(1 << 16, np.float32), np.empty(1 << 16, np.int32)
        self.piece = np.empty(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int32)

    def _room(self, needed: int, *names: str) -> None:
        for name in names:
            while needed > len(getattr(self, name)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.empty_like(old))))

    def _edges(self, points: np.ndarray, left: np.ndarray):
        """All pieces in the words: (first, last) character and trie node; ``left`` counts characters to the word's end."""
        words = self.vocabulary
        at, node, size = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        firsts, lasts, nodes = [], [], []
        while len(at):
            key = (node << 21) + points[at + size]
            place = np.minimum(np.searchsorted(words.step_key, key), len(words.step_key) - 1)
            known = words.step_key[place] == key
            at, node = at[known], words.step_to[place[known]].astype(np.int64)
            whole = words.node_piece[node] >= 0
            firsts.append(at[whole])
            lasts.append(at[whole] + size)
            nodes.append(node[whole])
            size += 1
            more = left[at] > size
            at, node = at[more], node[more]
        return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(nodes), firsts[0]

    def add(self, words: list[str]) -> None:
        """Tables of words not seen so far: forward filtering, one step for all their n-th characters."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        place = np.arange(len(points)) - np.repeat(begin, size)
        first, last, node, single = self._edges(points, np.repeat(size, size) - place)
        piece, log = self.vocabulary.node_piece[node].astype(np.int64), self.vocabulary.node_log[node]
        spelt = np.ones(len(points), bool)
        spelt[single] = False
        spelt = np.flatnonzero(spelt)
        first, last = np.concatenate((first, spelt)), np.concatenate((last, spelt))
        piece = np.concatenate((piece, self.vocabulary.size + points[spelt]))
        log = np.concatenate((log, np.full(len(spelt), self.vocabulary.spelt_log)))
        # Edges by the place of their end in the word, so that each step is one run of them. Both sorts
        # are stable; the first finds sorted runs, the second has small keys.
        order = np.argsort(last, kind="stable")
        narrow = place.astype(np.uint16) if int(size.max()) <= 1 << 16 else place
        order = order[np.argsort(narrow[last[order]], kind="stable")]
        first, last, piece, log = first[order], last[order], piece[order], log[order]
        steps = np.searchsorted(place[last], np.arange(int(size.max()) + 1))
        new = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        run = np.searchsorted(new, steps)
        from_ = np.where(place[first] > 0, first - 1, len(points))  # the last is the way to the beginning of a word
        ways = np.zeros(len(points) + 1)
        inside = np.empty(len(last))
        for a, b, low, high in zip(steps[:-1], steps[1:], run[:-1], run[1:]):
            cuts = new[low:high] - a
            count = np.diff(np.append(cuts, b - a))
            reach = ways[from_[a:b]] + log[a:b]
            top = np.maximum.reduceat(reach, cuts)
            reach = np.exp(reach - np.repeat(top, count))
            total = np.add.reduceat(reach, cuts)
            ways[last[new[low:high]]] = top + np.log(total)
            running = np.cumsum(reach)
            lead = running[cuts] - reach[cuts]
            inside[a:b] = (running - np.repeat(lead, count)) / np.repeat(total, count)
        inside[np.append(new[1:], len(last)) - 1] = 1.0
        end = self.edges + len(last)
        self._room(end, "cumulative", "previous", "piece")
        self._room(self.states + len(points), "start")
        self.start[self.states + last[new]] = self.edges + new
        self.cumulative[self.edges:end] = inside
        self.previous[self.edges:end] = np.where(from_ < len(points), self.states + from_, -1)
        self.piece[self.edges:end] = piece
        self.last.update(zip(words, (self.states + begin + size - 1).tolist()))
        self.edges, self.states = end, self.states + len(points)

    def final_states(self, words: list[str]) -> np.ndarray:
        if self.edges > EDGES:
            self.clear()
        unknown = set(words).difference(self.last)
        if unknown:
            self.add(list(unknown))
        return np.fromiter(map(self.last.__getitem__, words), np.int64, len(words))


def _spell(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids beyond the vocabulary stand for code points; they become byte pieces. Also the number of pieces of each."""
    point = ids - vocabulary.size
    spelt = point >= 0
    count = np.where(spelt, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), 1)
    if not spelt.any():
        return ids, count
    out = np.repeat(ids, count)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    at = np.flatnonzero(out >= vocabulary.size)
    code, of, nth = out[at] - vocabulary.size, np.repeat(count, count)[at], nth[at]
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0])[of]
    rest = code >> (6 * (of - 1 - nth))
    out[at] = vocabulary.byte_ids[np.where(nth == 0, lead | rest, 0x80 | (rest & 0x3F))]
    return out, count


def sample_pieces(texts: list[str], seeds: np.ndarray, tables: _Tables) -> list[np.ndarray]:
    """Piece ids of each text, drawn by its seed."""
    words: list[str] = []
    per_text = []
    for text in texts:
        found = tables.vocabulary.word.findall(" " + text) if text else []
        words += found
        per_text.append(len(found))
    per_text = np.array(per_text, np.int64)
    if not words:
        return [np.zeros(0, np.int32) for _ in texts]
    state = tables.final_states(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    text_of = np.repeat(np.arange(len(texts)), per_text)
    first = np.zeros(len(texts), np.int64)
    first[per_text > 0] = start[(np.cumsum(per_text) - per_text)[per_text > 0]]
    # Each word's numbers begin at 64 times its place in the text; a word has no more draws than characters.
    with np.errstate(over="ignore"):
        draw = seeds[text_of] + MIX * (64 * (start - first[text_of])).astype(np.uint64)
    alive, drawn = np.arange(len(words)), []
    steps = np.zeros(len(words), np.int64)
    while len(alive):
        u, here = unit(mixed(draw[alive])), state[alive]
        edge = tables.start[here].astype(np.int64)
        open_ = np.flatnonzero(tables.cumulative[edge] <= u)
        while len(open_):
            edge[open_] += 1
            open_ = open_[tables.cumulative[edge[open_]] <= u[open_]]
        drawn.append((alive, tables.piece[edge]))
        steps[alive] += 1
        state[alive] = tables.previous[edge]
        with np.errstate(over="ignore"):
            draw[alive] += MIX
        alive = alive[tables.previous[edge] >= 0]
    offset = np.cumsum(steps) - steps
    ids = np.empty(int(steps.sum()), np.int64)
    for i, (rows, piece) in enumerate(drawn):
        ids[offset[rows] + steps[rows] - 1 - i] = piece
    ids, count = _spell(ids, tables.vocabulary)
    ends = np.cumsum(count)[np.cumsum(steps) - 1]  # per word
    word_ends = np.cumsum(per_text)
    bounds = np.where(word_ends > 0, ends[np.maximum(word_ends - 1, 0)], 0)
    return np.split(ids.astype(np.int32), bounds[:-1])


def join_pieces(ids, spelling: list[bytes]) -> str:
    """The text of piece ids; the first space is the one that encoding put there."""
    text = b"".join(map(spelling.__getitem__, ids)).decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", column: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` as one struct ``row``, and the sampled pieces of its text as ``piece_ids``.

    The model file is read on the driver and sent along, as executors may not have it.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.lit(seed), F.col(key)).alias("seed"))
    content = _model(model)

    def run(batches):
        tables = _Tables(Vocabulary(content, alpha))
        for batch in batches:
            texts, seeds = batch.column(0).field(column), np.array(batch.column(1)).view(np.uint64)
            begin = 0
            while begin < batch.num_rows:
                end, size, part = begin, 0, []
                while end < batch.num_rows and size < CHUNK:
                    part.append(texts[end].as_py())
                    size += len(part[-1] or "")
                    end += 1
                found = sample_pieces([t or "" for t in part], mixed(seeds[begin:end]), tables)
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                pieces = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)),
                                                  mask=pa.array([t is None for t in part]))
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), pieces], names=["row", "piece_ids"])
                begin = end

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def spellings(model: bytes) -> list[bytes]:
    """The bytes of every piece; control pieces have none."""
    import sentencepiece

    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    made = []
    for i in range(read.get_piece_size()):
        if read.is_byte(i):
            made.append(bytes([int(read.id_to_piece(i)[1:-1], 16)]))
        else:
            silent = read.is_control(i) or read.is_unknown(i) or read.is_unused(i)
            made.append(b"" if silent else read.id_to_piece(i).replace(SPACE, " ").encode())
    return made


class Speller:
    """Texts of many lists of piece ids at once, as one gathering of bytes."""

    def __init__(self, spelling: list[bytes]):
        self.spelling, self.bytes = spelling, np.frombuffer(b"".join(spelling), np.uint8)
        self.size = np.fromiter(map(len, spelling), np.int64, len(spelling))
        self.start = np.cumsum(self.size) - self.size

    def texts(self, lists: pa.ListArray) -> pa.Array:
        ids = np.asarray(lists.flatten())
        if len(ids) > CHUNK or len(ids) and int(self.size[ids].sum()) > 1 << 26:
            return pa.array([None if x is None else join_pieces(x, self.spelling) for x in lists.to_pylist()], pa.string())
        counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        size = self.size[ids]
        ends = np.append(0, np.cumsum(size))
        found = self.bytes[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])]
        offsets = ends[np.append(0, np.cumsum(counts))]
        # The first space of a text is the one that encoding put there.
        begins = np.minimum(offsets[:-1], max(len(found) - 1, 0))
        lead = (offsets[1:] > offsets[:-1]) & (found[begins] == 0x20 if len(found) else False)
        kept = np.ones(len(found), bool)
        kept[offsets[:-1][lead]] = False
        offsets = offsets - np.append(0, np.cumsum(lead))
        valid = lists.is_valid()
        return pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found[kept]),
                                           None if lists.null_count == 0 else valid.buffers()[1], lists.null_count)


def decode(encoded: DataFrame, model: str = MODEL, column: str = "piece_ids") -> DataFrame:
    """``encoded`` as one struct ``row``, and the text of its piece ids as ``decoded``."""
    packed = encoded.select(F.struct(*encoded.columns).alias("row"))
    content = _model(model)

    def run(batches):
        speller = Speller(spellings(content))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.record_batch([part.column(0), speller.texts(part.column(0).field(column))], names=["row", "decoded"])

    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField("decoded", T.StringType())]))


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``piece_ids``; a column of that name is replaced."""
    others: list[Column] = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "piece_ids"]
    return encode(docs, **settings).select(*others, "piece_ids")
