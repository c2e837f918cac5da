"""Hidden Markov language model over word classes.

A word belongs to the class ``hash mod CLASSES``; the end of a text is a token with a class of its
own. A latent state emits a class, the class a word:

    P(text) = sum over state paths of  prod P(state | previous) * P(class | state) * P(word | class)

The last factor does not depend on the path, so the likelihood is the product of a hidden Markov
likelihood over class sequences, by the scaled forward recursion over the whole text, and a sum
of counts. States are trained by Baum-Welch: expected counts are gathered per task, summed by
Spark, and give the next parameters, whose size is fixed (STATES x CLASSES). The vocabulary is
never gathered in one place: texts are packed into blocks of bounded size that know their own
distinct words, and the counts of exactly those words are joined back to each block.

Smoothing: a word has probability (c + 0.1) / (n + 0.1 * (v + 1)) in its class (n tokens, v
distinct, in training), an unknown one included; classes are smoothed alike, and a state's
emissions are drawn towards the classes' overall shares by ``PRIOR`` tokens.

Results for odd input: a null text counts as empty, which is the end token alone; rows are scored
one by one, so repeated rows and null keys make no difference (a null doc_id is trained on if
crc32 of the empty text says so); without training rows every score is that of the smoothing
alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from causeway.llm.common import MIX, Work, crc_remainder, mixed, unit

STATES = 6
CLASSES = 1 << 15
ITERATIONS = 3
PRIOR = 200.0
STAY = 0.9
# Tokens per block, those that the recursions take at once, and those of a stretch of a text.
BLOCK_TOKENS = 1 << 21
CHUNK_TOKENS = 1 << 17
STRETCH = 64
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end


# ------------------------------------------------------------------ blocks

_BLOCK = ("block bigint, doc_id array<bigint>, held array<boolean>, length array<int>, "
          "words binary, token_low binary, token_high binary")


def _pack(batches):
    """(doc_id, text, held) to blocks: the block's distinct word hashes, and each text as places in them.

    The words are in order of falling frequency, so that places are small numbers and pack well.
    """
    task, count = TaskContext.get().partitionId(), 0
    ids, held, lengths, parts, size = [], [], [], [], 0

    def flush():
        words, token, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        words, token = words[order], rank[token]
        return pa.record_batch(
            [pa.array([(task << 32) + count]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
             pa.array([lengths], pa.list_(pa.int32())), pa.array([words.tobytes()]),
             pa.array([token.astype(np.uint16).tobytes()]), pa.array([(token >> np.uint32(16)).astype(np.uint16).tobytes()])],
            names=["block", "doc_id", "held", "length", "words", "token_low", "token_high"])

    for batch in batches:
        for i in range(batch.num_rows):
            words = (batch.column(1)[i].as_py() or b"").lower().split()
            row = np.empty(len(words) + 1, np.uint64)
            row[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            row[-1] = END
            ids.append(batch.column(0)[i].as_py())
            held.append(batch.column(2)[i].as_py())
            lengths.append(len(row))
            parts.append(row)
            size += len(row)
            if size >= BLOCK_TOKENS:
                yield flush()
                count += 1
                ids, held, lengths, parts, size = [], [], [], [], 0
    if parts:
        yield flush()


class _Block:
    def __init__(self, row: dict):
        self.block, self.ids, self.held = row["block"], row["doc_id"], np.array(row["held"], bool)
        self.length = np.array(row["length"], np.int64)
        self.words, low = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["token_low"], np.uint16)
        self.token = low.astype(np.uint32) + (np.frombuffer(row["token_high"], np.uint16).astype(np.uint32) << np.uint32(16))
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))

    def classes(self) -> np.ndarray:
        """The class of each token; the end has the last."""
        made = (self.words % np.uint64(CLASSES)).astype(np.int32)
        made[self.words == END] = CLASSES
        return made[self.token]

    def chunks(self, rows: np.ndarray):
        """The rows in runs of about CHUNK_TOKENS tokens; a longer text is a run of its own."""
        end = np.cumsum(self.length[rows])
        return np.split(rows, np.flatnonzero(np.diff((end - self.length[rows]) // CHUNK_TOKENS)) + 1) if len(rows) else []


class _Stretches:
    """The tokens of some texts of a block, cut into stretches of at most STRETCH tokens.

    Stretches are in order of falling length, so that at each step a prefix of them goes on.
    ``waves`` lists, for k = 0, 1, ..., the stretches that are the k-th of their text.
    """

    def __init__(self, block: _Block, rows: np.ndarray):
        length = block.length[rows]
        pieces = -(-length // STRETCH)
        text = np.repeat(np.arange(len(rows)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(length[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        self.text, self.nth, size = text[order], nth[order], size[order]
        self.start = block.start[rows][self.text] + self.nth * STRETCH
        self.alive = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        self.texts, self.total = len(rows), len(text)
        by_wave = np.lexsort((self.text, self.nth))
        self.waves = np.split(by_wave, np.flatnonzero(np.diff(self.nth[by_wave])) + 1) if self.total else []


def _blocks_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch.slice(i, 1).to_pylist()[0])


def _count_words(batches):
    """Blocks to (h, c): the training count of each distinct word, and whether it occurs at all (c may be 0)."""
    for block in _blocks_of(batches):
        train = np.repeat(~block.held, block.length)
        count = np.bincount(block.token[train], minlength=len(block.words))
        yield pa.record_batch([pa.array(np.full(len(block.words), block.block)), pa.array(block.words.view(np.int64)),
                               pa.array(count.astype(np.int64))], names=["block", "h", "c"])


# ------------------------------------------------------------------ the chain over classes


class Chain:
    """start (S), move (S x S) and emit (CLASSES + 1 x S) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def transfers(self, classes: np.ndarray, cut: _Stretches) -> tuple[np.ndarray, np.ndarray]:
        """Per stretch, the matrix from the states before its first emission to its last token, and its log scale."""
        states = len(self.start)
        log = np.zeros(cut.total)
        matrix = np.zeros((cut.total, states, states))
        matrix[:, np.arange(states), np.arange(states)] = self.emit[classes[cut.start]]
        for t in range(1, STRETCH):
            n = cut.alive[t]
            if not n:
                break
            seen = self.emit[classes[cut.start[:n] + t]]
            part = (matrix[:n].reshape(-1, states) @ self.move).reshape(n, states, states) * seen[:, None, :]
            if t % 4 == 0:
                scale = part.max(axis=(1, 2))
                part /= scale[:, None, None]
                log[:n] += np.log(scale)
            matrix[:n] = part
        return matrix, log

    def forward(self, matrix: np.ndarray, log: np.ndarray, cut: _Stretches):
        """Log likelihood per text, and per stretch the states before its first token's emission and at the token before."""
        total = np.zeros(cut.texts)
        before = np.zeros((cut.total, len(self.start)))
        previous = np.zeros_like(before)
        alpha = np.zeros((cut.texts, len(self.start)))
        for k, wave in enumerate(cut.waves):
            rows = cut.text[wave]
            previous[wave] = alpha[rows]
            before[wave] = self.start if k == 0 else alpha[rows] @ self.move
            reached = np.einsum("ns,nsj->nj", before[wave], matrix[wave])
            scale = reached.sum(axis=1)
            alpha[rows] = reached / scale[:, None]
            total[rows] += np.log(scale) + log[wave]
        return total, before, previous

    def likelihoods(self, block: _Block) -> np.ndarray:
        """Natural log likelihood of each text of the block."""
        classes, total = block.classes(), np.zeros(len(block.length))
        for rows in block.chunks(np.arange(len(block.length))):
            cut = _Stretches(block, rows)
            total[rows] = self.forward(*self.transfers(classes, cut), cut)[0]
        return total

    def expected(self, block: _Block, rows: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Add the expected counts of the texts ``rows``; returns their log likelihood."""
        classes = block.classes()
        return sum(self._expected(block, classes, part, start, move, emit) for part in block.chunks(rows))

    def _expected(self, block: _Block, classes: np.ndarray, rows: np.ndarray, start: np.ndarray, move: np.ndarray,
                  emit: np.ndarray) -> float:
        """The counts of one run of texts.

        What reaches a stretch from both ends is known from the transfer matrices, so the
        recursions inside run over all stretches at once and give the counts of whole texts.
        """
        cut, states = _Stretches(block, rows), len(self.start)
        matrix, log = self.transfers(classes, cut)
        total, before, previous = self.forward(matrix, log, cut)
        after = np.ones((cut.texts, states))
        beta = np.ones((cut.total, states))
        for wave in reversed(cut.waves):
            rows_ = cut.text[wave]
            beta[wave] = after[rows_]
            reached = np.einsum("nsj,nj->ns", matrix[wave], after[rows_]) @ self.move.T
            after[rows_] = reached / reached.sum(axis=1, keepdims=True)
        alphas, inner = [], before
        for t in range(STRETCH):
            n = cut.alive[t]
            if not n:
                break
            inner = (before if t == 0 else alphas[-1][:n] @ self.move) * self.emit[classes[cut.start[:n] + t]]
            alphas.append(inner / inner.sum(axis=1, keepdims=True))
        seen_all, weight_all = [], []
        for t in range(len(alphas) - 1, -1, -1):
            n = cut.alive[t]
            here = alphas[t] * beta[:n]
            here /= here.sum(axis=1, keepdims=True)
            seen = classes[cut.start[:n] + t]
            seen_all.append(seen)
            weight_all.append(here)
            carried = self.emit[seen] * beta[:n]
            first = before if t == 0 else alphas[t - 1][:n] @ self.move
            carried /= (first * carried).sum(axis=1, keepdims=True)
            move += self.move * ((previous if t == 0 else alphas[t - 1][:n]).T @ carried)
            if t == 0:
                start += here[cut.nth == 0].sum(axis=0)
            beta[:n] = carried @ self.move.T
            beta[:n] /= beta[:n].sum(axis=1, keepdims=True)
        seen, weight = np.concatenate(seen_all), np.concatenate(weight_all)
        for s in range(states):
            emit[:, s] += np.bincount(seen, weights=weight[:, s], minlength=len(emit))
        return total.sum()


def _expect(chain: Chain):
    """Blocks to expected counts, as rows (kind, id, counts per state), summed per task."""

    def run(batches):
        states = len(chain.start)
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        log, any_ = 0.0, False
        for block in _blocks_of(batches):
            rows = np.flatnonzero(~block.held)
            if len(rows):
                log += chain.expected(block, rows, start, move, emit)
                any_ = True
        if any_:
            used = np.flatnonzero(emit.any(axis=1))
            ids = np.concatenate((used, CLASSES + 1 + np.arange(states), [CLASSES + 1 + states, CLASSES + 2 + states]))
            rows = np.concatenate((emit[used], move, [start], [np.full(states, log / states)]))
            yield pa.record_batch([pa.array(ids), *[pa.array(rows[:, s]) for s in range(states)]],
                                  names=["id", *[f"s{s}" for s in range(states)]])

    return run


def _first_chain(shares: np.ndarray, seeds: list[np.ndarray], states: int) -> Chain:
    """States start near the class counts of seed texts far apart; shares alone where there are fewer texts."""
    emit = np.tile(shares[:, None], (1, states))
    for s, counts in enumerate(seeds):
        emit[:, s] = 0.5 * shares + 0.5 * counts / counts.sum()
    noise = 0.75 + 0.5 * unit(mixed(np.arange(emit.size, dtype=np.uint64) * MIX)).reshape(emit.shape)
    emit = emit * noise
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _seed_texts(batches):
    """Per block, the classes of a few training texts."""
    for block in _blocks_of(batches):
        classes = block.classes()
        rows = np.flatnonzero(~block.held & (block.length > 50))
        key = mixed(rows.astype(np.uint64) ^ mixed(np.array([block.block], np.uint64)))
        for i in np.argsort(key)[:4]:
            row = rows[i]
            seen = classes[block.start[row]:block.start[row] + block.length[row]].astype(np.uint16)
            yield pa.record_batch([pa.array([int(key[i] >> np.uint64(1))]), pa.array([seen.tobytes()])], names=["key", "seen"])


class Model:
    """The trained chain with the classes' smoothing; of fixed size."""

    def __init__(self, chain: Chain, class_total: np.ndarray, tokens: int, distinct: int, history: list[float]):
        self.chain, self.class_total = chain, class_total
        self.tokens, self.distinct, self.history = tokens, distinct, history


def _train(blocks: DataFrame, vocabulary: DataFrame, states: int, iterations: int, seeds: int = 64) -> Model:
    end = int(END.astype(np.int64))
    # As 2^64 is a multiple of CLASSES, the remainder of the signed hash is that of the unsigned one.
    klass = F.when(F.col("h") == end, CLASSES).otherwise(F.pmod("h", F.lit(CLASSES)))
    per_class = (vocabulary.where("c > 0").groupBy(klass.cast("int").alias("k"))
                 .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect())
    n, v = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for row in per_class:
        n[row["k"]], v[row["k"]] = row["n"], row["v"]
    class_total = n + 0.1 * (v + 1)
    shares = class_total / class_total.sum()
    found = (blocks.mapInArrow(_seed_texts, "key bigint, seen binary").orderBy("key", "seen").limit(seeds).collect())
    candidates = [np.bincount(np.frombuffer(r["seen"], np.uint16), minlength=CLASSES + 1).astype(float) for r in found]
    chosen: list[np.ndarray] = []
    if candidates:
        points = np.sqrt(np.stack(candidates))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        picked = [0]
        near = points @ points[0]
        while len(picked) < min(states, len(points)):
            picked.append(int(np.argmin(near)))
            near = np.maximum(near, points @ points[picked[-1]])
        chosen = [candidates[i] for i in picked]
    chain = _first_chain(shares, chosen, states)
    columns = [f"s{s}" for s in range(states)]
    history = []
    for _ in range(iterations):
        counted = blocks.mapInArrow(_expect(chain), "id bigint, " + ", ".join(f"{c} double" for c in columns))
        sums = counted.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        if not sums:
            break
        rows = np.zeros((CLASSES + 3 + states, states))
        for row in sums:
            rows[row["id"]] = row[1:]
        emit, move, start = rows[:CLASSES + 1], rows[CLASSES + 1:CLASSES + 1 + states], rows[-2]
        history.append(rows[-1].sum())
        emit = (emit + PRIOR * shares[:, None]) / (emit.sum(axis=0) + PRIOR)
        move, start = move + 1.0, start + 1.0
        chain = Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
    return Model(chain, class_total, int(n.sum()), int(v.sum()), history)


def _score(model: Model):
    """Blocks with the counts of their words to scores."""
    chain, unknown = model.chain, np.log10(0.1)
    log_total = np.log10(model.class_total)
    floor = np.log10(model.tokens + 0.1 * (model.distinct + 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block(row)
                counts = np.zeros(len(block.words), np.int64)
                known = np.array(row["h"], np.int64).view(np.uint64)
                if len(known):
                    order = np.argsort(block.words)
                    counts[order[np.searchsorted(block.words, known, sorter=order)]] = row["c"]
                classes = block.classes()
                weight = np.where(counts > 0, np.log10(counts + 0.1), unknown)[block.token]
                base = np.add.reduceat(weight - floor, block.start)
                inside = np.add.reduceat(weight - log_total[classes], block.start)
                n_known = np.add.reduceat((counts > 0)[block.token].astype(np.int64), block.start)
                path = chain.likelihoods(block)
                yield pa.record_batch(
                    [pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.length), pa.array(n_known),
                     pa.array(np.full(len(path), model.tokens)), pa.array(base), pa.array(inside + path / np.log(10))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, states: int = STATES, iterations: int = ITERATIONS, modulus: int = 10) -> DataFrame:
    """Train on the texts whose key's crc32 modulo ``modulus`` is not 0 and score all of them.

    Returns per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigram) and score (this model), both as log10 probabilities.
    """
    work = Work(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       (crc_remainder(F.col("doc_id"), modulus) == 0).alias("held"))
    blocks = work.cut(rows.mapInArrow(_pack, _BLOCK))
    words = work.cut(blocks.mapInArrow(_count_words, "block bigint, h bigint, c bigint"))
    vocabulary = work.cut(words.groupBy("h").agg(F.sum("c").alias("c")).where("c > 0"))
    model = _train(blocks, vocabulary, states, iterations)
    known = (words.select("block", "h").join(vocabulary, "h").groupBy("block")
             .agg(F.collect_list(F.struct("h", "c")).alias("hc"))
             .select(F.col("block").alias("of"), F.col("hc.h").alias("h"), F.col("hc.c").alias("c")))
    whole = blocks.join(known, F.col("block") == F.col("of"), "left").drop("of")
    whole = whole.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("h", "c")})
    return whole.mapInArrow(_score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
                                           "train_tokens bigint, base_score double, score double")
