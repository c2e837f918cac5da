"""Language identification by the nearest of several centroids per language.

A text becomes the counts of its hashed letter n-grams (one to three characters, runs of anything
else as one space), damped by a square root, weighted by inverse document frequency and
normalised. Document frequencies come from all learning documents. The labelled vectors of a
language are clustered by spherical k-means; a text belongs to the language of the centroid of
largest cosine. It is rejected when its cosine is less, by a margin, than that of all but a few of the
learning texts of that language and of similar or greater length. The centroids are
fitted on a sample; the distances are those of all learning texts, counted in a second pass. The
few (``outliers``) neither start or move a centroid nor set a radius, so a few mislabelled or noise texts
among the labelled ones let in neither themselves nor their like. Where a language has fewer than
``LEAST_TEXTS`` texts up to a length, none of them counts as odd.

Results for odd input: a text that is null or has no letter gets ``und`` with score 0 and is
rejected; so does every text if there is nothing to learn from; rows are predicted one by one, so
repeated rows and null keys make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from causeway.llm.common import Work

DIMENSIONS = 4096
CENTROIDS = 4
ROUNDS = 12
# Learning texts per language that the centroids are fitted on, in expectation.
SAMPLE = 1500
# Rejection radii are kept per power of two of the number of n-grams.
LENGTH_BINS = 24
# Distances are counted in cells of this many to the unit.
CELLS = 1000
MARGIN = 1.3
# A radius is taken from at least this many texts, else those of the next shorter lengths are added.
LEAST_TEXTS = 36
UNKNOWN = "und"

_FIRST = operator.methodcaller("column", 0)
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)
_NGRAM = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text, None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(points, len(_LETTER) - 1)]
    if not letter.any():
        return None
    # Letters, and after each run of them one space.
    space = np.array([32], np.uint32)
    line = np.concatenate((space, np.where(letter, points, space), space))
    letter = np.concatenate(([False], letter, [False]))
    line = line[letter | np.concatenate(([True], letter[:-1]))]
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    with np.errstate(over="ignore"):
        mixed = line * _NGRAM[0]
        mixed ^= mixed >> np.uint32(15)
        keys = [(mixed * _NGRAM[1]) >> shift]
        pair = mixed[:-1] * _NGRAM[2] + mixed[1:]
        pair ^= pair >> np.uint32(13)
        keys.append((pair * _NGRAM[1]) >> shift)
        triple = pair[:-1] * _NGRAM[2] + mixed[2:]
        triple ^= triple >> np.uint32(16)
        keys.append((triple * _NGRAM[0]) >> shift)
    return np.bincount(np.concatenate(keys), minlength=dimensions)


def _blocks(batches, texts):
    """(slice, rows, matrix of counts) for slices of bounded size; ``texts`` gets the column."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows, made = [], []
            for i, text in enumerate(texts(part).to_pylist()):
                counts = ngram_counts(text)
                if counts is not None:
                    rows.append(i)
                    made.append(counts)
            yield part, rows, (np.stack(made) if made else np.zeros((0, DIMENSIONS), np.int64))


def _frequencies(batches):
    seen, total = np.zeros(DIMENSIONS, np.int64), 0
    for _, _, counts in _blocks(batches, _FIRST):
        seen += (counts > 0).sum(axis=0)
        total += len(counts)
    # One row per dimension, the number of documents under -1.
    used = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], total))], names=["dim", "n"])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    made = np.sqrt(counts, dtype=np.float32) * idf
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)


def _length_bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), LENGTH_BINS - 1)


def outliers(n: int) -> int:
    """How many of n texts may be odd: one in a hundred, more of them where texts are few."""
    return max(n // 100, math.isqrt(n) // 3)


def _cluster(idf: np.ndarray):
    """The labelled texts of one language to its centroids."""

    def run(table: pa.Table) -> pa.Table:
        batches = table.select(["text"]).combine_chunks().to_batches()
        counts = np.concatenate([c for _, _, c in _blocks(batches, _FIRST)] or [np.zeros((0, DIMENSIONS), np.int64)])
        points = _vectors(counts, idf)
        names = ["lang", "centroid"]
        if not len(points):
            return pa.table([pa.array([], pa.string()), pa.array([], pa.binary())], names=names)
        # Start from texts far apart, but not the very farthest, then move to the mean directions.
        picked = [int(np.argmax(points @ points.mean(axis=0)))]
        near = points @ points[picked[0]]
        while len(picked) < min(CENTROIDS, len(points)):
            place = min(outliers(len(points)), len(points) - len(picked) - 1)
            picked.append(int(np.argpartition(near, place)[place]))
            near = np.maximum(near, points @ points[picked[-1]])
        centres = points[picked]
        odd = outliers(len(points))
        for _ in range(ROUNDS):
            cosine = points @ centres.T
            nearest = cosine.argmax(axis=1)
            nearest[np.argsort(cosine.max(axis=1), kind="stable")[:odd]] = -1
            of = np.bincount(nearest[nearest >= 0], minlength=len(centres))
            for k in range(len(centres)):
                if odd and of[k] <= odd:
                    # Too few to go by: split off a usual text of the largest cluster instead.
                    inside = np.flatnonzero(nearest == of.argmax())
                    centres[k] = points[inside[np.argsort(cosine[inside, of.argmax()], kind="stable")[len(inside) // 2]]]
                elif of[k]:
                    mean = points[nearest == k].mean(axis=0)
                    centres[k] = mean / max(np.linalg.norm(mean), 1e-9)
        lang = table.column("lang")[0].as_py()
        return pa.table([pa.array([lang] * len(centres), pa.string()),
                         pa.array([c.astype(np.float32).tobytes() for c in centres])], names=names)

    return run


def _distances(model: Model):
    """Texts to how many of them lie in each cell of distance, per centroid and length."""

    def run(batches):
        shape = (len(model.langs), LENGTH_BINS, CELLS + 1)
        seen = np.zeros(int(np.prod(shape)), np.int64)
        for _, _, counts in _blocks(batches, _FIRST):
            best, score = model.nearest(counts)
            cell = np.ceil((1 - score) * CELLS).astype(int)
            np.add.at(seen, np.ravel_multi_index((best, _length_bin(counts), cell), shape), 1)
        used = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(used), pa.array(seen[used])], names=["place", "n"])

    return run


def _radius(cells: np.ndarray, at: int) -> float:
    """The radius of length ``at`` from the counts per length and cell of distance, 0 without counts."""
    pooled = cells[at].copy()
    for shorter in range(at - 1, -1, -1):
        if pooled.sum() >= LEAST_TEXTS:
            break
        pooled += cells[shorter]
    n = int(pooled.sum())
    return int(np.searchsorted(pooled.cumsum(), n - outliers(n) if n >= LEAST_TEXTS else n)) / CELLS


def _radii(seen: np.ndarray, langs: list[str]) -> np.ndarray:
    """(centroids, lengths) from the counts per centroid, length and cell of distance."""
    radii = np.zeros(seen.shape[:2])
    for lang in set(langs):
        of = np.array([name == lang for name in langs])
        # A language that no learning text comes nearest to takes the radii of all.
        cells = seen[of].sum(axis=0) if seen[of].any() else seen.sum(axis=0)
        radii[of] = [_radius(cells, at) for at in range(LENGTH_BINS)]
    # Shorter texts lie farther off, so a length has at least the radius of all longer ones. The margin
    # is one of the cosine, so no radius lets in everything.
    radii = np.maximum.accumulate(radii[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(1 - (1 - radii) / MARGIN, 1 - 1 / CELLS)


class Model:
    """Centroids of all languages, idf weights and rejection radii per centroid and length; its size is that of the parameters."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, radii: np.ndarray):
        self.langs, self.centroids, self.idf, self.radii = langs, centroids, idf, radii

    def nearest(self, counts: np.ndarray):
        # In doubles, rounded: the sums of a product depend on the rows beside, in the last places.
        cosine = np.round(_vectors(counts, self.idf).astype(np.float64) @ self.centroids.T.astype(np.float64), 9)
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(cosine)), best], 0, 1)

    def predict(self, counts: np.ndarray):
        best, score = self.nearest(counts)
        return [self.langs[b] for b in best], score, (1 - score) > self.radii[best, _length_bin(counts)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a text and a lang."""
    spark = docs.sparkSession
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    document = rows.select("text").mapInArrow(_frequencies, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n"))
    found = {r["dim"]: r["n"] for r in document.collect()}
    total = found.pop(-1, 0)
    seen = np.zeros(DIMENSIONS)
    seen[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    # Written, so that its size is known and texts are sampled before they are shuffled.
    per_lang = Work(spark).cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")))
    chance = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("of"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(per_lang, "lang").where(draw < chance).select("lang", "text")
    fitted = chosen.groupBy("lang").applyInArrow(_cluster(idf), "lang string, centroid binary").orderBy("lang", "centroid").collect()
    if not fitted:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros((0, LENGTH_BINS)))
    model = Model([r["lang"] for r in fitted], np.stack([np.frombuffer(r["centroid"], np.float32) for r in fitted]), idf,
                  np.ones((len(fitted), LENGTH_BINS)))
    # Of all learning texts, not of the sample: a text outside it may lie farther off, or be longer.
    counted = rows.select("text").mapInArrow(_distances(model), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    seen = np.zeros((len(fitted), LENGTH_BINS, CELLS + 1), np.int64)
    for r in counted.collect():
        seen.flat[r["place"]] = r["n"]
    model.radii = _radii(seen, model.langs)
    return model


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with ``language`` = (lang_pred, score, rejected) beside its columns as one struct ``row``."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))

    def run(batches):
        for batch in batches:
            for part, rows, counts in _blocks([batch], lambda part: part.column(0).field(column)):
                langs, scores, rejected = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                if len(rows) and model.langs:
                    found, score, far = model.predict(counts)
                    for i, lang in zip(rows, found):
                        langs[i] = lang
                    scores[rows], rejected[rows] = score, far
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                                      names=["row", "lang_pred", "score", "rejected"])

    schema = T.StructType([*packed.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return packed.mapInArrow(run, schema)


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, learned from ``docs`` itself."""
    return predict(docs, fit(docs)).where("NOT rejected").select("row.*")
