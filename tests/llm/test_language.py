import random

import numpy as np
import pytest

from causeway.llm import language_id as li
from causeway.llm.queries import op5_language

SCHEMA = "doc_id bigint, text string, lang string, source string, row string, rejected string"
SYLLABLES = {"aa": "ka mo te ri".split(), "bb": "ßun öl grä chen".split(), "cc": "éau oui tion ñe".split()}


def documents(n=60):
    rng = random.Random(8)
    rows = []
    for lang, parts in SYLLABLES.items():
        for _ in range(n):
            words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 3, 10, 60, 300]))]
            rows.append((len(rows), " ".join(words) + rng.choice([".", " 12!", ""]), lang, "s", "r", "x"))
    return rows


def test_held_out_rows_are_recognised(spark):
    frame = spark.createDataFrame(documents(), SCHEMA)
    model = li.fit(frame.where("doc_id % 3 <> 0"))
    assert len(model.langs) == 3 * li.CENTROIDS and set(model.langs) == set(SYLLABLES)
    got = li.predict(frame, model)
    rows = got.collect()
    assert got.columns == ["row", "lang_pred", "score", "rejected"] and len(rows) == len(documents())
    right = [r.lang_pred == r.row.lang for r in rows if r.row.doc_id % 3 == 0]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_looks_at_the_text_only(spark):
    frame = spark.createDataFrame(documents(20), SCHEMA)
    model = li.fit(frame)
    other = spark.createDataFrame([(-1, t, "zz", None, None, None) for _, t, *_ in documents(20)], SCHEMA)
    one, two = ([(r.row.text, r.lang_pred, r.score, r.rejected) for r in li.predict(f.repartition(3), model).collect()]
                for f in (frame, other))
    assert sorted(one) == sorted(two)


def test_rejection_keeps_what_was_learned_from(spark):
    strange = ["Это совсем другой язык и его здесь никто не учил, " * 5, "完全不同的语言没有人在这里学过" * 9]
    rows = documents() + [(1000 + i, t, None, "s", "r", "x") for i, t in enumerate(strange)]
    odd = [(2000, None, "aa", "s", "r", "x"), (2001, "", "aa", "s", "r", "x"), (2002, "12 %% ..", "bb", "s", "r", "x"), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    kept = li.keep_recognised(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in documents()]
    rejected = {r.row.doc_id: r for r in li.predict(frame, li.fit(frame)).where("rejected").collect()}
    assert all(rejected[d].lang_pred == "und" and rejected[d].score == 0 for d in (2000, 2001, 2002, None))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame(documents(2), SCHEMA)
    model = li.fit(frame.where("doc_id < 0"))
    assert {(r.lang_pred, r.score, r.rejected) for r in li.predict(frame, model).collect()} == {("und", 0.0, True)}
    assert li.predict(frame.limit(0), model).count() == li.keep_recognised(frame.limit(0)).count() == 0


def test_ngrams_of_letters():
    assert li.ngram_counts(None) is None and li.ngram_counts("") is None and li.ngram_counts("1, 2 – 3!") is None
    assert (li.ngram_counts("Ab, cD 3") == li.ngram_counts("ab  cd")).all()
    # " a ", then per position one to three characters.
    assert li.ngram_counts("a").sum() == 3 + 2 + 1


def test_query_holds_out_a_quarter(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_language(spark, str(tmp_path)).collect()
    import zlib

    assert {r.doc_id for r in got if r.held_out} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2}
    lang = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.9
    assert 0.1 < np.mean([r.held_out for r in got]) < 0.4 and pytest.approx(len(rows)) == len(got)


def test_texts_outside_the_sample_are_kept(spark):
    frame = spark.createDataFrame(documents(200), SCHEMA)
    model = li.fit(frame, sample=6)
    assert [r.row.doc_id for r in li.predict(frame, model).where("rejected").collect()] == []


def test_a_few_odd_labelled_texts_let_nothing_in(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choice("qxzwvyjk") for _ in range(rng.randint(1, 9))) for _ in range(n))
    same_script = lambda n: " ".join("".join(rng.choice("zu pof wy xeb".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    clean = documents(200)
    odd = [(3000 + i, t, "aa", "s", "r", "x") for i, t in enumerate([noise(60), noise(300), "Это другой язык. " * 40])]
    mislabelled = [(4000 + i, t, "aa", "s", "r", "x") for i, (_, t, lang, *_) in enumerate(clean) if lang == "bb" and len(t) > 400][:2]
    unlearned = [(5000 + i, same_script(n), None, "s", "r", "x") for i, n in enumerate([20, 60, 300] * 3)]
    frame = spark.createDataFrame(clean + odd + mislabelled + unlearned, SCHEMA)
    got = {r.row.doc_id: r for r in li.predict(frame, li.fit(frame)).collect()}
    assert {d for d, r in got.items() if r.rejected} == {r[0] for r in odd + unlearned}
    assert all(got[r[0]].lang_pred == "bb" for r in mislabelled)
