import random

import numpy as np
from llm_plain import dedup_lines, mix, near_documents

import corpus_pipeline
from causeway.llm import language_id as li, piece_sampling as ps
from causeway.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(15)
    parts = {"aa": "ka mo te ri".split(), "bb": "sun ol gra chen".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    shared = line("aa", 55)
    rows = []
    for i in range(60):
        lang = rng.choice(["aa", "bb"])
        lines = [line(lang, rng.choice([1, 6, 20, 40])) for _ in range(rng.randint(1, 4))]
        if i % 7 == 0:
            lines.append(shared)
        rows.append((i, "\n".join(lines), lang, rng.choice(["s1", "s2", None])))
    for i in range(60, 75):  # near copies, broken into other lines, which line dedup does not see
        words = rows[i - 50][1].split()
        words.insert(rng.randrange(len(words) + 1), word("aa"))
        rows.append((i, "\n".join(" ".join(words[n:n + 9]) for n in range(0, len(words), 9)), rows[i - 50][2], "s1"))
    rows += [(80, "Это другой язык. " * 20, None, "s1"), (81, None, "aa", "s2"), (82, "", "aa", "s2"), (83, "77 -- 8", None, "s2")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_run_equals_plain_stages(spark, tmp_path):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
    model = li.fit(frame)
    kept = []
    for row in rows:
        counts = li.ngram_counts(row[1])
        if counts is not None and not model.predict(counts[None, :])[2][0]:
            kept.append(row)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {80, 81, 82, 83}
    texts = dedup_lines([(r[0], r[1]) for r in kept])
    unique = near_documents(texts, 5)
    stay = [r for r in kept if unique[r[0]][2]]
    assert len(stay) < len(kept)
    taken = mix([(r[0], r[3], texts[r[0]]) for r in stay])
    want = sorted((r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in stay for _ in range(taken[r[0]][2]))
    got = out.collect()
    assert sorted(tuple(r)[:5] for r in got) == want
    tables = ps._Tables(ps.Vocabulary(ps._model(ps.MODEL)))
    seeds = {r.doc_id: r.s for r in frame.select("doc_id", F.xxhash64(F.lit(0), F.col("doc_id")).alias("s")).collect()}
    for r in got:
        seed = ps.mixed(np.array([seeds[r.doc_id]], np.int64).view(np.uint64))
        assert r.piece_ids == ps.sample_pieces([r.text], seed, tables)[0].tolist()
        assert ps.join_pieces(r.piece_ids, tables.vocabulary.spelling) == r.text


def test_stages_take_odd_tables(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_dedup", "mixing", "piece_encoding"]
    odd = spark.createDataFrame([(None, None, None, None, None, "x")] * 2 + [(1, "ka ka ka", None, None, None, "x")] * 2,
                                SCHEMA + ", row string")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, str(tmp_path))
            assert made.columns[:6] == docs.columns and len(made.columns) == 6 + (name == "piece_encoding")
            made.collect()


def test_registered_queries():
    assert set(ORACLES) <= set(QUERIES) and "pipeline" in QUERIES
    assert sorted(q.split("_")[0] for q in QUERIES if q != "pipeline") == sorted(f"op{i}" for i in range(1, 14))
