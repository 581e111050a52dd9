"""The corpus pipeline, stage by stage, against brute-force versions on a small corpus."""

import hashlib
import random
from itertools import pairwise

import pytest
from test_decontaminate import brute as brute_leaks
from test_linededup import brute as brute_lines
from test_simhash_neardup import brute_near

import corpus_pipeline
from seqloom.llm import toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in ("ma", "te", "ri", "so") for b in ("lo", "ne", "ka") for c in ("ra", "st", "mi", "no", "du")]


def tables(spark, folder):
    rng = random.Random(11)
    sentence = lambda k=8: " ".join(rng.choice(VOCABULARY) for _ in range(k)).capitalize() + "."
    shared = [sentence() for _ in range(4)]
    items = [(i, sentence(30)) for i in range(4)]
    docs = []
    for i in range(160):
        lines = [sentence() for _ in range(rng.randrange(2, 12))]
        if i % 9 == 0:
            lines += shared
        if i % 11 == 0:
            lines.insert(1, items[i % 4][1])
        if i % 7 == 0:
            lines.append("You are a grobnik and a vaskull grobnik.")
        docs.append((i, "\n".join(lines)))
    for i in range(160, 200):  # copies and near copies
        text = docs[rng.randrange(100)][1]
        docs.append((i, text if i % 2 else text.rsplit(" ", 1)[0]))
    docs += [(300, None), (301, ""), (302, sentence(9000)), (None, sentence(20))]
    rows = [(d, t, None if i % 50 == 0 else "en", "web", len(t) if t else None) for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 7 == 0)) for d, _ in docs[:160]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages_equal_brute_force(spark, tmp_path):
    items, at = tables(spark, str(tmp_path)), str(tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    before, results = docs, []
    for n, name in enumerate(stage):
        after = stage[name](spark, before, at)
        if n < 4:
            assert after.columns == docs.columns
        after.write.parquet(f"{at}/out{n}")
        before = spark.read.parquet(f"{at}/out{n}")
        results.append([tuple(r) for r in before.collect()])

    start = [tuple(r) for r in docs.collect()]
    labels = spark.read.parquet(f"{at}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels).collect()
    toxic = {r.doc_id for r in scored if r.predicted}
    assert toxic and len([d for d in toxic if d is not None and (d % 7 == 0 or d >= 160)]) == len(toxic)
    assert sorted(results[0], key=str) == sorted((r for r in start if r[0] not in toxic), key=str)

    lines = brute_lines([r[:2] for r in results[0]])
    want = [(r[0], lines[r[0]][0], *r[2:4], len(lines[r[0]][0]) if lines[r[0]][1] else r[4]) for r in results[0]]
    assert any(n for _, n in lines.values()) and sorted(results[1], key=str) == sorted(want, key=str)

    kept = set(brute_near([r[:2] for r in results[1]]))
    assert len(kept) < len(results[1]) and sorted(results[2], key=str) == sorted((r for r in results[1] if (r[0], r[1] or "") in kept), key=str)

    leaks = {d for d, n, *_ in brute_leaks([r[:2] for r in results[2]], items) if n}
    assert leaks and sorted(results[3], key=str) == sorted((r for r in results[2] if r[0] not in leaks), key=str)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for d, t, *_ in results[3]:
        ids = library.encode(t or "")
        want.append((d, ids, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(results[4], key=str) == sorted(want, key=str)

    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_are_kept(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(30).selectExpr("*", "'a' as h", "1 as covered", "2 as fp", "3 as item_id", "4 as score", "5 as kept_id", "6 as component_id")
    seen = [docs]
    for _, f in corpus_pipeline.STAGES[:-1]:
        seen.append(f(spark, seen[-1], str(tmp_path)))
        assert seen[-1].columns == docs.columns
    assert all(a.count() >= b.count() > 0 for a, b in pairwise(seen))
