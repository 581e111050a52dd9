"""Toxicity: restored spellings, the character model by brute force, and accuracy on held-out labels."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import toxicity as op

SF = "/root/testdata/sf0.01"
CLEAN = "the river runs past old houses and people walk home slowly after work while children play near water".split()
BAD = ["grobnik", "vaskull", "mordrane"]
DISGUISE = str.maketrans({"o": "0", "i": "1", "a": "@", "s": "$", "e": "3"})


def hide(word, rng):
    kind = rng.randrange(5)
    if kind == 0:
        return word.translate(DISGUISE)
    if kind == 1:
        return ".".join(word)
    if kind == 2:
        return " ".join(word)
    if kind == 3:
        k = rng.randrange(len(word))
        return word[:k] + word[k] * 4 + word[k + 1 :]
    return word.upper()


def corpus(n=900):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 60))]
        if i % 3 == 0:
            for _ in range(3):
                w = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), w if rng.random() < 0.5 else hide(w, rng))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    return rows, labels


def test_counts_equal_brute_force(spark):
    texts = ["Hello, wörld", None, "", "a b", "日本"]
    got = {r.gram: r.n for r in op.char_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)).collect()}
    code = lambda c: 27 if "À" <= c <= "ÿ" else ord(c) - 96 if "a" <= c <= "z" else 0
    want = Counter()
    for t in texts:
        x = [0, 0, *(code(c) for c in (t or "").lower()), 0, 0]
        want.update((a * 28 + b) * 28 + c for a, b, c in zip(x, x[1:], x[2:], strict=False) if (a, b, c) != (0, 0, 0))
    assert {g: n for g, n in got.items() if g} == want


def test_decoding_finds_the_best_spelling():
    """Against all spellings of the lattice, by a random model."""
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.ones(28), size=(28, 28)))
    restore = op.Restorer(log_p)

    def spellings(token):
        runs, i = [], 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            runs.append((token[i], j - i, i == 0 or j == len(token)))
            i = j
        out = [("", 0.0)]
        for c, n, edge in runs:
            if c.isalpha():
                own = [(c, 0.0)] if n == 1 else [(c, -1.0 if n > 2 else -2.0), (c * 2, 0.0 if n == 2 else -1.0)]
            else:
                own = [(x * k, -1.0 - 0.5 * (k > 1)) for x in op.LOOKALIKES.get(c, "") for k in {1, min(2, n)}]
                if c in op.SEPARATORS or c not in op.LOOKALIKES:
                    own.append(("", -0.5))
                elif edge:
                    own.append(("", -2.0))
            out = [(t + x, s + y) for t, s in out for x, y in own]
        return out

    def score(text, cost):
        x = [0, 0, *(ord(c) - 96 for c in text), 0]
        return cost + sum(log_p[a][b][c] for a, b, c in zip(x, x[1:], x[2:], strict=False))

    pick = random.Random(1)
    for _ in range(80):
        token = "".join(pick.choice("ab0136@.-$ee") for _ in range(pick.randrange(1, 7)))
        best = max(score(t, s) for t, s in spellings(token))
        found = restore.decode(token)
        assert max(score(t, s) for t, s in spellings(token) if t == found) == pytest.approx(best)


def test_restores_hidden_words(spark):
    rows, _ = corpus(300)
    restore = op.Restorer(op.language_model(op.char_counts(spark.createDataFrame(rows, "doc_id long, text string"))))
    for token, word in [("ch1ldr3n", "children"), ("p.e.o.p.l.e", "people"), ("hou$es", "houses"), ("wa-ter", "water"), ("hhhhome", "home"), ("r1ver!", "river")]:
        assert word in restore.words(token), (token, restore.words(token))
    assert "people" in restore.spaced("some p e o p l e here")
    assert restore.words("plain") == ["plain"] and restore.words("1234") == [] and restore.words("don't")[:2] == ["don", "t"]


def test_words_in_spaced_runs(spark):
    """Behind a one-letter word, second in a run, over a doubled letter, and in a run of any length."""
    rows, _ = corpus(300)
    restore = op.Restorer(op.language_model(op.char_counts(spark.createDataFrame(rows, "doc_id long, text string"))))
    for run, words in [("a r i v e r", ["river"]), ("t h e r i v e r", ["the", "river"]), ("p a s t t h e h o u s e s", ["past", "the", "houses"]), ("o l d " * 3 + "v a s k u l l", ["old", "vaskull"])]:
        assert set(words) <= set(restore.spaced(run)), (run, restore.spaced(run))
    sentence = [*CLEAN, *BAD, *CLEAN]
    found = restore.spaced(" ".join("".join(sentence)))
    assert {*BAD} <= {*found} and len({*sentence} & {*found}) > 0.8 * len({*sentence}), found
    assert restore.spaced("a " * 5000 + "a")[-1].strip("a") == ""


def test_long_tokens_are_decoded(spark):
    """Stretched words, long words with signs, and words chained by separators."""
    rows, _ = corpus(300)
    restore = op.Restorer(op.language_model(op.char_counts(spark.createDataFrame(rows, "doc_id long, text string"))))
    all_words = lambda token: {w for g in restore.groups(token) for w in g}
    assert "vaskull" in all_words("v" + "a" * 60 + "skull") and "river" in all_words("r" + "1" * 45 + "ver")
    chain = all_words(".-.".join(".".join(w) for w in ["the", *BAD, "people"]))
    assert {*BAD, "people"} <= chain, chain
    assert {"the", "river"} <= all_words("the.r1ver") and restore.chained("old-houses") == [] and restore.chained("w.a.t.e.r") == []


def test_chained_sentence_is_toxic(spark):
    rows, labels = corpus()
    rows.append((9000, " ".join(CLEAN) + " " + ".-.".join(".".join(w) for w in ["people", *BAD, "walk"])))
    got = op.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.where("doc_id = 9000").first().predicted == 1


def test_spaced_sentence_is_toxic(spark):
    rows, labels = corpus()
    rows.append((9000, " ".join("".join(["people", *BAD, "walk", "home", *BAD, "near", "water"]))))
    got = op.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(rows[-1][1]) > 80 and got.where("doc_id = 9000").first().predicted == 1


def test_scores(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "river " * 100_000), (9003, "same"), (9003, "same"), (None, "no id")]
    labels += [(0, None), (None, 1), (99999, 1), (0, 0)]
    docs = spark.createDataFrame([(d, t, "src", 1.0) for d, t in rows], "doc_id long, text string, source string, score double")
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, toxic int, text string")
    got = op.score_toxicity(docs, table).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= op.THRESHOLD) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held])
    assert len(held) > 200 and right > 0.97
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 9000)
    kept = op.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in got if r.predicted}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in rows if d is not None and d not in gone)


def brute_counts(rows):
    code = lambda c: 27 if "À" <= c <= "ÿ" and c not in "×÷" else ord(c) - 96 if "a" <= c <= "z" else 0
    n = np.zeros((28, 28, 28))
    for _, t in rows:
        x = [0, 0, *(code(c) for c in (t or "").lower()), 0, 0]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            if a or b or c:
                n[a, b, c] += 1
    return n


def test_whole_query_equals_brute_force(spark):
    """In plain Python: counts, lexicon, evidence with each row's own counts taken out, the likeliest coefficients, scores. Spellings are decoded by
    the operator, whose decoding is held against all spellings above."""
    rows, labels = corpus(240)
    rows += [(500, None), (501, "s t u f f with v.a.s.k.u.l.l"), (502, " ".join(BAD) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in op.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    counts = {r.gram: r.n for r in op.char_counts(docs).collect()}
    want_counts = brute_counts(rows).ravel()
    assert all(counts.get(g, 0) == want_counts[g] for g in range(1, 28**3))
    restore = op.Restorer(op.language_model(op.char_counts(docs)))

    def groups(text):
        tokens = set((text or "").split())
        return [words for t in tokens for words in [restore.words(t), *([w] for w in restore.chained(t))]] + [[w] for w in restore.spaced(text or "")], len(tokens)

    learned = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    found = {d: groups(t) for d, t in rows}
    has = {d: {s for words in g for w in words for s in op.stems(w)} for d, (g, _) in found.items()}
    toxic, clean = Counter(), Counter()
    for d, y in learned.items():
        (toxic if y else clean).update(has[d])
    n_toxic, n_clean = sum(learned.values()), len(learned) - sum(learned.values())

    def evidence(d, own=None):
        best = {}
        for words in found[d][0]:
            options = []
            for s in {s for w in words for s in op.stems(w)}:
                t, c = toxic[s] - (own == 1), clean[s] - (own == 0)
                w = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 1.0) / (n_clean + 2))
                if t >= op.MIN_DOCS and toxic[s] >= op.MIN_DOCS and w >= op.MIN_WEIGHT and (own is None or np.log((toxic[s] + 0.5) / (n_toxic + 1)) - np.log((clean[s] + 1.0) / (n_clean + 2)) >= op.MIN_WEIGHT):
                    options.append((w, s))
            if options:
                w, s = max(options)
                best[s] = w
        w = sorted(best.values(), reverse=True)
        return (w[0], sum(op.FADE**k * max(0, x - op.DOUBT) for k, x in enumerate(w[1:])), np.log1p(found[d][1])) if w else (0, 0, 0)

    x = np.array([evidence(d, y) for d, y in learned.items()])
    beta = op.logistic(x, np.array(list(learned.values()), dtype=float))
    y = np.array(list(learned.values()), dtype=float)
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert np.allclose(x.T @ (y - p), 0.01 * beta[1:], atol=1e-4)  # no better coefficients: the gradient is the penalty's
    beta[1:3] = np.maximum(beta[1:3], 0)
    want = {d: 1 / (1 + np.exp(-np.clip(beta[0] + np.dot(evidence(d), beta[1:]), -30, 30))) for d, _ in rows}
    assert got == pytest.approx(want, abs=1e-6)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for flip in (0, 1):
        changed = [(d, y ^ flip if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
        results.append({r.doc_id: r.score for r in op.score_toxicity(docs, spark.createDataFrame(changed, "doc_id long, toxic int")).collect()})
    assert results[0] == pytest.approx(results[1])


def test_empty_tables_and_one_label(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert op.score_toxicity(docs, labels).collect() == [] and op.drop_toxic(docs, labels).collect() == []
    some = spark.createDataFrame([(1, "x"), (2, "y")], docs.schema)
    assert [r.predicted for r in op.score_toxicity(some, labels).collect()] == [0, 0]
    assert [r.predicted for r in op.score_toxicity(some, spark.createDataFrame([(1, 0), (2, 0)], labels.schema)).collect()] == [0, 0]


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op.score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert len(got) > 80 and np.mean([r.predicted == r.toxic for r in got]) > 0.9
