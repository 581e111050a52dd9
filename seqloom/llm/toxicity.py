"""Toxicity scores behind a noisy-channel deobfuscator.

1. A character trigram model is counted over every document.
2. A token that hides letters behind look-alike signs, separators or repetition is a lattice: each sign stands for the letters it resembles, a
   separator may be dropped, a run may be one letter or two. Viterbi decoding under the trigram model picks the restored spelling. In letters
   spaced out one by one a word may end after any letter, and in other tokens at any separator; each word is weighed.
3. Restored words and word stems are weighed by how much more often they occur in documents labelled toxic. A document's evidence is the largest
   weights of its distinct words; logistic regression makes it a probability.

Labels are learned from at most about TRAIN_ROWS labelled rows, chosen by a hash, which also bounds the lexicon; counts of the character model
cover all documents. The model knows Latin letters: other scripts are no letters to it, so they are neither restored nor look-alikes of Latin
ones, and their words weigh as they are written.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import product
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import crc32_mod, map_arrow, materialize, text_or_empty

TRAIN_ROWS = 200_000
STEMS = (3, 4, 5, 6)
_LONGEST_FIRST = STEMS[::-1]
#: A word or stem needs so many toxic training documents, and a weight of so much.
MIN_DOCS, MIN_WEIGHT = 2, 1.0
#: Words that a few toxic documents share by chance weigh hardly more.
DOUBT = 2.0
#: A document's k-th weight counts with this to the power of k - 2, so that long texts don't gather evidence from many small ones.
FADE = 0.85
THRESHOLD = 0.7
CACHE_TOKENS = 400_000
#: The words and stems of a token take more room; and so many counts are held before they are given on.
CACHE_FEATURES, HELD_COUNTS = 100_000, 300_000
#: Characters whose trigrams are in memory at once.
COUNTED_AT_ONCE = 1 << 19
#: Longer tokens are decoded each time, so that the cache of spellings stays small.
CACHED_LENGTH = 80
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
SEPARATORS = ".-_*~'`·+/\\,"
_ALPHABET = 28
_LUT = np.zeros(256, dtype=np.int64)
_LUT[97:123] = np.arange(1, 27)
_LUT[[c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]] = 27
_WORDS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: Signs around a token that hide nothing.
_EDGES = ".,;:?\"'()[]{}<>#%&=*!$~^"
_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Two plain words with a separator between: there is nothing to restore but those.
_PLAIN = re.compile(r"[^\W\d_]+[.\-_~'`·+/\\,][^\W\d_]+")


def char_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): trigrams of letters over all documents; gram is (a * 28 + b) * 28 + c with 0 for anything between words and 27 for accented letters."""

    def work(batches):
        total = np.zeros(_ALPHABET**3, dtype=np.int64)
        for batch in batches:
            data = np.frombuffer("  ".join(["", *batch.column("text").to_pylist(), ""]).lower().encode("latin-1", "replace"), dtype=np.uint8)
            for i in range(0, len(data) - 2, COUNTED_AT_ONCE):
                x = _LUT[data[i : i + COUNTED_AT_ONCE + 2]]
                total += np.bincount((x[:-2] * _ALPHABET + x[1:-1]) * _ALPHABET + x[2:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counts = map_arrow(docs.select(text_or_empty(F.col("text")).alias("text")), work, "gram long, n long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """log p(c | a, b), smoothed by the bigram; the table has 28**3 cells whatever the input."""
    n = np.zeros(_ALPHABET**3)
    for r in counts.collect():
        n[r.gram] = r.n
    n = n.reshape(_ALPHABET, _ALPHABET, _ALPHABET)
    unigram = (n.sum((0, 1)) + 1) / (n.sum() + _ALPHABET)
    bigram = (n.sum(0) + 8 * unigram) / (n.sum((0, 1))[:, None] + 8)
    return np.log((n + 8 * bigram[None]) / (n.sum(2, keepdims=True) + 8))


def _code(letter: str) -> int:
    c = letter.encode("latin-1", "replace")[0]
    return int(_LUT[c])


@lru_cache(1 << 14)
def _options(c: str, n: int, first: bool, last: bool, parts: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(letters, their codes, cost): what a run of n equal signs stands for; n = 7 means seven or more."""
    options: list[tuple[str, float]] = []
    if c.isalpha():
        options = [(c, 0.0)] if n == 1 else [(c, -1.0 if n > 2 else -2.0), (c * 2, 0.0 if n == 2 else -1.0)]
        if parts == "letters" and n > 1:  # the run may go over from one word to the next, or hold a word of one letter
            for runs in (r for k in (2, 3) for r in product((1, 2), repeat=k) if sum(r) <= n):
                options.append((" ".join(c * r for r in runs), 0.0 if sum(runs) == n else -1.0))
    else:
        options = [(letter * k, -1.0 - 0.5 * (k > 1)) for letter in LOOKALIKES.get(c, "") for k in {1, min(2, n)}]
        if c in SEPARATORS or c not in LOOKALIKES:
            options.append(("", -0.5))
            if parts == "signs" and not first and not last:
                options.append((" ", -0.5))
        elif first or last:
            options.append(("", -2.0))
    if parts == "letters" and not last:
        options += [(letters + " ", cost) for letters, cost in options if letters]
    return [(letters, tuple(map(_code, letters)), cost) for letters, cost in options]


class Restorer:
    """Restored spellings of tokens under a character model."""

    def __init__(self, log_p: np.ndarray):
        self.rows = log_p.reshape(-1, _ALPHABET).tolist()
        self._cached = lru_cache(1 << 16)(self._decode)

    def decode(self, token: str, parts: str = "") -> str:
        """The likeliest letters for a token. With parts a word may end after any letter ("letters") or at a sign ("signs"), and words come with a space between."""
        return self._cached(token, parts) if len(token) <= CACHED_LENGTH else self._decode(token, parts)

    def _decode(self, token: str, parts: str) -> str:
        """A Viterbi search over the token's lattice, whose states are the last two letters: linear in its length."""
        rows, states, done, i, step = self.rows, {0: (0.0, "")}, [], 0, 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            options = _options(c, min(j - i, 7), i == 0, j == len(token), parts)
            after: dict[int, tuple[float, str]] = {}
            for state, (score, text) in states.items():
                for letters, codes, cost in options:
                    if letters == " " and not state % _ALPHABET:  # a word has ended already
                        continue
                    k, s = state, score + cost
                    for z in codes:
                        s += rows[k][z]
                        k = k % _ALPHABET * _ALPHABET + z
                    old = after.get(k)
                    if old is None or s > old[0]:
                        after[k] = (s, text + letters)
            states, i, step = after, j, step + 1
            if not step % 64:  # what all spellings begin with is settled
                n = len(commonprefix([t for _, t in states.values()]))
                done.append(next(iter(states.values()))[1][:n])
                states = {k: (s, t[n:]) for k, (s, t) in states.items()}
        return "".join(done) + max(((s + rows[k][0], t) for k, (s, t) in states.items()), default=(0.0, ""))[1]

    @staticmethod
    def plain(token: str) -> str | None:
        """The lower-case word of a token of letters, with signs around it or not, that has nothing to restore; None for other tokens."""
        core = token.lower()
        if not core.isalpha():
            core = core.strip(_EDGES)
            if not core.isalpha():
                return None
        return None if _RUN.search(core) else core

    def words(self, token: str) -> list[str]:
        """The lower-case words of a token between white space, as written and as restored."""
        token = token.lower()
        if token.isalpha() and not _RUN.search(token):
            return [token]
        found = _WORDS.findall(token)
        core = token.strip(_EDGES)
        if not any(map(str.isalpha, core)):
            return found
        hidden = not core.isalpha() and any(c in LOOKALIKES or c in SEPARATORS for c in core)
        if hidden or _RUN.search(core):
            found.append(self.decode(core))
            for tail in {token.strip(".,;:?\"'()[]{}<>#%&=~^"), core} - {core}:
                found.append(self.decode(tail))
        return found

    def chained(self, token: str) -> list[str]:
        """The words of a token whose separators part some letters and only stand between others; none where that is one word."""
        core = token.lower().strip(_EDGES)
        if core.isalpha() or _PLAIN.fullmatch(core) and not _RUN.search(core) or not any(c in SEPARATORS for c in core) or not any(map(str.isalpha, core)):
            return []
        words = self.decode(core, "signs").split()
        return words if len(words) > 1 else []

    def groups(self, token: str) -> list[list[str]]:
        """The words of a token, put together where only the heaviest counts."""
        if (word := self.plain(token)) is not None:
            return [[word]]
        return [self.words(token), *([w] for w in self.chained(token))]

    def spaced(self, text: str) -> list[str]:
        """Words written with a space after each letter: each run as one word, and as the words it falls into."""
        found: dict[str, None] = {}
        for m in _SPACED.findall(text):
            if sum(map(str.isalpha, m)) >= 2:
                run = "".join(m.lower().split())
                found.update(dict.fromkeys([self.decode(run), *self.decode(run, "letters").split()]))
        return list(found)


def stems(word: str) -> list[str]:
    """What of a word is weighed: itself and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)] if len(word) >= 3 else []


class Features:
    """The words and stems of texts; those of a token are cached."""

    def __init__(self, restore: Restorer):
        self.restore = restore
        self.cache: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> set[str]:
        cache, tokens = self.cache, set(text.split())
        if len(cache) > CACHE_FEATURES:
            cache.clear()
        for t in tokens.difference(cache):
            cache[t] = tuple({s for words in self.restore.groups(t) for word in words for s in stems(word)})
        found = set().union(*map(cache.__getitem__, tokens))
        if any(len(t) == 1 for t in tokens):
            for word in self.restore.spaced(text):
                found.update(stems(word))
        return found


def evidence(weights: list[float], distinct: int) -> tuple[float, float, float]:
    """The largest weight, what the others have over DOUBT, each fading by its rank, and how many tokens there were for a word to be found by chance."""
    if not weights:
        return (0.0, 0.0, 0.0)
    first, *others = sorted(weights, reverse=True)
    rest, factor = 0.0, 1.0
    for w in others:
        if w <= DOUBT:
            break
        rest += factor * (w - DOUBT)
        factor *= FADE
    return (first, rest, float(np.log1p(distinct)))


_NOTHING: list = []


class Scorer:
    """Scores texts; what a token contributes is cached."""

    def __init__(self, restore: Restorer, lexicon: dict[str, float], beta: np.ndarray | None = None):
        self.restore, self.lexicon, self.beta = restore, lexicon, beta
        #: For each beginning that is weighed the heaviest of it and the shorter ones.
        self.begun: dict[str, tuple[float, str]] = {}
        for f in sorted((f for f in lexicon if f.endswith("-")), key=len):
            own = (lexicon[f], f)
            self.begun[f[:-1]] = max([own, *(x for k in STEMS if k < len(f) - 1 and (x := self.begun.get(f[:k])))])
        self.begins = {f[:3] for f in lexicon}  # of whatever is weighed: a word that begins otherwise weighs nothing
        self.cache: dict[str, list[tuple[float, str]]] = {}

    def _heaviest(self, word: str) -> tuple[float, str] | None:
        """The heaviest of a word and its beginnings."""
        if word[:3] not in self.begins:
            return None
        get, n, found = self.begun.get, len(word), None
        for k in _LONGEST_FIRST:
            if n > k and (found := get(word[:k])) is not None:
                break
        w = self.lexicon.get(word)
        return found if w is None or found is not None and found > (w, word) else (w, word)

    def _best(self, words: list[str]) -> tuple[float, str] | None:
        return max((x for word in words if (x := self._heaviest(word))), default=None)

    def evidence(self, text: str) -> tuple[float, float, float]:
        cache = self.cache
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        tokens = text.split()
        distinct = set(tokens)
        plain, heaviest, groups = self.restore.plain, self._heaviest, self.restore.groups
        for t in distinct.difference(cache):
            if (word := plain(t)) is None:
                cache[t] = [x for words in groups(t) if (x := self._best(words))] or _NOTHING
            else:
                cache[t] = [x] if (x := heaviest(word)) else _NOTHING
        found = {x for xs in map(cache.__getitem__, distinct) if xs for x in xs}
        if any(len(t) == 1 for t in distinct):
            for word in self.restore.spaced(text):
                if x := self._best([word]):
                    found.add(x)
        return evidence([w for w, _ in {s: (w, s) for w, s in found}.values()], len(distinct))

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.evidence(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(_design(x) @ self.beta, -30, 30)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant isn't penalised."""
    x = _design(x)
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def weight(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the shares of toxic and clean documents that have a word, with half a document's doubt for each twenty-fifth toxic one."""
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 1.0) / (n_clean + 2))


def fit(docs: DataFrame, labels: DataFrame, log_p: np.ndarray, train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, logistic weights) from the labelled rows: labels has doc_id and y."""
    spark = docs.sparkSession
    known = labels.count()
    if known > train_rows:  # an even hash keeps about train_rows of them
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * train_rows / known))
    # At most about TRAIN_ROWS rows of 16 bytes: a proven bound, so the texts needn't be shuffled.
    train = docs.join(F.broadcast(labels), "doc_id").select("text", "y")
    held = spark.sparkContext.broadcast(log_p)

    def count(batches):
        features, table, seen = Features(Restorer(held.value)), defaultdict(lambda: [0, 0]), [0, 0]
        rows = lambda t: pa.RecordBatch.from_arrays([pa.array(list(t)), pa.array([v[1] for v in t.values()], pa.int64()), pa.array([v[0] for v in t.values()], pa.int64())], ["feature", "toxic", "clean"])
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y] += 1
                for f in features(text):
                    table[f][y] += 1
            if len(table) > HELD_COUNTS:
                yield rows(table)
                table.clear()
        table[""] = seen
        yield rows(table)

    counted = map_arrow(train, count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = materialize(counted.where(f"toxic >= {MIN_DOCS} or feature = ''"), "words")
    seen = counted.where("feature = ''").first()
    n_toxic, n_clean = (seen.toxic, seen.clean) if seen else (0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.0
        return {}, np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0])
    ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 1.0) / (n_clean + 2))
    # All of them: how many there are is bounded by the labelled rows.
    rows = counted.where("feature <> ''").withColumn("w", ratio).where(f"w >= {MIN_WEIGHT}").collect()
    table = {r.feature: (r.toxic, r.clean) for r in rows}
    lexicon = {r.feature: r.w for r in rows}
    held_table = spark.sparkContext.broadcast((log_p, table))

    def left_out(batches):
        """Evidence of the training rows with their own share of the counts taken out, as for a document not seen."""
        lp, table = held_table.value
        restore = Restorer(lp)
        without = [{f: w for f, c in table.items() if (w := _left(c, y, n_toxic, n_clean)) >= MIN_WEIGHT} for y in (0, 1)]
        scorers = [Scorer(restore, lexicon) for lexicon in without]
        for batch in batches:
            out = [(*scorers[y].evidence(text), y) for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            e = np.array(out, dtype=np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, i]) for i in range(4)], ["first", "rest", "size", "y"])

    if n_toxic + n_clean > 1.2 * train_rows:  # documents repeat labelled ids: their evidence comes to the driver, so it is kept to the same bound
        train = train.where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1 << 30)) < int((1 << 30) * train_rows / (n_toxic + n_clean)))
    e = np.array([tuple(r) for r in map_arrow(train, left_out, "first double, rest double, size double, y double").collect()]).reshape(-1, 4)
    beta = logistic(e[:, :3], e[:, 3])
    beta[1:3] = np.maximum(beta[1:3], 0)
    return lexicon, beta


def _left(counts: tuple[int, int], y: int, n_toxic: int, n_clean: int) -> float:
    toxic, clean = counts[0] - (y == 1), counts[1] - (y == 0)
    return float(weight(toxic, clean, n_toxic, n_clean)) if toxic >= MIN_DOCS else 0.0


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1):
    """A broadcast (character model, lexicon, logistic weights): the first from all docs, the others from labels outside the held fold."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    log_p = language_model(char_counts(narrow))
    known = labels.where("doc_id is not null and toxic is not null").where(crc32_mod(F.col("doc_id"), fold) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    return docs.sparkSession.sparkContext.broadcast((log_p, *fit(narrow, materialize(known, "labels"), log_p)))


def _scorer(model: tuple[np.ndarray, dict[str, float], np.ndarray]) -> Scorer:
    log_p, lexicon, beta = model
    return Scorer(Restorer(log_p), lexicon, beta)


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    labels: doc_id and toxic; only rows whose crc32(doc_id) mod `fold` isn't `held` are learned from, null labels and ids are left out and a
    repeated doc_id counts with its largest label. Null and empty texts are scored as texts without evidence; a null doc_id is never held out.
    """
    model = train(docs, labels, fold, held)

    def work(batches):
        scorer = _scorer(model.value)
        for batch in batches:
            s = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    scored = map_arrow(narrow, work, "doc_id long, score double")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), fold) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those predicted toxic; their columns stay as they are. Rows are judged where they are read: no text is shuffled."""
    model = train(docs, labels)

    def work(batches):
        scorer = _scorer(model.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score([t or "" for t in batch.column("text").to_pylist()]) < threshold))

    return map_arrow(docs, work, docs.schema)
