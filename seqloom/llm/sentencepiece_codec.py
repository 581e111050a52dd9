"""SentencePiece encoding and decoding with forward states shared along a trie.

The model is read from its file; the library is not used. A batch's distinct marked words (runs of the space mark and the characters up to the
next mark) are sorted, which lays their trie out depth first, and a stack keeps the forward state of each prefix, so words with a common beginning
share its states.

Unigram models: the state is the best score of a prefix and its last piece (Viterbi). BPE models: merging isn't score-maximal, so Viterbi over the
scores would give other pieces; but the encoding of a prefix still ends in exactly one piece, and a sequence of pieces is the encoding of its text
exactly if each adjacent pair is the encoding of its own text. So the state is the last piece of the prefix's encoding: the piece whose
encoding before it ends in one that it doesn't merge with. The search and the sharing are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_arrow, one_a_worker, text_or_empty

MARK = "▁"
#: Words in the younger half of a worker's cache; pairs of pieces.
CACHE_WORDS, CACHE_PAIRS = 350_000, 350_000
#: Bytes of text whose words are in memory at once (one text at least).
SLICE_BYTES = 2 << 20
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: bytes, int, or four raw bytes."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.lowest = min((s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0) - 10


def read_model(path: str) -> Model:
    """Pieces, scores and settings of a model file. Only models without a normalisation table and with kept white space are taken."""
    pieces, scores, kinds, settings = [], [], [], {}
    with open(path, "rb") as f:
        message = f.read()
    for number, value in _fields(message):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    settings["kind"] = v
                elif n == 35:
                    settings["byte_fallback"] = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 3:
                    settings["dummy_prefix"] = bool(v)
                elif n == 2 and v or n == 4 and v:
                    raise ValueError("this model normalises its text")
    return Model(pieces, scores, kinds, **settings)


def merge(text: str, score: dict[str, float]) -> list[str]:
    """BPE by its definition: the best adjacent pair that is a piece is merged, the leftmost of equals, until none is."""
    parts: list[str | None] = list(text)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (s := score.get(m := parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (-s, i, after[i], m))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, j, m = heapq.heappop(heap)
        if parts[i] is None or after[i] != j or parts[i] + parts[j] != m:
            continue
        parts[i], parts[j], after[i] = m, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Codec:
    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: For the last piece of a prefix and a piece after it whether the two stay apart; n_pairs counts them.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        # A line end that no piece has is a word of its own: nothing merges with it.
        line = "" if any("\n" in p for p in model.ids) else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\n" if line else "")).findall
        if model.kind == BPE:
            self._learn_merges()

    def _learn_merges(self) -> None:
        """rank: the order in which merges come, single characters first. split: the two parts a piece is merged from."""
        model = self.model
        self.score = {p: model.scores[i] for p, i in model.ids.items()}
        ordered = sorted(model.ids, key=lambda p: (len(p) > 1, -self.score[p]))
        self.rank = {p: n for n, p in enumerate(ordered)}
        self.split: dict[str, tuple[str, str]] = {}
        for p in ordered:
            if len(p) > 1:
                # Without the piece itself its text ends in its two parts, if merging makes it at all.
                own = self.score.pop(p)
                parts = merge(p, self.score)
                self.score[p] = own
                if len(parts) == 2:
                    self.split[p] = (parts[0], parts[1])
        self.made = {p: p for p in model.ids if len(p) == 1 or p in self.split}
        #: By their last three characters how long pieces of three or more are, longest first: other lengths needn't be tried.
        lengths: dict[str, set[int]] = {}
        for p in self.made:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}

    def _joins(self, left: str, right: str) -> bool:
        """Whether the pair is the encoding of its text: undoing merges from the latest, none across the middle comes before one undone."""
        rank, split = self.rank, self.split
        limit = 1 << 60
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                if left in split:
                    limit, left = a, split[left][1]
                elif right in split:
                    limit, right = b + 1, split[right][0]
                else:
                    return True
            elif right in split:
                limit, right = b + 1, split[right][0]
            elif left in split:
                limit, left = a, split[left][1]
            else:
                return True

    def _extend_bpe(self, word: str, states: list[str], begin: int) -> None:
        """Adds the last piece of the encoding of word[:i] for each i from begin on, given those of the shorter prefixes."""
        made, pairs, lengths = self.made, self.pairs, self.lengths
        for i in range(begin, len(word) + 1):
            for k in (*lengths.get(word[i - 3 : i], ()), 2) if i > 2 else (i,):
                piece = made.get(word[i - k : i]) if k <= i else None
                if piece is None:
                    continue
                if k == i:
                    break
                after = pairs.get(left := states[i - k])
                if after is None:
                    after = pairs[left] = {}
                joins = after.get(piece)
                if joins is None:
                    joins = after[piece] = self._joins(left, piece)
                    self.n_pairs += 1
                if joins:
                    break
            else:
                piece = word[i - 1 : i]
            states.append(piece)

    def _extend_unigram(self, word: str, states: list[tuple[float, str]], begin: int) -> None:
        """Adds the best score of word[:i] and its last piece for each i from begin on."""
        ids, score = self.model.ids, self.model.scores
        for i in range(begin, len(word) + 1):
            best = (states[i - 1][0] + self.model.lowest, word[i - 1 : i])
            for j in range(max(0, i - self.model.longest), i):
                piece = word[j:i]
                if (at := ids.get(piece)) is not None and (s := states[j][0] + score[at]) > best[0]:
                    best = (s, piece)
            states.append(best)

    def _ids(self, pieces: list[str]) -> list[int]:
        out, ids, model = [], self.model.ids, self.model
        for p in pieces:
            if (at := ids.get(p)) is not None:
                out.append(at)
            elif model.byte_fallback:
                out += [model.bytes[b] for b in p.encode()]
            elif not out or out[-1] != model.unknown:
                out.append(model.unknown)
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words in trie order; states[i] is shared by all that begin with the same i characters."""
        bpe = self.model.kind == BPE
        extend = self._extend_bpe if bpe else self._extend_unigram
        states: list = ["" if bpe else (0.0, "")]
        last = ""
        ids, pack = self.model.ids.__getitem__, lambda x: array("i", x).tobytes()
        if self.n_pairs > CACHE_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        for word in sorted(words):
            if bpe and MARK * 2 in word:  # runs of marks are pieces of equal score, which ranks can't order
                self.cache[word] = np.array(self._ids(merge(word, self.score)), dtype="<i4").tobytes()
                continue
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            extend(word, states, shared + 1)
            pieces, i = [], len(word)
            while i:
                piece = states[i] if bpe else states[i][1]
                pieces.append(piece)
                i -= len(piece)
            pieces.reverse()
            try:
                found = pack(list(map(ids, pieces)))
            except KeyError:
                found = pack(self._ids(pieces))
            self.cache[word] = found
            last = word

    def marked(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        return self.words(MARK + text if self.model.dummy_prefix and text else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        split = [self.marked(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:  # words that aren't met again until the younger half is full go
            self.older, self.cache = self.cache, {}
        unknown = []
        for w in set().union(*split).difference(self.cache):
            if (found := self.older.get(w)) is not None:
                self.cache[w] = found
            else:
                unknown.append(w)
        self.learn(unknown)
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are put together, marks are spaces, the first one added by encoding goes."""
        model, out = self.model, bytearray()
        for i in ids:
            if model.kinds[i] == BYTE:
                out.append(int(model.pieces[i][3:5], 16))
            elif model.kinds[i] != CONTROL:
                out += " ⁇ ".encode() if i == model.unknown else model.pieces[i].replace(MARK, " ").encode()
        text = out.decode("utf-8", "replace")
        return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _codec(path: str) -> Codec:
    """One to a worker: its cache serves the worker's later tasks too."""
    return one_a_worker(("pieces", path), lambda: Codec(read_model(path)))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces, decoded_sha256) for each row of docs: the ids of the whole text and the hash of what they decode to.

    A null or empty text has no ids. Texts with the mark itself decode to spaces there, as the library's do. Columns other than doc_id and text
    are not read.
    """

    def work(batches):
        codec = _codec(model_path)
        plain = [p.replace(MARK, " ").encode() if k == NORMAL else None for p, k in zip(codec.model.pieces, codec.model.kinds, strict=True)]
        for batch in batches:
            encoded = codec.encode(batch.column("text").to_pylist())
            hashes = []
            for data in encoded:
                ids = np.frombuffer(data, dtype="<i4").tolist()
                try:
                    text = b"".join(map(plain.__getitem__, ids))
                    text = text[1:] if codec.model.dummy_prefix and text.startswith(b" ") else text
                except TypeError:  # bytes or unknown pieces
                    text = codec.decode(ids).encode()
                hashes.append(hashlib.sha256(text).hexdigest())
            lengths = np.array([len(e) // 4 for e in encoded])
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values), pa.array(lengths, pa.int64()), pa.array(hashes)], ["doc_id", "ids", "n_pieces", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return map_arrow(narrow, work, "doc_id long, ids array<int>, n_pieces long, decoded_sha256 string", SLICE_BYTES, "pieces")
