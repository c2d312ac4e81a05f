"""SentencePiece encoding and decoding in batched numpy.

A text is cut where no piece can reach across, which gives short words; each distinct word is encoded once a batch and
remembered. Words of equal length advance together as a matrix of code points: rolling hashes of all substrings of up to
the longest piece's length probe the sorted hashes of the pieces, which gives for every start and length a piece or none.

A unigram model is then solved by Viterbi: at each position the vectorised maximum over piece lengths of score and best
way so far, with the chosen length as the backpointer. A BPE model isn't: its scores are ranks of merges, and the best sum of
ranks is another segmentation than the merges give. So for a BPE model the same matrix and the same probes carry out
the merges: in every word at once the best-scored pair of neighbours (leftmost among equals) becomes one piece, until no word
has a pair. Words of more than LONG code points go through a heap instead, one by one.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mixed, text_runs, with_arrow

SPACE = "▁"
LONG = 64
KEEP = 200_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message: (number, value)."""
    i = 0

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f", b[i : i + 4])[0] if n == 4 else b[i : i + n]
            i += n


@dataclass
class Vocabulary:
    """Pieces, their scores and types, and the model's kind, as its file states them."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    kind: int
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file that the driver can open. Only models that leave the text as it is (identity
        normalisation, white space kept) are taken."""
        with open(path, "rb") as f:
            data = f.read()
        rows, kind, norm = [], UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                rows.append((d[1].decode(), d.get(2, 0.0), d.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("the model normalises its text; only identity models are supported")
        return cls([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), kind, bool(norm.get(3, 1)))


class Coder:
    """Encodes and decodes batches of texts; a task has one of its own."""

    def __init__(self, v: Vocabulary):
        self.v = v
        live = [i for i, t in enumerate(v.types) if t in (NORMAL, USER)]
        self.ids = {v.pieces[i]: i for i in reversed(live)}
        self.longest = max((len(p) for p in self.ids), default=1)
        keys = np.array([self._hash(p) for p in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int32)[order]
        self.bytes = {int(v.pieces[i][3:5], 16): i for i, t in enumerate(v.types) if t == BYTE}
        self.unknown = int(np.flatnonzero(v.types == UNKNOWN)[0]) if (v.types == UNKNOWN).any() else 0
        # a code point that is part of no longer piece is a word of its own; so is what stands between white space
        joined = sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE})
        inner = any(SPACE in p[1:].lstrip(SPACE) or (p[0] != SPACE and SPACE in p) for p in self.ids)
        known = "".join(map(re.escape, joined))
        self.cut = re.compile(f"(?s){SPACE}*[{known}]+|{SPACE}+|." if known and not inner else "(?s).+")
        worst = v.scores[live].min() if live else 0.0
        self.unknown_score = worst - 10.0
        text = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(v.pieces, v.types)]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_end = np.cumsum([len(t) for t in text])
        self.text_len = np.array([len(t) for t in text])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in mixed(np.array([ord(c) + 1 for c in piece], np.uint64)):
                h = h * _BASE + c
            return int(mixed(np.array([h], np.uint64))[0])

    def _substrings(self, words: list[str]) -> list[np.ndarray]:
        """For words of equal length L: by piece length (from 1), ids of shape words x (L - length + 1), -1 for none."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
        one = mixed(points.astype(np.uint64) + np.uint64(1))
        out, h = [], np.zeros((len(words), n + 1), np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            with np.errstate(over="ignore"):
                h = h[:, : n - length + 1] * _BASE + one[:, length - 1 :]
                key = mixed(h)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out.append(np.where(self.keys[at] == key, self.key_ids[at], -1))
        return out

    def _spelled(self, word: str, at: int) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in word[at].encode()]
        return [self.unknown]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Best segmentation by the sum of scores, of words of equal length."""
        n, found = len(words[0]), self._substrings(words)
        best = np.full((len(words), n + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((len(words), n + 1), np.int64)
        for j in range(1, n + 1):
            ways = np.full((len(words), min(j, len(found))), -np.inf)
            for length in range(1, ways.shape[1] + 1):
                ids = found[length - 1][:, j - length]
                score = np.where(ids >= 0, self.v.scores[ids], self.unknown_score if length == 1 else -np.inf)
                ways[:, length - 1] = best[:, j - length] + score
            # of equal ways the longest piece: it begins first
            back[:, j] = ways.shape[1] - np.argmax(ways[:, ::-1], axis=1)
            best[:, j] = ways[np.arange(len(words)), back[:, j] - 1]
        out = []
        for w, word in enumerate(words):
            j, ids = n, []
            while j:
                length = int(back[w, j])
                i = int(found[length - 1][w, j - length])
                ids.append([i] if i >= 0 else self._spelled(word, j - 1))
                j -= length
            out.append([x for part in reversed(ids) for x in part])
        return out

    def merges(self, words: list[str]) -> list[list[int]]:
        """What merging the best pair again and again gives, of words of equal length."""
        n, found, m = len(words[0]), self._substrings(words), len(words)
        table = np.full((m, n, len(found) + 1), -1, np.int32)  # by start and length
        for length, ids in enumerate(found, 1):
            table[:, : n - length + 1, length] = ids
        width = len(found)
        end = np.tile(np.arange(1, n + 2), (m, 1))  # of the piece that starts here; column n is a sentinel
        before = np.tile(np.arange(-1, n), (m, 1))  # start of the piece before the one that starts here
        alive = np.ones((m, n), bool)
        score = np.full((m, n), -np.inf)  # of joining the piece that starts here with the next

        def offer(rows: np.ndarray, at: np.ndarray) -> None:
            mid = end[rows, at]
            stop = end[rows, np.minimum(mid, n)]
            length = np.where((mid < n) & (stop - at <= width), stop - at, 0)
            ids = table[rows, at, length]
            score[rows, at] = np.where((length > 0) & (ids >= 0), self.v.scores[ids], -np.inf)

        if n > 1 and width > 1:
            score[:, : n - 1] = np.where(found[1] >= 0, self.v.scores[found[1]], -np.inf)
        busy = np.flatnonzero(score.max(axis=1) > -np.inf)
        while len(busy):
            at = np.argmax(score[busy], axis=1)
            go = score[busy, at] > -np.inf
            busy, at = busy[go], at[go]
            mid = end[busy, at]
            stop = end[busy, mid]
            alive[busy, mid] = False
            score[busy, mid] = -np.inf
            end[busy, at] = stop
            before[busy, stop] = at
            offer(busy, at)
            prior = before[busy, at]
            some = prior >= 0
            offer(busy[some], prior[some])
        rows, starts = np.nonzero(alive)
        ids = table[rows, starts, end[rows, starts] - starts]
        flat = ids.tolist()
        for k in np.flatnonzero(ids < 0).tolist():
            flat[k] = self._spelled(words[rows[k]], int(starts[k]))
        cuts = np.searchsorted(rows, np.arange(m + 1)).tolist()
        out = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        for w in set(rows[ids < 0].tolist()):
            out[w] = [x for y in out[w] for x in (y if isinstance(y, list) else [y])]
        return out

    def merge_long(self, word: str) -> list[int]:
        """The same merges of one long word, by a heap of pairs."""
        n = len(word)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (x := self.ids.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (-float(self.v.scores[x]), i, end[end[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out = []
        for i in range(n):
            if alive[i]:
                x = self.ids.get(word[i : end[i]])
                out += [x] if x is not None else self._spelled(word, i)
        return out

    def words(self, text: str) -> list[str]:
        text = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + text if self.v.dummy_prefix and text else text)

    def _learn(self, fresh: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        order, coded = [], []
        for n, own in by_length.items():
            if self.v.kind == BPE and n > LONG:
                done = [self.merge_long(w) for w in own]
            else:
                step = max(1, 400_000 // (n * min(n, self.longest)))
                solve = self.merges if self.v.kind == BPE else self.viterbi
                done = [x for i in range(0, len(own), step) for x in solve(own[i : i + step])]
            order += own
            coded += done
        count = np.array([len(x) for x in coded], np.int64)
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in coded for i in x), np.int32, int(count.sum()))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text's ids)."""
        if len(self.known) > KEEP:
            self._forget()
        words = [self.words(t or "") for t in texts]
        flat = [w for x in words for w in x]
        if fresh := sorted(set(flat) - self.known.keys()):
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        count = self.count[at]
        place = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(x) for x in words])] if words else np.zeros(0, np.int64)
        return self.flat[place], ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        n = self.text_len[ids]
        stop = np.cumsum(n)
        data = self.text[np.repeat(self.text_end[ids] - n - (stop - n), n) + np.arange(n.sum())].tobytes()
        cuts = np.concatenate([[0], stop])[np.concatenate([[0], ends])].tolist()
        out = [data[i:j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]
        return [t[1:] if self.v.dummy_prefix and t[:1] == " " else t for t in out]


def _listed(coder: Coder, texts: list[str | None], back: bool) -> tuple[pa.Array, pa.Array]:
    """(ids of each text, whether they decode to it; null if not asked)."""
    values, ends, same = [np.zeros(0, np.int32)], [0], []
    for part in text_runs(texts, rows=1 << 30):
        ids, stops = coder.encode(part)
        values.append(ids)
        ends += (stops + ends[-1]).tolist()
        same += [a == (b or "") for a, b in zip(coder.decode(ids, stops), part)] if back else [None] * len(part)
    offsets = pa.array(ends, pa.int32(), mask=np.append(np.array([t is None for t in texts], bool), False))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))), pa.array(same, pa.bool_())


def encode(docs: DataFrame, model: str | Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of every whole text. Null texts have null ids, empty ones none; a text's own U+2581 counts as a
    space. model: a file's path, or what it holds; the vocabulary (its size is the file's) is sent to the executors."""
    v = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def start() -> Callable[[pa.Array], pa.Array]:
        coder = Coder(shared.value)
        return lambda column: _listed(coder, column.to_pylist(), False)[0]

    return with_arrow(docs, [text], out, "array<int>", start)


def encode_checked(docs: DataFrame, model: str | Vocabulary, text: str = "text", out: str = "ids", check: str = "round_trip") -> DataFrame:
    """encode(), with a column that says whether the ids decode to the very text (a null text counts as come back; one with a
    U+2581 of its own doesn't come back, since that decodes to a space). Both are
    done by one worker, so neither ids nor decoded texts travel for the check."""
    v = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def start() -> Callable[[pa.Array], pa.Array]:
        coder = Coder(shared.value)
        return lambda column: pa.StructArray.from_arrays(_listed(coder, column.to_pylist(), True), names=["ids", "same"])

    both = free_name(docs, "_coded")
    coded = with_arrow(docs, [text], both, "struct<ids:array<int>,same:boolean>", start)
    kept = [c for c in docs.columns if c not in (out, check)]
    return coded.select(*kept, F.col(both)["ids"].alias(out), F.col(both)["same"].alias(check))


def decode(coded: DataFrame, model: str | Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the text of every array of ids (null for null); control pieces have no text, bytes that make no
    UTF-8 become U+FFFD."""
    v = model if isinstance(model, Vocabulary) else Vocabulary.load(model)
    shared = coded.sparkSession.sparkContext.broadcast(v)

    def start() -> Callable[[pa.Array], pa.Array]:
        coder = Coder(shared.value)

        def make(column: pa.Array) -> pa.Array:
            out: list[str | None] = []
            for a in range(0, len(column), 200):
                part = column.slice(a, 200)
                ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0), np.int64))
                texts = coder.decode(np.asarray(part.flatten(), np.int64), ends)
                out += [t if ok else None for t, ok in zip(texts, part.is_valid().to_pylist())]
            return pa.array(out, pa.string())

        return make

    return with_arrow(coded, [ids], out, "string", start)
