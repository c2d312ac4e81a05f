"""Benchmark decontamination by a stored positional inverted index of the documents.

1. Every task turns its documents into segments of about SEGMENT_WORDS words and writes each one's postings to the shared
   folder: the hashes of its terms, and for each term the places where it stands. All words of all texts are indexed,
   whatever the benchmark is; the index is spread over the documents, so no term is a hot key and no posting moves.
2. Windows of the test texts come in blocks of at most BLOCK_WORDS words. A block is broadcast, asked of every segment of the
   index, and dropped before the next. In a segment a window is looked up from its rarest term on: the
   places of each term, less its offset in the window, are intersected list by list, the shortest first, until all terms
   have been met (exact phrases) or the rarest few within a slack (proximity; rarity is that in the whole index).
3. What the blocks found is put together by document, narrow rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, text_runs, trim

WINDOW = 10
SEGMENT_WORDS = 1_000_000
BLOCK_WORDS = 500_000
#: Proximity: so many of a window's rarest terms, one more being allowed to miss, each at most so many words from its place.
NEAR_TERMS, NEAR_SLACK = 3, 3

#: A-Z become a-z; ASCII that is neither a letter nor a digit parts words; all other bytes belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Block:
    """Windows of some test items: the sorted hashes of their terms, a row of term numbers for each distinct window, the items of each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        known = {w: xxhash.xxh3_64_intdigest(w) for _, words in items for w in words}
        self.terms = np.unique(np.array(list(known.values()), np.uint64))
        number = {w: int(np.searchsorted(self.terms, np.uint64(h))) for w, h in known.items()}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = [str(i) for i, _ in items]
        for at, (_, words) in enumerate(items):
            ids = [number[w] for w in words]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(at)
        self.by_length: list[tuple[int, np.ndarray, list[list[int]]]] = []
        for n in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == n]
            self.by_length.append((n, np.array(own, np.int64).reshape(-1, n), [sorted(found[w]) for w in own]))

    def postings(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of each of the block's terms, one after the other; where each one's begin) in a segment of the index."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(len(terms) - 1, 0))
        here = terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), bool)
        length = np.where(here, counts[at], 0) if len(terms) else np.zeros(len(self.terms), np.int64)
        first = np.concatenate([[0], np.cumsum(length)])
        begin = np.cumsum(counts) - counts
        own = np.repeat(begin[at] if len(terms) else length, length) + np.arange(first[-1]) - np.repeat(first[:-1], length)
        return places[own], first

    def search(self, places: np.ndarray, first: np.ndarray, size: int, ends: np.ndarray, common: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]]:
        """For each window length: (length, window and place of the exact matches, windows and documents of near ones).

        places, first: postings(); size: one more than the last place; ends: the places after each
        document's end mark; common: how often each term is in all documents (None: no near matches). A near match is
        NEAR_TERMS of a window's NEAR_TERMS + 1 rarest terms (of a shorter window: all terms) in one document, each
        within NEAR_SLACK of its place as the rarest one that is met has it.
        """
        length = np.diff(first)
        keys = np.repeat(np.arange(len(self.terms)), length) * size + places  # by term, then place
        for n, windows, items in self.by_length:
            counts = length[windows]
            by_rarity = np.argsort(counts, axis=1, kind="stable")
            near = self._near(n, windows, keys, first, size, ends, common) if common is not None else np.zeros((2, 0), np.int64)
            live = np.flatnonzero(counts.min(axis=1) > 0)
            rarest = windows[live, by_rarity[live, 0]]
            reps = length[rarest]
            w = np.repeat(live, reps)
            inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            start = keys[np.repeat(first[rarest], reps) + inside] % size - by_rarity[w, 0]
            for k in range(1, n):
                offset = by_rarity[w, k]
                wanted = windows[w, offset] * size + start + offset
                at = np.searchsorted(keys, wanted)
                met = (start >= 0) & (start + n < size) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)
                w, start = w[met], start[met]
            yield n, w, start, near, items

    def _near(self, n: int, windows: np.ndarray, keys: np.ndarray, first: np.ndarray, size: int, ends: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Windows and documents of the near matches of windows of n terms."""
        of = min(NEAR_TERMS + 1, n)
        need = min(NEAR_TERMS, n)
        rank = np.argsort(common[windows], axis=1, kind="stable")[:, :of]
        begins = np.concatenate([[0], ends[:-1]])
        found = []
        for a in range(of - need + 1):  # the rarest term that is met; those before it miss
            anchor = windows[np.arange(len(windows)), rank[:, a]]
            reps = first[anchor + 1] - first[anchor]
            w = np.repeat(np.arange(len(windows)), reps)
            inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            place = keys[np.repeat(first[anchor], reps) + inside] % size
            doc = np.searchsorted(ends, place, side="right")
            start, missed = place - rank[w, a], np.full(len(w), a)
            for k in range(a + 1, of):
                term, around = windows[w, rank[w, k]] * size, start + rank[w, k]
                low = np.searchsorted(keys, term + np.maximum(around - NEAR_SLACK, begins[doc]))
                high = np.searchsorted(keys, term + np.minimum(around + NEAR_SLACK, ends[doc] - 1), side="right")
                missed = missed + (high <= low)
                on = missed <= of - need
                w, doc, start, missed = w[on], doc[on], start[on], missed[on]
            found.append(np.unique(np.stack([w, doc]), axis=1))
        return np.concatenate(found, axis=1)


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Block]:
    """Blocks of at most BLOCK_WORDS words (an item that has more is cut into runs that share window - 1 words)."""
    held: list[tuple[object, list[bytes]]] = []
    total = 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = words_of(row[1])
        step = max(BLOCK_WORDS - window + 1, 1)
        for k in range(0, max(1, len(words) - window + 1), step):
            part = words[k : k + step + window - 1]
            if total + len(part) > BLOCK_WORDS and held:
                yield Block(held, window)
                held, total = [], 0
            held.append((row[0], part))
            total += len(part)
    yield Block(held, window)


def index_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row for each segment. keys, ids, n_words: of its documents, an id being a hash of the text; terms: their
    sorted hashes; counts: how many places each has; places: by term and then place, each as the step from the one before.
    A document's words stand one after the other, and an empty place ends it."""
    kind = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([("keys", pa.list_(kind)), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def segment(keys: list, ids: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(t) for t in tokens], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *tokens])
        order = np.argsort(h, kind="stable")
        place = (np.arange(len(h)) + np.repeat(np.arange(len(n)), n))[order]
        h = h[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        step = np.diff(place, prepend=0)
        step[edge] = place[edge]
        counts = np.diff(np.append(edge, len(h)))
        return pa.RecordBatch.from_pydict({"keys": [keys], "ids": [ids], "n_words": [n.tolist()], "terms": [h[edge].tobytes()], "counts": [counts.astype(np.uint32).tobytes()], "places": [step.astype(np.uint32).tobytes()]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, tokens, size = [], [], [], 0
        for b in batches:
            at = 0
            for texts in text_runs(b.column(2).to_pylist()):
                words = [words_of(t) for t in texts]
                flat = [w for x in words for w in x]
                known = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
                h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
                keys += b.column(0).slice(at, len(texts)).to_pylist()
                ids += b.column(1).slice(at, len(texts)).to_pylist()
                tokens += np.split(h, np.cumsum([len(x) for x in words])[:-1])
                at += len(texts)
                size += len(flat)
                if size >= SEGMENT_WORDS:
                    yield segment(keys, ids, tokens)
                    keys, ids, tokens, size = [], [], [], 0
        if keys:
            yield segment(keys, ids, tokens)
        keys, ids, tokens = [], [], []
        trim()

    name = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), _text_id(text).alias("id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, f"keys array<{name}>, ids array<long>, n_words array<long>, terms binary, counts binary, places binary"), "index")


def _text_id(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _counted(index: DataFrame, block: Broadcast) -> np.ndarray:
    """How often each term of a block is in the index: a number for each term comes to the driver, which made the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.value.terms), np.int64)
        for b in batches:
            for terms, counts in zip(*(c.to_pylist() for c in b.columns)):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)
                both, mine, own = np.intersect1d(block.value.terms, terms, assume_unique=True, return_indices=True)
                total[mine] += counts[own]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(len(block.value.terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


def _asked(index: DataFrame, block: Broadcast, common: np.ndarray | None, kind: str) -> DataFrame:
    """(key, id, runs, items, near_items) of the documents that the windows of a block are found in; runs: of hit words, [from, to)."""
    schema = f"key {kind}, id long, runs array<struct<a:long,b:long>>, items array<string>, near_items array<string>"
    keys = index.schema["keys"].dataType.elementType
    arrow = pa.schema([("key", to_arrow_type(keys)), ("id", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def answer(own: Block, keys: list, ids: list, n_words: list, terms: bytes, counts: bytes, places: bytes) -> pa.RecordBatch:
        n = np.array(n_words, np.int64)
        ends = np.cumsum(n + 1)
        starts = ends - n - 1
        size = int(ends[-1]) + 1
        counts, step = np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(places, np.uint32).astype(np.int64)
        begin = np.cumsum(counts) - counts
        total = np.cumsum(step)
        before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], 0) if len(begin) else begin
        where, first = own.postings(np.frombuffer(terms, np.uint64), counts, total - np.repeat(before, counts))
        cover = np.zeros(size + 1, np.int32)
        exact: dict[int, set[int]] = {}
        close: dict[int, set[int]] = {}
        for length, w, start, met, items in own.search(where, first, size, ends, common):
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            for out, at, docs in ((exact, w, np.searchsorted(ends, start, side="right")), (close, *met)):
                for x, d in set(zip(at.tolist(), docs.tolist())):
                    out.setdefault(d, set()).update(items[x])
        hit = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
        up, down = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        runs: dict[int, list[dict]] = {}
        for d, a, b in zip(np.searchsorted(ends, up, side="right").tolist(), up.tolist(), down.tolist()):
            runs.setdefault(d, []).append({"a": a - int(starts[d]), "b": b - int(starts[d])})
        some = sorted(exact.keys() | close.keys())
        names = lambda found, d: sorted(own.items[i] for i in found.get(d, ()))
        return pa.RecordBatch.from_pylist([{"key": keys[d], "id": ids[d], "runs": runs.get(d, []), "items": names(exact, d), "near_items": names(close, d)} for d in some], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                if row[0]:
                    yield answer(block.value, *row)

    return index.mapInArrow(run, schema)


def find_windows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, near: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index of docs, hits): key, id, n_hit, items and near_items of the documents that any window is found in; see decontaminate()."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    index = index_texts(docs, key, text)
    found = None
    for own in _blocks(benchmark, item, text, window):
        block = spark.sparkContext.broadcast(own)  # of at most BLOCK_WORDS words
        hits = stored(_asked(index, block, _counted(index, block) if near else None, kind), "hits")
        found = hits if found is None else found.union(hits)
        block.unpersist()
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    # runs of one block are apart; those of several blocks may overlap
    count = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("runs"))),
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, r: F.struct(F.greatest(acc["to"], r["b"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["to"], r["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return index, found.groupBy("key", "id").agg(count.alias("n_hit"), every("items"), every("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, near: bool = True) -> DataFrame:
    """Per row of docs: key, n_words, n_hit, items (sorted ids of items with an exact window), near_items (proximity;
    empty without near).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. n_hit
    counts the document words inside any exact occurrence. Null and empty texts have no words and no hits; repeated rows
    are answered one by one; repeated items have the same id; an empty benchmark hits nothing; columns other than key
    and text are ignored.
    """
    index, hits = find_windows(docs, benchmark, key, text, item, window, near)
    rows = index.select(F.explode(F.arrays_zip("keys", "ids", "n_words")).alias("d")).select(F.col("d.keys").alias("k"), F.col("d.ids").alias("i"), F.col("d.n_words").alias("n_words"))
    none = F.array().cast("array<string>")
    out = rows.join(hits, F.col("k").eqNullSafe(F.col("key")) & (F.col("i") == F.col("id")), "left")
    return out.select(F.col("k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def without_windows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window, with all their columns, whatever the names of those are."""
    _, hits = find_windows(docs, benchmark, key, text, item, window, near=False)
    hit = hits.where("n_hit > 0").select(F.col("key").alias("_hit_key"), F.col("id").alias("_hit_id"))
    return docs.join(hit, F.col(key).eqNullSafe(F.col("_hit_key")) & (_text_id(text) == F.col("_hit_id")), "left_anti")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)

