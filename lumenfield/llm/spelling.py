"""Spelling variants: words at one edit's distance, found by bands of their letters' parities.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. An inserted or deleted letter flips
one bit, a replaced one two. The letters are dealt to three bands of even entropy, so at least one band of two near words is
equal. Words meet if a band is equal and their lengths differ by at most one; an edit also leaves one half of a word as it was, and
that half is part of the key, so a band that very many words share isn't a large group. What meets is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_runs, trim, with_arrow

#: Letters of a word: A to Z in either case, and U+00C0 to U+00FF.
WORD = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
BANDS = 3
#: Distinct words that a counting task holds before it hands them on; characters of a text that are looked at at once.
HELD, PIECE = 500_000, 4_000_000


def lowered(run: str) -> str:
    """run with A-Z, and no other letter, lower-cased."""
    return run.lower() if run.isascii() else run.translate(LOWER)


def runs_of(text: str) -> Counter[str]:
    """How often each lower-cased run of letters occurs in a text."""
    seen: Counter[str] = Counter()
    if len(text) <= PIECE:
        seen.update(WORD.findall(text))
    else:  # no list of all runs of a very long text
        seen.update(m.group() for m in WORD.finditer(text))
    out: Counter[str] = Counter()
    for run, n in seen.items():
        out[lowered(run)] += n
    return out


def misspelt(run: str, start: int, every: int) -> str:
    """run without one of its letters, if ``every`` divides its CRC-32 (begun at ``start``)."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, damage: int = 0, least: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters, of at least ``least`` letters, of all texts. A null text has none.

    With damage, every run whose CRC-32 (of ``key:run``) it divides loses a letter, as a typist would; a null key is empty text.
    Counts are summed in each task, HELD words at a time, before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            at = 0
            for texts in text_runs(b.column(1).to_pylist()):
                for doc, t in zip(b.column(0).slice(at, len(texts)).to_pylist(), texts):
                    start = zlib.crc32(f"{doc}:".encode() if doc is not None else b":")
                    for run, n in runs_of(t or "").items():
                        word = misspelt(run, start, damage) if damage else run
                        if len(word) >= least:
                            held[word] += n
                at += len(texts)
                if len(held) >= HELD:
                    yield handed()
                    held.clear()
        yield handed()
        held.clear()
        trim()

    pieces = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(count, "word string, n long")
    return pieces.groupBy("word").agg(F.sum("n").alias("n"))


def letter_bits(words: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each word: the parities of LETTERS; other characters are counted as no letter."""
    spelt = words.to_pylist()
    codes = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
    at = np.full(0x110000, -1, np.int16)
    at[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    row, letter = np.repeat(np.arange(len(spelt)), [len(s) for s in spelt]), at[codes]
    bits = np.zeros((len(spelt), len(LETTERS)), np.uint8)
    np.bitwise_xor.at(bits, (row[letter >= 0], letter[letter >= 0]), 1)
    return bits


def deal_letters(words: DataFrame) -> list[list[int]]:
    """Letters of each band, so that the entropies of the bands' bits are near equal: letters by falling entropy, each to the
    band that has least, of those with room: a band has a third of the letters. The driver gets one count for each letter."""

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(LETTERS), np.int64), 0
        for b in batches:
            total += letter_bits(b.column(0)).sum(axis=0, dtype=np.int64)
            rows += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(len(LETTERS))), pa.array(total), pa.array([rows] * len(LETTERS))], names=["letter", "ones", "rows"])

    found = words.select("word").mapInArrow(ones, "letter long, ones long, rows long").groupBy("letter").agg(F.sum("ones").alias("ones"), F.sum("rows").alias("rows")).collect()
    share = np.zeros(len(LETTERS))
    for r in found:
        share[r.letter] = r.ones / max(r.rows, 1)
    p = np.clip(share, 1e-12, 1 - 1e-12)
    entropy = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
    bands: list[list[int]] = [[] for _ in range(BANDS)]
    load = [0.0] * BANDS
    for i in np.argsort(-entropy, kind="stable").tolist():
        b = min((j for j in range(BANDS) if len(bands[j]) * BANDS < len(LETTERS)), key=lambda j: load[j])
        bands[b].append(i)
        load[b] += float(entropy[i])
    return bands


def with_masks(words: DataFrame, bands: list[list[int]]) -> DataFrame:
    """words with ``mask``: an array of the bands' masks."""

    def start():
        weight = np.zeros((len(LETTERS), BANDS), np.int64)
        for b, letters in enumerate(bands):
            weight[letters, b] = 1 << np.arange(len(letters), dtype=np.int64)

        def masks(word: pa.Array) -> pa.Array:
            values = letter_bits(word).astype(np.int64) @ weight
            return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, BANDS, dtype=np.int32)), pa.array(values.ravel()))

        return masks

    return with_arrow(words, ["word"], "mask", "array<long>", start)


def _halves(size: Column) -> Column:
    """(kind, text): the first and the last ``size`` letters of the word."""
    # the lengths are of text that begins at 1: substring(word, length - size + 1, size) is the last size letters
    return F.array(F.struct(F.lit(0).alias("half"), F.substring("word", F.lit(1), size).alias("kept")), F.struct(F.lit(1).alias("half"), F.substring("word", F.length("word") - size + 1, size).alias("kept")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words (word, n; distinct words) that differ by exactly one inserted, deleted or replaced letter, once.

    The shorter word of a pair, or of equal lengths the first in code-point order, is a. A row's keys are its bands, each with
    either half: of length L, the first or last L div 2 letters, L being the shorter word's length. So a word of length M has keys for
    L = M and, as the longer word, for L = M - 1. A pair counts at the first band and half that are equal, and so only once.
    """
    masked = with_masks(words, deal_letters(words))
    band = F.posexplode("mask").alias("band", "value")

    def keyed(df: DataFrame, shorter: Column, p: str) -> DataFrame:
        rows = df.withColumn("_len", shorter).withColumn("_h", F.explode(_halves(F.floor(F.col("_len") / 2).cast("int"))))
        rows = rows.select("word", "n", "mask", "_len", "_h.half", "_h.kept", band)
        return rows.select(F.xxhash64("_len", "half", "kept", "band", "value").alias("key"), *(F.col(c).alias(p + c) for c in ("word", "n", "mask", "half", "band")))

    size = F.length("word")
    left = keyed(masked, size, "a_")
    right = keyed(masked, F.explode(F.array(size, size - 1)), "b_")
    flips = sum(F.bit_count(F.col("a_mask")[i].bitwiseXOR(F.col("b_mask")[i])) for i in range(BANDS))
    longer = F.length("b_word") - F.length("a_word")
    apart = [F.col("a_mask")[i] != F.col("b_mask")[i] for i in range(BANDS)]
    first_band = F.when(~apart[0], 0).when(~apart[1], 1).otherwise(2)
    half = F.floor(F.length("a_word") / 2).cast("int")
    first_half = F.when(F.substring("a_word", F.lit(1), half) == F.substring("b_word", F.lit(1), half), 0).otherwise(1)
    meets = (
        (F.col("a_half") == F.col("b_half")) & (F.col("a_band") == F.col("b_band"))
        & (((longer == 0) & (flips <= 2) & (F.col("a_word") < F.col("b_word"))) | ((longer == 1) & (flips <= 1)))
        & (F.col("a_band") == first_band) & (F.col("a_half") == first_half)
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    # a word has many keys, which Spark doesn't count: neither side may be broadcast
    pairs = left.alias("l").hint("merge").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & meets)
    return pairs.select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form; one form a word, without cycles): the last form that is reached.

    Each round doubles how far a word has followed, so a chain of c forms takes about log2 c rounds; forms at least double
    their counts, so c is under 64. Rounds are written to the shared folder.
    """
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        step = now.hint("merge").join(on, now["root"] == on["_w"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        step = stored(step, "roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        now = step.select("word", "root")


def group_variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    n_near: how many words are near. form: the near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``ratio`` (over 1) times the word's n, else null, with its n as form_n. root: the word that forms lead to, word itself without a form. No words, no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.m")).alias("m"))
    enough = F.col("m") >= F.lit(ratio) * F.col("n")
    found = words.hint("merge").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("m")).alias("form_n"))
    found = stored(found, "variants")
    led = roots(found.where("form IS NOT NULL"))
    return found.hint("merge").join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
