import random
import zlib
from collections import Counter

import pytest

from lumenfield.llm import spelling as sl


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words, ratio=2):
    out = []
    form = {}
    for w, n in words.items():
        other = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(other, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out.append([w, form[w], None, n, len(other), -best[0] if form[w] else None])
    for r in out:
        at = r[0]
        while form[at]:
            at = form[at]
        r[2] = at
    return sorted(map(tuple, out))


def brute_counts(rows, damage, least):
    total = Counter()
    for i, t in rows:
        for run in sl.WORD.findall(t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return dict(total)


def groups(spark, words, **more):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(tuple(r) for r in sl.group_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    letters = "abeÀéÿz"  # few letters: every kind of edit, and equal masks
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(700)}
    for w in list(words)[:80]:  # planted edits at the first, middle and last letter
        for at in (0, len(w) // 2, len(w) - 1):
            words.setdefault(w[:at] + w[at + 1 :] or "q", rng.randint(1, 3))
            words.setdefault(w[:at] + "z" + w[at:], rng.randint(1, 3))
            words.setdefault(w[:at] + "é" + w[at + 1 :], rng.randint(1, 3))
    assert groups(spark, words) == brute_groups(words)


def test_very_many_words_of_one_half(spark):
    words = {"pre" * 4 + a + b: 1 + (a == b) * 5 for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"}
    assert groups(spark, words) == brute_groups(words)


def test_chains_and_ties(spark):
    words = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "caaaa": 2, "aaaaaz": 1}
    got = {r[0]: r for r in groups(spark, words)}
    assert got["aaaaa"][1:3] == ("aaaab", "bbbbb") and got["aaaaa"][4] == 3
    assert groups(spark, words) == brute_groups(words)


def test_empty(spark):
    assert groups(spark, {}) == [] and groups(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]


@pytest.mark.parametrize("damage", [0, 3])
def test_counts_of_odd_texts(spark, docs, monkeypatch, damage):
    monkeypatch.setattr(sl, "PIECE", 1000)
    monkeypatch.setattr(sl, "HELD", 5)
    rows = [(1, "Straße STRASSE strasse, l'été ÉTÉ Été"), (2, None), (3, ""), (None, "Hello hello a1b2"), (4, "x" * 5000), (5, "wörd " * 30_000), (5, "wörd again"), (6, "日本語 ελληνικά İstanbul ÿÿÿÿÿ"), (7, "A-b_c d\x00e")]
    got = {r.word: r.n for r in sl.word_counts(docs(rows), damage, 2).collect()}
    assert got == brute_counts(rows, damage, 2)
    assert sl.word_counts(docs([])).count() == 0


def test_query_on_small_texts(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["Letters", "lettres", "letters", "better", "bettter", "sample", "samples"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    words = {w: n for w, n in brute_counts(rows, 97, 5).items() if n >= 3}
    counts = sl.word_counts(docs(rows), 97, 5).where("n >= 3")
    assert sorted(tuple(r) for r in sl.group_variants(counts).select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute_groups(words)


def test_keys_of_words_are_not_broadcast(spark, monkeypatch):
    """A word has a dozen keys and more, which Spark doesn't count: what looks small may be a gigabyte in the driver."""
    seen = []
    monkeypatch.setattr(sl, "stored", lambda df, name, kept=sl.stored: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        words = spark.createDataFrame([("hallo", 9), ("halo", 3), ("hallos", 4)], "word string, n long")
        assert sl.group_variants(words).count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert any("Generate" in p for p in seen) and not any("BroadcastExchange" in p for p in seen)
