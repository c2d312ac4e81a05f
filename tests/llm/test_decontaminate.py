import hashlib
import random
from collections import Counter

import pytest

from lumenfield.llm import decontaminate as d
from lumenfield.llm.queries import op5_decontaminate, op5_proximity


def brute(texts, items, window=d.WINDOW):
    """(n_words, n_hit, items) by trying every place."""
    out = []
    for t in texts:
        words, hit, met = d.words_of(t), set(), set()
        for i, it in items:
            own = d.words_of(it)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                w = own[k : k + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        met.add(str(i))
        out.append((len(words), len(hit), sorted(met)))
    return out


@pytest.mark.parametrize("block", [500_000, 30])
def test_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    monkeypatch.setattr(d, "SEGMENT_WORDS", 200)
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé", "e1", "F"]
    say = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 14]))) for i in range(12)] + [(3, say(12)), (90, None), (91, ""), (92, "a"), (93, "Zz " * 45)]
    texts = ["", None, "!!", "a", "zz " * 30, "x " * 5000]
    texts += [" ".join(rng.choice([say(4), items[rng.randrange(13)][1], "q"]) for _ in range(rng.randint(1, 8))) for _ in range(120)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as n_hit")
    got = {r.doc_id: r for r in d.decontaminate(docs(enumerate(texts)), bench).collect()}
    for i, want in enumerate(brute(texts, items)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want, texts[i]
        assert set(got[i]["items"]) <= set(got[i].near_items)


def test_proximity_finds_a_window_with_a_changed_common_word(spark, docs):
    item = "the cat zebra the quagga the the okapi the the"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = d.decontaminate(docs([(1, item.replace("cat", "dog") + " the" * 30 + " dog" * 20 + " cat cat")]), bench).first()
    assert r.n_hit == 0 and r.near_items == ["1"]


def test_proximity_finds_a_window_with_any_word_replaced(spark, docs):
    words = [f"w{k}" for k in range(10)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(10)] + ["w8 other", "w0 other w9 w4", " ".join(words)]
    for parts in (1, 5):  # what else is in a batch changes nothing
        got = {r.doc_id: r for r in d.decontaminate(docs(enumerate(texts)).repartition(parts), bench).collect()}
        assert [got[k].near_items for k in range(len(texts))] == [["1"]] * 10 + [[], [], ["1"]]
        assert [got[k].n_hit for k in range(len(texts))] == [0] * 12 + [10]


def test_proximity_stays_inside_a_document(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = d.decontaminate(docs([(1, "a b"), (2, "c d"), (3, "e f")]).coalesce(1), bench).collect()
    assert [r.near_items for r in got] == [[], [], []]


def test_proximity_query(spark, small):
    exact = {r.doc_id: r.n_items for r in op5_decontaminate(spark, small).collect()}
    near = {r.doc_id: r.n_near for r in op5_proximity(spark, small).collect()}
    assert exact.keys() == near.keys() and any(near.values()) and all(near[k] >= n for k, n in exact.items())


def brute_near(texts, items, near=3, slack=3):
    """Of each text the items that it comes near to, window by window and place by place."""
    words = [d.words_of(t) for t in texts]
    common = Counter(w for ws in words for w in ws)
    windows = {}
    for i, t in items:
        own = d.words_of(t)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[k : k + 10]), set()).add(str(i))
    ranked = []
    for win, ids in windows.items():
        rank = sorted(range(len(win)), key=lambda o: (common[win[o]], o))[: near + 1]
        ranked.append((win, rank, min(near, len(win)), ids))
    out = []
    for ws in words:
        places = {}
        for p, w in enumerate(ws):
            places.setdefault(w, []).append(p)
        met = set()
        for win, rank, need, ids in ranked:
            spare = len(rank) - need
            for a in range(spare + 1):
                for p in places.get(win[rank[a]], ()):
                    start = p - rank[a]
                    missed = a + sum(not any(abs(q - start - o) <= slack for q in places.get(win[o], ())) for o in rank[a + 1 :])
                    if missed <= spare:
                        met |= ids
        out.append(sorted(met))
    return out


@pytest.mark.parametrize("segment", [40, 1_000_000])
def test_proximity_against_brute_force(spark, docs, monkeypatch, segment):
    monkeypatch.setattr(d, "SEGMENT_WORDS", segment)
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(60)]
    say = lambda n: [vocab[min(int(rng.expovariate(0.08)), 59)] for _ in range(n)]
    items = [(i, say(rng.choice([2, 3, 5, 10, 13]))) for i in range(15)]
    texts = []
    for _ in range(80):
        own = say(rng.randint(0, 25))
        if rng.random() < 0.7:  # an item with words changed, moved or left out
            seen = list(items[rng.randrange(15)][1])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(seen))
                seen[at : at + rng.randint(0, 1)] = say(rng.randint(0, 3))
                seen = seen or ["w0"]
            own = own + seen + say(rng.randint(0, 9))
        texts.append(" ".join(own))
    items = [(i, " ".join(ws)) for i, ws in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.near_items for r in d.decontaminate(docs(enumerate(texts)), bench).collect()}
    want = brute_near(texts, items)
    assert any(want) and not all(want)
    assert [got[i] for i in range(len(texts))] == want


def test_proximity_query_against_brute_force(spark, small):
    rows = {r.doc_id: r for r in op5_proximity(spark, small).collect()}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for (i, _), met in zip(texts, brute_near([t for _, t in texts], items)):
        assert (rows[i].n_near, rows[i].near, rows[i].near_sha256) == (len(met), bool(met), hashlib.sha256(",".join(met).encode()).hexdigest())


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs([(1, "a b")]), none).first().n_words == 2
    assert d.decontaminate(docs([(1, "a b")]).limit(0), none).count() == 0


def test_query(spark, small):
    rows = op5_decontaminate(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = [r for r in rows if r.contaminated]
    assert hit and len(rows) == len(texts)
    ids = [r.doc_id for r in hit][:10] + [r.doc_id for r in rows if not r.contaminated][:10]
    by = {r.doc_id: r for r in rows}
    for i, (n, h, met) in zip(ids, brute([texts[i] for i in ids], items)):
        assert (by[i].n_words, by[i].n_hit, by[i].n_items, by[i].items_sha256) == (n, h, len(met), hashlib.sha256(",".join(met).encode()).hexdigest())
