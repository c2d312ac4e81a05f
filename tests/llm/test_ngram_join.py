import random

import pytest

from lumenfield.llm import ngram_join as nj
from lumenfield.llm.queries import op1_ngram_join


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x1c", "\x01").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    index = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, s) in enumerate(sets):
        for o in {o for x in s for o in index[x] if o > k}:
            both = len(s & sets[o][1])
            if 100 * both >= 80 * (len(s) + len(sets[o][1]) - both):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "the", "The"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 200]))) for _ in range(40)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = ["", None, " \t\n", "a b", "A  B", "a b c", "x " * 3000, "x " * 3001]
    for _ in range(500):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(rng.choice([" ", "\n", "\t "]).join(w) + rng.choice(["", "", f" {passage}", " tail words here"]))
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "tile"), [(1, 2000), (2, 5)])
def test_against_brute_force(docs, monkeypatch, seed, tile):
    monkeypatch.setattr(nj, "TILE", tile)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_documents(docs(rows)).collect()}
    assert got == brute(rows)


def test_chain_of_near_copies_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 7)
    words = [f"k{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 90])) for i in range(60)]  # each like the next ones only
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_documents(docs(rows)).collect()}
    assert got == brute(rows)


def test_one_of_each_and_odd_tables(docs):
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (9, "other"), (7, ""), (8, None), (9, "other"), (None, "other"), (None, None)]
    kept = nj.one_of_each(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 7, 8, 9] and len(kept) == 6 and "n_chars" in kept[0].asDict()
    assert nj.link_documents(docs(rows).limit(0)).count() == 0
    assert nj.link_documents(docs([(1, None), (2, "")])).count() == 2


def test_hot_shingles_and_two_steps_of_dealing(docs, monkeypatch, spark):
    """Shingles that half of the documents hold go by class, and buckets are dealt to in two steps; links are the same."""
    monkeypatch.setattr(nj, "FEW", 5)
    monkeypatch.setattr(nj, "OFTEN", 1e-3)
    monkeypatch.setattr(nj, "CHUNK", 4000)
    monkeypatch.setattr(nj, "FAN", 2)
    monkeypatch.setattr(nj, "BUCKET_BYTES", 1 << 10)
    rows = corpus(5) + [(1000 + i, "one licence line that very many of the documents hold " * 3 + f" own{i} words{i}" * 2) for i in range(200)]
    df = docs(rows)
    assert len(nj.hot_shingles(nj.document_classes(df, "doc_id", "text"))) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_documents(df).collect()}
    assert got == brute(rows)


def test_rows_that_share_a_key_but_not_a_component(docs):
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "quite another text with six words"), (1, "quite another text with six words"), (2, "alpha beta gamma delta epsilon"), (3, ""), (3, "x y")]
    kept = sorted((r.doc_id, r.text) for r in nj.one_of_each(docs(rows)).collect())
    assert kept == [(1, "alpha beta gamma delta epsilon"), (1, "quite another text with six words"), (3, ""), (3, "x y")]
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    kept = nj.one_of_each(docs([(5, near), (5, near + " 10"), (5, "far away words")])).collect()
    assert sorted(len(r.text) for r in kept) in ([14, len(near)], [14, len(near) + 3])


def test_frequent_keys_keep_their_minimum(spark, monkeypatch):
    from lumenfield.llm import components as c

    monkeypatch.setattr(c, "OFTEN", 10)
    df = spark.range(1000).selectExpr("case when id % 3 = 0 then 0 else id end as k", "1000 - id as v")
    got = {(r.k, r.v): r.low for r in c.with_least(df, "k", "v", "low", 1000).collect()}
    assert len(got) == 1000 and all(low == (1 if k == 0 else v) for (k, v), low in got.items())


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_ngram_join(spark, small).collect()}
    assert got == brute(rows) and any(i != c for i, (_, c) in got.items())
