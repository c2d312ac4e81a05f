import sentencepiece as sp

import corpus_pipeline as cp
from test_decontaminate import brute as hits
from test_ngram_join import brute as components
from test_pii import brute as personal

from lumenfield.llm.queries import PIECES


def test_stages_against_brute_force(spark, small):
    raw = spark.read.parquet(f"{small}/documents.parquet")
    docs, seen = raw, []
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = cp.stored(stage(spark, docs, small), f"t-{name}")
        seen.append((name, before, docs.collect()))
        if name != "pieces":
            assert docs.columns == raw.columns
    by = {name: ({r.doc_id: r for r in a}, {r.doc_id: r for r in b}) for name, a, b in seen}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    a, b = by["quality"]
    good = [i for i, q in labels.items() if q]
    assert 0 < len(b) < len(a) and sum(i in b for i in good) >= 0.97 * len(good)

    a, b = by["near_duplicates"]
    assert sorted(b) == sorted({c for _, c in components([(i, r.text) for i, r in a.items()]).values()})

    a, b = by["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert set(b) == {i for i, (_, n, _) in zip(a, hits([r.text for r in a.values()], items)) if not n}

    a, b = by["personal_data"]
    assert set(a) == set(b)
    for i, r in a.items():
        assert personal(b[i].text) == [] and b[i].n_chars == len(b[i].text)
        if not personal(r.text) and "[" not in b[i].text:
            assert r.text == b[i].text

    a, b = by["pieces"]
    lib = sp.SentencePieceProcessor(model_file=PIECES)
    assert set(a) == set(b) and all(r.round_trip and r.ids == lib.encode(r.text) and r.n_pieces == len(r.ids) for r in b.values())


def test_run_on_empty_documents(spark, small, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copyfile(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_and_odd_rows(spark, small, tmp_path):
    """Extra columns named like the stages' own, nulls, repeated rows, and two texts under one doc_id."""
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copyfile(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    names = ["score", "_score", "spans", "_m0", "n_hit", "items", "id", "key", "ids", "round_trip", "cls", "_cls", "_set", "often", "rank"]
    raw = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7_000_001, None, "en", None, 0), (7_000_002, "", None, "s", 0), (7_000_003, "one text of its own " * 9, "en", "s", 1), (7_000_003, "another text under that number " * 9, "en", "s", 1), (None, "a text without a number " * 9, "en", "s", 1)], raw.schema)
    raw.union(raw.limit(5)).union(odd).selectExpr("*", *(f"'{n}' as {n}" for n in names)).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES:
        before, docs = docs, cp.stored(stage(spark, docs, str(tmp_path)), f"o-{name}")
        if name != "pieces":
            assert docs.columns == before.columns and {n for r in docs.select(names).distinct().collect() for n in r} == set(names)
        if name == "near_duplicates":
            left = {(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()}
            kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
            assert len(kept) == len(set(kept)) and {k for k in left if k[0] == 7_000_003} == {k for k in kept if k[0] == 7_000_003}
    assert len(set(docs.columns)) == len(docs.columns) and {"ids", "n_pieces", "round_trip"} <= set(docs.columns)
