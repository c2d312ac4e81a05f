import base64
import gzip
import hashlib
import random
import time

import numpy as np
import pytest

from lumenfield.llm import warc
from lumenfield.llm.queries import op8_warc

FAKE = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n tail"


def b32(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(5, "u", "same"), (3, None, "same"), (9, "u\r\nWARC-Type: x", "same"), (4, "u", FAKE), (6, "u", None), (7, "u", ""), (8, "é", "é😀\r\n\r\nWARC/1.0\r\n"), (10, "u", "\r\n\r\n"), (11, "u", "y" * 300000), (12, "u", FAKE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record", "2 as _first")
    path = str(tmp_path / "w")
    warc.write_warc(df.coalesce(1), path)
    got = {r.record_id: r for r in warc.read_warc(spark, path, payload=True).collect()}
    assert len(got) == len(rows)
    smallest = {"same": 3, FAKE: 4, "": 6}
    for i, _, html in rows:
        r, t = got[f"<urn:page:{i}>"], html or ""
        first = smallest.get(t, i)
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(t.encode()), b32(t), "response" if first == i else "revisit")
        assert r.refers_to == (None if first == i else f"<urn:page:{first}>")
        assert r.intact and r.chain_whole and (first != i or r.payload == t.encode())


def test_repeated_rows_nulls_and_empty(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, "a"), (None, "b"), (None, "b")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "r"))
    got = sorted((str(r.record_id), r.record_type) for r in warc.read_warc(spark, str(tmp_path / "r")).collect())
    assert got == sorted([("<urn:page:1>", "response")] * 2 + [("<urn:page:2>", "revisit"), ("<urn:page:null>", "revisit")] + [("<urn:page:null>", "response")] * 2)
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    warc.write_warc(df, str(tmp_path / "m"), min_bytes=2)
    assert {r.record_type for r in warc.read_warc(spark, str(tmp_path / "m")).collect()} == {"response"}


def rec(b, head=b""):
    return b"WARC/1.0\r\n%bContent-Length: %d\r\n\r\n%b\r\n\r\n" % (head, len(b), b)


def walked(content):
    """Offsets of the records of a file, one after the other."""
    at, out = 0, []
    while content[at : at + 7] == b"WARC/1.":
        head = content.find(b"\r\n\r\n", at)
        if head < 0:
            break
        n = int(content[at:head].split(b"Content-Length: ")[1].split(b"\r\n")[0])
        if content[head + 4 + n : head + 8 + n] != b"\r\n\r\n":
            break
        out.append((at, n))
        at = head + 8 + n
    return out, at == len(content)


@pytest.mark.parametrize("split", [3000, 1 << 20])
def test_splits_of_a_file_against_walking(spark, tmp_path, split):
    """Many tasks for one file: magic in payloads and headers, records that are longer than splits, headers over split edges."""
    rng = random.Random(split)
    bodies = [b"a", FAKE.encode(), b"", rec(b"in"), b"WARC/1.0\r\n", rec(rec(b"deep")), b"\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n", b"\xff\xfe\r\n\r\n", rec(b"x" * 500) * 3]
    content = b"".join(rec(rng.choice(bodies) * rng.choice([1, 1, 2]), rng.choice([b"", b"X: WARC/1.0 WARC/1.0 WARC/1.1\r\n", b"Y: " + b"WARC/1." * 40 + b"\r\n"])) for _ in range(60))
    (tmp_path / "a.warc").write_bytes(content)
    (tmp_path / "b.warc").write_bytes(rec(b"one"))
    (tmp_path / "c.warc").write_bytes(content[:-9])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(content))
    (tmp_path / "e.warc").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = warc.read_warc(spark, str(tmp_path), payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, data in (("a.warc", content), ("b.warc", rec(b"one")), ("c.warc", content[:-9]), ("d.warc.gz", content)):
        want, whole = walked(data)
        own = sorted((r.offset, r.stop, r.payload_bytes, r.chain_whole, r.payload_digest) for r in got if r.file.endswith(name))
        assert [o[0] for o in own] == [at for at, _ in want] and {o[3] for o in own} == {whole}
        for (at, stop, _, _, _), (_, n) in zip(own, want):
            assert data[stop - 4 : stop] == b"\r\n\r\n" and stop - at > n
    text = {r.offset: r.payload for r in got if r.file.endswith("a.warc")}
    for at, n in walked(content)[0]:
        block = content[content.index(b"\r\n\r\n", at) + 4 :][:n]
        assert text[at] == (block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block)


def test_pointers_jump():
    at, ends = np.array([0, 5, 9, 20]), np.array([5, 9, 31, 20])
    assert warc.jumped(at, ends).tolist() == [31, 31, 31, 20]
    assert warc.on_chain(at, ends, 0).tolist() == [True, True, True, False] and warc.on_chain(at, ends, 9).tolist() == [False, False, True, False]
    assert warc.jumped(at[:0], ends[:0]).tolist() == [] and warc.on_chain(at[:0], ends[:0], 0).tolist() == []
    n = np.arange(100_000)
    assert (warc.jumped(n, n + 1) == 100_000).all() and warc.on_chain(n, n + 1, 0).all()


def test_urls_of_any_length(spark, tmp_path):
    urls = {1: "u", 2: "http://x/" + "é" * 400_000, 3: "http://x/" + "WARC/1.0\r\n" * 30_000 + "WARC/1.0", 4: "u" + " " * 300_000 + "v", 5: None}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    warc.write_warc(df.coalesce(1), str(tmp_path / "u"))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "u"), payload=True, strict=True).collect()}
    assert len(got) == len(urls)
    for i, u in urls.items():
        r = got[f"<urn:page:{i}>"]
        assert r.target_uri == (u and u.replace("\r\n", "%0A")) and r.payload == f"page {i}".encode() and r.chain_whole


def test_broken_chains_are_refused_if_strict(spark, tmp_path):
    one = rec(b"a")
    for k, content in enumerate((one * 3 + one[:-3], b"x" + one, one[:-1], one + b"WARC/1.")):
        (tmp_path / f"{k}.warc").write_bytes(content)
        path = str(tmp_path / f"{k}.warc")
        assert warc.read_warc(spark, path).count() == (3, 0, 0, 1)[k]
        with pytest.raises(Exception, match="chain of records breaks off"):
            warc.read_warc(spark, path, strict=True).collect()


def test_many_candidates_cost_time_in_proportion(spark, tmp_path):
    began = time.time()
    for k, content in enumerate((b"WARC/1.0\r\nContent-Length: 1\r\n" * 100_000 + b"\r\n", b"WARC/1.0\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n", b"WARC/1.0\r\nContent-Length: 99999999\r\n\r\n\r\n\r\n" * 20_000)):
        (tmp_path / f"{k}.warc").write_bytes(content)
        assert warc.read_warc(spark, str(tmp_path / f"{k}.warc")).count() == 0
    assert time.time() - began < 90


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_query_with_revisits_by_either_join(spark, tmp_path, most):
    """Equal payloads in many rows; the revisits are broadcast or not."""
    rows = [(i, f"u{i}", f"page {i % 7} é" if i % 2 else "hot") for i in range(400)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op8_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = {}
    for i, _, t in rows:
        first.setdefault(t, i)
    assert got == {i: (len(t.encode()), b32(t), "response" if first[t] == i else "revisit", None if first[t] == i else first[t]) for i, _, t in rows}
