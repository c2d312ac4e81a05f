import random

import pytest
import sentencepiece as sp
from pyspark.sql import functions as F

from lumenfield.llm import pieces
from lumenfield.llm.queries import PIECES, op9_pieces


def texts(seed):
    rng = random.Random(seed)
    atoms = ["the", " ", "  ", "▁", "\n", "\t", "é", "😀", "ing", "Hello", "1", "日本", "ß", "\x00", "zz", "   " * 6, "tion", "·", "é", "<s>", "<0x41>"]
    out = ["", " ", "a", "▁", "word " * 500, "x" * 300, "ab" * 5000, "é" * 200, " " * 100, "\n\n\n"]
    return out + ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model file with its kind set to unigram and its ranks as log probabilities: the library then runs Viterbi."""
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    data, i, out = open(PIECES, "rb").read(), 0, b""
    v = pieces.Vocabulary.load(PIECES)
    import struct

    for p, t, k in zip(v.pieces, v.types, range(len(v.pieces))):
        own = p.encode()
        body = b"\x0a" + varint(len(own)) + own + b"\x15" + struct.pack("<f", -6 - (k * 7919 % 1000) / 100) + b"\x18" + varint(int(t))
        out += b"\x0a" + varint(len(body)) + body
    spec = b"\x18\x01" + b"\x98\x02\x01"  # model_type unigram, byte fallback (field 35)
    out += b"\x12" + varint(len(spec)) + spec
    norm = b"\x0a\x08identity\x18\x01\x20\x00\x28\x01"
    out += b"\x1a" + varint(len(norm)) + norm
    path = tmp_path_factory.mktemp("m") / "u.model"
    path.write_bytes(out)
    return str(path)


def split(ids, ends):
    return [ids[i:j].tolist() for i, j in zip([0, *ends], ends)]


def test_merges_equal_the_library():
    own, lib, some = pieces.Coder(pieces.Vocabulary.load(PIECES)), sp.SentencePieceProcessor(model_file=PIECES), texts(1)
    ids, ends = own.encode(some)
    assert split(ids, ends) == lib.encode(some)
    assert own.decode(ids, ends) == [t.replace("▁", " ") for t in some]


def test_viterbi_equals_the_library_on_a_unigram_model(unigram):
    v = pieces.Vocabulary.load(unigram)
    assert v.kind == pieces.UNIGRAM
    own, lib, some = pieces.Coder(v), sp.SentencePieceProcessor(model_file=unigram), texts(2)
    ids, ends = own.encode(some)
    score = lambda x: sum(v.scores[i] for i in x)
    for t, a, b in zip(some, split(ids, ends), lib.encode(some)):
        assert a == b or abs(score(a) - score(b)) < 1e-4 * max(1, len(t)), t  # equal sums may be cut in another way
    assert own.decode(ids, ends) == [t.replace("▁", " ") for t in some]


def test_viterbi_is_not_the_bpe_encoding():
    v = pieces.Vocabulary.load(PIECES)
    own = pieces.Coder(v)
    words = sorted({w for t in texts(3) for w in own.words(t) if 2 < len(w) < 20})
    differ = sum(own.viterbi([w]) != own.merges([w]) for w in words)
    assert differ > 0


def test_operator_on_odd_rows(docs):
    rows = [None, "", "a b", "a b", "▁x", "y" * 200000]
    df = docs(enumerate(rows)).withColumn("ids", F.lit("old"))
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(df, PIECES), PIECES).collect()}
    assert got[0].ids is None and got[0].decoded is None and got[1].ids == [] and got[1].decoded == ""
    assert got[2].ids == got[3].ids and got[4].decoded == " x" and got[5].decoded == rows[5]
    assert pieces.encode(df.limit(0), PIECES).count() == 0
    both = {r.doc_id: r for r in pieces.encode_checked(df, PIECES).collect()}
    assert {i: r.ids for i, r in both.items()} == {i: r.ids for i, r in got.items()} and {i for i, r in both.items() if not r.round_trip} == {4}  # its U+2581 became a space
    assert pieces.encode_checked(df.limit(0), PIECES).count() == 0


def test_query_equals_the_library(spark, small):
    lib = sp.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op9_pieces(spark, small).collect()
    assert len(rows) == len(docs) and all(r.round_trip and r.n_pieces == len(lib.encode(docs[r.doc_id])) for r in rows)
