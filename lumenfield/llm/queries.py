"""The opN_ queries of this package and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, crc_text, shared_path, table
from .conversations import repair_report
from .decontaminate import decontaminate, items_digest
from .html_text import extract_text
from .language_model import score_texts
from .neighbours import nearest
from .ngram_join import link_documents
from .pieces import encode_checked
from .pii import count_kind, find_spans, span_text
from .quality import score, train
from .sharding import balanced_tree, grown, inner_nodes, shard_rows
from .spelling import group_variants, word_counts
from .topk import sparse_rows, top_k
from .warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15: two regions of two racks of four shards."""
    rows = shard_rows(table(spark, sf_dir, "documents"), balanced_tree(2, 2, 4))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_TREES = [(n.name, c.name, c.weight, c.shard, k) for k, tree in enumerate((balanced_tree(2, 2, 4), grown(balanced_tree(2, 2, 4)))) for n in inner_nodes(tree) for c in n.children]
_STEP = lambda i: f"""l{i} AS (SELECT doc_id, grown, arg_min(child, -ln((('0x' || substr(md5(k || '|' || child), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496) / weight) AS node, k FROM l{i - 1} JOIN tree USING (grown) WHERE parent = node GROUP BY doc_id, k, grown)"""
ORACLES["op6_sharding"] = f"""
WITH {CRC_TABLE_SQL},
tree(parent, child, weight, shard, grown) AS (VALUES {", ".join(f"('{p}', '{c}', {w}, {'NULL' if s is None else s}::INTEGER, {k})" for p, c, w, s, k in _TREES)}),
l0 AS (SELECT doc_id, grown, 'root' AS node, coalesce(doc_id::VARCHAR, 'null') AS k FROM (SELECT DISTINCT doc_id FROM documents), (SELECT DISTINCT grown FROM tree)),
{_STEP(1)}, {_STEP(2)}, {_STEP(3)},
pl AS (SELECT doc_id, max(shard) FILTER (grown = 0) AS shard, max(shard) FILTER (grown = 1) AS grown_shard, ('0x' || substr(md5(any_value(k)), 1, 8))::BIGINT AS h FROM l3 JOIN tree USING (grown) WHERE child = node GROUP BY 1),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, ({crc_sql("coalesce(text, '')")})::BIGINT AS text_crc32 FROM documents, crc_table)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, d.doc_id NULLS FIRST, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM d JOIN pl ON d.doc_id IS NOT DISTINCT FROM pl.doc_id
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts by base kind, a digest of the base spans, and all spans."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["rank"] < 4)
    return found.select(
        "doc_id",
        *(count_kind(spans, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.aggregate(spans, F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"),
    )


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of ten-word benchmark windows in all documents."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=False)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that all documents come near to, one word of a window being changed or a few moved."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("near_items").cast("long").alias("n_near"), items_digest(F.col("near_items")).alias("near_sha256"), (F.size("near_items") > 0).alias("near"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_text("doc_id") % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back from them."""
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:([0-9-]+)>$", 1).try_cast("long")
    return read_warc(spark, path, strict=True).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM f
"""


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest, by inner product, of every vector whose id is divisible by 20, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLES["op3_neighbours"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return link_documents(table(spark, sf_dir, "documents"))


#: The vocabulary file that op9 and the pipeline use; a path that the driver can open.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: how many pieces, a hash of their ids, and whether the text came back."""
    coded = encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


@query
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    held_out = F.coalesce(crc_text("doc_id") % 7 == 2, F.lit(False))
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out, sampled_parent=True)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_ngram_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
c AS (SELECT i, min(j) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.i = d.doc_id
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[k : k + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM i WHERE len(w) > 0)),
ln AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, w[k : k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS k FROM d, ln)),
h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every vector whose id is divisible by 50 with all others."""
    found = top_k(sparse_rows(table(spark, sf_dir, "embeddings")), F.col("key") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), "score")


ORACLES["op11_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.i <> c.i WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one run in 97 misspelt, with the forms that they are variants of."""
    counts = word_counts(table(spark, sf_dir, "documents"), damage=97, least=5)
    return group_variants(counts.where("n >= 3"))


ORACLES["op12_spelling"] = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
o AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
c AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM o GROUP BY ALL),
h AS (SELECT r, n, ({crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || r")})::BIGINT AS h FROM c, crc_table),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN w b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN w b ON a.x = b.word),
b AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'o': other}}) AS best FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.o END AS form, CASE WHEN -best.m >= 2 * w.n THEN -best.m END::BIGINT AS form_n FROM w LEFT JOIN b USING (word)),
t(word, led) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.led WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.led AS root, f.n, f.n_near, f.form_n FROM f JOIN t e USING (word) JOIN f l ON l.word = e.led AND l.form IS NULL
"""


def damaged_turns(convs: DataFrame) -> DataFrame:
    """conversations with faults planted by the CRC-32 of conv_id:turn: turns dropped, emptied, without stops, twice, or of another role."""
    space = F.lit(" ")
    fault = F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20
    said = F.coalesce("text", space)
    rows = convs.withColumn("_fault", fault).where("_fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(said, ".!?", "")).otherwise(said).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged: their faults and their cheapest repair."""
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(convs, damaged_turns(convs))


_LAST = "regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1)"

ORACLES["op13_conversations"] = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, (({crc_sql("k")})::BIGINT % 20)::INT AS h FROM c, crc_table),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0)),
n AS (
  SELECT *, row_number() OVER w AS i,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '?' END AS x,
    CASE WHEN substr(lag(role) OVER w, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS odd
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
k AS (SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS seen FROM n),
g AS (SELECT *, CASE WHEN {_LAST} = '' THEN 'b' WHEN seen THEN 'd' WHEN {_LAST} NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM k),
run(st, now, runs, ins) AS (VALUES
  ('-', '-', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''),
  ('-', 'u', 'I', 'user:' || chr(10)), ('s', 'u', 'I', 'user:' || chr(10)), ('u', 'a', 'I', 'assistant:' || chr(10)), ('a', 'u', 'I', 'user:' || chr(10)),
  ('-', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('u', 'u', 'II', 'assistant:' || chr(10) || 'user:' || chr(10)), ('a', 'a', 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
a AS (
  SELECT g.conv_id, g.i, run.st, now AS nx, 3 * length(runs) + 4 AS price, runs || 'D' AS code, ins AS line FROM g, run
  UNION ALL SELECT g.conv_id, g.i, run.st, CASE now WHEN 'u' THEN 'a' ELSE 'u' END, 3 * length(runs) + 3 + (CASE fault WHEN 't' THEN 3 ELSE 0 END), runs || 'R', ins || CASE now WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text || chr(10) FROM g, run WHERE fault IN ('', 't')
  UNION ALL SELECT g.conv_id, g.i, run.st, x, 3 * length(runs) + (CASE fault WHEN 't' THEN 3 ELSE 0 END), runs || 'K', ins || role || ':' || text || chr(10) FROM g, run
  WHERE fault IN ('', 't') AND ((x = 's' AND now = '-') OR (x = 'u' AND now IN ('-', 's', 'a')) OR (x = 'a' AND now = 'u'))),
z AS (SELECT conv_id, max(i) AS n FROM g GROUP BY 1),
r AS (
  SELECT conv_id, 0::BIGINT AS i, '-' AS st, 0 AS cost, '' AS audit, '' AS told FROM z
  UNION ALL
  SELECT conv_id, i, st, w.c, w.a, w.t FROM (
    SELECT r.conv_id, a.i, a.nx AS st, min({{'c': r.cost + a.price, 'a': r.audit || a.code, 't': r.told || a.line}}) AS w
    FROM r JOIN a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.i = r.i + 1 AND a.st = r.st GROUP BY 1, 2, 3)),
e AS (
  SELECT r.conv_id, min({{'c': cost + 3 * length(runs), 'a': audit || runs, 't': told || ins}}) AS w FROM r JOIN z ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.n JOIN run ON run.st = r.st
  WHERE now IN ('-', 'a') GROUP BY 1),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    sum(CASE WHEN i > 1 THEN odd ELSE 0 END)::BIGINT AS illegal FROM g GROUP BY 1)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.w.c, 0)::BIGINT AS cost, coalesce(e.w.a, '') AS audit, sha256(coalesce(substr(e.w.t, 1, length(e.w.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id
"""
