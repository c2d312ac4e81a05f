"""WARC archives: written by Spark's text sink, read back by verifying the chain of record boundaries.

A payload may hold the magic that starts a record, so a reader can't trust the magic. Archives are read as text that the
magic parts, so the splits of one file go to many tasks. A task lists the candidates of its split (the magic, after an
empty line) with the place where each one's record would end, which is its successor's place, and finds by pointer jumping
where the chain from each one leaves the split. Those exits, few for each split, are joined and jump on from the start
of the file, what is reached doubling with each round, until every split has its entry; then a split's candidates
that the entry reaches are records and the others aren't. Only narrow rows are joined; a record that holds the magic, and so is in pieces,
has its pieces read again and put together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: An archive file has at most so many records.
FILE_RECORDS = 20_000

CRLF = "\r\n"
MAGIC = b"WARC/1."
_GAP = b"\r\n\r\n"
_VERSION = re.compile(rb"[01]\r\n")
_FIELD = {k: re.compile(rb"(?im)^" + k.encode() + rb":[ \t]*+([^\r\n]*+)\r?$") for k in ("Content-Length", "WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To", "WARC-Payload-Digest")}
_HTTP_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*([0-9]+)")
#: Base 32 as conv() writes it, and as RFC 4648 does.
_CONV32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string: four runs of 40 bits, eight digits each."""
    runs = [F.lpad(F.conv(F.substring(F.sha1(value), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*runs)), _CONV32, _RFC32)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """key, record (the text of a WARC record less its last line end) of every page.

    Among equal payloads of at least min_bytes bytes, those with the smallest key are responses and the others revisits
    of it; smaller payloads are all responses. Null html is an empty payload; a null key comes after all others and is
    written as "null"; repeated rows get a record each; a null url gives no target line. Payloads move only where the
    revisits are more than Spark broadcasts (spark.sql.autoBroadcastJoinThreshold); the result is the same.
    """
    value = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_id"), F.col(url).alias("_url"), value.alias("_html"))
    own = own.withColumn("_digest", sha1_base32(F.col("_html"))).withColumn("_bytes", F.octet_length("_html"))
    narrow = own.where(F.col("_bytes") >= min_bytes).select("_key", "_id", "_digest")
    first = narrow.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    revisits = narrow.join(first, "_digest").where(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_key")))
    revisits = stored(revisits.groupBy("_id", "_digest").agg(F.first("_first").alias("_first")), "revisits")
    joined = own.join(revisits, ["_id", "_digest"], "left")
    again = F.col("_first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda title, c: F.concat(F.lit(f"{title}: "), c, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("_html")))
    record = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("_url", r"[\r\n]+", "%0A")), F.lit("")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("_first"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(CRLF),
    )
    return joined.select(F.col("_key").alias(key), record.alias("record"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip", **columns: object) -> None:
    """Archives of all pages under path (new), one file a task or more; see records()."""
    records(pages, **columns).select("record").write.option("maxRecordsPerFile", FILE_RECORDS).text(path, lineSep=CRLF, compression=compression)


def jumped(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate goes on beyond the candidates at ``at`` (ascending): the first end on it that none of
    them has as its place. Each pointer is replaced by its pointer's pointer until none leads to a candidate."""
    n = len(at)
    if not n:
        return ends
    where = np.searchsorted(at, ends)
    inside = (where < n) & (at[np.minimum(where, n - 1)] == ends) & (ends != at)
    jump = np.where(inside, where, np.arange(n))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return ends[jump]


def on_chain(at: np.ndarray, ends: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates are reached from the one at ``entry``."""
    n = len(at)
    where = np.searchsorted(at, ends)
    jump = np.where((where < n) & (at[np.minimum(where, max(n - 1, 0))] == ends), where, n) if n else where
    jump, reached = np.append(jump, n), np.append(at == entry, False)
    for _ in range(int(n).bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


_FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, intact boolean, payload binary"
_PIECES = "file string, block long, at long, ends long, leaves long, first boolean, body long, whole boolean, " + _FIELDS
#: Of a split: its bytes, whether it ends with an empty line, its first bytes to the first empty line, and the candidate whose header goes on after it.
_SPLITS = "bytes long, closed boolean, head binary, open_at long, open_head binary, size long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in schema.split(", "))])


def _read(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, piece): what stands before, between and after the magic, in order within a split of a file."""
    m = F.col("_metadata")
    text = spark.read.text(path, lineSep=MAGIC.decode())
    return text.select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("piece"))


def _header(head: bytes) -> tuple[int, dict]:
    """(stated length of the block, or -1; fields) of a header, the magic left out."""

    def get(field: str) -> str | None:
        m = _FIELD[field].search(head + b"\r\n")
        return m[1].rstrip(b" \t").decode("utf-8", "replace") if m else None

    length = get("Content-Length") or ""
    n = int(length) if length.isdecimal() and length.isascii() and len(length) < 19 else -1
    kind, stated = get("WARC-Type"), (get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None
    return n, {"record_id": get("WARC-Record-ID"), "record_type": kind, "target_uri": get("WARC-Target-URI"), "refers_to": get("WARC-Refers-To"), "payload_digest": stated}


def _content(fields: dict, block: bytes, payload: bool) -> dict:
    """The fields that follow from a record's block."""
    head, gap, rest = block.partition(_GAP)
    http = head.startswith(b"HTTP/")
    data, stated = rest if http and gap else block, fields["payload_digest"]
    if fields["record_type"] == "revisit":
        m = _HTTP_LENGTH.search(head) if http else None
        digest, size = stated, int(m[1]) if m else None
    else:
        digest, size = base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data)
    return fields | {"payload_digest": digest, "payload_bytes": size, "intact": stated is None or stated == digest, "payload": data if payload else None}


def _scan(payload: bool):  # noqa: ANN202
    """The candidates of each split, and a row (at is null) for the split itself. Places count from where the split's first
    piece has its magic."""
    schema = _arrow(_PIECES + ", " + _SPLITS)

    def split(name: str, block: int, size: int, pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        at, closed, opened = 0, None, None  # closed: the piece before ends with an empty line; None: it isn't known
        head, in_head = [], True
        for k, piece in enumerate(pieces):
            if in_head:
                i = piece.find(_GAP)
                head.append(MAGIC + (piece if i < 0 else piece[: i + 4]))
                in_head = i < 0
            if opened is None:
                starts = (closed is not False or (block == 0 and k == 1 and at == len(MAGIC))) and not (block == 0 and k == 0)
                if starts and _VERSION.match(piece):
                    opened = (at, k == 0, [])
            if opened is not None:
                i = piece.find(_GAP)
                opened[2].append(piece if i < 0 else piece[:i])
                if i >= 0:
                    text = MAGIC.join(opened[2])
                    n, fields = _header(text)
                    body = opened[0] + len(MAGIC) + len(text) + 4
                    row = {"at": opened[0], "first": opened[1], "body": body, "ends": body + n + 4 if n >= 0 else -1, "whole": False} | fields
                    if n >= 0 and len(opened[2]) == 1 and i + 4 + n + 4 == len(piece) and piece.endswith(_GAP):
                        row |= {"whole": True} | _content(fields, piece[i + 4 : -4], payload)
                    rows.append(row)
                    opened = None
            closed = piece.endswith(_GAP)
            at += len(MAGIC) + len(piece)
        if opened is not None:
            rows.append({"at": opened[0], "first": opened[1], "ends": opened[0], "whole": False})
        places, ends = np.array([r["at"] for r in rows], np.int64), np.array([r["ends"] for r in rows], np.int64)
        for row, leaves in zip(rows, jumped(places, ends).tolist()):
            row |= {"file": name, "block": block, "leaves": leaves}
        rest = MAGIC.join(opened[2]) if opened is not None else None
        rows.append({"file": name, "block": block, "bytes": at, "closed": bool(closed), "head": b"".join(head), "open_at": opened[0] if opened is not None else None, "open_head": rest, "size": size})
        for a in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_pylist(rows[a : a + 2000], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*k, p) for b in batches for *k, p in zip(*(c.to_pylist() for c in b.columns)))
        now = next(rows, None)
        while now is not None:
            key = now[:3]

            def own() -> Iterator[bytes]:
                nonlocal now
                while now is not None and now[:3] == key:
                    yield now[3]
                    now = next(rows, None)

            yield from split(*key, own())

    return scan


def _continued(t: pa.Table) -> pa.Table:
    """Of one file: the candidates whose header goes on in the next splits, with their headers read to the end."""
    t = t.sort_by("block")
    out = []
    heads = t["head"].to_pylist()
    for k, (block, at, text) in enumerate(zip(t["block"].to_pylist(), t["open_at"].to_pylist(), t["open_head"].to_pylist())):
        for more in heads[k + 1 :] if at is not None else ():
            text += more
            if text.endswith(_GAP):
                n, fields = _header(text[:-4])
                body = at + len(MAGIC) + len(text)
                out.append({"file": t["file"][0].as_py(), "block": block, "at": at, "ends": body + n + 4 if n >= 0 else -1, "body": body} | fields)
                break
    return pa.Table.from_pylist(out, schema=_arrow(_OPEN))


_OPEN = "file string, block long, at long, ends long, body long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string"


def _entered(candidates: pa.Table, entries: pa.Table) -> pa.Table:
    """Of one split: the candidates that its entry reaches."""
    c = candidates.sort_by("at")
    at, ends = c["at"].to_numpy(), c["ends"].to_numpy()
    kept = np.zeros(len(at), bool)
    for entry in entries["entry"].to_pylist():
        kept |= on_chain(at, ends, entry)
    some = at[kept]
    return pa.table({"file": pa.array([c["file"][0].as_py() if len(at) else None] * len(some), pa.string()), "block": pa.array([c["block"][0].as_py() if len(at) else None] * len(some), pa.int64()), "at": pa.array(some, pa.int64())})


def read_warc(spark: SparkSession, path: str, payload: bool = False, strict: bool = False) -> DataFrame:
    """A row for each record on its file's chain; with payload, its bytes too.

    Archives may be plain, or compressed as whole files. payload_digest is the one computed from a response's payload, and a
    revisit's stated one; intact: the two agree. payload_bytes is that of the full payload (for a revisit, as its HTTP
    header states). chain_whole is false for all records of a file that breaks off: those before the break are returned,
    or with strict the call fails. An empty file has no records. The candidates are found, and the chain is
    followed, when this is called.
    """
    found = stored(_read(spark, path).mapInArrow(_scan(payload), _PIECES + ", " + _SPLITS), "candidates")
    order = Window.partitionBy("file").orderBy("block")
    splits = found.where("at is null").select("file", "block", "bytes", "closed", "size", (F.sum("bytes").over(order) - F.col("bytes") - len(MAGIC)).alias("base"), F.lag("closed").over(order).alias("before"))
    splits = stored(splits, "splits")  # a row for each split of the input
    rows = found.where("at is not null").drop(*(x.split()[0] for x in _SPLITS.split(", ")))
    cut = found.where("at is null").select("file", "block", "head", "open_at", "open_head")
    files = cut.where("open_at is not null").select("file").distinct()
    more = cut.join(files, "file", "left_semi").groupBy("file").applyInArrow(_continued, _OPEN)
    more = more.select("*", F.col("ends").alias("leaves"), F.lit(False).alias("whole"))
    rows = rows.where("body is not null").unionByName(more, allowMissingColumns=True)
    rows = rows.join(splits.select("file", "block", "base", "before"), ["file", "block"]).where(~F.coalesce("first", F.lit(False)) | F.coalesce("before", F.lit(False)))
    rows = rows.drop("first", "before")

    # exits: the places where some split's chain goes on, and the starts of files; few for each split
    place = lambda c: F.when(F.col(c) >= 0, F.col("base") + F.col(c)).otherwise(-1)
    steps = rows.select("file", "block", "at", place("at").alias("from"), place("leaves").alias("to"))
    exits = steps.select("file", F.col("to").alias("from")).union(splits.select("file", F.lit(0).cast("long"))).distinct()
    jump = stored(steps.join(exits, ["file", "from"]).select("file", "from", "to", F.col("block").alias("in_block"), F.col("at").alias("entry"), (F.col("from") == 0).alias("reached")), "exits")
    most = splits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(int(most - 1).bit_length()):
        on = jump.select("file", F.col("from").alias("to"), F.col("to").alias("further"))
        seen = jump.where("reached").select("file", F.col("to").alias("from"), F.lit(True).alias("_hit")).distinct()
        jump = jump.join(seen, ["file", "from"], "left").join(on, ["file", "to"], "left")
        jump = stored(jump.select("file", "from", F.coalesce("further", "to").alias("to"), "in_block", "entry", (F.col("reached") | F.coalesce("_hit", F.lit(False))).alias("reached")), "exits")
    entries = jump.where("reached").select("file", F.col("in_block").alias("block"), "entry")
    kept = rows.select("file", "block", "at", "ends").groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(_entered, "file string, block long, at long")
    kept = rows.select("file", "block", "at", "base", "ends").join(kept, ["file", "block", "at"]).where("ends >= 0")
    kept = stored(kept.select("file", "block", "at", place("at").alias("offset"), place("ends").alias("stop")), "kept")

    total = splits.groupBy("file").agg(F.sum("bytes").alias("n"), F.max("size").alias("size"), F.max_by("closed", "block").alias("closed"))
    plain = ~F.lower("file").rlike(r"\.(gz|bz2|zst|lz4|deflate|snappy)$")
    last = kept.groupBy("file").agg(F.max("stop").alias("last"), F.count(F.lit(1)).alias("n_records"))
    end = F.col("n") - len(MAGIC)
    ok = F.coalesce((F.col("last") == end) & F.col("closed") & (~plain | (end == F.col("size"))), F.lit(False))
    whole = stored(total.join(last, "file", "left").select("file", ok.alias("chain_whole"), F.coalesce("n_records", F.lit(0)).alias("n_records")), "files")
    if strict and (bad := whole.where("not chain_whole").first()):
        raise ValueError(f"{bad.file}: the chain of records breaks off after {bad.n_records} records")
    good = rows.join(kept, ["file", "block", "at"]).join(whole.drop("n_records"), "file")
    out = ["file", "offset", "stop", "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "intact", "chain_whole", *(["payload"] if payload else [])]
    broken = good.where("not whole")
    if broken.select("at").isEmpty():
        return good.select(out)
    return good.where("whole").select(out).unionByName(_together(spark, path, broken, splits, payload).select(out))


def _together(spark: SparkSession, path: str, broken: DataFrame, splits: DataFrame, payload: bool) -> DataFrame:
    """The records that are in several pieces, from the pieces that they touch."""
    spans = broken.select("file", (F.col("base") + F.col("body")).alias("body"), "offset", "stop", "record_id", "record_type", "target_uri", "refers_to", "payload_digest", "chain_whole")
    near = splits.select("file", "block", "base", "bytes")
    touched = spans.join(near, "file").where((F.col("base") < F.col("stop")) & (F.col("base") + F.col("bytes") > F.col("body"))).select("file", "block", "base", "offset", "body", "stop")

    kinds = "file string, block long, at long, piece binary"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for b in batches:
            names, blocks, pieces = (b.column(i).to_pylist() for i in (0, 1, 3))
            places = []
            for own, piece in zip(zip(names, blocks), pieces):
                key, at = (own, 0) if own != key else (key, at)
                places.append(at)
                at += len(MAGIC) + len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((names, pa.string()), (blocks, pa.int64()), (places, pa.int64()), ([MAGIC + x for x in pieces], pa.binary()))], schema=_arrow(kinds))

    pieces = _read(spark, path).mapInArrow(placed, kinds)
    parts = pieces.join(touched, ["file", "block"]).withColumn("from", F.col("base") + F.col("at"))
    parts = parts.where((F.col("from") < F.col("stop")) & (F.col("from") + F.octet_length("piece") > F.col("body")))

    def join(t: pa.Table, s: pa.Table) -> pa.Table:
        t, fields = t.sort_by("from"), s.to_pylist()[0]
        content, low = b"".join(t["piece"].to_pylist()), t["from"][0].as_py() if t.num_rows else 0
        block = content[fields["body"] - low : fields["stop"] - 4 - low]
        if content[fields["stop"] - 4 - low : fields["stop"] - low] != _GAP:
            return pa.Table.from_pylist([], schema=_arrow(schema))  # it doesn't end where it says
        full = _content({k: fields[k] for k in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")}, block, payload)
        row = {k: fields[k] for k in ("file", "offset", "stop", "chain_whole")} | full
        return pa.Table.from_pylist([row], schema=_arrow(schema))

    schema = "file string, offset long, stop long, chain_whole boolean, " + _FIELDS
    parts = parts.select(F.col("file").alias("name"), F.col("offset").alias("record"), "from", "piece")
    return parts.groupBy("name", "record").cogroup(spans.groupBy("file", "offset")).applyInArrow(join, schema)
