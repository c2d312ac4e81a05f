"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

1. Every document's set is made of hashes of WIDTH words; equal sets are one class from here on.
2. Shingles travel once, as packed blocks of 48-bit hashes, to the bucket of their upper bits, where each is met with all
   classes that hold it. A shingle of one class alone can't be shared, so only the others go on. A class with too few
   of them has no partner and is done, which is where most of an ordinary corpus stays. Shingles that make up more than
   OFTEN of all (counted by parts while the classes are made) aren't met in a bucket, where they would be a hot key: they are
   known to be shared, rank as the most frequent of all, and go straight to their classes.
3. With shingles in the order of their frequency, two linked classes share one among the first n - ceil(0.8 n) + 1 of
   each (the rest is too short to make up the overlap). Classes that share such a shingle are put together as groups.
4. A group is cut into tiles by bands of set size, each 1.25 times the last, since linked sizes are within 0.8 of each
   other; a tile holds a band and the next. Each class gets a hashed bitmap as wide as its band needs. For two sets
   every bit that only one has stands for a shingle that only one has, so bit counts bound the overlap from above; a pair whose
   bound is large enough is settled by intersecting the sorted arrays. A class that has been linked isn't compared
   with others of its component again, so a tile of copies costs as many comparisons as it has classes.
5. A tile of more than TILE classes is dealt over blocks. Blocks are linked inside, then their components' leaders are,
   and then each block meets the classes of other blocks that are in another component than the tile's largest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free_name, mixed, partitions_for, stored, text_runs, trim, with_arrow
from .components import connected, with_least

WIDTH = 5
#: Linked: SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (80, 100)
TILE = 2000
BUCKET_BYTES = 10 << 20
CHUNK = 1_000_000
#: A hot shingle has this share of all shingles, so there are at most 1 / OFTEN of them. FEW: fewer occurrences aren't hot.
OFTEN, FEW = 2e-5, 500
#: Buckets that a chunk is dealt to at once; beyond, it is dealt to groups of buckets first.
FAN = 8192
#: Characters of text whose shingles are made at once (a longer text is taken whole).
SLICE = 1_000_000
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words = [(t or "").encode().lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    first = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        last = max(0, len(h) - width + 1)
        total = np.zeros(last, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(h[k : k + last])
        total = mixed(total)
    out = []
    for i, m in enumerate(n.tolist()):
        at = int(first[i])
        if m >= width:
            out.append(np.unique(total[at : at + m - width + 1]))
        elif m:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=m)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """A set's number, the same for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The bucket, below parts, that the upper 32 bits say."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def document_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, cls, often) of every row; cls is null for an empty set. Rows with a value of ``often`` are of no
    document: cls is a shingle that is frequent in some chunk of a task, and often how frequent."""
    kind = docs.schema[key].dataType.simpleString()

    def frequent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        found, n = found[n >= max(2, int(OFTEN * CHUNK))], n[n >= max(2, int(OFTEN * CHUNK))]
        if len(found):
            none = pa.nulls(len(found))
            yield pa.RecordBatch.from_arrays([none.cast(arrow[0].type), none.cast(pa.int64()), pa.array(found.view(np.int64)), pa.array(n)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            at = 0
            for texts in text_runs(b.column(1).to_pylist(), SLICE):
                sets = shingle_sets(texts)
                n, cls = pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)).cast(arrow[0].type), n, cls, pa.nulls(len(texts), pa.int64())], schema=arrow)
                at += len(texts)
                held += sets
                size += sum(map(len, sets))
                if size >= CHUNK:
                    yield from frequent(held)
                    held, size = [], 0
                    trim()
        if held:
            yield from frequent(held)
        held = []
        trim()

    out = f"`{key}` {kind}, n_shingles long, cls long, often long"
    arrow = to_arrow_schema(docs.select(key).withColumns({"n_shingles": F.lit(0).cast("long"), "cls": F.lit(0).cast("long"), "often": F.lit(0).cast("long")}).schema)
    return docs.select(key, text).mapInArrow(run, out)


def hot_shingles(found: DataFrame) -> np.ndarray:
    """The hot shingles of document_classes(), sorted: at most 1 / OFTEN of them, whatever the input. A copy's shingles count again, as
    they do in the packed blocks before those meet."""
    total = found.where("often is null").agg(F.sum("n_shingles")).first()[0] or 0
    n = found.where("often is not null").groupBy("cls").agg(F.sum("often").alias("n"))
    return np.sort(np.array([r.cls for r in n.where(F.col("n") > max(FEW, OFTEN * total)).select("cls").collect()], np.int64).view(np.uint64))


def _packed(docs: DataFrame, text: str, parts: int, hot: np.ndarray) -> DataFrame:
    """(bucket, classes, counts, tokens): the shingles of a chunk of distinct sets that fall into a bucket. Hot ones have buckets
    of their own, from -1 down, by class, and all their bits."""
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)  # at most 1 / OFTEN numbers

    def dealt(bucket: np.ndarray, cls: np.ndarray, owner: np.ndarray, tokens: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")  # owners stay in order within a bucket
        bucket, tokens, owner = bucket[order], tokens[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(0, int)
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own, counts = np.unique(owner[i:j], return_counts=True)
            low = tokens[i:j].view(np.uint8).reshape(-1, 8)[:, :width]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket[i]], pa.int64()), "classes": [cls[own].tobytes()], "counts": [counts.astype(np.uint32).tobytes()], "tokens": [low.tobytes()]})

    def emit(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cls, hot = np.array(list(held), np.int64), shared_hot.value
        tokens = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(cls)), [len(s) for s in held.values()])
        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)
        own, often = owner[~is_hot], tokens[~is_hot]
        yield from dealt(part_of(often, parts).astype(np.int64), cls, own, often & _LOW48, 6)
        home = part_of(cls.view(np.uint64) + np.uint64(1 << 63), parts).astype(np.int64)
        yield from dealt(-1 - home[owner[is_hot]], cls, owner[is_hot], tokens[is_hot], 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            for texts in text_runs(b.column(0).to_pylist(), SLICE):
                for s in shingle_sets(texts):
                    if len(s) and (c := class_of(s)) not in held:
                        held[c] = s
                        size += len(s)
                if size >= CHUNK:
                    yield from emit(held)
                    held, size = {}, 0
                    trim()
        if held:
            yield from emit(held)
        held = {}
        trim()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of few buckets, put together: as run() does, but from packed rows of a group of buckets."""
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        size = 0

        def put() -> Iterator[pa.RecordBatch]:
            for k, rows in held.items():
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int64())} | {n: [b"".join(r[i] for r in rows)] for i, n in enumerate(("classes", "counts", "tokens"))})

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(k, []).append(tuple(row))
                size += len(row[2])
                if size >= 16 * CHUNK:
                    yield from put()
                    held, size = {}, 0
        yield from put()

    kinds = "bucket long, classes binary, counts binary, tokens binary"
    packed = docs.select(text).mapInArrow(run, kinds)
    if parts > FAN:  # a chunk would be dealt to so many buckets that its rows hold next to nothing
        packed = packed.repartition(FAN, F.floor(F.col("bucket") / math.ceil(parts / FAN))).mapInArrow(again, kinds)
    return packed


def _trimmed(f: Callable[..., pa.Table], cogrouped: bool = False) -> Callable[..., pa.Table]:
    """f, giving freed memory back after each call: workers that have done a large group are kept for other tasks."""

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        trim()
        return out

    return two if cogrouped else one


def _shared(parts: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket: shingles that two classes or more hold, with their frequency, packed by the bucket of the class."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()])
        cls, counts = join("classes", np.int64), join("counts", np.uint32).astype(np.int64)
        width = 8 if bucket < 0 else 6
        some = join("tokens", np.uint8).reshape(-1, width)
        tokens = np.zeros((len(some), 8), np.uint8)
        tokens[:, :width] = some
        tokens = tokens.view(np.uint64).ravel()
        fresh = np.zeros(len(cls), bool)  # a class may come from several chunks
        fresh[np.unique(cls, return_index=True)[1]] = True
        keep = np.repeat(fresh, counts)
        owner, tokens = np.repeat(cls, counts)[keep], tokens[keep]
        if bucket < 0:
            df = np.full(len(owner), 0xFFFFFFFF)
        else:
            order = np.argsort(tokens, kind="stable")
            owner, tokens = owner[order], tokens[order]
            edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
            often = np.diff(edge)
            df = np.repeat(often, often)
            many = df > 1
            owner, tokens, df = owner[many], tokens[many] | (np.uint64(bucket & 0xFFFF) << np.uint64(48)), df[many]
        home = part_of(owner.view(np.uint64) + np.uint64(1 << 63), parts)
        order = np.argsort(home, kind="stable")
        home = home[order]
        at = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, int)
        cols = [x[order] for x in (owner, tokens, df.astype(np.uint32))]
        cells = [[x[i:j].tobytes() for i, j in zip(at, [*at[1:], len(home)])] for x in cols]
        return pa.table({"home": pa.array(home[at].astype(np.int32)), "classes": pa.array(cells[0], pa.binary()), "tokens": pa.array(cells[1], pa.binary()), "df": pa.array(cells[2], pa.binary())})

    return run


def _needed(n: np.ndarray) -> np.ndarray:
    """The least overlap that a set of n can be linked with."""
    return -(-n * SHARE[0] // SHARE[1])


def _survivors(heads: pa.Table, blocks: pa.Table) -> pa.Table:
    """Classes that may have a partner: their size, the first shared shingles in the order of frequency, all shared ones."""
    out: dict[str, list] = {"cls": [], "n": [], "prefix": [], "tokens": []}
    if heads.num_rows and blocks.num_rows:
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in blocks[name].to_pylist()])
        cls, tokens, df = join("classes", np.int64), join("tokens", np.uint64), join("df", np.uint32)
        sizes = dict(zip(heads["hcls"].to_pylist(), heads["n"].to_pylist()))
        order = np.lexsort((tokens, df, cls))
        cls, tokens = cls[order], tokens[order]
        edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1], [True]]))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            n, shared = sizes[int(cls[i])], j - i
            first = shared - int(_needed(np.int64(n))) + 1  # n - needed + 1, less the n - shared that are its own
            if first > 0:
                out["cls"].append(int(cls[i]))
                out["n"].append(n)
                out["prefix"].append(tokens[i : i + first].view(np.int64))
                out["tokens"].append(np.sort(tokens[i:j]).tobytes())
    return pa.table({"cls": pa.array(out["cls"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())), "tokens": pa.array(out["tokens"], pa.binary())})


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits / 64 words for each set; bits is a power of 2."""
    at = mixed(np.concatenate(sets)) & np.uint64(bits - 1)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    np.bitwise_or.at(maps, (own, (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
    return maps


def link_tile(cls: np.ndarray, n: np.ndarray, sets: list[np.ndarray], allowed: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of a tile. allowed(i, others): which of the others i may be compared with."""
    size = np.array([len(s) for s in sets])
    maps = bitmaps(sets, 1 << min(16, max(8, int(4 * size.max()).bit_length())))
    left, out = np.ones(len(cls), bool), []
    for seed in range(len(cls)):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = [seed]
        while frontier:
            i = frontier.pop()
            others = np.flatnonzero(left)
            others = others[allowed(i, others) & (n[others] * SHARE[1] >= n[i] * SHARE[0]) & (n[i] * SHARE[1] >= n[others] * SHARE[0])]
            for a in range(0, len(others), 4096):
                some = others[a : a + 4096]
                only_i = np.bitwise_count(maps[i] & ~maps[some]).sum(axis=1, dtype=np.int64)
                only_o = np.bitwise_count(maps[some] & ~maps[i]).sum(axis=1, dtype=np.int64)
                bound = np.minimum(size[i] - only_i, size[some] - only_o)
                for j in some[linked(bound, n[i], n[some])].tolist():
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if linked(both, n[i], n[j]):
                        out.append((int(cls[i]), int(cls[j])))
                        left[j] = False
                        frontier.append(j)
    return out


def linked(both, n, m):  # noqa: ANN001, ANN201
    """SHARE[1] * both >= SHARE[0] * union, of numbers or arrays."""
    return (SHARE[0] + SHARE[1]) * both >= SHARE[0] * (n + m)


def _pairs(t: pa.Table) -> pa.Table:
    """Links of one tile (grp, band and whatever else it is dealt by). role: "all" is compared with all; a "far" class
    only with others, and nothing with a class of the same known component (lab)."""
    t = t.sort_by([("n", "ascending"), ("cls", "ascending")])
    cls, n, own, band = t["cls"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy(), t["band"].to_numpy()
    far, lab = np.asarray(t["far"]), t["lab"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]

    def allowed(i: int, others: np.ndarray) -> np.ndarray:
        ok = (np.minimum(own[i], own[others]) == band[i]) & ~(far[i] & far[others])
        return ok & ((lab[i] == 0) | (lab[i] != lab[others]))

    links = link_tile(cls, n, sets, allowed)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _tile_links(tiles: DataFrame, *by: str) -> DataFrame:
    return tiles.groupBy("grp", "band", *by).applyInArrow(_trimmed(_pairs), "a long, b long")


def class_links(docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): links between classes that span every component of linked classes."""
    parts = partitions_for(docs, BUCKET_BYTES)
    shared = _packed(docs, text, parts, hot_shingles(classes)).groupBy("bucket").applyInArrow(_trimmed(_shared(parts)), "home int, classes binary, tokens binary, df binary")
    home = F.shiftrightunsigned(F.shiftrightunsigned(F.col("hcls").bitwiseXOR(F.lit(-(1 << 63))), 32) * parts, 32).cast("int")
    heads = classes.where("cls is not null and often is null").groupBy(F.col("cls").alias("hcls")).agg(F.first("n_shingles").alias("n")).withColumn("hhome", home)
    kept = stored(heads.groupBy("hhome").cogroup(shared.groupBy("home")).applyInArrow(_trimmed(_survivors, cogrouped=True), "cls long, n long, prefix array<long>, tokens binary"), "survivors")

    rare = kept.select("cls", F.explode("prefix").alias("token"))
    hubs = rare.groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub < top").select("token", "hub")
    groups = connected(rare.join(hubs, "token").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    grouped = groups.union(groups.select(F.col("comp").alias("node"), "comp").distinct()).withColumnRenamed("comp", "grp")

    own = F.floor(F.log(F.col("n").cast("double")) / math.log(SHARE[1] / SHARE[0])).cast("int")
    members = kept.select("cls", "n", "tokens").join(grouped, F.col("cls") == F.col("node")).select("grp", "cls", "n", own.alias("own"), "tokens")
    # a rounding error of the logarithm may move a size to the next band, so a tile reaches two bands up
    tiles = members.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1, F.col("own") - 2)))
    tiles = tiles.where("band >= 0").select("*", F.lit(False).alias("far"), F.lit(0).cast("long").alias("lab"))
    counts = tiles.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("size"))
    big = counts.where(F.col("size") > TILE).select("grp", "band", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    big = stored(big, "tiles")
    if big.isEmpty():
        return _tile_links(tiles)

    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int")
    dealt = stored(tiles.join(big, ["grp", "band"], "left").withColumn("block", block), "dealt")
    inside = stored(_tile_links(dealt.drop("blocks"), "block"), "links")
    return inside.union(_between(dealt.where("blocks is not null"), inside))


def _labelled(tiles: DataFrame, links: DataFrame) -> DataFrame:
    found = connected(links)
    return tiles.drop("lab").join(found, F.col("cls") == F.col("node"), "left").withColumn("lab", F.coalesce("comp", "cls")).drop("node", "comp")


def _between(dealt: DataFrame, inside: DataFrame) -> DataFrame:
    """Links between the blocks of large tiles."""
    # leaders: the smallest class of each component in each block, dealt over tasks with a few blocks each
    named = stored(_labelled(dealt, inside), "named")
    leaders = named.join(named.groupBy("grp", "band", "block", "lab").agg(F.min("cls").alias("cls")), ["grp", "band", "block", "lab", "cls"])
    few = F.floor(F.col("block") / 64).cast("int")
    upper = stored(_tile_links(leaders.withColumn("few", few).drop("blocks", "block"), "few"), "links")
    named = stored(_labelled(dealt, inside.union(upper)), "named")
    # the rest: all classes that aren't in a tile's largest component meet every other block
    sizes = named.groupBy("grp", "band", "lab").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy("grp", "band").agg(F.max_by("lab", F.struct("size", "lab")).alias("toplab"))
    named = named.join(top, ["grp", "band"])
    away = named.where("lab <> toplab").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block").drop("block").withColumnRenamed("to", "block").withColumn("far", F.lit(True))
    columns = ["grp", "band", "block", "cls", "n", "own", "tokens", "far", "lab"]
    return upper.union(_tile_links(named.select(columns).unionByName(away.select(columns)), "block"))


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links, itself included) of every row of docs.

    A text of fewer than WIDTH words is one shingle; an empty or null one has none and is linked with nothing, not even
    with its like. Equal sets are always linked; repeated rows are rows of one component; an empty table gives no
    rows; columns other than key and text are ignored. A row without a key counts as its component's member but never
    names it.
    """
    return _named(docs, key, text).select(key, "n_shingles", "component_id")


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """link_documents() with the class of each row's set (cls; null: empty) and its component's (comp)."""
    classes = stored(document_classes(docs, key, text), "classes")
    links = connected(class_links(docs, classes, text))
    rows = classes.where("often is null").drop("often")
    named = stored(rows.where("cls is not null").join(links, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node"), "named")
    out = with_least(named, "comp", key, "component_id", named.count())
    return out.unionByName(rows.where("cls is null").withColumns({"comp": F.lit(None).cast("long"), "component_id": F.col(key)}))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that name their component, each once: of repeated rows one stays. Rows without a key can't name
    one and stay as they are. Rows that share a key but not a component are different documents: each stays or goes by its own."""
    keyed = docs.where(F.col(key).isNotNull())
    named = stored(_named(keyed, key, text).select(key, "cls", "comp", (F.col(key) == F.col("component_id")).alias("names")), "names")
    # a key whose rows all name, or all don't, needs no look at its texts; with several sets it does
    by = named.groupBy(key).agg(F.count_if("names").alias("yes"), F.min(F.coalesce("cls", F.lit(0))).alias("low"), F.max(F.coalesce("cls", F.lit(0))).alias("high"))
    once = keyed.join(by.where("yes > 0 and low = high").select(key), key, "left_semi").dropDuplicates([key])
    several = keyed.join(by.where("yes > 0 and low <> high").select(key), key, "left_semi")
    own_set = free_name(docs, "_set")
    several = with_arrow(several, [text], own_set, "long", lambda: _class_column).withColumn(own_set, F.coalesce(own_set, F.lit(0)))
    own = named.where("names").groupBy(F.col(key).alias("_named_key"), "comp").agg(F.min(F.coalesce("cls", F.lit(0))).alias("_named_set")).drop("comp")
    several = several.join(own, (F.col(key) == F.col("_named_key")) & (F.col(own_set) == F.col("_named_set")), "left_semi").dropDuplicates([key, own_set])
    return once.select(docs.columns).unionByName(several.select(docs.columns)).unionByName(docs.where(F.col(key).isNull()))


def _class_column(column: pa.Array) -> pa.Array:
    return pa.array([class_of(s) if len(s) else None for s in shingle_sets(column.to_pylist())], pa.int64())
