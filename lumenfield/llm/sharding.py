"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` from a hash of the key and
the child's name, and the smallest draw wins, so a child gets its share of weight and a change of one child's weight
moves rows only from or to that child. A tree grows by a new subtree beside the regions: no other weight changes, so
rows move only into it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_text


@dataclass(frozen=True)
class Node:
    """A subtree; a leaf has a shard number and its own weight, any other node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else self.own_weight)

    @property
    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves] if self.children else [self]


def inner_nodes(tree: Node) -> list[Node]:
    return [tree, *(x for c in tree.children for x in inner_nodes(c))] if tree.children else []


def balanced_tree(regions: int, racks: int, shards: int, weights: dict[int, float] | None = None) -> Node:
    """regions x racks x shards leaves, numbered from 0; weights: of shards that don't weigh 1."""
    weights, n, tops = weights or {}, 0, []
    for r in range(regions):
        cells = []
        for k in range(racks):
            cells.append(Node(f"r{r}/k{k}", tuple(Node(f"r{r}/k{k}/s{n + i}", (), n + i, weights.get(n + i, 1.0)) for i in range(shards))))
            n += shards
        tops.append(Node(f"r{r}", tuple(cells)))
    return Node("root", tuple(tops))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region and rack of its own."""
    n, r = len(tree.leaves), f"r{len(tree.children)}"
    leaf = Node(f"{r}/k0/s{n}", (), n, weight)
    return Node("root", (*tree.children, Node(r, (Node(f"{r}/k0", (leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight; u, over 0 and at most 1, has the first 52 bits of an MD5 of key and name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node.name}")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(1)) / F.lit(float(1 << 52))) / F.lit(float(node.weight))


def with_shard(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """df with the shard number of its string column ``key``. Each level is a column of its own, the place of the
    chosen node among that level's nodes, so that no draw is made twice. Nodes of weight 0 get nothing."""
    level, column, depth = [tree], F.lit(0), 0
    while any(n.children for n in level):
        below = [(i, c) for i, n in enumerate(level) for c in (n.children or (n,)) if c.weight > 0]
        cases = None
        for i in range(len(level)):
            own = [(at, c) for at, (j, c) in enumerate(below) if j == i]
            if not own:
                continue
            drawn = F.lit(own[0][0]) if len(own) == 1 else F.array_min(F.array(*(F.struct(_draw(F.col(key), c).alias("d"), F.lit(at).alias("i")) for at, c in own)))["i"]
            cases = F.when(column == i, drawn) if cases is None else cases.when(column == i, drawn)
        df, column, depth = df.withColumn(f"_{out}{depth}", cases), F.col(f"_{out}{depth}"), depth + 1
        level = [c for _, c in below]
    shards = F.element_at(F.array(*(F.lit(n.shard) for n in level)), column + 1)
    return df.withColumn(out, shards.cast("int")).drop(*(f"_{out}{d}" for d in range(depth)))


def shard_rows(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of every row.

    size: UTF-8 bytes of the text (null: none) plus 1. slot numbers a shard's rows from 0 without gaps, in the order of a hash
    of the key, the key and the text's CRC. A shard's rows are numbered in ``cells`` ranges of that hash (by default
    the session's shuffle partitions), each sorted on its own, after the counts of the ranges before; no task gets a
    whole shard, and how many ranges there are changes no slot. A null key is a key like any other; repeated rows get
    slots of their own; an empty table gives no rows; other columns of docs are ignored.
    """
    cells = cells or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, name = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        crc_text(value).alias("text_crc32"),
        name.alias("_name"),
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long").alias("_hash"),
    ).withColumn("_cell", F.shiftright(F.col("_hash") * cells, 32))
    rows = with_shard(with_shard(rows, "_name", tree, "shard"), "_name", grown(tree), "grown_shard").drop("_name")
    w = Window.partitionBy("shard", "_cell")
    before = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n")).drop("_n")
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy("_hash", F.col(key), "text_crc32")))
    return (
        ranked.join(before, ["shard", "_cell"])
        .withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
    )
