"""Places of subsets in lexicographic order, as column expressions over wide decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binomials are exact up to 38 digits: of up to 126 elements, whatever the size.
WIDE, MOST = "decimal(38,0)", 126


def binomials(n: Column) -> Column:
    """Rows 0 to n of Pascal's triangle, as an array of arrays: element [m][k] is m over k. n is at most MOST."""
    one = F.lit(1).cast(WIDE)

    def grown(rows: Column, m: Column) -> Column:
        last = F.element_at(rows, -1)
        inside = F.transform(F.sequence(F.lit(1), m), lambda k: (F.get(last, k - 1) + F.coalesce(F.get(last, k), F.lit(0).cast(WIDE))).cast(WIDE))
        return F.concat(rows, F.array(F.concat(F.array(one), inside)))

    rows = F.aggregate(F.sequence(F.lit(0), n), F.array(F.array(one)).cast(f"array<array<{WIDE}>>"), lambda rows, m: F.when(m > 0, grown(rows, m)).otherwise(rows))
    return F.when(n <= MOST, rows).otherwise(F.raise_error(F.lit(f"subsets of more than {MOST} elements have no exact place")).cast(f"array<array<{WIDE}>>"))


def rank(subset: Column, n: Column, table: Column) -> Column:
    """The place of a subset (elements from 0 on, rising) among those of its size of n elements; table: binomials(n)."""
    zero = F.lit(0).cast(WIDE)

    def step(acc: Column, e: Column) -> Column:
        there = F.array_contains(subset, e)
        skipped = F.get(F.get(table, n - e - 1), acc["left"] - 1)  # subsets that have e next
        return F.struct(F.when(there, acc["left"] - 1).otherwise(acc["left"]).alias("left"), (acc["rank"] + F.when(there | (acc["left"] == 0), zero).otherwise(F.coalesce(skipped, zero))).cast(WIDE).alias("rank"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.size(subset).alias("left"), zero.alias("rank")), step, lambda acc: acc["rank"])


def unrank(place: Column, n: Column, k: Column, table: Column) -> Column:
    """The subset of size k of n elements at a place; the inverse of rank(). Null where there is no such place."""
    zero = F.lit(0).cast(WIDE)

    def step(acc: Column, e: Column) -> Column:
        with_e = F.when(acc["left"] > 0, F.coalesce(F.get(F.get(table, n - e - 1), acc["left"] - 1), zero)).otherwise(zero)
        take = acc["rest"] < with_e
        return F.struct(
            F.when(take, acc["left"] - 1).otherwise(acc["left"]).alias("left"), F.when(take | (acc["left"] == 0), acc["rest"]).otherwise(acc["rest"] - with_e).cast(WIDE).alias("rest"),
            F.when(take, F.concat(acc["out"], F.array(e))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(k.alias("left"), place.cast(WIDE).alias("rest"), F.array().cast("array<int>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])
    total = F.get(F.get(table, n), k)
    return F.when((place >= 0) & (place.cast(WIDE) < total), found)
