"""Statistical expressions and relations: rates, overlaps, multiple testing, exact tails, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: str = "", b: str = "2") -> Column:
    """Euclidean distance of (x, y, z) with suffix a from (x, y, z) with suffix b."""
    return F.sqrt(sum((F.col(f"{c}{a}") - F.col(f"{c}{b}")) * (F.col(f"{c}{a}") - F.col(f"{c}{b}")) for c in "xyz"))


def mcc(tp: Column, fp: Column, tn: Column, fn: Column, undefined: float = 0.0) -> Column:
    """Matthews correlation; undefined where a margin is empty."""
    d = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(d == 0, F.lit(undefined)).otherwise((tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(d))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Classification metrics; null where a denominator is 0, and balanced accuracy of what is defined."""
    over = lambda a, b: F.when(b > 0, a.cast("double") / b)
    sens, spec = over(tp, tp + fn), over(tn, tn + fp)
    both = F.coalesce((sens + spec) / 2, sens, spec)
    return {"sensitivity": sens, "specificity": spec, "accuracy": over(tp + tn, tp + fp + tn + fn), "ppv": over(tp, tp + fp), "npv": over(tn, tn + fn), "f1": over(tp * 2, tp * 2 + fp + fn), "balanced_accuracy": both, "mcc": mcc(tp, fp, tn, fn)}


def jaccard(both: Column, either: Column) -> Column:
    """Of counts; 0 where both sets are empty."""
    return F.when(either > 0, both.cast("double") / either).otherwise(0.0)


def dice(both: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, both.cast("double") * 2 / (a + b)).otherwise(0.0)


def z_score(obs: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (obs - mean) / sd).otherwise(0.0)


def seed(master: int, run: str, context: Column) -> Column:
    """32-bit seed of a context: the lower eight of the first sixteen hex digits of its SHA-256."""
    text = F.concat(F.lit(f"{master}|{run}|"), context)
    return F.conv(F.substring(F.sha2(text, 256), 9, 8), 16, 10).cast("long")


def benjamini_hochberg(df: DataFrame, p: str = "p", order: str = "residue_index", q: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """df with rank, q_bh, q_by and significant, per family ``by``.

    q is the running minimum of m p / rank from the largest p down; significant: p is at most the largest p with
    p <= rank q / m, ties at the boundary included. q_by is q_bh times the harmonic number of m, at most 1.
    """
    by = by or ["gene"]
    family = Window.partitionBy(*by)
    up = family.orderBy(p, order)
    r = df.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count(F.lit(1)).over(family))
    down = family.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    harmonic = F.sum(1.0 / F.col("rank")).over(family)
    r = r.withColumn("q_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down)))
    edge = F.max(F.when(F.col(p) <= F.col("rank") * q / F.col("m"), F.col(p))).over(family)
    return r.withColumn("q_by", F.least(F.lit(1.0), F.col("q_bh") * harmonic)).withColumn("significant", F.coalesce(F.col(p) <= edge, F.lit(False)))


def ln_factorials(sizes: DataFrame) -> DataFrame:
    """(gene, lf): the array of ln(i!) for i from 0 to m_all, of each gene in (gene, m_all)."""
    each = sizes.select("gene", F.explode(F.sequence(F.lit(0), F.col("m_all").cast("int"))).alias("i"))
    total = F.sum(F.log(F.greatest(F.col("i"), F.lit(1)).cast("double"))).over(Window.partitionBy("gene").orderBy("i"))
    return each.select("gene", F.struct("i", total.alias("lf")).alias("e")).groupBy("gene").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["lf"]).alias("lf"))


def hypergeometric_tail(k: Column, m_all: Column, m_good: Column, n: Column) -> Column:
    """P(X >= k) of n draws from m_all with m_good good ones; needs a column lf of ln_factorials()."""
    f = lambda i: F.element_at("lf", (i + 1).cast("int"))
    comb = lambda a, b: f(a) - f(b) - f(a - b)
    low, high = F.greatest(k, n + m_good - m_all, F.lit(0)), F.least(m_good, n)
    total = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, i: acc + F.exp(comb(m_good, i) + comb(m_all - m_good, n - i) - comb(m_all, n)))
    return F.when(k <= F.greatest(F.lit(0), n + m_good - m_all), 1.0).when(low > high, 0.0).otherwise(F.least(F.lit(1.0), total))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks of ties, per ``by``."""
    def ranked(c: str) -> Column:
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2

    return df.select(*by, ranked(x).alias("rx"), ranked(y).alias("ry")).groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))
