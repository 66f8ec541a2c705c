"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, inner_name, small

#: Larger mean rates are sums of independent Poisson counts with means of at most this.
PART = 16.0
#: Terms of a distribution function; beyond them is a probability below 1e-16 for a mean of PART.
TERMS = 80


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the parts: the first 52 bits of their MD5."""
    name = F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_cdf(mean: Column) -> Column:
    """P(count <= k) for k = 0 .. TERMS - 1."""
    first = F.exp(-mean)
    begin = F.struct(first.alias("p"), F.array(first).alias("f"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["f"], F.array(F.element_at(state["f"], -1) + p)).alias("f"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), begin, step)["f"]


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5) -> DataFrame:
    """(source, chars, weight, rate): the mean number of times that each document of a source is repeated.

    ``weights`` (source, weight) gives the target shares of characters, in any unit; sources it lacks get none. Without
    it, a source's weight is its number of characters to the ``power``. The mixture has as many characters as the
    corpus, on average: rate = share * all characters / the source's characters. A source without characters has rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    sizes = sizes.select("source", F.coalesce("chars", F.lit(0)).alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(power)))
    else:
        named = weights.select(F.col("source").alias("_of"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighed.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("all_chars"))
    rate = F.when(
        (F.col("chars") > 0) & (F.col("weights") > 0),
        F.col("weight") / F.col("weights") * F.col("all_chars") / F.col("chars"),
    )
    return weighed.join(F.broadcast(totals)).select(
        "source", "chars", "weight", F.coalesce(rate, F.lit(0.0)).alias("rate")
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, seed: str = "mix"
) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, in a global random order.

    The count inverts the Poisson distribution with the mean of ``rates`` at a number hashed from seed and doc_id, so
    a rerun, or a task that runs again, makes the same mixture. mix_copy numbers a row's copies from 1; mix_place is
    its random place: rows are dealt over partitions and sorted by it. These two replace columns of the same names.

    Null texts count no characters; a null source is a source of its own; rows with a null doc_id share one random
    number, as do rows that repeat a doc_id. An empty table gives an empty result.
    """
    docs = docs.drop("mix_copy", "mix_place")
    parts, mean, cdf, count, of = (inner_name(docs, x) for x in ("parts", "mean", "cdf", "count", "of"))
    table = Scratch(docs.sparkSession, "mix").save(rates(docs, weights, power), "rates")
    table = table.withColumn(parts, F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    table = table.withColumn(mean, F.col("rate") / F.col(parts))
    table = table.select(F.col("source").alias(of), parts, poisson_cdf(F.col(mean)).alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def drawn(part: Column) -> Column:
        u = uniform(seed, "count", name, part.cast("string"))
        return F.size(F.filter(F.col(cdf), lambda f: f <= u))

    joined = docs.join(small(table, 10_000, F.lit(8 * TERMS + 64)), F.col("source").eqNullSafe(F.col(of)))
    total = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda a, part: a + drawn(part))
    copies = joined.withColumn(count, total).where(F.col(count) > 0)
    copies = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(count))))
    place = uniform(seed, "place", name, F.col("mix_copy").cast("string"))
    placed = copies.select(*docs.columns, "mix_copy", place.alias("mix_place"))
    return placed.repartition("mix_place").sortWithinPartitions("mix_place")
