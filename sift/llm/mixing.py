"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets the mean repetition rate
``rate = repeats * w * corpus_size / source_size`` (sizes in characters).  Each
document's count is the Poisson distribution of that rate, inverted at a
uniform number that is a hash of the seed and the document id; the document is
exploded by its count, and the copies are shuffled globally by a range
partitioning on a second hash.  The same seed gives the same mixture on any
cluster.

The cumulative distribution is a short array per source (one row per source,
broadcast up to ``BROADCAST_SOURCES`` of them, else joined by source and salt; its length follows the rate, about rate + 10 standard deviations, the
point where the remaining probability is below the hash's resolution).  Rates
above ``PART_RATE`` are split into a sum of equal independent Poisson parts,
each inverted at its own hash, since exp(-rate) would underflow.

Defined cases: a null source is a source of its own; a null or empty text
counts one character, so a source of empty texts has a finite rate; rows with
equal ids get equal counts (and a null id hashes as empty); a source with no
target weight gets rate 0; an empty table gives an empty result; extra columns
are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.llm.scratch import free_name, stage

#: Target weight of a source without explicit weights: its share of characters to this power.
TEMPERATURE = 0.5
#: Mean number of copies a character of the corpus gets.
REPEATS = 1.0
SEED = 20240601
#: Largest rate inverted in one piece; exp(-64) is far above the smallest double.
PART_RATE = 64.0
#: Rates of so many sources are broadcast (a row has under 170 numbers, so all under 14 MB).
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
                 repeats: float = REPEATS, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: source, size, rate, parts, cdf (of one part)."""
    size = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")
    sizes = documents.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        spark = documents.sparkSession
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "key string, weight double")
        weighed = (sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("key")), "left")
                        .withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    # rounding the rate makes it independent of the order in which weights were added
    whole = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("size").alias("all_size"))
    rate = F.when(F.col("all_weight") > 0, F.round(F.lit(float(repeats)) * (F.col("weight") / F.col("all_weight"))
                                                  * (F.col("all_size") / F.col("size")), 9)).otherwise(0.0)
    rated = (weighed.crossJoin(F.broadcast(whole))  # one row of totals
                    .select("source", "size", rate.alias("rate"))
                    .withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")))
    part = F.col("rate") / F.col("parts")
    top = F.ceil(part + 10 * F.sqrt(part) + 20).cast("int")
    # p(k) = p(k-1) * part / k, summed as it goes
    step = F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * part / k).alias("p"),
                                F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return rated.withColumn("cdf", step)


def copies(rates_cdf: Column, parts: Column, seed: int, *keys: Column) -> Column:
    """Number of copies: each part is the number of steps of its cdf at or below its uniform number."""
    return F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda total, part: total + F.size(F.filter(rates_cdf, lambda c: c <= uniform(seed, *keys, part))))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
        repeats: float = REPEATS, seed: int = SEED, id_col: str = "doc_id", source: str = "source",
        text: str = "text", copy_col: str | None = "copy") -> DataFrame:
    """The documents, each as often as drawn, in a globally shuffled order.

    The columns of ``documents`` are followed by ``copy_col`` (from 0), unless
    that is None or a column of that name is there already.
    """
    rates = source_rates(documents, weights, temperature, repeats, source, text)
    key, cdf, parts, copy, place = (free_name(documents, n) for n in ("__source", "__cdf", "__parts", "__copy", "__place"))
    rates = rates.select(F.col("source").alias(key), F.col("cdf").alias(cdf), F.col("parts").alias(parts))
    drawn = copies(F.col(cdf), F.col(parts), seed, F.col(id_col))
    rates = stage(rates, "rates")
    if rates.count() <= BROADCAST_SOURCES:      # counted: texts stay where they were read
        rated = documents.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col(key)))
    else:                                       # each source's rows are dealt over SALTS tasks
        salt, number = free_name(documents, "__salt"), F.pmod(F.xxhash64(id_col, text), F.lit(SALTS))
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rated = documents.join(salted, F.col(source).eqNullSafe(F.col(key)) & (number == F.col(salt))).drop(salt)
    exploded = (rated.withColumn(copy, F.explode(F.when(drawn > 0, F.sequence(F.lit(0), drawn - 1))))
                         .drop(key, cdf, parts))
    order = uniform(seed + 1, F.col(id_col), F.col(copy))
    shuffled = exploded.withColumn(place, order).repartitionByRange(place).sortWithinPartitions(place, id_col, copy).drop(place)
    if copy_col is None or copy_col.lower() in {c.lower() for c in documents.columns}:
        return shuffled.drop(copy)
    return shuffled.withColumnRenamed(copy, copy_col)
