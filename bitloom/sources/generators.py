"""Generated byte sources: synthetic video, prime gaps and Fibonacci bytes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def synthetic_video(spark: SparkSession, frames: int = 20, width: int = 64, height: int = 64, still: float = 0.4, seed: int = 42) -> DataFrame:
    """frame, pos, v: the first share of frames is a gradient of even bytes, the others are noise of the seed."""
    size = width * height * 3
    first = int(frames * still)
    df = spark.range(frames * size).select((F.col("id") / size).cast("long").alias("frame"), (F.col("id") % size).alias("pos"))
    ramp = F.floor(F.col("pos") * 255 / size).cast("int").bitwiseAND(254)
    noise = F.pmod(F.xxhash64("frame", "pos", F.lit(seed)), F.lit(256)).cast("int")
    return df.withColumn("v", F.when(F.col("frame") < first, ramp).otherwise(noise))


def prime_gaps(spark: SparkSession, n: int) -> DataFrame:
    """pos, v: the gaps between the first n + 1 primes, modulo 256.

    A number below the bound is prime if no whole divisor up to its root divides it; candidates are tested apart.
    """
    bound = 20 if n < 6 else int(n * (math.log(n) + math.log(math.log(n))) * 1.2) + 20
    number = spark.range(2, bound).select(F.col("id").alias("p"))
    top = int(bound**0.5) + 1
    odd = number.where((F.col("p") == 2) | (F.col("p") % 2 == 1))
    prime = odd.where(~F.exists(F.sequence(F.lit(2), F.lit(top)), lambda d: (d * d <= F.col("p")) & (F.col("p") % d == 0)))
    order = Window.orderBy("p")
    gaps = prime.select((F.row_number().over(order) - 1).cast("long").alias("pos"), (F.lead("p").over(order) - F.col("p")).alias("v"))
    return gaps.where(F.col("pos") < n).withColumn("v", (F.col("v") % 256).cast("int"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """pos, v: the first n Fibonacci numbers modulo 256, whose period is 384."""
    period = F.expr("aggregate(sequence(1, 383), array(0, 1), (a, i) -> concat(a, array((a[i] + a[i - 1]) % 256)))")
    return spark.range(n).select(F.col("id").alias("pos"), F.get(period, (F.col("id") % 384).cast("int")).cast("int").alias("v"))
