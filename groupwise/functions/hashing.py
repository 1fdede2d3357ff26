"""Reproducible randomness from row keys: the same key and seed give the same draw on any cluster, and after a retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

UNIT_SCALE = 4294967296.0


def hash_key(seed: str | int, *parts: Column | str) -> Column:
    """32 hex digits of md5 over ``seed|part|part...``; ordering by it is a random permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def unit(seed: str | int, *parts: Column | str) -> Column:
    """Uniform draw in [0, 1) from the first 8 hex digits of :func:`hash_key`."""
    return hash_int(seed, *parts).cast("double") / F.lit(UNIT_SCALE)


def hash_int(seed: str | int, *parts: Column | str) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def poisson(rate: Column | str, seed: str | int, *parts: Column | str) -> Column:
    """Poisson draw by inversion. Large rates are a sum of independent draws with rate at most 16, so nothing underflows."""
    rate = col(rate)
    pieces = F.greatest(F.ceil(rate / F.lit(16.0)).cast("int"), F.lit(1))
    part = rate / pieces

    def one(i: Column) -> Column:
        u = unit(seed, *parts, i)
        start = F.struct(F.lit(0).alias("k"), F.exp(-part).alias("p"), F.exp(-part).alias("cdf"))

        def step(acc: Column, _: Column) -> Column:
            k = acc["k"] + 1
            p = acc["p"] * part / k
            return F.when(u >= acc["cdf"], F.struct(k.alias("k"), p.alias("p"), (acc["cdf"] + p).alias("cdf"))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: acc["k"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), pieces), one), F.lit(0), lambda acc, k: acc + k)
