"""Numbers of 64 bits for rows: equal rows have one, different rows have different ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import cut, small

#: Times that colliding rows are numbered anew before that counts as an error; each leaves about 2**-64 times as many pairs as there are.
TRIES = 8


def _hash(seed: int, columns: tuple[str, ...]) -> Column:
    """Nulls count: xxhash64 by itself passes over them."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """(row, uid): each row as a struct with its number. Rows that are equal in ``columns`` have one number.

    A number is a hash. Numbers that rows of different second hashes share are looked for over all rows, as two longs a row and aggregated before they are
    shuffled; rows with such a number, hardly any, get one of another hash, until there are none. So rows are told apart by 128 bits and known by 64.
    The columns may have any types that can be hashed, and nulls; no rows give no rows.
    """
    known = docs.select(F.struct("*").alias("row"), _hash(0, columns).alias("uid"), _hash(1, columns).alias("check"), *(_hash(k, columns).alias(f"other_{k}") for k in range(2, TRIES + 2)))
    for k in range(2, TRIES + 2):
        shared = known.groupBy("uid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
        shared = cut(shared.select("uid", F.lit(True).alias("shared")))
        if shared.isEmpty():
            return known.select("row", "uid")
        known = known.join(small(shared), "uid", "left").withColumn("uid", F.when(F.col("shared"), F.col(f"other_{k}")).otherwise(F.col("uid"))).drop("shared")
    raise ValueError(f"rows still share numbers after {TRIES} hashes")
