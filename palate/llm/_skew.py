"""Joins of many rows with what is known of their key, where one key may hold a third of the rows.

Few keys can be hot: at most ``HOT_KEYS`` of them hold more than one in ``HOT_KEYS`` of the rows. These, and no
more, are broadcast, with the number of salts over which their rows are dealt; what is known of a hot key is
repeated once a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 4096
FEW_ROWS = 512  # no key with fewer rows is worth a salt


def hot_keys(counts: DataFrame, on: list[str], n: str, few: int = FEW_ROWS) -> DataFrame:
    """(*on, salts) of the hot keys among ``counts`` (one row a key, ``n`` rows each): fewer than ``HOT_KEYS``."""
    total = int(counts.agg(F.sum(n)).first()[0] or 0)
    share = max(total / HOT_KEYS, few)
    return counts.where(F.col(n) > share).select(*on, F.ceil(F.col(n) / share).cast("int").alias("salts"))


def join_back(members: DataFrame, facts: DataFrame, on: list[str], hot: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``members`` joined with ``facts`` (one row a key) on the columns ``on``. The rows of the keys in ``hot``
    are dealt over their salts by the columns ``by``, the same way whenever a task runs again."""
    salts = F.coalesce("salts", F.lit(1))
    dealt = members.join(F.broadcast(hot), on, "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("salts")
    told = facts.join(F.broadcast(hot), on, "left")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(told, [*on, "salt"], how).drop("salt")
