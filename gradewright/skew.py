"""Joins of many rows to one row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000


def lookup(rows: DataFrame, keyed: DataFrame, key: str, count: str = "cnt") -> DataFrame:
    """rows joined to keyed, which has one row a key and in ``count`` the rows that the key has.

    Keys above HOT_SHARE of the counted rows are at most 1 / HOT_SHARE in number: they are
    broadcast and their rows stay where they are. All other keys are joined by a shuffle in which no key
    exceeds that share. Rows without a partner are left out, null keys too.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    limit = max(1000.0, total * HOT_SHARE)
    hot = F.broadcast(keyed.filter(F.col(count) > limit).drop(count))
    cold = keyed.filter(F.col(count) <= limit).drop(count)
    if not hot.take(1):
        return rows.join(cold, key)
    return rows.join(hot, key).unionByName(rows.join(cold, key))
