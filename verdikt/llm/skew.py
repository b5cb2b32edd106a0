"""Joins that a hot key cannot send to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more than one of so many rows; so at most so many keys are hot, which bounds what is broadcast.
HOT_SHARE = 200
#: Below so many rows no key is worth a treatment of its own.
HOT_ROWS = 200


def join_by_counts(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """``left`` inner-joined with ``right``, which has one row per value of ``key`` and how many left rows have it in ``count``.

    Rows of hot keys, at most ``HOT_SHARE`` keys, meet their row of ``right`` by broadcast; the rest are shuffled.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT_ROWS, total / HOT_SHARE)
    few = right.where(hot).drop(count)
    if not few.take(1):
        return left.join(right.drop(count), key)
    return (left.join(F.broadcast(few), key)
            .unionByName(left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).drop(count), key)))
