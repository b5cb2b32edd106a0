"""Season calendar: August to July."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdikt.functions.text import col


def season_of(date: Column | str) -> Column:
    day = col(date)
    start = F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(start.cast("string"), F.lit("-"),
                    F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def is_season_id(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}$"), F.lit(False))


def season_window(season: Column | str) -> Column:
    start = F.substr(col(season), F.lit(1), F.lit(4)).try_cast("int")
    return F.struct(F.make_date(start, F.lit(8), F.lit(1)).alias("starts_on"),
                    F.make_date(start + 1, F.lit(7), F.lit(31)).alias("ends_on"))


def season_status(season: Column | str, today: Column) -> Column:
    window = season_window(season)
    return (F.when(today < window["starts_on"], "upcoming")
            .when(today > window["ends_on"], "final").otherwise("live"))
