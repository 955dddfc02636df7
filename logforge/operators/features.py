"""Features of events and actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logforge.functions.skew import lookup
from logforge.operators.missing import col

#: Texts that mean there is no access type.
NO_ACCESS = ("Unknown", "nan", "")


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday (Monday 0), month, year and weekend flag of the event."""
    t = col(ts)
    return df.withColumns({
        "event_hour": F.hour(t), "event_dayofweek": F.weekday(t), "event_month": F.month(t), "event_year": F.year(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int")})


def actor_table(df: DataFrame, actor: str, ts: str, label: str | None = None, granularity: str = "date") -> DataFrame:
    """Event count, label ratio, active days and velocity (events for each active day) of each actor.

    Active days are distinct dates; granularity "timestamp" counts distinct times instead. Fit this on training rows
    alone where the ratio is to be a feature."""
    active = F.to_date(col(ts)) if granularity == "date" else col(ts)
    days = F.count_distinct(active)
    found = [F.count(F.lit(1)).alias("actor_event_count"), days.alias("actor_active_days")]
    if label is not None:
        found.append(F.avg(col(label)).alias("actor_bot_ratio"))
    out = df.where(col(actor).isNotNull()).groupBy(col(actor).alias("__actor")).agg(*found)
    safe = F.when(F.col("actor_active_days") == 0, 1).otherwise(F.col("actor_active_days"))
    return out.withColumn("actor_event_velocity", F.col("actor_event_count") / safe)


def attach_actor(df: DataFrame, table: DataFrame, actor: str) -> DataFrame:
    """df with an actor table's columns; null for a null or unknown actor. A hot actor's events meet copies of its row in
    many tasks."""
    return lookup(df, table, col(actor), "__actor")


def programmatic_flag(access: str) -> Column:
    return F.when(F.coalesce(col(access), F.lit("nan")).isin(*NO_ACCESS), 0).otherwise(1).alias("is_programmatic")


def integration_flag(name: str) -> Column:
    return col(name).isNotNull().cast("int").alias("is_integration_event")


def flag_members(df: DataFrame, name: str, members: DataFrame, out: str) -> DataFrame:
    """df with a flag: whether the column's value is in a table of distinct values, which has the same column name."""
    known = members.select(col(name).alias("__value")).distinct().withColumn("__in", F.lit(True))
    return lookup(df, known, col(name), "__value").withColumn(out, F.coalesce("__in", F.lit(False))).drop("__in")


def drop_flagged(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag isn't true; null isn't."""
    return df.where(~F.coalesce(col(flag), F.lit(False)))
