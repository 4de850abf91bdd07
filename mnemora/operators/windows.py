"""Sessions, threads, islands, versions and retention: operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions.fixed import SESSION_GAP_HOURS
from mnemora.session import stored


def sessions(rows: DataFrame, by: str, ts: str, order: list[str], hours: float = SESSION_GAP_HOURS) -> DataFrame:
    """rows with session, from 1 for each value of by: a new one starts after a gap of more than hours."""
    w = Window.partitionBy(by).orderBy(ts, *order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    new = F.when(gap.isNull() | (gap > int(hours * 3_600_000_000)), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def sessions_split(rows: DataFrame, by: str, ts: str, order: list[str], hours: float = SESSION_GAP_HOURS, unit: str = "day") -> DataFrame:
    """The same as sessions() for values of by with very many rows: no task sorts more than one's unit of time.

    Each unit is numbered by itself; its bounds and number of new sessions are one row, and a window over
    these rows tells where each unit's numbers begin.
    """
    limit = int(hours * 3_600_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = rows.withColumn("__unit", F.date_trunc(unit, ts)).withColumn("__at", at)
    w = Window.partitionBy(by, "__unit").orderBy(ts, *order)
    inner = F.coalesce((F.col("__at") - F.lag("__at").over(w) > limit).cast("int"), F.lit(0))
    cut = cut.withColumn("__new", inner).withColumn("__within", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    units = cut.groupBy(by, "__unit").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.sum("__new").alias("inner"))
    u = Window.partitionBy(by).orderBy("__unit")
    starts = F.coalesce((F.col("first") - F.lag("last").over(u) > limit).cast("int"), F.lit(1))
    units = units.withColumn("starts", starts)
    before = F.coalesce(F.sum(F.col("starts") + F.col("inner")).over(u.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.select(by, "__unit", (before + F.col("starts")).alias("__base"))
    return cut.join(units, [by, "__unit"]).withColumn("session", F.col("__base") + F.col("__within")).select(*rows.columns, "session")


def session_summary(rows: DataFrame, by: str, ts: str, who: str) -> DataFrame:
    """One row per session: bounds, messages, and the distinct participants, sorted."""
    return rows.groupBy(by, "session").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("messages"),
        F.array_join(F.array_sort(F.collect_set(who)), ",").alias("participants"),
    )


def reply_anchor(parent: Column, message_id: Column) -> Column:
    """A post's thread: its parent, or itself without the chat's prefix (up to the first ::)."""
    return F.coalesce(parent, F.regexp_replace(message_id, r"^.*?::", ""))


def has_substance(messages: DataFrame, by: list[str], text: str = "content_text", long: int = 20, total: int = 100) -> DataFrame:
    """Threads with a message of more than long characters and total characters in all, system messages aside."""
    return messages.filter(~F.col("is_system")).groupBy(*by).agg(F.count_if(F.length(text) > long).alias("long_messages"), F.sum(F.length(text)).alias("characters")).filter((F.col("long_messages") > 0) & (F.col("characters") >= total))


def runs(rows: DataFrame, by: str, order: str, who: str) -> DataFrame:
    """rows with __run, the number (from 1) of the run of rows of the same speaker; order tells a group's rows apart."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.lag(who).over(w).eqNullSafe(F.col(who)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("__change", change).withColumn("__run", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def in_order(order: str, text: str) -> Column:
    """The texts of a group, one a line, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")


def collapse(rows: DataFrame, by: str, order: str, who: str, text: str, most: int = 50_000) -> DataFrame:
    """One row per run of rows of the same speaker: turn_index from 0, speaker, content (cut at most characters)."""
    out = runs(rows, by, order, who).groupBy(by, "__run").agg(F.min(who).alias("speaker"), F.min(order).alias("first"), F.count(F.lit(1)).alias("parts"), in_order(order, text).alias("content"))
    return out.select(by, (F.col("__run") - 1).alias("turn_index"), "speaker", "first", "parts", F.substring("content", 1, most).alias("content"))


def first_of(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group, whatever comes after; groups are cut short before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_of(rows: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """All rows with their place from 1 in an order that tells them apart, however many they are.

    They are range-partitioned and stored with their partition; only the counts of partitions meet in one task.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__place", place).join(before, "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def latest_with_ties(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """All rows of each group's latest time."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(ts)))).filter("__r = 1").drop("__r")


def version_key(name: Column, modified: Column) -> Column:
    """A leading 12-digit stamp of a file name, or else the time of its last change in that form."""
    stamp = F.regexp_extract(name, r"^(\d{12})_", 1)
    return F.when(stamp != "", stamp).otherwise(F.date_format(modified, "yyyyMMddHHmm"))


def latest_versions(files: DataFrame, folder: str = "folder", name: str = "name", modified: str = "modified") -> DataFrame:
    """The newest version of each logical file (name without stamp, lower case) of a folder."""
    logical = F.lower(F.regexp_replace(F.col(name), r"^\d{12}_", ""))
    whole = files.withColumn("logical", logical).withColumn("version", version_key(F.col(name), F.col(modified)))
    return first_of(whole, [folder, "logical"], F.desc("version"), F.col(name))


def iso_week(day: Column) -> Column:
    """Year and week as YYYY-Www, by the ISO calendar."""
    return F.format_string("%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def keep_rolling(snapshots: DataFrame, group: str, name: str, keep: int) -> DataFrame:
    """snapshots with kept: the newest by name of each group."""
    return snapshots.withColumn("kept", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(name))) <= keep)


def keep_generations(snapshots: DataFrame, group: str, day: str, daily: int, weekly: int) -> DataFrame:
    """snapshots with kept: the newest daily ones, and the newest of each of the latest weekly weeks."""
    out = snapshots.withColumn("week", iso_week(F.col(day)))
    out = out.withColumn("__d", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(day))))
    out = out.withColumn("__w", F.row_number().over(Window.partitionBy(group, "week").orderBy(F.desc(day))))
    out = out.withColumn("__n", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc("week"))))
    return out.withColumn("kept", (F.col("__d") <= daily) | ((F.col("__w") == 1) & (F.col("__n") <= weekly))).drop("__d", "__w", "__n")


def month_chunks(since: Column, until: Column) -> Column:
    """Array of struct(start, stop) that cuts [since, until) at the first of months."""
    firsts = F.sequence(F.trunc(since, "MM"), F.trunc(F.date_sub(until, 1), "MM"), F.expr("interval 1 month"))
    return F.when(since < until, F.transform(firsts, lambda m: F.struct(F.greatest(m, since).alias("start"), F.least(F.add_months(m, 1), until).alias("stop"))))
