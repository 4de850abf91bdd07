"""Freshness and coverage checks; each is one aggregate of one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(rows: DataFrame, source: str, ts: str, now: Column, hours: float) -> DataFrame:
    """rows, latest, counts of the last day and week, and STALE if nothing came within hours (or ever)."""
    back = lambda **k: now - F.make_interval(**{n: F.lit(x) for n, x in k.items()})
    late = F.max(ts).isNull() | (F.max(ts) < now - F.make_interval(secs=F.lit(hours * 3600)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.max(ts).alias("latest"), F.count_if(F.col(ts) > back(days=1)).alias("last_day"), F.count_if(F.col(ts) > back(days=7)).alias("last_week"),
        F.when(late, "STALE").otherwise("OK").alias("state"),
    ).select(F.lit(source).alias("source"), "*")


def histogram(rows: DataFrame, status: str) -> DataFrame:
    """n and percent of each status."""
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("status", "n", F.round(100.0 * F.col("n") / F.col("total"), 3).alias("percent"))


def coverage(rows: DataFrame, done: DataFrame, key: str, least: float) -> DataFrame:
    """total, covered, and WARN if fewer than that share are done."""
    marked = rows.join(done.select(key, F.lit(1).alias("__in")).dropDuplicates([key]), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("__in").alias("covered")).withColumn("state", F.when(F.col("covered") < least * F.col("total"), "WARN").otherwise("OK"))


def backlog(images: DataFrame, mails: DataFrame, processed: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """pending mails, unclassified images, and how many of those are stuck for longer than hours."""
    pending = mails.join(processed.select("message_id").distinct(), "message_id", "left_anti").agg(F.count(F.lit(1)).alias("pending"))
    open_ = F.col("classification") == "unclassified"
    stuck = images.agg(F.count_if(open_).alias("unclassified"), F.count_if(open_ & (F.col("classified_at") < now - F.make_interval(secs=F.lit(hours * 3600)))).alias("stuck"))
    return pending.join(F.broadcast(stuck))


def lag(upstream: DataFrame, stored: DataFrame, ts: str, now: Column) -> DataFrame:
    """Seconds that the store is behind its source, whose future times count as now."""
    up = upstream.agg(F.least(F.max(ts), now).alias("up"))
    own = stored.agg(F.max(ts).alias("own"))
    return up.join(F.broadcast(own)).select((F.unix_seconds(F.col("up").cast("timestamp")) - F.unix_seconds(F.col("own").cast("timestamp"))).alias("lag_seconds"))


def _plain(path: str) -> str:
    """A root without scheme and last slash."""
    return "/" + path.split(":", 1)[-1].strip("/")


def under(path: Column, root: str) -> Column:
    """Whether a path lies under a root, whole names compared."""
    return F.regexp_replace(path, "^[a-z0-9]+:/*", "/").startswith(_plain(root).rstrip("/") + "/")


def root_label(path: Column, roots: list[str]) -> Column:
    """Where a file lies: the last name of the first root it is under and the folders below; else its folder's name."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    folder = F.regexp_extract(plain, r"^(.*)/[^/]*$", 1)
    label = [F.when(under(path, r), F.concat(F.lit(_plain(r).rsplit("/", 1)[-1]), F.substr(folder, F.lit(len(_plain(r).rstrip("/")) + 1)))) for r in roots]
    return F.coalesce(*label, F.regexp_extract(folder, r"([^/]*)$", 1))


def newest_files(files: DataFrame, roots: list[str], now: Column) -> DataFrame:
    """root, files, newest (times to come count as now) of each root; roots without files too."""
    root = F.coalesce(*[F.when(under(F.col("path"), r), F.lit(r)) for r in roots])
    found = files.select(root.alias("root"), F.least("modified", now).alias("modified")).filter("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.max("modified").alias("newest"))
    every = files.sparkSession.createDataFrame([(r,) for r in roots], "root string")
    return every.join(found, "root", "left").select("root", F.coalesce("files", F.lit(0)).alias("files"), "newest")


def marker_files(files: DataFrame, known: dict[str, str], now: Column, hours: float = 24) -> DataFrame:
    """name, kind, state, age_hours of marker files and of those known (name to kind: log or sentinel).

    A log is OK if it was written within hours, else STALE, or MISSING. A sentinel that is there is PRESENT and
    blocks; files that nobody knows count as sentinels. Times to come count as now.
    """
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.least("modified", now.cast("timestamp")))) / 3600.0
    seen = files.groupBy("name").agg(F.max("modified").alias("modified")).select("name", age.alias("age_hours"))
    names = files.sparkSession.createDataFrame(list(known.items()), "name string, kind string")
    rows = names.join(seen, "name", "full").withColumn("kind", F.coalesce("kind", F.lit("sentinel")))
    log = F.when(F.col("age_hours").isNull(), "MISSING").when(F.col("age_hours") > hours, "STALE").otherwise("OK")
    return rows.select("name", "kind", F.when(F.col("kind") == "log", log).otherwise(F.when(F.col("age_hours").isNull(), "ABSENT").otherwise("PRESENT")).alias("state"), "age_hours")
