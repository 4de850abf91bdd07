"""Actions, decisions, threads: duplicates, expiry, staleness, overdue ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions.fixed import STALE_DEADLINE_DAYS
from mnemora.operators.windows import first_of, latest_with_ties
from mnemora.session import dealt

ISO_DATE = r"^\d{4}-\d{2}-\d{2}"


def deadline_date(deadline: Column) -> Column:
    """The date that a free-text deadline starts with, else null."""
    return F.when(deadline.rlike(ISO_DATE), F.substring(deadline, 1, 10).try_cast("date"))


def without_repeats(actions: DataFrame, id_column: str = "id", total: int = 0) -> DataFrame:
    """The first of actions with the same mail, task, owner and deadline (null as '').

    A mail has few actions, so they are dealt before anything is sorted; groups by mail and owner need no other shuffle.
    Their total, where known, keeps the rows of a task few as they grow.
    """
    keyed = dealt(actions, "email_id", "owner", total=total).withColumn("__deadline", F.coalesce("deadline", F.lit("")))
    return first_of(keyed, ["email_id", "task", "owner", "__deadline"], F.col(id_column)).drop("__deadline")


def expire(actions: DataFrame, as_of: Column, days: int = STALE_DEADLINE_DAYS) -> DataFrame:
    """Open actions whose dated deadline is more than days back become expired."""
    old = (F.col("status") == "open") & (deadline_date(F.col("deadline")) < F.date_sub(as_of, days))
    return actions.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def overdue(actions: DataFrame, as_of: Column) -> DataFrame:
    """Open actions with a dated deadline before as_of, and days_overdue."""
    day = deadline_date(F.col("deadline"))
    return actions.filter((F.col("status") == "open") & (day < as_of)).withColumn("days_overdue", F.datediff(as_of, day))


def stale_threads(mails: DataFrame, user: str, as_of: Column, days: int = 5) -> DataFrame:
    """Threads whose last mail is from the user and older than days; all last mails of a thread, if equal in time.

    An empty user pattern finds nothing.
    """
    if not user:
        return mails.limit(0).withColumn("days_waiting", F.lit(0))
    last = latest_with_ties(mails.filter("conversation_id is not null"), ["conversation_id"], "date_received")
    waited = (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("date_received").cast("timestamp"))) / 86400
    mine = F.lower("sender_address").contains(user.lower())
    return last.filter(mine & (F.col("date_received") < as_of.cast("timestamp") - F.make_interval(days=F.lit(days)))).withColumn("days_waiting", waited.cast("int"))
