"""Writing as functions of old and new tables, and files. `operators.snapshots` keeps tables that change."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.windows import first_of


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and those rows of new that no row has by any of the keys (nulls are no match); the first of new wins."""
    for key in keys:
        known = new.filter(F.col(key).isNotNull())
        new = first_of(known, [key], F.col(order)).unionByName(new.filter(F.col(key).isNull()))
        new = new.join(old.select(key).filter(F.col(key).isNotNull()), key, "left_anti").select(new.columns)
    return old.unionByName(new.select(old.columns))


def move_mailboxes(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the mailbox that new has for a message."""
    now = new.filter("mailbox_name is not null").groupBy("message_id").agg(F.max("mailbox_name").alias("__now"))
    return old.join(now, "message_id", "left").withColumn("mailbox_name", F.coalesce("__now", "mailbox_name")).select(old.columns)


def insert_links(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Set union by key; old rows stay."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(key), key, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Of all rows of a key the last by order; new rows win ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_of(both, [key], F.desc_nulls_last(order), F.desc("__new")).select(old.columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str, touched: DataFrame | None = None) -> DataFrame:
    """Children of the parents that new (or touched) names are replaced; others stay."""
    parents = (new if touched is None else touched).select(parent).distinct()
    return old.join(parents, parent, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def attempts(log: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Failures in a row at the end of each key's log, and its last status."""
    last_ok = F.max(F.when(ok, F.col(order)))
    ends = log.groupBy(key).agg(last_ok.alias("__ok"), F.max_by("status", order).alias("last_status"), F.max(order).alias("last_attempt_at"))
    return log.join(ends, key).groupBy(key, "last_status", "last_attempt_at").agg(F.count_if(F.col("__ok").isNull() | (F.col(order) > F.col("__ok"))).alias("attempts"))


def fully_loaded(staged: DataFrame, loaded: DataFrame, batch: str = "batch", key: str = "message_id") -> DataFrame:
    """Batches whose messages are all loaded; one without messages is never among them."""
    marked = staged.join(loaded.select(key, F.lit(1).alias("__in")).dropDuplicates([key]), key, "left")
    return marked.groupBy(batch).agg(F.count(key).alias("messages"), F.count("__in").alias("loaded")).filter("messages > 0 and messages = loaded")


def keep_flags(old: DataFrame, new: DataFrame, key: str, flag: str) -> DataFrame:
    """new rows in place of old ones, with the old row's flag where it was set."""
    was = old.select(key, F.col(flag).alias("__was"))
    mine = new.join(was, key, "left").withColumn(flag, F.coalesce("__was", flag, F.lit(False))).select(old.columns)
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(mine)


def register_files(files: DataFrame, known: DataFrame, mails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New attachments (message_id, filename, …) with their email_id, and those whose mail isn't there yet."""
    fresh = files.dropDuplicates(["message_id", "filename"]).join(known.select("message_id", "filename"), ["message_id", "filename"], "left_anti")
    mail = mails.select("message_id", F.col("id").alias("email_id"))
    return fresh.join(mail, "message_id"), fresh.join(mail, "message_id", "left_anti")


def moved_from_inbox(mails: DataFrame, live: DataFrame, live_provider: DataFrame, inbox: str = "Inbox", archive: str = "Archive") -> DataFrame:
    """mails with mailbox archive for inbox rows that neither set of live ids (message_id, internet_message_id) has."""
    for ids, key in ((live, "message_id"), (live_provider, "internet_message_id")):
        seen = ids.select(F.col(key), F.lit(True).alias(f"__{key}")).dropDuplicates([key])
        mails = mails.join(seen, key, "left")
    gone = (F.col("mailbox_name") == inbox) & F.col("__message_id").isNull() & F.col("__internet_message_id").isNull()
    return mails.withColumn("mailbox_name", F.when(gone, archive).otherwise(F.col("mailbox_name"))).drop("__message_id", "__internet_message_id")


def write_batches(rows: DataFrame, path: str, per_file: int = 200) -> None:
    rows.write.option("maxRecordsPerFile", per_file).json(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """One file for each row (name, content) in a folder that all executors reach; how many.

    A file has its name only when it is whole; a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = base = None
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                if fs is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                at = f"{base}/{name}"
                parent, _, last = at.rpartition("/")
                fs.create_dir(parent, recursive=True)
                beside = f"{parent}/_{last}.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside, compression=None) as out:
                    out.write(content)
                fs.move(beside, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def staging_files(mails: DataFrame, batch: Column) -> DataFrame:
    """Mails as staging files (name, content): an object with batch_number and emails for each batch."""
    one = F.struct(*mails.columns)
    groups = mails.groupBy(batch.alias("batch_number")).agg(F.array_sort(F.collect_list(F.to_json(one))).alias("emails"))
    text = F.concat(F.lit('{"batch_number": '), "batch_number", F.lit(', "emails": ['), F.array_join("emails", ",\n"), F.lit("]}"))
    return groups.select(F.concat(F.lit("batch-"), F.lpad(F.col("batch_number").cast("string"), 9, "0"), F.lit(".json")).alias("name"), text.alias("content"))
