"""The store's entities as views of the driver's tables, in Spark and in DuckDB SQL.

Mails are orders, people customers and suppliers, topics part brands, actions order lines, attachments
documents, chats events, sessions conversations. Every view is lazy and reads the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.index import TextIndex
from mnemora.session import fresh_path

#: "Now" in queries on orders and on events.
AS_OF, EVENTS_AS_OF = "2001-12-31", "2024-02-01"


#: Full-text indexes that this session has built: name and state of the files to the index.
_INDEXES: dict[tuple, TextIndex] = {}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _state(self, name: str) -> str:
        """What the files of a table look like: their names, lengths and times."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        at = place(f"{self.dir}/{name}.parquet")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return ";".join(f"{s.getPath()},{s.getLen()},{s.getModificationTime()}" for s in fs.listStatus(at))

    def index(self, name: str, table: str, rows: DataFrame, key: str, fields: list[str]) -> TextIndex:
        """The full-text index of rows made from a table, as a store keeps one beside its texts.

        It is built when a session first asks for it, and again if the table's files have changed or it was removed.
        """
        state = (self.spark.sparkContext.applicationId, name, key, *fields, self._state(table))
        if state not in _INDEXES or not _INDEXES[state].there():
            _INDEXES[state] = TextIndex(self.spark, fresh_path(self.spark, f"index-{name}", lasting=True), key, fields).put(rows)
        return _INDEXES[state]

    def document_index(self) -> TextIndex:
        """Documents by their whole text, and by its beginning as a title would be."""
        return self.index("documents", "documents", self.table("documents").select("doc_id", "text", F.substring("text", 1, 60).alias("head")), "doc_id", ["text", "head"])

    def turn_index(self, role: str | None = None) -> TextIndex:
        turns = self.table("conversations") if role is None else self.table("conversations").filter(F.col("role") == role)
        return self.index(f"turns-{role}", "conversations", turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id", ["text"])

    def chat_rows(self) -> DataFrame:
        """Chats: title none, summary the first two turns."""
        first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
        return self.table("conversations").filter("turn < 2").groupBy(F.col("conv_id").alias("chat_id")).agg(first.alias("summary"), F.lit(None).cast("string").alias("title"))

    def chat_index(self) -> TextIndex:
        return self.index("chats", "conversations", self.chat_rows(), "chat_id", ["summary", "title"])

    def turns_of_chats(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"))

    def source_rows(self) -> DataFrame:
        """Sources of documents as threads, by the number at the end of their name."""
        number = F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("long")
        return self.table("documents").groupBy(number.alias("thread_id")).agg(F.min("source").alias("title"), F.lit(None).cast("string").alias("summary")).filter("thread_id is not null")

    def source_index(self) -> TextIndex:
        return self.index("sources", "documents", self.source_rows(), "thread_id", ["title", "summary"])

    def fact_rows(self) -> DataFrame:
        """Events as facts, two thirds of them tagged."""
        tag = F.when(F.col("event_id") % 3 == 0, "[PREFERENCE] ").when(F.col("event_id") % 3 == 1, "[TECHNICAL] ").otherwise("")
        return self.table("events").select(F.col("event_id").alias("fact_id"), F.concat(tag, "event_type").alias("fact"), F.col("ts").alias("at"))

    def fact_index(self) -> TextIndex:
        return self.index("facts", "events", self.fact_rows().filter("fact like '[%'"), "fact_id", ["fact"])

    def item_index(self) -> TextIndex:
        return self.index("items", "benchmark", self.table("benchmark").select("item_id", "text"), "item_id", ["text"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def mails(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("email_id"), F.col("o_orderdate").alias("date_received"), F.col("o_custkey").alias("conversation_id"),
            F.concat(F.lit("c:"), F.col("o_custkey")).alias("sender_id"), F.col("o_orderstatus").alias("sentiment"), F.col("o_orderpriority").alias("urgency"),
        )

    def people(self) -> DataFrame:
        c = self.table("customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("person_id"), F.col("c_name").alias("name"), F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@n"), F.col("c_nationkey"), F.lit(".example")).alias("email"))
        s = self.table("supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey")).alias("person_id"), F.col("s_name").alias("name"), F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ".")), F.lit("@n"), F.col("s_nationkey"), F.lit(".example")).alias("email"))
        return c.unionByName(s)

    def mail_people(self) -> DataFrame:
        sent = self.table("orders").select(F.col("o_orderkey").alias("email_id"), F.concat(F.lit("c:"), F.col("o_custkey")).alias("person_id"), F.lit("sender").alias("role"))
        got = self.table("lineitem").select(F.col("l_orderkey").alias("email_id"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("person_id"), F.col("l_returnflag").alias("role")).distinct()
        return sent.unionByName(got)

    def mail_topics(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
        return self.table("lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select(F.col("l_orderkey").alias("email_id"), "topic").distinct()

    def actions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("email_id"), F.concat(F.lit("task "), F.col("l_partkey")).alias("task"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("owner"),
            F.when(F.col("l_linenumber") == 7, "asap").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("deadline"), F.when(F.col("l_linestatus") == "O", "open").otherwise("completed").alias("status"), F.col("l_linenumber").alias("line"),
        )

    def decisions(self) -> DataFrame:
        return self.table("lineitem").filter("l_returnflag = 'R'").select(
            F.col("l_orderkey").alias("email_id"), F.concat(F.lit("part "), F.col("l_partkey")).alias("decision"), F.concat(F.lit("s:"), F.col("l_suppkey")).alias("decided_by"),
            F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate")).alias("decision_date"),
        )

    def attachments(self) -> DataFrame:
        docs, labels = self.table("documents"), self.table("labels")
        return docs.join(labels, "doc_id", "left")

    def messages(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("chat_id"), F.col("ts").alias("composed_at"), F.col("event_type").alias("sender"), "value", "props")


SQL = {
    "mails": "mails as (select o_orderkey as email_id, o_orderdate as date_received, o_custkey as conversation_id, 'c:' || o_custkey as sender_id, o_orderstatus as sentiment, o_orderpriority as urgency from orders)",
    "people": "people as (select 'c:' || c_custkey as person_id, c_name as name, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@n' || c_nationkey || '.example' as email from customer "
    "union all select 's:' || s_suppkey, s_name, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '.', 'g')) || '@n' || s_nationkey || '.example' from supplier)",
    "mail_people": "mail_people as (select o_orderkey as email_id, 'c:' || o_custkey as person_id, 'sender' as role from orders union all select distinct l_orderkey, 's:' || l_suppkey, l_returnflag from lineitem)",
    "mail_topics": "mail_topics as (select distinct l_orderkey as email_id, p_brand as topic from lineitem join part on l_partkey = p_partkey)",
    "actions": "actions as (select l_orderkey as email_id, 'task ' || l_partkey as task, 's:' || l_suppkey as owner, case when l_linenumber = 7 then 'asap' else strftime(l_shipdate, '%Y-%m-%d') end as deadline, "
    "case when l_linestatus = 'O' then 'open' else 'completed' end as status, l_linenumber as line from lineitem)",
    "decisions": "decisions as (select l_orderkey as email_id, 'part ' || l_partkey as decision, 's:' || l_suppkey as decided_by, case when l_linenumber % 2 = 0 then l_shipdate::date end as decision_date from lineitem where l_returnflag = 'R')",
    "messages": "messages as (select event_id, user_id as chat_id, ts as composed_at, event_type as sender, value, props from events)",
}


def with_views(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
