"""Preference formatting of chosen and rejected conversations, with DataFrame operations only.

The longest common prefix of turns (same role and text) is rendered once as the prompt. What follows on
either side is its completion, with a mask: the character spans, from 0, that a model is trained on, which
are the assistant's texts and their end marks; headers and other roles' turns are masked out.

A turn is rendered as `<|role|>\\n`, its text, `<|end|>\\n`. So that no text can forge a mark, `escaped` puts a
backslash into every `<|` of a role or text (and one more into every `<\\`, which makes it reversible).

Defined results. Turns are ordered by turn, then role, then text; a row that repeats counts once. Null role
or text is as ''. Rows without a conversation id are left out. A conversation on one side only is paired
with an empty one. Two equal conversations are a pair too, with all turns as prompt and both completions '': such
a pair prefers nothing, and with_equal=False leaves it out. A conversation becomes one row in any case, so its turns meet in one task; nothing else
does. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
_MARKS = "<|", "|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    """text without the beginning of a mark."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def conversations(turns: DataFrame, id_column: str = "conv_id", escape: bool = False) -> DataFrame:
    """conv_id and turns array<struct<turn, role, text>>, in order, of rows (conv_id, turn, role, text)."""

    def plain(c: str) -> Column:
        own = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return (escaped(own) if escape else own).alias(c)

    turn = F.struct(F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    return turns.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("conv_id")).agg(F.array_sort(F.array_distinct(F.collect_list(turn))).alias("turns"))


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(_MARKS[0]), t["role"], F.lit(_MARKS[1]), t["text"], F.lit(_MARKS[2]))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """Spans [start, stop) of trained characters in the rendered turns."""
    lead = sum(len(x) for x in _MARKS[:2])
    kind = "struct<at:long,spans:array<struct<start:long,stop:long>>>"

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + lead + F.length(t["role"])
        stop = start + F.length(t["text"]) + len(_MARKS[2])
        more = F.when(t["role"] == TRAINED, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:long,stop:long>>"))
        return F.struct(stop.alias("at"), F.concat(a["spans"], more).alias("spans")).cast(kind)

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans")).cast(kind), step, lambda a: a["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, with_equal: bool = True) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    chosen and rejected: conv_id (the pair's id on either side) and turns, as from conversations(). with_equal:
    whether pairs whose two sides are equal are among them.
    """
    none = F.array().cast("array<struct<turn:long,role:string,text:string>>")
    both = chosen.select("conv_id", F.col("turns").alias("c")).join(rejected.select("conv_id", F.col("turns").alias("r")), "conv_id", "full")
    both = both.select("conv_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(least).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("conv_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    if not with_equal:
        both = both.filter((F.size("c") > 0) | (F.size("r") > 0))
    return both.select(
        F.col("conv_id").alias("pair_id"), F.col("n").cast("long").alias("n_prompt_turns"), _text(F.col("p")).alias("prompt"),
        _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"),
    )


def span_text(spans: Column) -> Column:
    """Spans as text, start-stop with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")


def swapped_answers(convs: DataFrame) -> DataFrame:
    """Each conversation with its last assistant turn's text replaced by that of its neighbour.

    Neighbours are the conversations 2j and 2j + 1. A conversation without an assistant turn stays as it is;
    a neighbour that has none, or isn't there, gives ''. Ids are whole numbers.
    """
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)))
    rows = convs.select("conv_id", "turns", last.alias("last"))
    answers = rows.filter("last is not null").select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.expr("turns[last].text").alias("other"))
    rows = rows.join(answers, "conv_id", "left")
    new = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(t["text"]).alias("text")))
    return rows.select("conv_id", new.alias("turns"))
