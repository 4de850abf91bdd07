"""Mixing sources to target weights by hierarchical budgets, with DataFrame operations only.

The token budget goes down a tree (domain, language, source, or any other columns). At each node it is
shared among the children in proportion to their weights. A child gets no more than its subtree holds
(tokens times max_epochs); what it leaves goes to its siblings in proportion, again and again, which is
solved in one pass over the children by rising capacity per weight. As a subtree's own capacity limits what
it gets, a shortage is first made up by siblings and reaches an ancestor only if all of them are full.

A leaf's tokens are whole epochs over all its documents, and of one more epoch the first documents in an
order seeded by (seed, epoch, doc_id) whose tokens fit. That prefix is found without sorting a leaf in one
task: a leaf's order is cut into equal ranges of RANGE_ROWS documents at most on average, whose tokens are
summed. The range where the budget ends is found from the top: of FAN large parts of the order, the one where
a running sum passes the budget, of its FAN parts again, and so on, so no task runs over more than FAN sums of
a leaf. Rows are only sorted in that one range.

Shortfall: documents are taken whole and the prefix ends at the first that does not fit, so a leaf leaves less than
that one document's tokens, and what it leaves goes to nobody. A small leaf with a long document early in its order
can thus leave most of its tokens (README.md has measured shares).

Children are ordered by tokens per weight exactly (whole part, then 18 digits), which holds for weights below
10 ** 9; larger ones are refused. The children of one node are shared out in one task: there are as many as
different values of a level under it, not rows.

Defined results. Weights are integers of 0 or more; a value without one has weight 1. Null and '' are one
value of a level. Nothing is taken from a leaf that gets no tokens. Shares are rounded down, so a node may
leave as many tokens as it has children. Rows without tokens (null or empty text) cost none and follow the
order. Repeated rows count each; equal order keys go by doc_id, then tokens, then what is carried. An empty table gives an empty
result. Only the columns asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm._shared import written

RANGE_ROWS = 256
#: Bits of a step in the search for the last range; FAN is 2 ** FAN_BITS.
FAN_BITS = 10
MOST_WEIGHT = 10**9
_ORDER_BITS = 60


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, cap, weight, total: the parent's tokens) with their own tokens as total."""
    by_room = Window.partitionBy(*parent).orderBy("room", "room_more", name)
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    rows = children.filter("weight > 0").withColumn("room", F.expr("cap div weight"))
    rows = rows.withColumn("room_more", F.expr("cast(cap % weight as decimal(19,0)) * 1000000000000000000 div weight"))
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(after))
    full = _big(F.col("cap")) * _big(F.col("weight_left")) <= _big(F.col("total") - F.col("cap_before")) * _big(F.col("weight"))
    rows = rows.withColumn("full", full)
    all_ = Window.partitionBy(*parent)
    rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0)))
    rows = rows.withColumn("weights", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_), F.lit(1)))
    got = F.expr("case when full then cap else least(cap, cast(rest as decimal(19,0)) * cast(weight as decimal(19,0)) div weights) end")
    return rows.select(*parent, name, got.cast("long").alias("total"))


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """levels, tokens, rows, total (tokens given) of every leaf. leaves: levels, tokens, rows; one row a leaf.

    budget is an aggregate expression over leaves, such as F.lit(10 ** 9) or F.sum("tokens") * 2.
    """
    if any(not 0 <= w < MOST_WEIGHT for level in weights for w in level.values()):
        raise ValueError(f"weights are from 0 to less than {MOST_WEIGHT}")
    total = leaves.agg(F.least(budget.cast("long"), F.sum(F.col("tokens") * max_epochs))).first()[0] or 0
    given = None
    for i, name in enumerate(levels):
        parent = levels[:i]
        nodes = leaves.groupBy(*levels[: i + 1]).agg((F.sum("tokens") * max_epochs).alias("cap"))
        own = F.create_map(*(F.lit(x) for kv in weights[i].items() for x in kv))[F.col(name)] if weights[i] else F.lit(None).cast("int")
        nodes = nodes.withColumn("weight", F.coalesce(own, F.lit(1)).cast("long"))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("total", F.lit(total))
        given = _share(nodes, parent, name)
    return leaves.join(given, levels, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def _last_range(ranges: DataFrame, names: list[str], most: int) -> DataFrame:
    """names, last (range, before: the tokens of earlier ranges) of leaves whose ranges hold more than rest."""
    last = None
    for depth in range(FAN_BITS, max(most, 1) + FAN_BITS, FAN_BITS):
        part = lambda d: F.expr(f"shiftright(range, greatest(bits - {d}, 0))")
        inside = ranges.withColumn("part", part(depth))
        if last is None:
            inside = inside.withColumn("before", F.lit(0).cast("long"))
        else:
            inside = inside.join(last, names).filter(part(depth - FAN_BITS) == F.col("last.range")).withColumn("before", F.col("last.before"))
        sums = inside.groupBy(*names, "part").agg(F.sum("sum").alias("sum"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("sum").over(Window.partitionBy(*names).orderBy("part")))
        first = F.min(F.struct(F.col("part").alias("range"), (F.col("upto") - F.col("sum")).alias("before")))
        last = sums.filter("upto > rest").groupBy(*names).agg(first.alias("last"))
    return last


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: Column, max_epochs: int = 1, seed: int = 0, tokens: Column | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, levels, tokens, copies (how often the document is taken) of every row of docs, and what carry names.

    levels: name to expression, from the root down. tokens: an expression; by default the number of words. carry:
    name to expression of small values that tell rows apart, such as a text's hash; the names are new ones.
    """
    names, carried = list(levels), list(carry or {})
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), (word_tokens(text) if tokens is None else tokens).alias("tokens"), *(c.alias(n) for n, c in (carry or {}).items()))
    slim = written(slim, "mixing-rows")
    leaves = slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    plan = leaf_budgets(leaves, names, weights, budget, max_epochs)
    plan = plan.withColumn("epochs", F.expr("case when tokens > 0 then total div tokens else 0 end"))
    plan = plan.withColumn("rest", F.col("total") - F.col("epochs") * F.col("tokens"))
    plan = plan.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / RANGE_ROWS))).cast("int"))
    plan = written(plan.select(*names, "total", "epochs", "rest", "bits"), "mixing-plan")

    order = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, _ORDER_BITS // 4), 16, 10).cast("long")
    rows = slim.join(plan, names).withColumn("order", order).withColumn("range", F.expr(f"shiftright(order, {_ORDER_BITS} - bits)"))
    ranges = written(rows.groupBy(*names, "range").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"), F.max("bits").alias("bits")), "mixing-ranges")
    most = ranges.agg(F.max("bits")).first()[0] or 0
    last = _last_range(ranges, names, most)
    rows = rows.join(last, names, "left").withColumn("edge", F.col("last.range"))
    columns = ["doc_id", *names, "tokens", *carried]
    taken = lambda more: F.when(F.col("total") > 0, F.col("epochs") + more.cast("long")).otherwise(F.lit(0)).cast("long").alias("copies")
    clear = rows.filter("edge is null or range <> edge").select(*columns, taken(F.col("edge").isNull() | (F.col("range") < F.col("edge"))))
    running = Window.partitionBy(*names).orderBy("order", "doc_id", "tokens", *carried).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.filter("range = edge").withColumn("upto", F.col("last.before") + F.sum("tokens").over(running)).select(*columns, taken(F.col("upto") <= F.col("rest")))
    return clear.unionByName(edge)
