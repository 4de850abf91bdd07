"""Quality rules as a bitmask ledger, with DataFrame operations only.

Every rule is evaluated once for each document. The ledger, a written table, holds the measurements and one
bit per failed rule. Policies, by version, only combine bits; ablations (what a rule alone rejects) are counts
of masked bits, so neither reads a text again.

Measurements: n_words (words `[^\\x20\\x09-\\x0D]+`), word_chars (code points in words), n_symbols (characters
of `[#*$%&|<>]`), n_dup_lines (\\n-split lines with a word, equal to an earlier line), n_repeat_words (words
in 8-word windows found twice or more in the text, the first included).

Repeated windows: windows are hashed to 64 bits; only if two hashes of a text are equal are they sorted with
their positions. Windows of equal hashes are then sorted by their words, so that a collision of hashes repeats
nothing, and the words covered by repeated windows are summed up over neighbouring positions.

Defined results. A null text has no words: all measurements are 0, and it fails the rules on words. Rules
hold for each row by itself, so repeated rows, ids or null ids don't matter. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm._shared import written

#: Words of a window, a power of two.
WINDOW = 8
_WORD, _SPACE, _SYMBOL = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"

#: Rule name to the condition under which a text fails; a rule's bit is its place here, so add at the end only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
#: Policy version to the rules that it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
    "v2": ("few_words", "repeated_windows", "short_words", "symbols", "repeated_lines"),
}


def mask(policy: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def _neighbours(array: Column, f) -> Column:
    n = F.size(array)
    return F.zip_with(F.slice(array, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(array, F.lit(2), F.greatest(n - 1, F.lit(0))), f)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and failed (the bits of failed rules) of every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("__text", _SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(_WORD)).alias("__lines"),
        F.regexp_count("__text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
    )
    n = F.size("__words")
    rows = rows.select(
        "doc_id",
        "__words",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    # hashes of 2, 4 and 8 neighbouring words, each from two of the ones before
    size = 1
    while size < WINDOW:
        behind = F.slice("__hashes", F.lit(size + 1), F.greatest(F.size("__hashes") - size, F.lit(0)))
        front = F.slice("__hashes", F.lit(1), F.greatest(F.size("__hashes") - size, F.lit(0)))
        rows = rows.withColumn("__hashes", F.zip_with(front, behind, lambda a, b: F.xxhash64(a, b)))
        size *= 2
    rows = rows.withColumnRenamed("__hashes", "__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size("__windows") > F.size(F.array_distinct("__windows"))
    rows = rows.withColumn("__placed", F.when(some, placed))
    twice = lambda sorted_, key: F.array_distinct(F.flatten(_neighbours(sorted_, lambda a, b: F.when(a[key] == b[key], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
    # the words of windows whose hash repeats; others can't repeat
    rows = rows.withColumn("__same", F.array_sort(F.transform(twice(F.col("__placed"), "h"), lambda i: F.struct(F.array_join(F.slice("__words", i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("i")))))
    rows = rows.withColumn("__at", F.array_sort(twice(F.col("__same"), "w")))
    covered = F.aggregate(_neighbours(F.col("__at"), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.when(F.size("__at") > 0, covered).otherwise(F.lit(0)).cast("long"))
    failed = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("failed"))


def passes(policy: str, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed (rows failing it), n_only (rows that only it rejects) under a policy, from a ledger.

    Bits are first counted by value, at most one row for each combination of rules, then spread by rule.
    """
    combos = rows.select(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(RULES) if name in POLICIES[policy]))
    each = combos.select("bits", "n", F.explode(names).alias("r"))
    zero = F.lit(0)
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(zero)).alias("n_only"),
    )


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger of every row of docs with base_failed and kept (passes the base and the given policy)."""
    return judged(written(ledger(docs), "ledger"), policy)


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger under a policy: base_failed, kept."""
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes(policy)).alias("kept"), "failed")
