"""Entity resolution: people and topics are merged by keys; merges are maps from loser to survivor.

People are rows (id, name, email). Every phase is a function of people that returns the people that stay and
a map (loser, survivor). Groups are aggregated, never gathered; maps are composed, so that a phase sees what
the one before it left. Nothing is written: a dry run is a run whose result isn't stored.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from mnemora.functions import text as T
from mnemora.functions.fixed import FUZZY_THRESHOLD
from mnemora.operators.joins import with_groups
from mnemora.operators.windows import numbered
from mnemora.session import remove, spread, stored

MAP = ["loser", "survivor"]


def _email(c: str = "email") -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is worked out once: a plan repeats a column's expression in each filter on it, but not a generator's."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _by_key(people: DataFrame, key: Column, eligible: Callable[[Column], Column], gate: Column | None = None, keep_email: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merges eligible people of equal key into the one with an e-mail and the least id, under the best name.

    eligible: a condition on a row and its key; gate: an aggregate condition over the group.
    """
    keyed = _once(people, "__any", key).withColumn("__key", F.when(eligible(F.col("__any")), F.col("__any"))).drop("__any")
    # equal ranks of names go to the first by id
    best = F.max_by("name", F.struct(T.name_rank(F.col("name")), -F.col("id")))
    groups = keyed.filter("__key is not null").groupBy("__key").agg(
        F.min(F.struct(F.col("email").isNull().alias("none"), F.col("id").alias("id"))).getField("id").alias("survivor"),
        best.alias("best"), F.min_by("email", F.when(F.col("email").isNotNull(), F.col("id"))).alias("some_email"),
        F.count(F.lit(1)).alias("n"), (F.lit(True) if gate is None else gate).alias("ok"),
    )
    whole = with_groups(keyed, groups.filter("n > 1 and ok"), ["__key"], "left")
    merged = whole.filter("survivor is not null and id <> survivor").select(F.col("id").alias("loser"), "survivor")
    name = F.when(F.col("id") == F.col("survivor"), F.col("best")).otherwise(F.col("name"))
    email = F.when(F.col("id") == F.col("survivor"), F.coalesce("email", "some_email")).otherwise(F.col("email")) if keep_email else F.col("email")
    stay = whole.filter("survivor is null or id = survivor").select("id", name.alias("name"), email.alias("email"))
    return stay, merged


def _two_words(key: Column) -> Column:
    return F.size(F.split(key, " ")) >= 2


def clean_names(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    return people.withColumn("name", T.clean_name(F.col("name"))), _none(people)


def _none(people: DataFrame) -> DataFrame:
    return people.limit(0).select(F.col("id").alias("loser"), F.col("id").alias("survivor"))


def into_addressed(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People without e-mail go into the first with one and the same name of two words or more."""
    keyed, key = _once(people, "__any", T.normalize_name(F.col("name"))), F.col("__any")
    known = keyed.filter("email is not null").groupBy(key.alias("__key")).agg(F.min("id").alias("survivor"))
    whole = keyed.withColumn("__key", F.when(F.col("email").isNull() & _two_words(key), key)).drop("__any")
    whole = with_groups(whole, known, ["__key"], "left")
    return whole.filter("survivor is null").select("id", "name", "email"), whole.filter("survivor is not null").select(F.col("id").alias("loser"), "survivor")


def unaddressed(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People without e-mail of the same name of two words or more become one."""
    key = T.normalize_name(F.col("name"))
    return _by_key(people, key, lambda k: F.col("email").isNull() & _two_words(k))


def personal_addresses(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People of the same name become one if all of their e-mails are personal ones."""
    key = T.normalize_name(F.col("name"))
    return _by_key(people, key, lambda k: F.col("email").isNotNull() & _two_words(k), F.bool_and(T.is_personal(F.col("email"))))


def address_as_name(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People named by an address go into its owner; without one, an address of two parts becomes a name."""
    key = F.lower(F.trim(F.col("name")))
    owners = people.filter(~F.col("name").contains("@") & F.col("email").isNotNull()).groupBy(F.lower("email").alias("__key")).agg(F.min("id").alias("survivor"))
    whole = people.withColumn("__key", F.when(F.col("name").contains("@"), key))
    whole = with_groups(whole, owners, ["__key"], "left")
    readable = F.when(F.col("__key").isNotNull() & (F.lower("email") == F.col("__key")), T.name_from_address(F.col("__key")))
    stay = whole.filter("survivor is null").select("id", F.coalesce(readable, F.col("name")).alias("name"), "email")
    return stay, whole.filter("survivor is not null").select(F.col("id").alias("loser"), "survivor")


def same_address(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _by_key(people, _email(), lambda k: k.isNotNull())


def other_spelling(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People of the same canonical name of two tokens or more become one, unless two e-mails tell them apart."""
    key = T.canonical_name(F.col("name"))
    return _by_key(people, key, _two_words, F.count_distinct(_email()) <= 1, keep_email=True)


PHASES = [clean_names, into_addressed, unaddressed, personal_addresses, address_as_name, same_address, other_spelling]


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The map that does first and then second."""
    later = second.select(F.col("loser").alias("survivor"), F.col("survivor").alias("__then"))
    return first.join(later, "survivor", "left").select("loser", F.coalesce("__then", "survivor").alias("survivor")).unionByName(second.select(*MAP))


def resolve(people: DataFrame, phases=PHASES, cut=stored) -> tuple[DataFrame, DataFrame]:
    """All phases in order. Each phase's result is stored, as the next one reads it several times."""
    total, people = _none(people), spread(people, "id")
    for phase in phases:
        people, merged = phase(people)
        total = cut(compose(total, merged))
        people = cut(people)
    return people, total


def reassign(rows: DataFrame, column: str, merged: DataFrame, key: list[str] | None = None) -> DataFrame:
    """rows with losers replaced by survivors; of rows that then agree on key, one stays."""
    out = rows.join(merged.select(F.col("loser").alias(column), "survivor"), column, "left").withColumn(column, F.coalesce("survivor", column)).select(rows.columns)
    return out.dropDuplicates(key) if key else out


def upsert_people(people: DataFrame, seen: DataFrame) -> DataFrame:
    """people with those of seen (name, email, n: order) added: by e-mail, else by exact name; longest names win."""
    new = seen.withColumn("email", _email())
    by_email = new.filter("email is not null").groupBy("email").agg(F.max_by("name", F.struct(F.length("name"), -F.col("n"))).alias("new_name"), F.min("n").alias("n"))
    longer = F.when(F.length("new_name") > F.length("name"), F.col("new_name")).otherwise(F.col("name"))
    old = people.join(by_email.select(F.col("email").alias("__mail"), "new_name"), _email() == F.col("__mail"), "left").select("id", longer.alias("name"), "email")
    mails = by_email.join(people.select(_email().alias("email")), "email", "left_anti").select(F.col("new_name").alias("name"), "email", "n")
    names = new.filter("email is null and name is not null").groupBy("name").agg(F.min("n").alias("n")).join(people.select("name"), "name", "left_anti").join(mails.select("name"), "name", "left_anti")
    fresh = mails.unionByName(names.select("name", F.lit(None).cast("string").alias("email"), "n"))
    return old.unionByName(with_ids(fresh, people, "n").select("id", "name", "email"))


def with_ids(fresh: DataFrame, old: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Ids for new rows, after the largest old one, in the order of a column; ranges are counted, not gathered.

    Rows are range-partitioned by order and stored with their partition, so that whoever reads them later, or
    again after a lost executor, finds each row where it was counted; equal orders go by the other columns. Each
    partition's count is a row, so only partitions meet in one task.
    """
    ranged = stored(fresh.repartitionByRange(order, *_others(fresh, order)).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order, *_others(fresh, order)))
    whole = ranged.withColumn("__place", place).join(F.broadcast(before), "__part").join(F.broadcast(top))
    return whole.withColumn(key, (F.col("__top") + F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__n", "__before", "__place", "__top")


def _others(df: DataFrame, but: str) -> list[str]:
    return [c for c in df.columns if c != but]


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """UDF: twice the matching letters over all letters (Ratcliff and Obershelp); no built-in measures it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _letters(canon: Column, surname: Column) -> Column:
    """A text's letters as a set of texts (how often so far, letter), those that are seldom first: equal letters differ by number.

    The surname's letters, which all of a block have, and a blank come last.
    """
    numbered = lambda letters: F.transform(letters, lambda x, i: F.concat(F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x)).cast("string"), x))
    of = lambda text: F.sort_array(F.transform(F.array(F.split(text, "")), numbered)[0], asc=False)
    parted = lambda x: F.concat(F.array_except(x["all"], x["last"]), F.array_intersect(x["all"], x["last"]))
    return F.transform(F.array(F.struct(of(canon).alias("all"), F.array_union(of(surname), F.array(F.lit("1 "))).alias("last"))), parted)[0]


#: A block of more people is dealt to tiles of so many.
_TILE = 1024


def _meeting(few: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """few and many (as "few" and "many") of one surname and key, each pair once.

    A block of several parts (column parts, one if there is none) is dealt to them by id on either side, and each part of the one
    meets each of the other by itself: no pair is left out, and what a task holds and compares at once does not grow with the block.
    """
    parts = lambda rows: F.col("parts") if "parts" in rows.columns else F.lit(1)
    dealt = lambda rows: rows.withColumn("own", F.pmod(F.xxhash64("id"), parts(rows)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), parts(rows) - 1)).alias("other"))
    same = [F.col(f"few.{a}") == F.col(f"many.{b}") for a, b in (("surname", "surname"), (key, key), ("own", "other"), ("other", "own"))]
    return dealt(few).alias("few").join(dealt(many).alias("many"), [*same, F.col("few.id") != F.col("many.id")])


def _alike(named: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a block whose letters allow a ratio of threshold.

    Of two texts of l and m letters at least threshold (l + m) / 2 must be in both, and m is l threshold / (2 - threshold)
    at least; so the first letters of both, in one order, as many as may be missing and one more, have one in common.
    """
    if "letters" not in named.columns:
        named = _once(named, "letters", _letters(F.col("canon"), F.col("surname")))
    whole = named.withColumn("length", F.size("letters"))
    least = F.ceil(F.col("length") * threshold / (2 - threshold) - 1e-9).cast("int")
    whole = whole.withColumn("first", F.slice("letters", F.lit(1), F.col("length") - least + 1))
    each = whole.select("*", F.explode("first").alias("letter"))
    pairs = _meeting(each, each, "letter").filter("few.id < many.id")
    # a pair counts at the first letter that both have
    pairs = pairs.filter(F.array_intersect("few.first", "many.first")[0] == F.col("few.letter"))
    both = F.size(F.array_intersect("few.letters", "many.letters"))
    return pairs.filter(2.0 * both >= threshold * (F.col("few.length") + F.col("many.length")) - 1e-9)


def _within(named: DataFrame) -> DataFrame:
    """Pairs of a block of which one's tokens are all among the other's: they meet at the longest token of the fewer beside the surname."""
    longest = lambda tokens: F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    few = named.withColumn("token", F.coalesce(longest(F.filter("tokens", lambda t: t != F.col("surname"))), "surname"))
    many = named.select("*", F.explode(F.array_distinct("tokens")).alias("token"))
    pairs = _meeting(few, many, "token")
    pairs = pairs.filter(F.size(F.array_except("few.tokens", "many.tokens")) == 0)
    # two with the same tokens find each other twice
    same = F.size(F.array_except("many.tokens", "few.tokens")) == 0
    return pairs.filter(~same | (F.col("few.id") < F.col("many.id")))


def fuzzy_pairs(people: DataFrame, threshold: float = FUZZY_THRESHOLD, block: int | None = None, most: int | None = None, tile: int = _TILE) -> DataFrame:
    """id_a, id_b, score of people who may be one, for review; best first.

    Only within blocks of people of one surname, whatever their size. Not if the keys are equal or e-mails differ. Only pairs
    whose letters allow the threshold are compared letter by letter.
    On request only blocks of at most block people, or the most best pairs: that leaves out the rest.
    """
    # stored, as tokens and letters are read by both searches, on each side
    named = _once(spread(people, "id").select("id", _email().alias("email"), "name"), "tokens", T.canonical_tokens(F.col("name"))).drop("name")
    named = named.withColumn("surname", T.surname_key(F.col("tokens"))).withColumn("canon", F.array_join("tokens", " "))
    named = stored(named.withColumn("letters", _letters(F.col("canon"), F.col("surname"))), "named").filter("surname <> ''")
    sizes = named.groupBy("surname").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2)
    sizes = sizes if block is None else sizes.filter(F.col("size") <= block)
    named = with_groups(named, sizes.select("surname", F.ceil(F.col("size") / tile).cast("int").alias("parts")), ["surname"])
    out = None
    a, b = (lambda name: F.col(f"few.{name}")), (lambda name: F.col(f"many.{name}"))
    for found, subset in ((_alike(named, threshold), False), (_within(named), True)):
        found = found.filter((a("canon") != b("canon")) & (a("email").isNull() | b("email").isNull() | (a("email") == b("email"))))
        if subset:
            part = found.select(F.least(a("id"), b("id")).alias("id_a"), F.greatest(a("id"), b("id")).alias("id_b"), F.lit(0.9).alias("score"))
        else:
            contained = (F.size(F.array_except(a("tokens"), b("tokens"))) == 0) | (F.size(F.array_except(b("tokens"), a("tokens"))) == 0)
            found = found.filter(~contained).select(a("id").alias("id_a"), b("id").alias("id_b"), a("canon").alias("ca"), b("canon").alias("cb"))
            # pairs of one large block are few bytes, and long work
            part = spread(found, "id_a", "id_b").select("id_a", "id_b", matching_ratio("ca", "cb").alias("score"))
        out = part if out is None else out.unionByName(part)
    out = out.filter(F.col("score") >= threshold)
    out = out.select("id_a", "id_b", F.bround("score", 3).alias("score")).orderBy(F.desc("score"), "id_a", "id_b")
    return out if most is None else out.limit(most)


def review_rows(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of fuzzy_pairs as rows of a review file, each with an empty decision; best first."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(people.select(F.col("id").alias(f"id_{side}"), F.col("name").alias(f"name_{side}"), F.col("email").alias(f"email_{side}")), f"id_{side}")
    columns = ["id_a", "name_a", "email_a", "id_b", "name_b", "email_b", "score"]
    return out.select(*columns, F.lit("").alias("decision")).orderBy(F.desc("score"), "id_a", "id_b")


def write_review(rows: DataFrame, path: str) -> None:
    """Review rows as one file of JSON lines in the folder at path: a person reads it from top to bottom."""
    rows.coalesce(1).sortWithinPartitions(F.desc("score"), "id_a", "id_b").write.mode("overwrite").option("ignoreNullFields", False).json(path)


REVIEW = "id_a long, name_a string, email_a string, id_b long, name_b string, email_b string, score double, decision string"


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a review file (or a folder of them), n: their order; lines that can't be read are left out.

    A large file is read by several tasks: lines go by the byte range they were read in, then by their place in it.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("n"), "value")
    rows = lines.filter("trim(value) <> ''").select("n", F.from_json("value", REVIEW).alias("r")).select("n", "r.*")
    return rows.filter("id_a is not null and id_b is not null")


def reviewed_merges(people: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The map (loser, last survivor) of reviewed pairs (id_a, id_b, decision 'merge') of people who are both there.

    Case and blanks around a decision don't matter. Pairs are taken in order of n (without one, by ids); a pair
    of which an earlier one merged somebody away is skipped. The survivor has an e-mail if only one of the two
    has, else it is the lesser id. Who would lose is known beforehand, so a decision waits only for earlier ones in which one of
    its two would lose: see _taken.
    """
    rows = reviewed.filter(F.lower(F.trim("decision")) == "merge").filter("id_a <> id_b")
    rows = rows.drop("email_a", "email_b") if "email_a" in rows.columns else rows
    for side in ("a", "b"):
        rows = rows.join(people.select(F.col("id").alias(f"id_{side}"), F.col("email").alias(f"email_{side}")), f"id_{side}")
    order = [F.col(c) for c in (*(["n"] if "n" in rows.columns else []), "id_a", "id_b")]
    none = lambda c: F.coalesce(_email(c), F.lit("")) == ""
    first = F.struct(none("email_a"), F.col("id_a")) < F.struct(none("email_b"), F.col("id_b"))
    rows = numbered(rows, "number", *order)
    rows = rows.select("number", F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("winner"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("loser"))
    into = _taken(stored(rows, "decisions")).select("loser", F.col("winner").alias("survivor"))
    while True:  # a survivor may have lost later
        into = stored(into, "merged")
        later = into.select(F.col("loser").alias("survivor"), F.col("survivor").alias("last"))
        if into.join(later, "survivor", "left_semi").isEmpty():
            return into.select(*MAP)
        into = into.join(later, "survivor", "left").select("loser", F.coalesce("last", "survivor").alias("survivor"))


def _taken(decisions: DataFrame) -> DataFrame:
    """Those of the decisions (number, winner, loser) that count when they are followed by number.

    One counts unless an earlier one that counts made its winner or loser lose. In each round a decision is settled if such a one
    counts, or if none that might is open; one that waits for a single other is the opposite of that one, so rows
    of decisions that wait for each other are settled together, by doubling.
    """
    open_, done, used = decisions, decisions.limit(0), []
    while True:
        first = open_.groupBy("loser").agg(F.min("number").alias("m1"))
        second = open_.join(first, "loser").filter("number > m1").groupBy("loser").agg(F.min("number").alias("m2"))
        marks = stored(first.join(second, "loser", "left").join(done.groupBy("loser").agg(F.min("number").alias("lost")), "loser", "full"), "marks", used)
        seen = open_
        for side in ("winner", "loser"):
            seen = seen.join(marks.select(F.col("loser").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("m1", "m2", "lost"))), side, "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("number"), F.lit(False))
        off = before("lost_winner") | before("lost_loser")
        waits = [F.when(before(c), 1).otherwise(0) for c in ("m1_winner", "m2_winner", "m1_loser", "m2_loser")]
        n = waits[0] + waits[1] + waits[2] + waits[3]
        state = F.when(off, "off").when(n == 0, "on").when(n == 1, "not").otherwise("open")
        on = F.when(state == "not", F.when(before("m1_winner"), F.col("m1_winner")).otherwise(F.col("m1_loser")))
        seen = stored(seen.select("number", "winner", "loser", state.alias("state"), on.alias("of")), "seen", used)
        # state "not": the opposite of decision `of`; "same": as that one
        while not seen.filter("state in ('not', 'same')").join(seen.filter("state <> 'open'").select(F.col("number").alias("of")), "of", "left_semi").isEmpty():
            other = seen.filter("state <> 'open'").select(F.col("number").alias("of"), F.col("state").alias("then"), F.col("of").alias("beyond"))
            flip = F.when(F.col("then") == "on", "off").when(F.col("then") == "off", "on").when(F.col("then") == "not", "same").otherwise("not")
            now = F.when(F.col("then").isNull(), F.col("state")).when(F.col("state") == "not", flip).otherwise(F.col("then"))
            to = F.when(F.col("then").isNull(), F.col("of")).otherwise(F.col("beyond"))
            chain = seen.filter("state in ('not', 'same')").join(other, "of", "left").select("number", "winner", "loser", now.alias("state"), to.alias("of"))
            seen = stored(chain.unionByName(seen.filter("state in ('on', 'off', 'open')")), "seen", used)
        counted = seen.filter("state = 'on'").select(decisions.columns)
        done = stored(done.unionByName(counted), "taken")
        open_ = stored(seen.filter("state not in ('on', 'off')").select(decisions.columns), "open")
        if open_.isEmpty():
            remove(decisions.sparkSession, used)
            return done


def resolve_topics(topics: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (id, name, display_name) under one key each, and the map; the most used stays, then the least id."""
    usage = links.groupBy(F.col("topic_id").alias("id")).agg(F.count(F.lit(1)).alias("usage"))
    keyed = topics.withColumn("canon", T.normalize_topic(F.col("name"))).join(usage, "id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)))
    groups = keyed.groupBy("canon").agg(
        F.max_by("id", F.struct("usage", -F.col("id"))).alias("survivor"),
        F.max_by("display_name", F.struct(F.length("display_name"), -F.col("id"))).alias("display_name"),
    )
    merged = keyed.join(groups, "canon").filter("id <> survivor").select(F.col("id").alias("loser"), "survivor")
    return groups.select(F.col("survivor").alias("id"), F.col("canon").alias("name"), "display_name"), merged


def upsert_topics(topics: DataFrame, seen: DataFrame) -> DataFrame:
    """topics with the names of seen (name, n: order) that none of them has; the first spelling is displayed."""
    new = seen.withColumn("key", T.normalize_topic(F.col("name"))).filter("key <> ''").groupBy("key").agg(F.min_by("name", "n").alias("display_name"), F.min("n").alias("n"))
    fresh = new.join(topics.select(F.col("name").alias("key")), "key", "left_anti")
    return topics.unionByName(with_ids(fresh, topics, "n").select("id", F.col("key").alias("name"), "display_name"))


def import_people(people: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """people with names, roles and departments of a canonical list, and the map of its aliases.

    canonical: canonical_name, email, role, department, aliases. Rows are found by e-mail, else by name; none
    are added. Aliases found by name go into the person.
    """
    by_mail = people.filter(_email().isNotNull()).groupBy(_email().alias("mail")).agg(F.min("id").alias("by_mail"))
    by_name = people.groupBy(T.normalize_name(F.col("name")).alias("norm")).agg(F.min("id").alias("by_name"))
    found = canonical.join(by_mail, F.lower(F.trim("email")) == F.col("mail"), "left").join(by_name, T.normalize_name(F.col("canonical_name")) == F.col("norm"), "left")
    found = found.withColumn("id", F.coalesce("by_mail", "by_name")).filter("id is not null").select("id", "canonical_name", "role", "department", "aliases")
    names = found.select(F.col("id").alias("survivor"), F.explode("aliases").alias("alias")).select("survivor", T.normalize_name(F.col("alias")).alias("norm"))
    merged = people.select(F.col("id").alias("loser"), T.normalize_name(F.col("name")).alias("norm")).join(names, "norm").filter("loser <> survivor").groupBy("loser").agg(F.min("survivor").alias("survivor"))
    new = found.select("id", "canonical_name", F.col("role").alias("new_role"), F.col("department").alias("new_department"))
    out = people.join(new, "id", "left").select(
        "id", F.coalesce("canonical_name", "name").alias("name"), "email", F.coalesce("new_role", "role").alias("role"), F.coalesce("new_department", "department").alias("department")
    )
    return out.join(merged.select(F.col("loser").alias("id")), "id", "left_anti"), merged


def addresses_by_name(messages: DataFrame) -> DataFrame:
    """name_key, address: the first address under a name, case aside, in senders, then receivers, then copies."""
    kinds = (("sender", 0), ("to_recipients", 1), ("cc_recipients", 2))
    out = None
    for column, place in kinds:
        one = F.explode(F.array("sender") if column == "sender" else F.coalesce(F.col(column), F.array())).alias("p")
        part = messages.select(one).select(F.lower(F.trim("p.name")).alias("name_key"), F.col("p.address").alias("address"), F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out.filter("name_key <> '' and address is not null").groupBy("name_key").agg(F.min(F.struct("place", "address")).getField("address").alias("address"))
