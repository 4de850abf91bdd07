from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import people as P


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, email string")


def pairs(df):
    return {(r.loser, r.survivor) for r in df.collect()}


def test_canonical_names(spark):
    names = ["Παπαδόπουλος Νίκος", "Νίκος Παπαδόπουλος", "Nikos Papadopoulos", "N. Papadopoulos", "Θεοχάρης Ψαρρός", "José Müller", ""]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.canonical_name(F.col("n")).alias("c")).collect()]
    assert got[:4] == ["nikos papadopoulos"] * 3 + ["papadopoulos"] and got[4:] == ["psarros theocharis", "jose muller", ""]


def test_clean_names(spark):
    cases = {"Ann Lee (E40220)": "Ann Lee", "Ann Lee (557)": "Ann Lee", "Ann Lee (a@b.c)": "Ann Lee", "Bob (via Tool)": "Bob", "Ann (Annie) ": "Ann (Annie)", "Δ Ε (ΔΙΕΥΘΥΝΤΗΣ)": "Δ Ε", " Solo ": "Solo"}
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", T.clean_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == cases


def test_topics(spark):
    cases = {"Cards Migration": "cards migration", "Cards-Migration": "cards migration", "cards_migration ": "cards migration", "Café/Ρεύμα..x": "cafe ρευμα x", "": ""}
    got = spark.createDataFrame([(n,) for n in cases], "n string").select("n", T.normalize_topic(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == cases


def test_phases(spark):
    df = table(spark, [(1, "Ann Lee", None), (2, "ann  lee", "ann@corp.example"), (3, "Ann", None), (4, "ΝΙΚΟΣ ΔΗΜΟΥ", None), (5, "Νίκος Δήμου", None)])
    assert pairs(P.into_addressed(df)[1]) == {(1, 2)}
    stay, merged = P.unaddressed(df)
    assert pairs(merged) == {(5, 4)} and {r.id: r.name for r in stay.collect()}[4] == "Νίκος Δήμου"
    df = table(spark, [(1, "Ann Lee", "a@gmail.com"), (2, "ANN LEE", "a@yahoo.gr"), (3, "Bob Ray", "b@gmail.com"), (4, "Bob Ray", "b@corp.example")])
    assert pairs(P.personal_addresses(df)[1]) == {(2, 1)}
    df = table(spark, [(1, "ann.lee@x.example", "ann.lee@x.example"), (2, "bob@x.example", None), (3, "Bob Ray", "BOB@x.example")])
    stay, merged = P.address_as_name(df)
    assert pairs(merged) == {(2, 3)} and {r.id: r.name for r in stay.collect()} == {1: "Ann Lee", 3: "Bob Ray"}
    df = table(spark, [(1, "A", " X@y.example"), (2, "Ann Lee", "x@y.example"), (3, "C", None)])
    stay, merged = P.same_address(df)
    assert pairs(merged) == {(2, 1)} and {r.id: r.name for r in stay.collect()}[1] == "Ann Lee"


def test_other_spellings_merge_unless_addresses_differ(spark):
    df = table(spark, [(1, "Παπαδόπουλος Νίκος", None), (2, "Nikos Papadopoulos", "n@x.example"), (3, "Ann Lee", "a@x.example"), (4, "Lee Ann", "b@x.example"), (5, "Nikos", None)])
    stay, merged = P.other_spelling(df)
    assert pairs(merged) == {(1, 2)} and stay.count() == 4


def test_resolution_is_idempotent_and_maps_compose(spark):
    rows = [(1, "Ann Lee (123)", None), (2, "ANN LEE", None), (3, "Lee Ann", "ann@x.example"), (4, "Bob", None), (5, "ann lee", "ANN@x.example ")]
    stay, merged = P.resolve(table(spark, rows))
    assert {r.survivor for r in merged.collect()} == {3} and {r.loser for r in merged.collect()} == {1, 2, 5}
    again, none = P.resolve(stay)
    assert none.collect() == [] and sorted(again.collect()) == sorted(stay.collect())


def test_fuzzy_pairs(spark):
    df = table(spark, [(1, "Nikos Papadopoulos", None), (2, "Papadopoulos", "p@x.example"), (3, "Nikolas Papadopoulos", None), (4, "Zoe Papadopoulos", "z@x.example"), (5, "Papadopoulos Nikos", None)])
    got = {(r.id_a, r.id_b): r.score for r in P.fuzzy_pairs(df).collect()}
    assert got[1, 2] == 0.9 and got[1, 3] > 0.9 and (1, 5) not in got and (2, 4) not in got


def test_reassign_and_topics(spark):
    links = spark.createDataFrame([(1, 10, "to"), (1, 11, "to"), (2, 11, "cc")], "email_id long, person_id long, role string")
    merged = spark.createDataFrame([(11, 10)], "loser long, survivor long")
    got = P.reassign(links, "person_id", merged, ["email_id", "person_id", "role"])
    assert {tuple(r) for r in got.select("email_id", "person_id", "role").collect()} == {(1, 10, "to"), (2, 10, "cc")}
    topics = spark.createDataFrame([(1, "cards-migration", "cards-migration"), (2, "cards migration", "Cards Migration!"), (3, "cards_migration", "x"), (4, "Solo-Topic", "Solo-Topic")], "id long, name string, display_name string")
    links = spark.createDataFrame([(3,), (3,), (1,)], "topic_id long")
    stay, merged = P.resolve_topics(topics, links)
    assert {tuple(r) for r in stay.collect()} == {(3, "cards migration", "Cards Migration!"), (4, "solo topic", "Solo-Topic")} and pairs(merged) == {(1, 3), (2, 3)}


def test_upserts_give_ids_in_order(spark):
    topics = spark.createDataFrame([(7, "budget", "Budget")], "id long, name string, display_name string")
    seen = spark.createDataFrame([("Digital-Banking", 2), ("BUDGET", 1), ("digital banking", 3), ("Zeta", 0)], "name string, n long")
    assert [tuple(r) for r in P.upsert_topics(topics, seen).orderBy("id").collect()] == [(7, "budget", "Budget"), (8, "zeta", "Zeta"), (9, "digital banking", "Digital-Banking")]


def test_import_and_lookup(spark):
    people = spark.createDataFrame([(1, "Ann L", "ann@x.example", None, None), (2, "Annie Lee", None, None, None), (3, "Bob", None, None, None)], "id long, name string, email string, role string, department string")
    canonical = spark.createDataFrame([("Ann Lee", "ANN@x.example", "cto", "it", ["Annie Lee", "A. Lee"]), ("Nobody", None, "x", "y", [])], "canonical_name string, email string, role string, department string, aliases array<string>")
    out, merged = P.import_people(people, canonical)
    assert pairs(merged) == {(2, 1)} and {r.id: (r.name, r.role) for r in out.collect()} == {1: ("Ann Lee", "cto"), 3: ("Bob", None)}
    who = "struct<name:string,address:string>"
    mails = spark.createDataFrame([(("Ann", "late@x"), [("Bob", "b@x")], [("ANN ", "cc@x")])], f"sender {who}, to_recipients array<{who}>, cc_recipients array<{who}>")
    assert {tuple(r) for r in P.addresses_by_name(mails).collect()} == {("ann", "late@x"), ("bob", "b@x")}
