import collections
import random
import re

from mnemora.llm import rules
from tests.llm.edge import TEXTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text or "")
    where = collections.defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    repeat = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def check(rows, got):
    want = []
    for i, text in rows:
        m = measures(text)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert not any(r.kept for r in got if r.base_failed)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        words = rng.choices(["a", "bé", "c#", "d🙂", "<e>", "\n", "\n\n"], k=rng.randint(0, 40))
        text = " ".join(words)
        rows.append((i, text + " " + text[: rng.randint(0, 60)] + "\tx " + text if i % 3 else text))
    check(rows, rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_edges(spark):
    check([(i, t) for i, t, _, _ in TEXTS], rules.verdicts(documents(spark)).collect())
    assert rules.verdicts(documents(spark).limit(0)).collect() == []


def test_policies_and_ablations(spark):
    rows = [(1, "one two"), (2, "$$$ " * 25), (3, " ".join(f"word{i}" for i in range(30))), (4, "# " * 3)]
    ledger = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = {p: {r.doc_id for r in ledger.filter(rules.passes(p)).collect()} for p in rules.POLICIES}
    assert kept["base"] == {3} and kept["v1"] == {3}
    for policy, names in rules.POLICIES.items():
        found = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(ledger, policy).collect()}
        bits = [r.failed & rules.mask(policy) for r in ledger.collect()]
        place = {n: 1 << i for i, n in enumerate(rules.RULES)}
        assert found == {n: (sum(b & place[n] > 0 for b in bits), sum(b == place[n] for b in bits)) for n in names}


def test_ablations_of_all_versions_equal_sql(spark):
    from mnemora.llm import queries
    from mnemora.session import reachable
    from tests.compare import both

    reachable(spark)
    got, want = both(spark, "rule_ablations", queries.MORE_QUERIES["rule_ablations"], queries.MORE_SQL["rule_ablations"])
    assert got == want and len(got) == sum(map(len, rules.POLICIES.values()))
