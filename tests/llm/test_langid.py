import math
import random

import numpy as np

from mnemora.llm import langid
from tests.llm.edge import documents

WORDS = {"en": "the and of with ring tion ness shall", "fr": "le des été où çoise naux eaux tion", "de": "der und über straße heit keit tion"}


def corpus(spark, n=240):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 30))), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def code_length(data: bytes, counts: dict, lang: int, order: int) -> float:
    """The definition, byte by byte."""
    total = 0.0
    for i in range(len(data)):
        for k in range(min(order, i), -2, -1):
            if k < 0:
                total += 8
                break
            ctx = data[i - k : i]
            seen = {s[-1]: n for (l, s), n in counts.items() if l == lang and len(s) == k + 1 and s[:-1] == ctx}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += -math.log2(seen[data[i]] / (n + d))
                break
            total += -math.log2(d / (n + d))
    return total


def test_code_lengths_equal_the_definition():
    order, counts, table = 3, {}, []
    for lang, text in enumerate(["abracadabra banana", "cabbage ababab baggage"]):
        data = langid._CODED[np.frombuffer(text.encode(), np.uint8)].tobytes()
        for k in range(order + 1):
            for i in range(len(data) - k):
                counts[lang, data[i : i + k + 1]] = counts.get((lang, data[i : i + k + 1]), 0) + 1
    for (lang, s), n in counts.items():
        table.append((lang, len(s), int.from_bytes(s, "big"), n))
    trees = langid.Trees(["x", "y"], table, order)
    texts = [b"abracadabra", b"", b"zebra bag", b"ab\xc3\xa9 cab", b"q"]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = trees.bits(np.frombuffer(b"".join(texts), np.uint8), offsets)
    coded = [langid._CODED[np.frombuffer(t, np.uint8)].tobytes() for t in texts]
    want = [[code_length(t, counts, lang, order) for lang in (0, 1)] for t in coded]
    assert np.allclose(got, want, atol=1e-3)


def test_long_texts_are_coded_in_pieces(monkeypatch):
    data = np.frombuffer(b"the cat and the dog " * 50, np.uint8)
    table = [(0, k + 1, int.from_bytes(bytes(data[i : i + k + 1]), "big"), 1) for k in range(3) for i in range(200)]
    trees = langid.Trees(["x"], table, 2)
    whole = trees.bits(data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert np.allclose(trees.bits(data, np.array([0, len(data)])), whole)


def test_held_out_accuracy(spark):
    df, rows = corpus(spark)
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(df)).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held and all(got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    df, _ = corpus(spark)
    trees = langid.learn(df)
    rows = documents(spark)
    got = langid.predict(rows, trees, carry=["text", "kind"]).collect()
    assert len(got) == rows.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6, 10}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.predict(rows.limit(0), trees).collect() == []
    none = langid.predict(rows, langid.learn(rows.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    df, _ = corpus(spark)
    wrong = df.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'zz' else lang end as lang")
    assert langid.learn(wrong).languages == ["de", "en", "fr"]


def test_more_strings_than_sixteen_bits_number():
    """Every string of a sample is kept: 5-byte strings beyond 65,536 code as the definition says."""
    rng = random.Random(9)
    order, counts, contexts = 4, {}, {}
    data = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(90_000))
    for k in range(order + 1):
        for i in range(len(data) - k):
            s = data[i : i + k + 1]
            counts[s] = counts.get(s, 0) + 1
    for s, n in counts.items():
        contexts.setdefault(s[:-1], {})[s[-1]] = n
    assert sum(len(s) == order + 1 for s in counts) > 1 << 16
    trees = langid.Trees(["x"], [(0, len(s), int.from_bytes(s, "big"), n) for s, n in counts.items()], order)

    def definition(text: bytes) -> float:
        total = 0.0
        for i in range(len(text)):
            for k in range(min(order, i), -1, -1):
                seen = contexts.get(text[i - k : i])
                if seen is None:
                    continue
                n, d = sum(seen.values()), len(seen)
                if text[i] in seen:
                    total -= math.log2(seen[text[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        return total

    texts = [data[:5000], data[-5000:], bytes(rng.choice(b"abcxyz ") for _ in range(3000))]
    got = trees.bits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))[:, 0]
    assert np.allclose(got, [definition(t) for t in texts], rtol=1e-5)


def test_contexts_are_as_long_as_a_number_holds():
    import pytest

    with pytest.raises(ValueError):
        langid.Trees(["x"], [], 7)


def test_learn_and_decide_against_brute_force(spark):
    df, rows = corpus(spark, 60)
    import zlib

    counts = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            data = langid._CODED[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
            for k in range(3):
                for j in range(len(data) - k):
                    key = (sorted(WORDS).index(lang), data[j : j + k + 1])
                    counts[key] = counts.get(key, 0) + 1
    got = {r.doc_id: r for r in langid.predict(df, langid.learn(df, 10**6, 2)).collect()}
    for i, text, _ in rows[:25]:
        data = langid._CODED[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
        bits = [code_length(data, counts, lang, 2) for lang in range(3)]
        assert got[i].lang_pred == sorted(WORDS)[int(np.argmin(bits))]
        assert abs(got[i].score - 1 / sum(2.0 ** (min(bits) - b) for b in bits)) < 1e-3
        assert abs(got[i].bits_per_byte - min(bits) / len(data)) < 1e-3
