import collections
import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.edge import documents
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_neardup import brute as near_brute


def corpus(spark):
    words = {"en": "the river and the old stone house stood there with green windows", "fr": "la rivière et la vieille maison de pierre était là avec des fenêtres vertes"}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        own = " ".join(f"{w}{chr(97 + (i * 7 + j) % 26)}" for j, w in enumerate(words[lang].split() * 3))
        rows.append((i, f"{own}\ncommon footer line\n{words[lang]} {chr(97 + i % 26)}", lang, f"src{i % 5}"))
    rows += [(200 + i, rows[1][1], "en", "src1") for i in range(15)]  # exact copies
    rows += [(300, rows[2][1].replace("oldc", "olde", 1), "en", "src2"), (301, "12 34", "en", "src1"), (302, None, None, None)]
    return documents(spark, rows).select(pipeline.COLUMNS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = pipeline.language_id(spark, docs, str(tmp_path))
    before, after = rows_of(docs), rows_of(first)
    assert {r[0] for r in before} - {r[0] for r in after} == {301, 302}
    assert {(r[0], r[1]) for r in after} <= {(r[0], r[1]) for r in before}
    first = spark.createDataFrame(after, first.schema)
    second = pipeline.line_dedup(spark, first, "")
    want = {(r[0], r[1]) for r in line_brute([(r[0], r[1]) for r in after], pipeline.MIN_DOCS, True) if r[3] == 0 or r[1].split()}
    got = rows_of(second)
    assert {(r[0], r[1]) for r in got} == want and all(len(r[1]) == r[4] for r in got)
    assert 1 in {r[0] for r in got}  # of copies one stays
    third = pipeline.near_dedup(spark, second, "")
    kept = {r[0] for r in near_brute([(r[0], r[1]) for r in got], pipeline.SHINGLE_WORDS, pipeline.PERCENT) if r[3]}
    assert {r[0] for r in rows_of(third)} == kept and 300 not in kept
    fourth = pipeline.mix(spark, third, "")
    mixed = rows_of(fourth)
    tokens = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert set(mixed) < set(rows_of(third)) and 0.7 <= tokens(mixed) / tokens(rows_of(third)) <= 0.8
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: r for r in pipeline.encode(spark, fourth, "").collect()}
    assert {i: r.ids for i, r in last.items()} == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in mixed}
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in last.values())
    whole = collections.Counter((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert set(whole.values()) == {1} and len(whole) == len(last)


def test_edges(spark):
    docs = documents(spark)
    plain = docs.select(pipeline.COLUMNS)
    for name, stage in pipeline.STAGES[1:]:
        for df in (docs, plain, plain.limit(0)):
            out = stage(spark, df, "")
            rows = out.collect()
            assert out.columns == pipeline.COLUMNS or name == "bpe"
            assert rows or not df.count()


def test_mixing_goes_by_row_and_keeps_its_budget(spark):
    """Rows without a doc_id share in the budget, two texts of one id are chosen each, equal rows together."""
    rows = [(i % 40 if i % 5 else None, f"w{i} " * (3 + i % 9), "en", f"s{i % 3}", 0) for i in range(200)] + [(None, "same text here", "en", "s1", 0)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(rows_of(pipeline.mix(spark, docs, "")))
    all_ = collections.Counter(rows)
    size = lambda c: sum(len(r[1].split()) * n for r, n in c.items())
    assert got <= all_ and 0.7 * size(all_) < size(got) <= 0.8 * size(all_)
    assert all(n == all_[r] for r, n in got.items())
    assert 0 < sum(r[0] is None for r in got) < sum(r[0] is None for r in all_)
    texts = collections.defaultdict(set)
    for r in got:
        texts[r[0]].add(r[1])
    assert any(i is not None and 0 < len(t) < 4 for i, t in texts.items())


def test_all_stages_on_edges(spark, tmp_path):
    """Nulls, empties, repeats, a long text and no rows through the whole pipeline."""
    edges = documents(spark).select(pipeline.COLUMNS).union(corpus(spark).withColumn("doc_id", F.col("doc_id") + 10_000)).union(documents(spark).select(pipeline.COLUMNS).filter("doc_id = 8"))
    for name, df in (("edges", edges), ("none", edges.limit(0))):
        (tmp_path / name).mkdir()
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = collections.Counter(r.doc_id for r in out)
        assert (len(out) > 50 and not {4, 5, 6} & set(ids) and all(n == 1 for i, n in ids.items() if i is not None)) if name == "edges" else out == []


def test_language_id_against_the_definition(spark):
    """Stage 1 keeps the rows, with the language, that code lengths by definition decide on."""
    import zlib

    import numpy as np
    from tests.llm.test_langid import code_length

    docs = corpus(spark).limit(60)
    rows = rows_of(docs)
    langs = sorted({r[2] for r in rows})
    counts = collections.Counter()
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            data = pipeline.langid._CODED[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
            counts.update((langs.index(lang), data[j : j + k + 1]) for k in range(5) for j in range(len(data) - k))
    got = {r[0]: r[2] for r in rows_of(pipeline.language_id(spark, docs, ""))}
    for i, text, *_ in rows[:12]:
        data = pipeline.langid._CODED[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
        own = {k: v for k, v in counts.items()}
        bits = [code_length(data, own, lang, 4) for lang in range(len(langs))]
        best = int(np.argmin(bits))
        sure = 1 / sum(2.0 ** max(-1000, min(bits) - b) for b in bits) >= pipeline.LEAST_SCORE and min(bits) / len(data) <= pipeline.MOST_BITS
        assert got.get(i) == (langs[best] if sure else None)
