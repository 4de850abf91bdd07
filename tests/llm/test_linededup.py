import collections
import random
import zlib

import numpy as np
import pytest

from mnemora.llm import linededup
from tests.llm.edge import documents

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, keep_first):
    rows = [(i, t or "") for i, t in rows]
    where = collections.defaultdict(list)
    for doc in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        for k, line in enumerate(doc[1].split("\n")):
            if key := line.strip(SPACES).translate(LOWER):
                where[key].append((doc, k))
    drop = {x for places in where.values() if len({d for d, _ in places}) >= min_docs for x in places[keep_first:]}
    out = []
    for doc in rows:
        lines = doc[1].split("\n")
        kept = [x for k, x in enumerate(lines) if (doc, k) not in drop]
        out.append((doc[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,keep_first", [(2, False), (2, True), (1, True), (4, False), (4, True)])
@pytest.mark.parametrize("partitions", [1, 13])
def test_against_brute_force(spark, min_docs, keep_first, partitions):
    rng = random.Random(min_docs)
    lines = ["Common", " common\t", "é", "x" * 50, "", "  "] + [f"rare {i}" for i in range(60)]
    weights = [30, 20, 5, 5, 5, 5] + [1] * 60
    rows = [(i, "\n".join(rng.choices(lines, weights, k=rng.randint(0, 9)))) for i in range(300)]
    rows += [(7, "common"), (None, "Common\nrare 1"), (400, None), (401, "common\n" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bitmaps = linededup.keep_bitmaps(df, min_docs, keep_first=keep_first)
        got = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in linededup.apply_bitmaps(df, bitmaps).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    if keep_first:  # the order of rows that share an id or have none is by a hash of the text
        ties = {7, None}
        assert [r for r in got if r[0] not in ties] == [r for r in brute(rows, min_docs, keep_first) if r[0] not in ties] or min_docs == 1
        assert [r[2] for r in got] == [r[2] for r in brute(rows, min_docs, keep_first)] or min_docs == 1
    else:
        assert got == brute(rows, min_docs, keep_first)


def test_first_occurrences_only(spark):
    df = spark.createDataFrame([(2, "a\nb\na"), (1, "b\nc\nB "), (3, "c")], "doc_id long, text string")
    bitmaps = linededup.keep_bitmaps(df, 1, keep_first=True)
    assert {r.doc_id: r.kept_text for r in linededup.apply_bitmaps(df, bitmaps).collect()} == {1: "b\nc", 2: "a", 3: ""}
    bits = {r.doc_id: np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8))[: r.n_lines].tolist() for r in bitmaps.collect()}
    assert bits == {1: [1, 1, 0], 2: [1, 0, 0], 3: [0]}


def test_edges(spark):
    df = documents(spark)
    got = linededup.digests(df, min_docs=3).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_lines, by[1].n_dropped, by[3].n_dropped, by[4].n_lines, by[5].n_dropped) == (3, 1, 1, 1, 0)
    assert by[None].n_dropped == 1 and by[7].n_dropped == 0
    assert linededup.digests(df.limit(0)).collect() == []


def test_short_keys_stay(spark):
    df = spark.createDataFrame([(i, "é\nab") for i in range(5)], "doc_id long, text string")
    assert {(r.n_lines, r.n_dropped) for r in linededup.digests(df, 2, min_chars=2).collect()} == {(2, 1)}
