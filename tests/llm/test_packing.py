import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemora.llm import bpe, packing
from mnemora.llm._shared import written
from tests.llm.edge import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def least(sizes, capacity):
    """The fewest sequences, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(120))
def test_what_is_fixed_costs_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 30])
    sizes = [rng.randint(rng.choice([1, capacity // 4, capacity // 3]), capacity) for _ in range(rng.randint(0, 11))]
    fixed, rest = packing.reduce(Counter(sizes), capacity)
    assert all(sum(x * k for x, k in p) <= capacity for p, _ in fixed)
    taken = Counter(x for p, n in fixed for x, k in p for _ in range(n * k))
    assert taken + Counter(rest) == Counter(sizes)
    assert sum(n for _, n in fixed) + least(list(Counter(rest).elements()), capacity) == least(sizes, capacity)


def plain_best_fit(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        k = min((k for k in range(len(rooms)) if rooms[k] >= x), key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 50, 2048])
    sizes = [min(capacity, 1 + int(rng.expovariate(1) * capacity / rng.choice([2, 5]))) for _ in range(rng.randint(0, 500))]
    plan = packing.best_fit(Counter(sizes), capacity)
    rooms = sorted(capacity - sum(x * k for x, k in p) for p, n in plan for _ in range(n))
    assert Counter(x for p, n in plan for x, k in p for _ in range(n * k)) == Counter(sizes)
    assert rooms == plain_best_fit(sizes, capacity)


def test_patterns_stay_few():
    rng = random.Random(0)
    counts = {x: rng.randint(1, 10**9) for x in range(1, 2049)}
    plan = packing.patterns(counts)
    total = sum(x * n for x, n in counts.items())
    assert len(plan) < 4 * 2048
    assert sum(n for _, n in plan) <= -(-total // 2048) * 1.01
    places = packing.Places(plan)
    for x in (1, 7, 1024, 2048):
        sequence, offset = places.of(x, np.array([0, counts[x] // 2, counts[x] - 1]))
        assert (sequence >= 0).all() and (sequence < places.sequences).all() and (offset + x <= 2048).all()


def check(rows, docs, capacity):
    """rows hold every document whole and fill sequences without gaps."""
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    order = lambda r: (r[0] is None, *r[:0], str(r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_edges(spark, capacity):
    docs = documents(spark)
    vocabulary = bpe.broadcast_vocabulary(spark, PATH)
    rows = packing.packed(docs.repartition(3), vocabulary, capacity).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n = check(rows, texts, capacity)
    sizes = [r.length for r in rows]
    assert -(-sum(sizes) // capacity) <= n <= len(plain_best_fit(sizes, capacity))
    assert packing.packed(docs.limit(0), vocabulary).collect() == []


def test_one_length_in_many_tasks_and_sequences(spark):
    rows = [(i, "one two three" if i % 3 else f"text {i} of some words") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    vocabulary = bpe.broadcast_vocabulary(spark, PATH)
    found = packing.packed(docs, vocabulary, 64)
    n = check(found.collect(), rows, 64)
    whole = {r.sequence_id: r for r in packing.sequences(found).collect()}
    assert len(whole) == n and all(len(r.ids) <= 64 and r.starts[0] == 0 for r in whole.values())
    assert all(list(whole[r.sequence_id].ids[r.offset : r.offset + r.length]) == r.ids for r in found.collect())


def test_bad_lengths_are_refused(spark):
    rows = written(spark.createDataFrame([(1, 0, 0, 99)], "doc_id long, part int, nth long, length long"), "bad")
    with pytest.raises(ValueError):
        packing.pack(rows, 64)


def test_ids_of_words_are_those_of_texts():
    coder = bpe.BacktrackingBPE(bpe.read_vocabulary(PATH))
    with open(PATH, "rb") as f:
        packer, rng = packing._Packer(coder, f.read()), random.Random(3)
    marks = [*"abcdeXYZ0123 \n\t.,!'-_éÀßÿİıſKÅẞΣ漢🙂", "\x1c", "\x85", "\u00a0", "\u2028", "e\u0301", "'s", "'RE", " <|endoftext|> ", "<|startoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["", "x" * 5000, "the end. " * 2000]
    for text in texts * 2:
        assert packer.ids(text) == np.array(coder.encode(text), "<u4").tobytes(), text
