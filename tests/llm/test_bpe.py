import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemora.llm import bpe
from tests.llm.edge import TEXTS, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.BacktrackingBPE(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


def test_equals_the_library(both):
    mine, library = both
    rng = random.Random(1)
    letters = "abcdethinsgrou'  " + "éßÜΣσİ漢🙂\x00\x7f\x85 ²½"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("aetinsorhl") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>a<|startoftext|> b<|ENDOFTEXT|>", "it's I'LL 'S", "a" * 5000, "ab" * 3000, "ＡＢ é́"]
    texts += [t or "" for _, t, _, _ in TEXTS]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(text)
        assert ids == want.ids, text[:80]
        assert mine.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_backtracking_equals_merging_by_rank(both):
    mine, _ = both
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("theraionds") for _ in range(rng.randint(1, 14))) + ""
        assert mine._backtrack(word) == mine._by_rank(word)


def test_rows(spark, both):
    _, library = both
    df = documents(spark)
    vocabulary = bpe.broadcast_vocabulary(spark, PATH)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, vocabulary).collect()), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, text, _, _ in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert bpe.digests(df.limit(0), vocabulary).collect() == []
    ids = bpe.encode(df, vocabulary)
    assert {r.decoded for r in bpe.decode(ids.filter("doc_id = 8"), vocabulary).collect()} == {"one</w>"}


def test_every_code_point(both):
    mine, library = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("ab{0}cd 1", "A{0}{0}1{0}"):
        texts = ["\n".join(form.format(chr(c)) for c in points[k : k + 64]) for k in range(0, len(points), 64)]
        wrong = [k for k, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))) if mine.encode(text) != want.ids]
        assert [hex(points[64 * k]) for k in wrong] == []


def test_sequences_of_code_points_from_any_plane(both):
    mine, library = both
    rng = random.Random(12)
    known = [0x41, 0xE9, 0x301, 0x307, 0x345, 0x3A3, 0x1100, 0x1161, 0x0BC6, 0x0BBE, 0x20, 0x0A, 0x85, 0xA0, 0x2028, 0x130, 0xB2]
    later = [*range(0x105C0, 0x105F4), *range(0x11380, 0x113D5), *range(0x16100, 0x1613A), *range(0x16D40, 0x16D7A), *range(0x10D40, 0x10D86), 0x0897, 0x1C89, 0xA7CB, 0x16EA0]
    points = [chr(c) for c in known + later]
    texts = ["".join(rng.choices(points, k=rng.randint(1, 8))) for _ in range(20_000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(6)) if not 0xD800 <= c < 0xE000) for _ in range(20_000)]
    wrong = [text for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if mine.encode(text) != want.ids]
    assert [list(map(hex, map(ord, t))) for t in wrong[:5]] == []


def test_another_normalizer_is_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "x.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.read_vocabulary(str(tmp_path / "x.json"))
