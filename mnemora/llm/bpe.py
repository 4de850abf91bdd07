"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

The vocabulary is read once on the driver (a bounded file) and broadcast. For a piece of text the
Aho-Corasick automaton over reversed tokens gives the longest token that starts at each place. The encoder
goes left to right with these, accepts a token only if it is compatible with the one before (no merge of
lower rank would have crossed their border), falls back to the next shorter prefix token, and steps back
where none fits. Places that were left once are marked, so each is entered a bounded number of times and
the result equals applying the merges by rank.

NFC, lower case, letters and digits are those of `unicodedata`. The tokenizers library has tables of its own,
of later versions of Unicode; so a text with a code point that `unicodedata` doesn't know is normalized and cut
into pieces (not encoded) by that library's normalizer and splitter. Tests compare every code point.

Defined results. A null or empty text has no ids and the decoded text ''. Repeated rows are encoded each, and
texts of any length whole. Special tokens in a text become their ids. An empty table gives an empty result.
Other columns are not read, whatever their names. A vocabulary file with another normalizer, splitting or
decoder than the one built here is refused.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm._shared import small_batches

#: Stands for the vocabulary's end-of-word mark while matching; no byte maps to it.
_END = ""
#: Pieces in each half of a Python worker's cache.
CACHE_PIECES = 200_000
#: Rows put together for one output batch.
BATCH_ROWS = 256


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: What `pieces` and `decode` do, as a vocabulary file states it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def read_vocabulary(path: str) -> dict:
    """The parts of a tokenizers JSON file that encoding needs; path is a local path on the driver.

    Raises ValueError if the file asks for anything that this module does otherwise.
    """
    with open(path, "rb") as f:
        return parse_vocabulary(f.read(), path)


def parse_vocabulary(data: bytes, path: str) -> dict:
    spec = json.loads(data)
    model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [x for x in steps if x["type"] == "Split"]
    same = spec["normalizer"] == _NORMALIZER and spec["decoder"] is None and len(split) == 1 and steps == [split[0], _BYTES]
    same = same and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True) and {k: model.get(k, v) for k, v in _PLAIN_MODEL.items()} == _PLAIN_MODEL
    if not same or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: another normalizer, splitting, model or decoder than this encoder's")
    pieces = [split[0]["pattern"]["Regex"]]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {
        "vocab": model["vocab"],
        "merges": merges,
        "end": model.get("end_of_word_suffix") or "",
        "pattern": pieces[0],
        "added": {x["content"]: x["id"] for x in spec["added_tokens"]},
    }


@functools.cache
def category_class(start: str) -> str:
    """The code points whose category in `unicodedata` begins so, as ranges of a pattern's class."""
    of = [unicodedata.category(chr(c)).startswith(start) for c in range(sys.maxunicode + 1)] + [False]
    starts = [c for c in range(len(of)) if of[c] and not (c and of[c - 1])]
    ends = [c for c in range(len(of) - 1) if of[c] and not of[c + 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class BacktrackingBPE:
    """Encoder and decoder for one vocabulary; built once per Python worker."""

    def __init__(self, spec: dict):
        end = spec["end"]
        inner = {(t[: -len(end)] + _END if end and t.endswith(end) else t): i for t, i in spec["vocab"].items()}
        self.text = {i: t for t, i in inner.items()}
        mark = lambda t: t[: -len(end)] + _END if end and t.endswith(end) else t
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.token_rank = dict.fromkeys(self.text, -1)
        for r, (a, b) in enumerate(spec["merges"]):
            a, b = mark(a), mark(b)
            pair, whole = (inner[a], inner[b]), inner[a + b]
            if pair not in self.rank:
                self.rank[pair], self.merged[pair] = r, whole
            if whole not in self.parts:
                self.parts[whole], self.token_rank[whole] = pair, r
        self.single = inner
        usable = {t: i for t, i in inner.items() if self._by_rank(t) == [i]}
        self.size = {i: len(t) for t, i in usable.items()}
        self.shorter = {}
        for t, i in usable.items():
            cut = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), None)
            self.shorter[i] = cut
        self.ends = bool(end)
        self.forward, self.automaton = ahocorasick.Automaton(), ahocorasick.Automaton()
        for t, i in usable.items():
            self.forward.add_word(t, i)
            self.automaton.add_word(t[::-1], i)
        self.forward.make_automaton()
        self.automaton.make_automaton()
        self.letters = byte_letters()
        whole = spec["pattern"].replace(r"\p{L}", category_class("L")).replace(r"\p{N}", category_class("N"))
        self.split = regex.compile(whole.replace(r"\s", r"\p{White_Space}"), regex.V0)
        # the same pattern for texts whose letters, digits and spaces are only these: re is faster than regex
        letters, digits, spaces = "A-Za-zÀ-ÖØ-öø-ɏ", "0-9", r"\t-\r "
        self.plain = re.compile(spec["pattern"].replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", spaces))
        self.rare = re.compile(f"[^\0-\x7f{letters}]")
        self.unknown = re.compile(f"[{category_class('Cn')}]")
        self.pattern = spec["pattern"]
        self.added = spec["added"]
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.compatible: dict[tuple[int, int], bool] = {}
        #: Pieces seen of late, and those seen before them; the older half goes when the newer is full.
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        top = max([*spec["vocab"].values(), *self.added.values()]) + 1
        self.number = list(range(top))  # one object for a number, however many cached pieces hold it
        names = [b""] * top
        for t, i in [*spec["vocab"].items(), *self.added.items()]:
            names[i] = t.encode()
        #: Token i with a space behind it is blob[offset[i]:offset[i + 1]].
        self.offset = np.zeros(top + 1, np.int64)
        np.cumsum([len(x) + 1 for x in names], out=self.offset[1:])
        self.blob = np.frombuffer(b"".join(x + b" " for x in names), np.uint8)

    def _symbols(self, word: str) -> list[int]:
        """The base tokens of a word; the last letter and the end mark are one."""
        out = list(word[:-2]) + [word[-2:]] if word.endswith(_END) and len(word) > 1 else list(word)
        return [self.single[x] for x in out] if all(x in self.single for x in out) else []

    def _by_rank(self, word: str) -> list[int]:
        """The definition: again and again merge the leftmost pair of lowest rank. Used to check tokens."""
        out = self._symbols(word)
        while len(out) > 1:
            r, at = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(out, out[1:])))
            if r == 1 << 60:
                break
            out[at : at + 2] = [self.merged[out[at], out[at + 1]]]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart when merges run by rank.

        The border is undone merge by merge, the latest first. At each step the two tokens that touch the
        border would have merged if their pair has a merge that comes before whatever built on them next.
        """
        key = (left, right)
        if (known := self.compatible.get(key)) is not None:
            return known
        a, b, ok = left, right, True
        #: Merges of this rank or later had no chance: a (b) was taken up by the merge of rank a_used (b_used).
        a_used = b_used = 1 << 60
        while True:
            r = self.rank.get((a, b))
            # a pair that includes the border merges first if its rank is below b's next merge, and, being
            # further left, also at the same rank; against a's next merge, which lies further left, it must be below
            if r is not None and r < a_used and r <= b_used:
                ok = False
                break
            ra, rb = self.token_rank[a], self.token_rank[b]
            if ra < 0 and rb < 0:
                break
            # undo the merge that ran last; at the same rank the right one ran last
            if ra > rb:
                a_used, a = ra, self.parts[a][1]
            else:
                b_used, b = rb, self.parts[b][0]
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        word = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        if self.ends:
            word += _END
        # the encoder takes these, the longest token at each place, until a border doesn't hold
        first = [token for _, token in self.forward.iter_long(word)]
        known, last = self.compatible, -1
        for token in first:
            ok = last < 0 or known.get((last, token))
            if not (self.fits(last, token) if ok is None else ok):
                return self._backtrack(word)
            last = token
        return first if sum([self.size[x] for x in first]) == len(word) else self._backtrack(word)

    def _backtrack(self, word: str) -> list[int]:
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        longest: list[int | None] = [None] * n
        for at, token in self.automaton.iter(word[::-1]):
            at = n - 1 - at
            if longest[at] is None or size[token] > size[longest[at]]:
                longest[at] = token
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token is not None:
                stop = at + size[token]
                if open_[stop] and (stop == n or longest[stop] is not None) and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token is None:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
            else:
                out.append(token)
                at = stop
                token = longest[at] if at < n else None
        return out

    def pieces(self, text: str) -> list[str]:
        """The normal form's pieces. Runs of white space only separate, so they needn't be put together first."""
        if self.rare.search(text) and self.unknown.search(text):
            return self._later_pieces(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: a word's last sigma is as any other
        text = text.replace("Σ", "σ").lower()
        return (self.split if self.rare.search(text) else self.plain).findall(text)

    @functools.cached_property
    def _later(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)

    def _later_pieces(self, text: str) -> list[str]:
        """Pieces by the library's own tables of code points."""
        normal, split = self._later
        return [piece for piece, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def piece(self, piece: str) -> tuple[int, ...] | list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.older.get(piece) or self.encode_piece(piece)
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.older, self.cache = self.cache, {}
                self.cache[piece] = ids = tuple(map(self.number.__getitem__, ids))
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.added_split.split(text or "") if self.added_split else [text or ""]):
            if k % 2:
                out.append(self.added[part])
                continue
            pieces = self.pieces(part)
            found = list(map(self.cache.get, pieces))
            if None in found:
                found = [self.piece(p) if ids is None else ids for p, ids in zip(pieces, found)]
            out.extend(chain.from_iterable(found))
        return out

    def decode(self, ids) -> bytes:
        """Tokens joined by a space, by slices of the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1])][:-1].tobytes()


_built: dict[str, BacktrackingBPE] = {}


def _coder(shared) -> BacktrackingBPE:
    """One coder per Python worker and vocabulary."""
    path, data = shared.value
    if path not in _built:
        _built.clear()
        _built[path] = BacktrackingBPE(parse_vocabulary(data, path))
    return _built[path]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary for all executors: one file of a tokenizer, 2 MB here, whatever the input's size.

    The file's bytes are sent, so that a worker keeps its coder alone and not also what it was made from.
    """
    read_vocabulary(path)  # an error comes before any task runs
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def encode(docs: DataFrame, vocabulary, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> for every row of docs (doc_id, text); with decoded, also the text of those ids.

    A null or empty text has no ids and the decoded text ''. Repeated rows are encoded each. Other columns
    of docs are not read, whatever their names. No shuffle: a row is read, encoded and passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                ids = [np.array(coder.encode(t), np.int32) for t in batch.column(1).to_pylist()]
                out = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    out.append(pa.array([coder.decode(x) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary) -> DataFrame:
    """doc_id, decoded string for every row of rows (doc_id, ids); null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(k, BATCH_ROWS)
                text = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, decoded string")


def digests(docs: DataFrame, vocabulary, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and if asked for ids, of every row of docs."""
    rows = encode(docs, vocabulary, decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
    )
