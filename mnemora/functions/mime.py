"""Messages as trees of parts: headers, nested boundaries, transfer encodings and character sets, all of it built-in functions.

Bytes are carried as texts of ISO-8859-1, where a letter is a byte, until a part's own character set is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.session import stored

_BYTES = "ISO-8859-1"
#: The upper half of the Greek Windows character set, as letters of ISO-8859-1 and what they stand for.
_UPPER = bytes(range(128, 256)).decode("latin-1")
_GREEK = bytes(range(128, 256)).decode("cp1253", "replace")


def _cut(text: Column, begin: Column, length: Column) -> Column:
    """A text's bytes from begin (from 1). Letters would have to be counted from the start of the text, and for its length once more."""
    return F.substr(text.cast("binary"), begin, length).cast("string")


def decoded(content: Column, charset: Column | None = None) -> Column:
    """A binary as text: by its character set if it is one of those known here, else UTF-8 if it is that, else ISO-8859-1."""
    utf8, latin = content.cast("string"), F.decode(content, _BYTES)
    found = F.when(F.is_valid_utf8(utf8), utf8).otherwise(latin)
    if charset is None:
        return found
    name = F.lower(charset)
    return F.when(name.isin("windows-1253", "cp1253", "iso-8859-7"), F.translate(latin, _UPPER, _GREEK)).when(name.isin("iso-8859-1", "latin-1", "windows-1252"), latin).otherwise(found)


def _unquoted(text: Column, mark: str = "=") -> Column:
    """Bytes of a text in which =XX is a byte; other marks stay. A run of such bytes is one piece, and so is what lies between two."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?:{mark}\\p{{XDigit}}\\p{{XDigit}})++|[^{mark}]++|{mark}"), F.lit(0))
    piece = lambda t: F.when(t.startswith(mark) & (t != mark), F.replace(t, F.lit(mark), F.lit(""))).otherwise(F.hex(F.encode(t, _BYTES)))
    return F.unhex(F.array_join(F.transform(pieces, piece), ""))


def _unbase64(text: Column) -> Column:
    whole = lambda t: F.substr(t, F.lit(1), F.length(t) - F.when(F.length(t) % 4 == 1, 1).otherwise(0))
    padded = lambda t: F.concat(t, F.repeat(F.lit("="), F.pmod(-F.length(t), F.lit(4))))
    # a lambda's argument is computed once, however often it is used
    bare = F.rtrim(F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("="))
    # replacing by a pattern takes many times as long as looking for it: only where ends of lines were not all
    clean = lambda t: F.when(t.rlike("[^A-Za-z0-9+/]"), F.regexp_replace(t, "[^A-Za-z0-9+/]+", "")).otherwise(t)
    letters = F.transform(F.transform(F.transform(F.array(bare), clean), whole), padded)[0]
    # what is written as it should be needs no cleaning; else nothing is left in it that could fail
    return F.coalesce(F.try_to_binary(text, F.lit("base64")), F.unbase64(letters))


def _joined(body: Column) -> Column:
    """A quoted-printable text without its soft ends of lines, by a pattern only where they are not all alike."""
    has = lambda mark: body.contains(mark)
    mixed = has("= ") | has("=\t") | (has("=\n") & has("=\r\n"))
    alike = F.when(has("=\n"), F.replace(body, F.lit("=\n"), F.lit(""))).otherwise(F.replace(body, F.lit("=\r\n"), F.lit("")))
    return F.when(mixed, F.regexp_replace(body, "=[ \\t]*\\r?\\n", "")).otherwise(alike)


def body_bytes(body: Column, encoding: Column) -> Column:
    """The bytes of a part's body by its transfer encoding."""
    kind = F.lower(F.trim(encoding))
    return F.when(kind == "base64", _unbase64(body)).when(kind == "quoted-printable", _unquoted(_joined(body))).otherwise(F.encode(body, _BYTES))


_WORD = r"=\?([^?]+)\?([BbQq])\?([^?]*)\?="


def header_text(value: Column) -> Column:
    """A header's value with its encoded words read; white space between two of them is none."""
    whole = F.regexp_replace(value, r"(=\?[^?]+\?[BbQq]\?[^?]*\?=)\s+(?==\?)", "$1")
    gaps, words = F.split(whole, _WORD), F.regexp_extract_all(whole, F.lit(_WORD), F.lit(0))
    of = lambda w, i: F.regexp_extract(w, _WORD, i)
    read = lambda w: decoded(F.when(F.lower(of(w, 2)) == "b", _unbase64(of(w, 3))).otherwise(_unquoted(F.translate(of(w, 3), "_", " "))), of(w, 1))
    return F.concat(decoded(F.encode(gaps[0], _BYTES)), F.array_join(F.transform(words, lambda w, i: F.concat(read(w), F.coalesce(decoded(F.encode(F.get(gaps, i + 1), _BYTES)), F.lit("")))), ""))


def _lines(head: Column) -> Column:
    """(k, v) of a head's lines in their order, names in lower case; lines that go on are one."""
    lines = F.filter(F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: x.rlike(r"^[!-9;-~]+[ \t]*:"))
    return F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([!-9;-~]+)", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[!-9;-~]+[ \t]*:", "")).alias("v")))


def _named(pairs: Column) -> Column:
    """map of names to values; of a repeated name the first counts."""
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda o: o["k"] == p["k"])))


def parameter(value: Column, name: str) -> Column:
    """A parameter of a header's value; '' if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(value, rf'(?i)[;\s]{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(value, rf'(?i)[;\s]{name}\s*=\s*([^";\s]+)', 1), F.lit(""))


def _extended(value: Column, name: str) -> Column:
    """A parameter that is written as charset'language'text with %XX; '' if there is none."""
    raw = F.regexp_extract(parameter(value, rf"{name}\*"), r"^([^']*)'[^']*'(.*)$", 2)
    return decoded(_unquoted(raw, "%"), F.nullif(F.regexp_extract(parameter(value, rf"{name}\*"), r"^([^']*)'", 1), F.lit("")))


def _read(rows: DataFrame, part: Column) -> DataFrame:
    """rows with the headers and the body (text) of a part; one that begins with an empty line has no head.

    Each step is a generator's column: it is computed once for a row, however often it is used behind.
    """
    none = F.regexp_extract(F.substring(part, 1, 2), r"^\r?\n", 0)
    # bound to the beginning, as a split goes on looking for more ends behind the last one it needs
    cut = F.when(none == "", F.split(part, r"(?s)\A.*?\r?\n\r?\n", 2)).otherwise(F.array(F.lit(""), _cut(part, F.length(none) + 1, F.octet_length(part))))
    kept = rows.columns
    rows = rows.select(*kept, F.explode(F.array(cut)).alias("cut"))
    text = F.coalesce(F.get("cut", F.lit(1)), F.lit(""))
    head = F.when(none != "", "").when(F.size("cut") < 2, part).otherwise(_cut(part, F.lit(1), F.octet_length(part) - F.octet_length(text)))
    rows = rows.select(*kept, text.alias("text"), F.explode(F.array(_lines(head))).alias("lines"))
    return rows.select(*kept, "text", F.explode(F.array(_named(F.col("lines")))).alias("headers"))


def _children(level: DataFrame, key: str) -> DataFrame:
    """level with every part that is still a text in `part` read: it becomes a node, and what lies in it rows with a `part`.

    A row of a level that is a node already stays as it is. A multipart's text is cut once at all its edges: the search
    begins with a fixed text, which Java looks for in leaps. What is before the first edge or behind the closing one is no part.
    """
    rows = _read(level, F.col("part"))
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col("headers")["content-type"], r"^\s*([^;\s]+)", 1)), F.lit("")), F.lit("text/plain"))
    rows = rows.select(key, "path", "node", "headers", "text", F.col("part").isNull().alias("done"), F.explode(F.array(F.struct(kind.alias("kind"), parameter(F.col("headers")["content-type"], "boundary").alias("edge")))).alias("is"))
    inner = F.when(F.col("done"), "done").when(F.col("is.kind") == "message/rfc822", "message").when(F.col("is.kind").startswith("multipart/") & (F.col("is.edge") != ""), "parts").otherwise("none")
    rows = rows.withColumn("inner", inner)
    quoted = F.concat(F.lit("\n--\\Q"), F.replace(F.col("is.edge"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?=(?:--)?[ \\t]*(?:\\r?\\n|$))"))
    rows = rows.withColumn("pieces", F.explode(F.array(F.when(F.col("inner") == "parts", F.split(F.concat(F.lit("\n"), "text"), quoted)))))
    found = F.slice("pieces", F.lit(2), F.size("pieces") - 1)
    closing = F.array_position(F.transform(found, lambda p: p.startswith("--")), True)
    last = F.size("pieces") - 1
    rows = rows.withColumn("kept", F.when(closing > 0, closing.cast("int") - 1).otherwise(last))
    # a part begins behind its edge's line; an end of line before an edge is the edge's
    begin = lambda p: F.octet_length(F.substring_index(p, "\n", 1)) + 2
    less = lambda p, i: F.when(p.endswith("\r") & (i + 1 < last), 1).otherwise(0)
    body = lambda p, i: _cut(p, begin(p), F.greatest(F.octet_length(p) - begin(p) + 1 - less(p, i), F.lit(0)))
    node = F.struct("headers", F.col("is.kind").alias("type"), "inner", F.when(F.col("inner") == "none", F.col("text")).alias("text"))
    row = lambda path, part, node: F.struct(path.alias("path"), part.cast("string").alias("part"), node.alias("node"))
    none = F.lit(None)
    itself = F.array(row(F.col("path"), none, F.when(F.col("done"), F.col("node")).otherwise(node)))
    below = F.transform(F.slice("pieces", F.lit(2), F.col("kept")), lambda p, i: row(F.concat("path", F.array(i + 1)), body(p, i), none.cast(level.schema["node"].dataType)))
    message = F.array(row(F.concat("path", F.array(F.lit(1))), F.col("text"), none.cast(level.schema["node"].dataType)))
    all_ = F.when(F.col("inner") == "parts", F.concat(itself, below)).when(F.col("inner") == "message", F.concat(itself, message)).otherwise(itself)
    return rows.select(key, F.explode(all_).alias("row")).select(key, "row.*")


_NODE = "struct<headers:map<string,string>,type:string,inner:string,text:string>"
#: So many levels of nesting are read before rows are written; deeper ones take another pass.
_LEVELS = 4


def _nodes(messages: DataFrame, key: str, content: str) -> DataFrame:
    """key, path, type, inner, filename, disposition, headers, body of every part of messages, also of those that have parts (inner is not 'none', no body).

    Written once, with bodies decoded; only texts nested deeper than a pass reads are written as they are, and read again.
    """
    out = None
    # a generator's column: a filter on the content itself would be put before a shuffle of messages, and work them out there as well
    level = messages.select(F.col(key), F.array().cast("array<int>").alias("path"), F.explode(F.array(F.decode(content, _BYTES))).alias("part"), F.lit(None).cast(_NODE).alias("node")).filter("part is not null")
    while True:
        for _ in range(_LEVELS):
            level = _children(level, key)
        h = F.col("node.headers")
        # the first of the four ways to write a name, each of them read once
        given = lambda value, name: [F.when(value.contains("*"), _extended(value, name)), header_text(parameter(value, name))]
        names = F.array(*given(h["content-disposition"], "filename"), *given(h["content-type"], "name"))
        name = F.coalesce(F.get(F.filter(names, lambda x: x != ""), F.lit(0)), F.lit(""))
        named = h["content-disposition"].rlike(r"(?i)name") | h["content-type"].rlike(r"(?i)name")
        disposition = F.coalesce(F.lower(F.regexp_extract(h["content-disposition"], r"^\s*([^;\s]+)", 1)), F.lit(""))
        body = body_bytes(F.col("node.text"), F.coalesce(h["content-transfer-encoding"], F.lit("")))
        rows = stored(level.select(key, "path", "part", "node.type", "node.inner", F.when(named, name).otherwise("").alias("filename"), disposition.alias("disposition"), "node.headers", body.alias("body")), "parts")
        done = rows.filter("part is null").drop("part")
        out = done if out is None else out.unionByName(done)
        level = rows.filter("part is not null")
        if level.isEmpty():
            return out
        level = level.select(key, "path", "part", F.lit(None).cast(_NODE).alias("node"))


def mime_parts(messages: DataFrame, key: str, content: str) -> DataFrame:
    """key, path (places from 1), type, filename, disposition, headers, body (binary) of the parts that have no parts.

    Containers that are broken off end where the text does. A null message has no parts; one without a boundary it names is a part itself.
    """
    return _nodes(messages, key, content).filter("inner = 'none'").drop("inner")


def message_texts(messages: DataFrame, key: str, content: str) -> DataFrame:
    """key, text of messages: subject, sender and date, and the first plain part that is no attachment, else the first HTML one."""
    nodes = _nodes(messages, key, content)
    shown = (F.col("inner") == "none") & F.col("type").isin("text/plain", "text/html") & (F.col("disposition") != "attachment")
    body = F.struct("type", "body", F.nullif(parameter(F.col("headers")["content-type"], "charset"), F.lit("")).alias("charset"))
    # only what is shown is read as a text
    first = nodes.groupBy(key).agg(F.min_by("headers", F.size("path")).alias("h"), F.min_by(F.when(shown, body), F.when(shown, F.struct(F.col("type") != "text/plain", F.col("path")))).alias("first"))
    first = first.select(key, "h", "first.type", F.explode(F.array(decoded(F.col("first.body"), F.col("first.charset")))).alias("body"))
    line = lambda name: F.coalesce(header_text(F.col("h")[name]), F.lit("N/A"))
    head = F.concat(F.lit("Subject: "), line("subject"), F.lit("\nFrom: "), line("from"), F.lit("\nDate: "), line("date"), F.lit("\n"))
    text = F.when(F.col("type") == "text/html", T.html_text(F.col("body"))).otherwise(F.col("body"))
    return first.select(key, F.concat(head, F.coalesce(F.concat(F.lit("\n"), text), F.lit(""))).alias("text"))
