"""Tables with nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""

LONG = "\n".join(f"line {i} of a long text, number {i % 97}" for i in range(20_000))

TEXTS = [
    (1, "the cat sat on the mat and the dog sat on the log\nshared line\nthe end of it", "en", "src1"),
    (2, "the cat sat on the mat and the dog sat on the log\n Shared Line \nthe end of it", "en", "src1"),
    (3, "le chat est sur la table et le chien est sous la table\nSHARED LINE\n", "fr", "src2"),
    (4, None, "en", None),
    (5, "", None, "src2"),
    (6, " \t\n\x0b\x0c\r ", "en", ""),
    (7, LONG, "en", "src1"),
    (8, "one", "en", "src3"),
    (8, "one", "en", "src3"),
    (None, "shared line\nélan Ünïcode ΑΣ Σ 漢字 🙂", "fr", "src3"),
    (10, "12 !! ?? 34", "de", "src9"),
    (11, "ab " * 4000, "de", "src1"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["h1", "key", "keep", "n", "kind", "cid", "root", "score", "ids", "failed", "order", "range", "tokens", "total", "__text", "__id", "text_hash"]


def documents(spark, rows=None):
    """The edge rows, with columns that operators might use inside."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(*r, 0) + ("x",) * len(CLASHES) for r in rows], COLUMNS + "".join(f", {c} string" for c in CLASHES))
