"""Text columns: folding, names, topics, HTML, URLs, file names. JVM-side unless marked as a UDF."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from mnemora.functions.fixed import GREEK_PAIRS, GREEK_SINGLES, NAME_NOTES, PERSONAL_DOMAINS, REPLY_PREFIXES, TRACKING_PARAMETERS, VIDEO_HOSTS


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Letters of all scripts whose decomposition is one letter and marks, and what stays; then all marks."""
    pairs, marks = {}, []
    for code in range(0xC0, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c):
            base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
            if len(base) == 1 and base != c:
                pairs[c] = base
    return "".join([*pairs, *marks]), "".join(pairs.values())


def strip_accents(text: Column) -> Column:
    """Letters without their marks (Mn), in all scripts. ASCII texts pass untouched.

    Where a mark stood between two signs that would compose without it, these stay apart: use
    strip_accents_all if that matters.
    """
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_fold_table())).otherwise(text)


@functools.cache
def _marks() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Mn"}


@pandas_udf(StringType())
def strip_accents_all(text: pd.Series) -> pd.Series:
    """UDF for all scripts: NFD, marks dropped, NFC."""
    marks = _marks()
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(marks)), na_action="ignore")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_topic(name: Column) -> Column:
    """One spelling for topics that differ in case, accents, separators and spaces."""
    return squeeze(F.regexp_replace(strip_accents(F.lower(F.trim(name))), r"[-_/.]+", " "))


def normalize_name(name: Column) -> Column:
    return squeeze(strip_accents(F.lower(F.trim(name))))


def transliterate(name: Column) -> Column:
    """Greek to Latin letters, lower case, without accents; letter pairs go first."""
    out = strip_accents(F.lower(name))
    for greek, latin in GREEK_PAIRS:
        out = F.replace(out, F.lit(greek), F.lit(latin))
    one = {g: l for g, l in GREEK_SINGLES.items() if len(l) == 1}
    for greek, latin in GREEK_SINGLES.items():
        if greek not in one:
            out = F.replace(out, F.lit(greek), F.lit(latin))
    return F.translate(out, "".join(one), "".join(one.values()))


def canonical_tokens(name: Column) -> Column:
    return F.sort_array(F.filter(F.regexp_extract_all(transliterate(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1))


def canonical_name(name: Column) -> Column:
    """A key that neither word order nor script changes."""
    return F.array_join(canonical_tokens(name), " ")


def surname_key(tokens: Column) -> Column:
    """The longest canonical token, the first of equal ones; '' without tokens."""
    longest = F.array_max(F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("t"))))
    return F.coalesce(longest["t"], F.lit(""))


def clean_name(name: Column) -> Column:
    """A name without a trailing note in brackets, if that is staff number, address, title or the like."""
    note = F.trim(F.regexp_extract(name, r"^.+?\s*\((.+?)\)\s*$", 1))
    bare = F.trim(F.regexp_extract(name, r"^(.+?)\s*\(.+?\)\s*$", 1))
    return F.when(note.rlike("(?iu)" + "|".join(f"(?:{x})" for x in NAME_NOTES)) & (note != ""), bare).otherwise(F.trim(name))


def name_rank(name: Column) -> Column:
    """Sorts spellings: mixed case, then accented Greek, then not all capitals, then longer."""
    n = F.trim(name)
    capitals = (n == F.upper(n)) & (n != F.lower(n))
    small = (n == F.lower(n)) & (n != F.upper(n))
    return F.struct((~capitals & ~small).alias("mixed"), n.rlike("[άέήίόύώ]").alias("accents"), (~capitals).alias("not_capitals"), F.length(n).alias("length"))


def is_personal(email: Column) -> Column:
    return F.lower(email).rlike("(?:" + "|".join(d.replace(".", r"\.") for d in PERSONAL_DOMAINS) + ")$")


def name_from_address(address: Column) -> Column:
    """First.Last@host as First Last; null if the part before @ has no dot."""
    parts = F.split(F.split_part(F.lower(address), F.lit("@"), F.lit(1)), r"\.")
    words = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000)))
    return F.when(F.size(parts) >= 2, F.array_join(words, " "))


def normalize_subject(subject: Column) -> Column:
    """A subject without reply and forward prefixes, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(subject), r"(?iu)^(?:\s*(?:" + "|".join(REPLY_PREFIXES) + r")\s*:\s*)+", "")))


def thread_key(conversation: Column, references: Column, reply_to: Column, subject: Column) -> Column:
    """16 hex digits of the first that is there: conversation, first reference, message replied to, subject."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    first = F.nullif(F.regexp_extract(F.coalesce(references, F.lit("")), r"^\s*(\S+)", 1), F.lit(""))
    basis = F.coalesce(blank(conversation), first, blank(reply_to), normalize_subject(F.coalesce(subject, F.lit(""))))
    return F.substring(F.sha2(basis.cast("binary"), 256), 1, 16)


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def unescape_common(text: Column) -> Column:
    """The entities that pages use most, JVM-side; the ampersand last, so nothing is unescaped twice."""
    for entity, letter in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


#: What `html.unescape` takes for an entity.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@pandas_udf(ArrayType(StringType()))
def _entities(found: pd.Series) -> pd.Series:
    """UDF: the letters of entities."""
    import html

    return found.map(lambda each: [html.unescape(x) for x in each], na_action="ignore")


def unescape_html(text: Column) -> Column:
    """All named and numeric entities as letters; only entities go to a UDF, texts don't."""
    gaps = F.split(text, _ENTITY, -1)
    rest = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    return F.concat(gaps[0], F.array_join(F.zip_with(_entities(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))), rest, lambda letter, gap: F.concat(letter, gap)), ""))


def html_text(html: Column, unescape=unescape_common) -> Column:
    """A page's text: styles, scripts and tags out, entities as letters, spaces squeezed."""
    text = F.regexp_replace(html, r"(?s)<style[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<script[^>]*>.*?</script>", "")
    return squeeze(unescape(F.regexp_replace(text, r"<[^>]+>", " ")))


def message_text(html: Column, unescape=unescape_html) -> Column:
    """A chat message's text: line breaks kept, other tags out; a < that opens no tag stays."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return F.coalesce(F.trim(unescape(F.regexp_replace(text, r"<(?=[a-zA-Z/!?])[^>]+>", ""))), F.lit(""))


def html_title(html: Column, unescape=unescape_common) -> Column:
    """The first title element; null without one."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), unescape(squeeze(title)))


def title_from_url(url: Column) -> Column:
    """The last path part as words; the host if there is no path."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+$", "")
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(path != "", F.initcap(F.translate(stem, "-_", "  "))).otherwise(F.try_parse_url(url, F.lit("AUTHORITY")))


def drop_tracking(url: Column) -> Column:
    """A URL without tracking parameters; what stays keeps its order."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING_PARAMETERS)), "&")
    return F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), F.regexp_extract(url, r"(#.*)$", 1))


def extract_urls(text: Column, host: str = r"[^\s\"'<>]+") -> Column:
    """Distinct, sorted URLs of a text on hosts that match, without tracking parameters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)https?://{host}/[^\s\"'<>]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda u: drop_tracking(F.regexp_replace(u, r"[.,;)\"'>]+$", "")))))


def video_id(url: Column) -> Column:
    """A video's id in the usual forms of its URLs; null for others."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    long_ = F.when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))).otherwise(some(F.regexp_extract(path, r"^/(?:embed|v|shorts)/([^/]+)", 1)))
    return F.when(host == VIDEO_HOSTS[0], some(F.regexp_extract(path, r"^/+([^/]+)", 1))).when(host.isin(*VIDEO_HOSTS[1:]), long_)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def contact_id(url: Column) -> Column:
    """What follows the last /contacts/ of a contact's URL; null without."""
    return F.when(url.contains("/contacts/"), F.substring_index(url, "/contacts/", -1))


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case ASCII words with hyphens, most characters at most."""
    plain = F.regexp_replace(strip_accents(F.lower(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, most), r"-+$", "")


@functools.cache
def _ascii_table() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatible form (NFKD) has one ASCII letter, these, and those that have several with them."""
    one, more = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        found = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if found:
            (one if len(found) == 1 else more)[chr(code)] = found
    return "".join(one), "".join(one.values()), more


def ascii_letters(text: Column) -> Column:
    """Letters in compatible form (NFKD) as far as ASCII has them."""
    letters, plain, more = _ascii_table()
    some = F.from_json(F.lit(json.dumps(more)), "map<string,string>")
    codes, other = sorted(map(ord, more)), r"[^\x00-\x7F]"
    first, last = [c for c in codes if chr(c - 1) not in more], [c for c in codes if chr(c + 1) not in more]
    # ranges, behind a look at whether it is ASCII: a class of many single letters would be searched for each letter
    several = f"(?={other})[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in zip(first, last)) + "]"
    pieces = lambda t: F.regexp_extract_all(t, F.lit(rf"{other}|[\x00-\x7F]+"), F.lit(0))
    spelled = lambda t: F.when(t.rlike(several), F.array_join(F.transform(pieces(t), lambda p: F.coalesce(F.try_element_at(some, p), p)), "")).otherwise(t)
    clean = lambda t: F.when(t.rlike(other), F.regexp_replace(t, other + "+", "")).otherwise(t)
    return F.when(text.rlike(other), F.transform(F.transform(F.array(F.translate(text, letters, plain)), spelled), clean)[0]).otherwise(text)


def file_slug(name: Column, most: int = 60) -> Column:
    """A file's name in lower case with underscores, most characters at most; a short extension at the end is kept."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(ascii_letters(name), r"[^\w\s.-]", ""), r"^\s+|\s+$", "")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"[\s\-_]+", "_"), r"\.+", ".")
    extension = F.regexp_extract(plain, r"\.([^.]{0,7})$", 1)
    stem = F.substr(plain, F.lit(1), F.lit(most - 1) - F.length(extension))
    cut = F.when(F.length(plain) <= most, plain).when(plain.rlike(r"\.[^.]{0,7}$"), F.concat(stem, F.lit("."), extension)).otherwise(F.substring(plain, 1, most))
    return F.regexp_replace(cut, r"^[._]+|[._]+$", "")


def is_noise(text: Column, least: int = 50, share: float = 0.1) -> Column:
    """Too short, or with too few letters and digits."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return (F.length(t) < least) | (letters < share * F.length(t))


def like(text: Column, part: str, raw: bool = False) -> Column:
    """Whether part is in text, whatever the case. raw: % and _ in part are wildcards."""
    return text.ilike(f"%{part}%") if raw else F.lower(text).contains(part.lower())


def embed_text(subject: Column, sender: Column, date: Column, summary: Column) -> Column:
    """What an e-mail's vector is made from; parts that are missing leave no separators."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    head = F.concat_ws(" · ", some(subject), some(sender), some(F.substring(date, 1, 10)))
    return F.concat_ws(" — ", F.nullif(head, F.lit("")), some(summary))


def id_kind(message_id: Column) -> Column:
    """numeric, document (negative), news or opaque."""
    return F.when(message_id.rlike(r"^\d+$"), "numeric").when(message_id.rlike(r"^-\d+$"), "document").when(message_id.startswith("news:"), "news").otherwise("opaque")


def document_id(content: Column) -> Column:
    """A standalone document's id: minus the first 15 hex digits of its hash."""
    return F.concat(F.lit("-"), F.conv(F.substring(F.sha2(content, 256), 1, 15), 16, 10))
