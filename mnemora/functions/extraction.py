"""Extraction answers: tolerant JSON, coercion to one schema, checks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from mnemora.functions.fixed import LANGUAGES, SENTIMENTS, URGENCIES

PERSON_ITEM = "struct<{}>"
SCHEMA = (
    "summary string, topics array<string>, decisions array<struct<decision:string,decided_by:string,decision_date:string>>, "
    "action_items array<struct<task:string,owner:string,deadline:string,status:string>>, commitments array<struct<commitment:string,by:string,to:string>>, "
    "people_roles map<string,string>, sentiment string, urgency string, language string, key_facts array<string>, references array<string>"
)
_NAMES = {"decided_by", "owner", "by", "to"}
_ITEMS = {"decisions": ("decision", "decided_by", "decision_date"), "action_items": ("task", "owner", "deadline", "status"), "commitments": ("commitment", "by", "to")}


_SCALAR = json.JSONDecoder(strict=False)
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)


class _Cut(Exception):
    """The text ends within a value, of which nothing can be kept."""


def _beginning(text: str, at: int) -> tuple[object, int, bool]:
    """The value that begins at a place, where it ends, and whether it is whole; ValueError where no JSON text goes on so."""
    at = _next(text, at)
    mark = text[at : at + 1]
    if mark == '"':
        m = _TEXT.match(text, at)
        return _letters(m[1]), m.end(), bool(m[2])
    if mark not in ("{", "["):
        try:
            value, end = _SCALAR.raw_decode(text, at)
        except ValueError:
            if not text[at:].strip("truefalsn-"):  # half a word at the end
                raise _Cut from None
            raise
        if end < len(text) and not text[end:].strip("-+.0123456789eE"):  # half a number
            raise _Cut
        return value, end, True
    out, at = ({} if mark == "{" else []), at + 1
    while True:
        at = _next(text, at)
        if at == len(text):
            return out, at, False
        if text[at] == ("}" if mark == "{" else "]"):
            return out, at + 1, True
        if out:
            if text[at] != ",":
                raise ValueError(f"no comma at {at}")
            at += 1
        try:
            key = None
            if mark == "{":
                key, at, whole = _beginning(text, at)
                at = _next(text, at)
                if not whole or at == len(text):
                    raise _Cut
                if not isinstance(key, str) or text[at] != ":":
                    raise ValueError(f"no key at {at}")
                at += 1
            value, at, whole = _beginning(text, at)
        except _Cut:
            return out, len(text), False
        out.__setitem__(key, value) if mark == "{" else out.append(value)
        if not whole:
            return out, len(text), False


def _next(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def _letters(inner: str) -> str:
    """A string's text, less an escape that was cut off at its end."""
    if "\\" not in inner:
        return inner
    for less in range(7):
        try:
            return json.loads(f'"{inner[: len(inner) - less]}"', strict=False)
        except ValueError:
            continue
    return inner


def kept(text: str) -> dict | None:
    """What a cut-off JSON object holds whole, and the last string as far as it goes; None if it isn't cut off."""
    try:
        value, _, whole = _beginning(text, 0)
    except (ValueError, _Cut, RecursionError):
        return None
    return None if whole else value


def loads(raw: str | None) -> dict | None:
    """The object in an answer, whatever stands around it; None if none can be had."""
    if raw is None:
        return None
    text = re.sub(r"```(?:json)?[ \t]*", "", raw).strip()
    begin = text.find("{")
    if begin < 0:
        return None
    text = text[begin:]
    whole = text[: text.rfind("}") + 1]
    for candidate in (whole, text) if whole and whole != text else (text,):
        tidy = re.sub(r'(["}\]])[ \t]*\n\s*(?=["{\[])', r"\1,\n", re.sub(r",(?=\s*[}\]])", "", candidate))
        # what doesn't end as an object does can be none
        for attempt in dict.fromkeys((candidate, tidy)) if candidate[-1] == "}" else ():
            try:
                found = json.loads(attempt)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
        if (found := kept(tidy)) is not None:
            return found
    return None


def _plain(value, name: str) -> str | None:
    """A scalar: of lists the names joined, else the first; null and empty as None."""
    if isinstance(value, list):
        value = ", ".join(str(x) for x in value if x) if name in _NAMES else next((x for x in value if x), None)
    if value is None or value == "":
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def coerce(data: dict) -> dict:
    """One shape for all answers: bare items become structs, scalars lose their lists, words their case."""
    out = {"summary": _plain(data.get("summary"), "summary") or ""}
    for key in ("topics", "key_facts", "references"):
        value = data.get(key) or []
        out[key] = [x for x in (_plain(v, key) for v in (value if isinstance(value, list) else [value])) if x]
    for key, names in _ITEMS.items():
        rows = data.get(key) or []
        out[key] = []
        for row in rows if isinstance(rows, list) else [rows]:
            row = row if isinstance(row, dict) else {names[0]: row}
            item = {n: _plain(row.get(n), n) for n in names}
            if key == "action_items":
                item["status"] = (item["status"] or "open").lower()
            if item[names[0]]:
                out[key].append(item)
    roles = {}
    for person, role in (data.get("people_roles") or {}).items() if isinstance(data.get("people_roles"), dict) else ():
        role = role.get("role") if isinstance(role, dict) else role
        roles[person] = _plain(role, "owner") or ""
    out["people_roles"] = roles
    for key, allowed in (("sentiment", SENTIMENTS), ("urgency", URGENCIES), ("language", LANGUAGES)):
        value = (_plain(data.get(key), key) or "").lower()
        out[key] = value if value in allowed else allowed[0]
    return out


@pandas_udf(StringType())
def repaired(raw: pd.Series) -> pd.Series:
    """UDF: the answer as JSON of SCHEMA's shape, null if it holds no object. Then `from_json(…, SCHEMA)`."""

    def one(text):
        data = loads(text)
        return None if data is None else json.dumps(coerce(data), ensure_ascii=False)

    return raw.map(one, na_action="ignore")


def parsed(raw: Column) -> Column:
    return F.from_json(repaired(raw), SCHEMA)


def issues(x: Column) -> Column:
    """What a parsed answer lacks, as an array of words."""
    return F.filter(F.array(
        F.when(x.isNull(), "unreadable"), F.when(F.trim(x["summary"]) == "", "summary"), F.when(F.exists(x["action_items"], lambda a: a["owner"].isNull()), "owner"),
        F.when(F.exists(x["decisions"], lambda d: d["decided_by"].isNull()), "decided_by"), F.when(F.exists(x["commitments"], lambda c: c["by"].isNull()), "by"),
    ), lambda i: i.isNotNull())
