"""Rows from a model's replies: isolating and mending JSON, without guessing what is missing."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[a-zA-Z]*\s*(.*?)```", re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BRACKETS = {"{": re.compile(r"[{}]"), "[": re.compile(r"[\[\]]")}
_QUOTES = str.maketrans({"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'"})


def outside_strings(text: str, change) -> str:
    """``change`` applied to all that is not within double quotes."""
    out, at = [], 0
    for m in _STRING.finditer(text):
        out += [change(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + change(text[at:])


def without_trailing_commas(text: str) -> str:
    """Commas go where only space and a closing bracket follow; strings are masked meanwhile."""
    kept: list[str] = []
    masked = _STRING.sub(lambda m: kept.append(m.group()) or f'"{len(kept) - 1}"', text)
    masked = re.sub(r",(\s*[}\]])", r"\1", masked)
    return re.sub(r'"(\d+)"', lambda m: kept[int(m.group(1))], masked)


def first_value(text: str) -> str | None:
    """The first bracketed value that closes, brackets in strings apart."""
    masked = _STRING.sub(lambda m: "." * len(m.group()), text)
    found = []
    for left, brackets in _BRACKETS.items():
        depth, start = 0, masked.find(left)
        for m in brackets.finditer(masked, start) if start >= 0 else ():
            depth += 1 if m.group() == left else -1
            if not depth:
                found.append((start, text[start : m.end()]))
                break
    return min(found)[1] if found else None


def mend(reply: str | None) -> tuple[str | None, str]:
    """A reply as strict JSON text and '', or None and what is wrong with it."""
    if not reply or not reply.strip():
        return None, "nothing"
    fence = _FENCE.search(reply)
    body = (fence.group(1) if fence else reply).strip()
    part = first_value(body)
    if part is None and not re.match(r'\s*(["\d-]|true|false|null)', body):
        return None, "truncated" if re.search(r"[{\[]", body) else "no JSON value"
    tries = [body] + ([] if part is None else [part, without_trailing_commas(part), without_trailing_commas(outside_strings(part, lambda s: s.translate(_QUOTES)))])
    for text in tries:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False), ""
        except ValueError:
            continue
    return None, "not JSON"


def rows_of(value: object, key: str) -> list:
    """A list as it is, the list under ``key``, or one object without that key as a list."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        return value[key] if isinstance(value.get(key), list) else [value] if value and key not in value else []
    return []


def parsed(reply: Column, key: str) -> Column:
    """Struct of items (JSON texts) and error for each reply."""

    @F.pandas_udf("items array<string>, error string")
    def run(replies: pd.Series) -> pd.DataFrame:
        out = []
        for r in replies:
            text, error = mend(r)
            out.append(([] if text is None else [json.dumps(x, ensure_ascii=False) for x in rows_of(json.loads(text), key)], error))
        return pd.DataFrame(out, columns=["items", "error"])

    return run(reply)
