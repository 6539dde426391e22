"""JSON that may be cut short."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: strings, whole or cut off, and brackets; nothing else in JSON says how deep one is
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', re.DOTALL)
_CLOSING = {"{": "}", "[": "]"}


def salvaged(raw: str | None, least: int = 20) -> str | None:
    """The first JSON object in raw, without a code fence, as it is if it parses; of one cut short, all up to the last part that is
    complete one level below its top, closed by the brackets then open; null if there is none, or if that is no longer than least."""
    fenced = re.search(r"```[a-zA-Z]*(.*?)(?:```|\Z)", raw or "", re.DOTALL)
    for body in ([fenced[1]] if fenced else []) + [raw or ""]:
        if "{" not in body:
            continue
        text = body[body.index("{") :].rstrip("` \n\t\r")
        done = _parsed(text)
        return done if done is not None else _parsed(_closed(text, least))
    return None


def _closed(text: str, least: int) -> str:
    """text up to where a bracket last closes with one left open, and what closes that one."""
    open_brackets: list[str] = []
    best = ""
    for mark in _MARKS.finditer(text):
        if mark[0] in _CLOSING:
            open_brackets.append(_CLOSING[mark[0]])
        elif open_brackets and mark[0] == open_brackets[-1]:
            open_brackets.pop()
            if len(open_brackets) == 1 and mark.end() > least:
                best = text[: mark.end()] + open_brackets[0]
    return best


def _parsed(body: str) -> str | None:
    try:
        return json.dumps(json.loads(body), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def salvage(raw: Column) -> Column:
    """salvaged() of a column; parsing by hand is what built-in functions can't express."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(salvaged)

    return run(raw)


def split_list(x: Column) -> Column:
    """A comma-joined list as an array, without empty parts."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), ","), lambda c: c != "")
