"""Records of JSON files in whatever layout they landed: array, one object, objects one after another, cut off, mixed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder(strict=False)
_SKIP = " \t\r\n﻿,[]"


def complete_objects(text: str | None) -> Iterator[dict]:
    """``placed_objects`` without the places."""
    return (d for _, d in placed_objects(text))


def placed_objects(text: str | None) -> Iterator[tuple[int, dict]]:
    """(place of its first sign, object) of the complete top-level JSON objects of a text, in order: of an array, of lines, or one after another.

    Elements that are no objects are skipped. What can't be read is skipped up to the next line that begins an object;
    a cut-off tail gives nothing. Null and blank texts give nothing.
    """
    if not text:
        return
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in _SKIP:
            # An element of an array that is itself an array is foreign: pass it whole, but not the outer array.
            if c == "[" and text[:i].strip(" \t\r\n﻿"):
                try:
                    _, i = _DECODER.raw_decode(text, i)
                    continue
                except ValueError:
                    pass
            i += 1
            continue
        try:
            value, end = _DECODER.raw_decode(text, i)
        except (ValueError, RecursionError):
            at = min((p for p in (text.find("\n{", i), text.find("\n[", i)) if p >= 0), default=-1)
            if at < 0:
                return
            i = at + 1
            continue
        if isinstance(value, dict):
            yield i, value
        i = end


MOST_CHARS = 1 << 26  # of one record; what is longer counts as broken


def streamed_objects(pieces: Iterator[str]) -> Iterator[dict]:
    """``complete_objects`` of a text that comes in pieces: no more than a piece and a record are held at once."""
    pieces = iter(pieces)
    buffer, i, ended, inside = "", 0, False, False  # inside: something stood before, so that '[' begins an element
    while True:
        while i < len(buffer) and buffer[i] in _SKIP and not (buffer[i] == "[" and inside):
            inside = inside or buffer[i] == "["
            i += 1
        if i < len(buffer):
            try:
                value, end = _DECODER.raw_decode(buffer, i)
                if ended or buffer[end:].lstrip("+-.eE0123456789"):  # a number at the end of a piece may go on
                    inside, i = True, end
                    if isinstance(value, dict):
                        yield value
                    continue
            except (ValueError, RecursionError):
                if ended or len(buffer) - i > MOST_CHARS:
                    if buffer[i] == "[":  # no whole element, so its parts are looked at
                        i += 1
                        continue
                    at = min((p for p in (buffer.find("\n{", i), buffer.find("\n[", i)) if p >= 0), default=-1)
                    i = len(buffer) if at < 0 else at + 1
                    continue
        if ended:
            return
        piece = next(pieces, None)
        ended = piece is None
        buffer, i = buffer[i:] + (piece or ""), 0


def _plain(v: object) -> str | None:
    """A value as text: strings as they are, null as null, whole numbers without a point, others as JSON."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return str(int(v))
    return json.dumps(v, ensure_ascii=False, sort_keys=True)


def records_column(content: Column, fields: list[str], payload: bool = False) -> Column:
    """array<struct<rec_no, at, fields..., [payload]>> of a column of whole files; rec_no counts complete objects from 1, ``at`` is an object's place in the file."""
    cols = ["rec_no bigint", "at bigint", *[f"`{f}` string" for f in fields], *(["payload string"] if payload else [])]

    def one(text: str | None) -> list[dict]:
        out = []
        for n, (at, d) in enumerate(placed_objects(text), 1):
            r = {"rec_no": n, "at": at} | {f: _plain(d.get(f)) for f in fields}
            if payload:
                r["payload"] = json.dumps(d, ensure_ascii=False)
            out.append(r)
        return out

    @F.pandas_udf(f"array<struct<{','.join(c.replace(' ', ':', 1) if not c.startswith('`') else c.replace('` ', '`:') for c in cols)}>>")
    def scan(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return scan(content)
