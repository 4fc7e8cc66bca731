"""Canonical forms of texts, computed for a whole Arrow batch at once.

A character counts if its Unicode category is a letter (L*) or a number (N*); texts are put in lower case first.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
import regex

from lodeflow.operators.batches import code_points

#: A label is a letter and at most 15 letters, digits, blanks, hyphens or underscores; a Chinese one has at most 6 signs.
LABEL = regex.compile(r"[^\p{L}\p{N}]*(\p{Han}{1,6}|(?!\p{Han})\p{L}[\p{L}\p{N} _-]{0,15}?)[^\p{L}\p{N}:：]*[:：]")
#: Labels that mark turns of a dialogue, whose order matters, beside those of one sign.
SPEAKERS = {"user", "assistant", "system", "human", "用户", "助手", "系统"}
_BREAKS = regex.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
#: Nothing that counts stands before the brace of an object.
_OPENS = regex.compile(r"[^\p{L}\p{N}{]*\{")
_OBJECT = regex.compile(r"[^\p{L}\p{N}{]*(\{.*\})[^\p{L}\p{N}}]*", regex.DOTALL)
_INVISIBLE = regex.compile(r"[\p{Cc}\p{Cf}]+")
_INVISIBLE_IN_LINES = regex.compile(r"[\p{Cc}\p{Cf}--[\r\n\x0b\x0c\x85]]+", regex.V1)
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


@functools.cache
def kept_points() -> np.ndarray:
    """For each code point, whether it counts."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def flat(text: str) -> str:
    """Lower case, letters and digits only."""
    return _OTHER.sub("", text.lower())


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The flat forms of all texts end to end as code points, and the n+1 offsets between them."""
    points, offsets = code_points([t.lower() for t in texts])
    kept = kept_points()[points]
    places = np.concatenate(([0], np.cumsum(kept)))
    return points[kept], places[offsets]


class _Fields(list):
    """The (name, value) pairs of an object, as they stand."""


def _loaded(text: str) -> object:
    """A JSON text with objects as ``_Fields`` and numbers as they are written; None if it isn't one."""
    try:
        return json.loads(_INVISIBLE.sub("", text), object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, RecursionError):
        return None


def _in_order(fields: Iterable[tuple[str, str]]) -> str:
    return "".join(k + v for k, v in sorted((flat(k), v) for k, v in fields))


def _flat_value(value: object) -> str:
    """A value's letters and digits; the fields of an object in order, at every depth, those of a list as they stand."""
    match value:
        case _Fields():
            return _in_order((k, _flat_value(v)) for k, v in value)
        case list():
            return "".join(map(_flat_value, value))
        case str():
            return flat(value)
        case _:
            return flat(json.dumps(value))


def _fields_of_object(text: str) -> list[tuple[str, str]] | None:
    found = _OBJECT.fullmatch(text)
    fields = _loaded(found[1]) if found else None
    return [(k, _flat_value(v)) for k, v in fields] if isinstance(fields, _Fields) else None


def _fields_of_lines(text: str) -> list[tuple[str, str]] | None:
    fields = []
    for line in _BREAKS.split(text):
        if flat(line):
            found = LABEL.match(line)
            if not found:
                return None
            value = line[found.end() :]
            nested = _loaded(value) if value.lstrip()[:1] in ("{", "[") else None
            fields.append((found[1], flat(value) if nested is None else _flat_value(nested)))
    labels = {flat(k) for k, _ in fields}
    whole = len(fields) > 1 and len(labels) == len(fields)
    return fields if whole and not any(len(k) == 1 or k in SPEAKERS for k in labels) else None


def labelled(text: str) -> str | None:
    """The canonical form of a text made of labelled fields only, in either notation, else None."""
    fields = _fields_of_object(text) if _OPENS.match(text) else None
    if fields is None and LABEL.match(seen := _INVISIBLE_IN_LINES.sub("", text)):
        fields = _fields_of_lines(seen)
    return _in_order(fields) if fields else None


def digests(texts: list[str], points: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """192 bits of each canonical form, NULL for texts without letter or digit. points, offsets: as of ``flatten``."""
    out: list[bytes | None] = []
    raw = points.astype("<u4", copy=False).tobytes()
    ends = (offsets * 4).tolist()
    for i, text in enumerate(texts):
        form = labelled(text)
        data = raw[ends[i] : ends[i + 1]] if form is None else form.encode("utf-32-le", "surrogatepass")
        out.append(blake2b(data, digest_size=24).digest() if data else None)
    return out
