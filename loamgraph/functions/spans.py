"""Where a passage stands in a text although blanks, quotes and dashes differ: position maps, hits and patches.

A text is flattened: canonical composition, plain quotes and dashes, no blanks or carriage return at line ends, runs of
spaces as one. Indents stay as they are; in a passage the first line may begin inside a line, so it is flattened both with and
without its indent. Places are code points of the composed text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import TYPOGRAPHIC

_PLAIN = str.maketrans(*TYPOGRAPHIC)
_LINE_END = re.compile(r"[ \t]*\r?(?=\n|\Z)")
_INDENT = re.compile(r"^[ \t]+", re.M)


def flat(text: str, indent: bool = True) -> tuple[str, np.ndarray]:
    """(flattened text, for each of its signs the place in the composed text). ``indent``: the first line's stays, too."""
    text = unicodedata.normalize("NFC", text).translate(_PLAIN)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    gone, kept = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    for m in _INDENT.finditer(text):
        kept[m.start() : m.end()] = indent or m.start() > 0
    gone[1:] = (codes[1:] == 32) & (codes[:-1] == 32) & ~kept[1:]
    for m in _LINE_END.finditer(text):
        gone[m.start() : m.end()] = True
    at = np.flatnonzero(~gone)
    return codes[at].tobytes().decode("utf-32-le", "surrogatepass"), at


def apart(text: str, passage: str) -> list[tuple[int, int]]:
    """(start, end) in the text as it is of the passage as it is written, but that a run of spaces counts as one: from left to
    right, none over another one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))) if len(codes) else codes
    body, n = codes[at].tobytes().decode("utf-32-le", "surrogatepass"), len(passage)
    end = lambda k: int(at[k]) if k < len(at) else len(codes)
    return [(int(at[m.start()]), end(m.start() + n)) for m in re.finditer(re.escape(passage), body)] if passage else []


def hits(text: str, passage: str) -> list[int]:
    """All places of a flattened passage in a flattened text, overlapping ones too. One that begins with a blank does not
    slide into a deeper indent: inside an indent it hits at its start only."""
    found = [m.start() for m in re.finditer(f"(?={re.escape(passage)})", text)] if passage else []
    if passage[:1] not in (" ", "\t"):
        return found
    return [k for k in found if k == 0 or text[k - 1] == "\n" or text[text.rfind("\n", 0, k) + 1 : k].strip(" \t")]


def spans(text: str, passage: str) -> list[tuple[int, int]]:
    """(start, end) in the composed text of all hits of a passage; a carriage return goes with its newline."""
    whole = unicodedata.normalize("NFC", text)
    body, at = flat(whole)
    pairs = dict.fromkeys((k, len(want)) for indent in (True, False) for want in [flat(passage, indent)[0]] for k in hits(body, want))
    back = lambda k: k - (0 < k < len(whole) and whole[k - 1 : k + 1] == "\r\n")
    return [(back(int(at[k])), back(int(at[k + n]) if k + n < len(at) else int(at[-1]) + 1)) for k, n in pairs]


def patched(text: str | None, passage: str | None, new: str | None) -> str | None:
    """The text with its only match of the passage replaced: as it stands, else flattened; None if there is none or several.
    Newlines of the new text are written as the text has them."""
    if not text or not passage:
        return None
    if passage in text:
        return text.replace(passage, new or "") if text.find(passage) == text.rfind(passage) else None
    found = spans(text, passage)
    if len(found) != 1:
        return None
    whole, fresh = unicodedata.normalize("NFC", text), (new or "").replace("\r\n", "\n").replace("\r", "\n")
    return whole[: found[0][0]] + (fresh.replace("\n", "\r\n") if "\r\n" in whole else fresh) + whole[found[0][1] :]


#: How many signs of position maps are held before they are handed on.
HELD = 500_000


@F.pandas_udf(StructType([StructField("flat", StringType()), StructField("at", ArrayType(IntegerType()))]))
def position_map(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The flattened text and its position map; empty of a null. A batch's maps leave in parts, of about HELD signs each."""
    frame = lambda rows: pd.DataFrame({"flat": [r[0] for r in rows], "at": [r[1] for r in rows]})
    for text in texts:
        rows, signs = [], 0
        for t in text:
            body, at = flat(t or "")
            rows.append((body, at.astype(np.int32)))
            signs += len(at)
            if signs >= HELD:
                yield frame(rows)
                rows, signs = [], 0
        if rows:
            yield frame(rows)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def passage_spans(text: pd.Series, passage: pd.Series) -> pd.Series:
    """All spans of each row's passage in its text."""
    return pd.Series([[{"start": a, "end": b} for a, b in spans(t, p)] if t and p else [] for t, p in zip(text, passage, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def spans_apart(text: pd.Series, passage: pd.Series) -> pd.Series:
    """The spans of each row's passage as it is written, none over another one."""
    return pd.Series([[{"start": a, "end": b} for a, b in apart(t, p)] if t and p else [] for t, p in zip(text, passage, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def fuzzy_patch(text: pd.Series, passage: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([patched(t, o, n) for t, o, n in zip(text, passage, new, strict=True)], dtype=object)
