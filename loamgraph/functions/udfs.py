"""Text functions without a built-in form, as pandas UDFs over Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition."""
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


#: Signs of the longest texts that are compared many at a time; their counts are bytes.
SHORT = 255


def matched(before: list[str], after: list[str]) -> np.ndarray:
    """How many signs ``difflib``'s matching blocks have in each pair of texts: the longest common stretch, the first of
    equal ones, and the same left and right of it. One step takes all pairs' stretches, row by row of their tables."""
    both = np.frombuffer("".join([*before, *after]).encode("utf-32-le", "surrogatepass"), np.uint32)
    signs, code = np.unique(both, return_inverse=True)
    code = code.astype(np.uint8 if len(signs) < 254 else np.uint32)
    at = np.cumsum([0, *map(len, before), *map(len, after)])
    n = len(before)
    todo = np.stack([np.arange(n), at[:n], at[1 : n + 1], at[n:-1], at[n + 1 :]])
    same = np.zeros(n, np.int64)

    def grid(lo, hi, other):
        """A column for each stretch, its end filled up."""
        x = lo + np.arange((hi - lo).max())[:, None]
        return np.where(x < hi, code[np.minimum(x, len(code) - 1)], code.dtype.type(other))

    while True:
        todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
        if not todo.shape[1]:
            return same
        todo, new = todo[:, np.argsort((todo[2] - todo[1]) * 256 + todo[4] - todo[3])], []
        for part in np.array_split(todo, max(1, todo.shape[1] // 4096), 1):
            row, alo, ahi, blo, bhi = part
            left, right = grid(alo, ahi, -1 % (1 << 8 * code.itemsize)), grid(blo, bhi, -2 % (1 << 8 * code.itemsize))
            size, i0, j0 = np.zeros(len(row), np.uint8), *np.zeros((2, len(row)), np.int64)
            last, now = np.zeros((2, len(right) + 1, len(row)), np.uint8)
            for i, sign in enumerate(left):
                np.add(last[:-1], 1, out=now[1:])
                now[1:] *= right == sign
                most = now.max(0)
                up = np.flatnonzero(most > size)
                size[up], i0[up], j0[up] = most[up], i + 1 - most[up].astype(np.int64), now[:, up].argmax(0) - most[up].astype(np.int64)
                last, now = now, last
            size = size.astype(np.int64)
            np.add.at(same, row, size)
            i0, j0, hit = i0 + alo, j0 + blo, size > 0
            new += [np.stack([row, alo, i0, blo, j0])[:, hit], np.stack([row, i0 + size, ahi, j0 + size, bhi])[:, hit]]
        todo = np.concatenate(new, 1)


@F.pandas_udf(StructType([StructField("unified", StringType()), StructField("ratio", DoubleType()), StructField("size", StringType())]))
def change_summary(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """A unified diff by lines, the share of changed signs and its name: minor, moderate or major."""

    pairs = [(a or "", b or "") for a, b in zip(before, after, strict=True)]
    short = [k for k, (a, b) in enumerate(pairs) if max(len(a), len(b)) <= SHORT]
    known = dict(zip(short, matched(*([pairs[k][side] for k in short] for side in (0, 1))).tolist(), strict=True))

    def one(k, a, b):
        same = known[k] if k in known else sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        total = len(a) + len(b)
        ratio = 100 * (total - 2 * same) / total if total else 0.0
        was, now = a.splitlines(), b.splitlines()
        if len(was) == len(now) == 1:
            lines = ["--- before", "+++ after", "@@ -1 +1 @@", f"-{was[0]}", f"+{now[0]}"] if was != now else []
        else:
            lines = difflib.unified_diff(was, now, "before", "after", lineterm="")
        return "\n".join(lines), round(ratio, 2), "minor" if ratio < 5 else "moderate" if ratio < 20 else "major"

    return pd.DataFrame([one(k, *pair) for k, pair in enumerate(pairs)], columns=["unified", "ratio", "size"])


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("keyword", StringType())])))
def occurrences(text: pd.Series, keywords: pd.Series) -> pd.Series:
    """Where keywords are to be marked in a text (0-based): of each keyword's hits, found one after the other, the leftmost
    and then the longest that begin where no earlier one goes on."""

    def one(t, words):
        hits = []
        for w in words if t and words is not None else ():
            at = t.find(w) if w else -1
            while at >= 0:
                hits.append((at, -len(w), w))
                at = t.find(w, at + len(w))
        out, end = [], 0
        for at, size, w in sorted(hits):
            if at >= end:
                out.append({"start": at, "keyword": w})
                end = at - size
        return out

    return pd.Series([one(t, w) for t, w in zip(text, keywords, strict=True)], dtype=object)
