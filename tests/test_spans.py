"""Position maps, hits and patches: sign by sign, and against a search over all places."""

import random
import unicodedata

import duckdb
import pandas as pd
from loamgraph import registry
from loamgraph.functions import spans as P


def by_sign(text, indent=True):
    """The same, one sign after the other."""
    text = unicodedata.normalize("NFC", text).translate(str.maketrans("“”‘’–—", "\"\"''--"))
    out, at, start = [], [], 0
    for number, line in enumerate(text.split("\n")):
        if number:
            out.append("\n")
            at.append(start - 1)
        body = line[:-1] if line.endswith("\r") else line
        body = body.rstrip(" \t")
        lead = len(body) - len(body.lstrip(" \t")) if number or indent else 0
        for k, c in enumerate(body):
            if k >= lead and c == " " and k > lead and body[k - 1] == " ":
                continue
            out.append(c)
            at.append(start + k)
        start += len(line) + 1
    return "".join(out), at


def test_flat_sign_by_sign():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("ab  \t\n\r“–é") for _ in range(r.randint(0, 25)))
        for indent in (True, False):
            got = P.flat(text, indent)
            assert (got[0], got[1].tolist()) == by_sign(text, indent), (text, indent)


def test_every_span():
    """Spans are all places whose flattened passage is there, but for blanks that slide into an indent."""
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("aab  \n\t") for _ in range(r.randint(1, 20)))
        old = "".join(r.choice("ab \n") for _ in range(r.randint(1, 4)))
        body, at = by_sign(text)
        want = set()
        for indent in (True, False):
            p = by_sign(old, indent)[0]
            for k in range(len(body) - len(p) + 1 if p else 0):
                line = body[:k].split("\n")[-1]
                if body[k : k + len(p)] == p and not (p[0] in " \t" and line and not line.strip(" \t")):
                    want.add((at[k], at[k + len(p)] if k + len(p) < len(at) else at[-1] + 1))
        assert set(P.spans(text, old)) == want, (text, old)


def test_patches():
    assert P.spans("x\n    deep\n  b", " b") == [] and P.spans("x\n  b y  b", " b") == [(7, 10)] and P.patched("x\n  b", "  b", "c") == "x\nc"
    assert P.patched("one – two", "one - two", "3") == "3" and P.patched("a a", "a", "b") is None
    assert P.patched("a  b\r\nc  d\r\n", "b\nc d", "x\ny") == "a  x\r\ny\r\n"
    assert P.patched("aaa", "aa", "b") is None and P.patched("", "a", "b") is None and P.patched("a", "", "b") is None
    assert P.patched("café  au lait", "café au", None) == " lait" and P.flat("")[0] == ""


def test_spans_query_against_its_sql(spark, tmp_path):
    """Overlapping hits, typographic signs, texts that are not composed, carriage returns, empty lines and newlines at the end."""
    texts = ["ab cab cab x", "ab cab\ncab cab ab cab", "it's me it\u2019s me it's me", "it\u2019s me it's me", "e\u0301a b e\u0301a b", "a b\r\nc a b\r\nd", "a b\r", "a b\r c a b a b\r", "a b c\n\na b d", "a b a b\n", "a a a a", "\U0001f600 x \U0001f600 x", "a b", " a b a b", "a.b c aXb c", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = registry.ORACLES["s10_spans"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(sql[sql.index("SELECT * FROM (WITH t AS") :]).fetchall()
    got = registry.QUERIES["s10_spans"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 11


def test_maps_of_a_batch_leave_in_parts():
    texts = pd.Series(["ab  c\n" * 20_000, None, "x", *["word " * 30_000] * 12])
    parts = list(P.position_map.func(iter([texts])))
    longest = max(len(P.flat(t or "")[1]) for t in texts)
    assert max(sum(map(len, p["at"])) for p in parts) < P.HELD + longest
    assert [x for p in parts for x in p["flat"]] == [P.flat(t or "")[0] for t in texts]
