"""Personal data: base spans against the patterns as written, the field against enumeration, generated and odd texts."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import pii, skipchain
from loamgraph.llm.common import table
from loamgraph.llm.queries import QUERIES

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    """The base spans by the patterns as they stand in the contract."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and total % 10 == 0, 8 <= len(digits) <= 15)
            if ok[k]:
                out.append((k, m.start(), m.end()))
    return out


def as_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_rows(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op11_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(as_text(base).encode()).hexdigest()
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert {(pii.KINDS.index(k), int(a), int(b)) for k, a, b in listed} >= set(base)
        assert listed == sorted(listed, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_base_of_random_texts():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("0123456789..--@@++() ab%_é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.255.0", "4111 1111-1111 1111 4111111111111111", "+1 (555) 010-9999 +12", "x" * 40 + "@a", "@@a@b..c"):
        assert pii.base_spans(text) == brute(text), text


def small_field(seed, n_labels=3):
    r = np.random.default_rng(seed)
    group = np.array([0, 1, 1])
    skip = r.normal(0, 0.6, (1, 2, 2))
    return skipchain.Field(r.normal(0, 1, (2, n_labels)), r.normal(0, 0.6, (n_labels, n_labels)), (skip + skip.transpose(0, 2, 1)) / 2, group, np.ones(n_labels, bool), np.ones((n_labels, n_labels), bool))


@pytest.mark.parametrize(("edges", "near"), [([(0, 1, 0), (1, 2, 0), (1, 3, 1)], 1e-3), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)], 0.08)])
def test_beliefs_against_enumeration(edges, near):
    """Exact on a tree; close on a loop that a skip edge makes."""
    for seed in range(5):
        f, r = small_field(seed), np.random.default_rng(seed + 50)
        e = np.array(edges)
        g = skipchain.Graph(r.integers(0, 2, (4, 2)).astype(float), e[:, 0], e[:, 1], e[:, 2], np.zeros(4, bool), np.array([-1, -1, 2, -1]))
        node, edge = f.potentials(g)
        want = np.zeros((4, 3))
        for ys in itertools.product(range(3), repeat=4):
            p = np.exp(sum(node[i, y] for i, y in enumerate(ys)) + sum(edge[t][ys[a], ys[b]] for a, b, t in edges))
            want[range(4), ys] += p
        got = skipchain.normal(f.propagate(g, sweeps=200)[0], (1,))
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < near


def test_generated_texts_that_were_not_learnt_from():
    r, right, wrong, missed = random.Random(77), 0, [], []
    for _ in range(300):
        text, want = pii.made(r)
        base = set(pii.base_spans(text))
        rest = {s for s in want if not any(s[1] < b and a < s[2] for _, a, b in base)}
        added = {s[:3] for s in pii.found([text], pii.field())[0] if not s[3]}
        right, wrong, missed = right + len(added & rest), wrong + [*(added - rest)], missed + [*(rest - added)]
    assert right > 300 and len(wrong) <= 0.03 * right and len(missed) <= 0.03 * right


def test_a_like_token_elsewhere_decides():
    """The same words with a number: alone it is none, beside its like with a plus far away it is a phone number."""
    loose, far = "la ti 743-555-3824 on er", "an st mi " * 400
    only = pii.found([loose + far], pii.field())[0]
    both = pii.found([loose + far + "+1 (743) 555-3824 st"], pii.field())[0]
    assert only == [] and [(k, loose.index("743"), loose.index("743") + 12, False) for k in (3,)] == [s for s in both if not s[3]]


def test_odd_texts_and_redaction(spark):
    two = "pay 4111111111111111 5500005555555559 now"
    texts = [None, "", "   ", "plain words only.", "é語 a@b.co", two, "mail jo (at) example (dot) com soon", "host 10[.]0[.]0[.]7 up", "in 2024 at 10:30 we had 12 of 30, 1.2.3 and 45%", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "+1 (743) 555-3824 and 743.555.3824"]
    df = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)] + [(3, two, "y", 9)], "doc_id long, text string, spans string, base int")
    got = {}
    for r in pii.digests(pii.spans(df)).collect():
        got.setdefault(r.doc_id, []).append(r.spans)
    assert got[0] == got[1] == got[2] == got[8] == got[9] == [""]
    assert sorted(got[3]) == ["", "card:4:20,card:21:37"] and got[4] == ["email:3:9"] and got[5] == ["card:4:20,card:21:37"]
    assert got[6] == ["email:5:30"] and got[7] == ["ip:5:19"] and got[10] == ["phone:0:17,phone:22:34"]
    clear = {r.doc_id: r.text for r in pii.redacted(df.where("doc_id <> 3")).collect()}
    assert clear[0] is None and clear[1] == "" and clear[5] == "pay <CARD> <CARD> now" and clear[7] == "host <IP> up" and clear[4] == "é語 <EMAIL>"
    assert pii.spans(df.where("false")).count() == 0 and pii.redacted(df).columns == df.columns


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "a1" * 200_000, "+1" * 200_000, "1 " * 60_000, "a@b" * 100_000, "(at)" * 50_000, "+1" + "(" * 400_000, "x(at) " * 20_000])
def test_time_is_linear(text):
    pii.field()
    began = time.time()
    pii.found([text], pii.field())
    assert time.time() - began < 12


@pytest.mark.parametrize("text", [
    "ISBN 978-3-16-148410-0 is a book number, see page 12.", "Order 12345678 shipped 2024-01-02 at 10:20, total $1,234.50 (12% off).", "It grew from 1234567 to 2345678 in 2010-2020.", "Serial 4111 1111 1111 1112 is bad",
    "2021-03-04T05:06:07Z log 192.168.1.300 err", "at 52.5200, 13.4050 and 48.8566, 2.3522", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "uuid 123e4567-e89b-12d3-a456-426614174000", "he works at(home), 2 (at) 3 dollars each (at) home", "user@localhost and @handle #12",
])
def test_plain_numbers_are_left_alone(text):
    assert pii.found([text], pii.field()) == [[]]
