"""Segmentation by hand-made lexicons against a search over all paths, and discovery of words."""

import itertools
import math
import random

from pyspark.sql import functions as F

from loamgraph.operators import search as S
from loamgraph.operators import segment as G


def all_paths(run, score, unknown):
    """The best split of a run by trying every one."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        parts, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(run[start:k])
                start = k
        parts.append(run[start:])
        if all(p in score or len(p) == 1 for p in parts):
            total = sum(score.get(p, unknown) for p in parts)
            key = (total, [len(p) for p in reversed(parts)])
            if best is None or key > best[0]:
                best = (key, parts)
    return best[1], best[0][0]


def test_paths_against_all_splits(spark):
    r = random.Random(6)
    score = {"": -9000}
    for _ in range(40):
        score["".join(r.choice("天地人山") for _ in range(r.randint(1, 4)))] = -r.randint(1, 8) * 1000
    runs = sorted({"".join(r.choice("天地人山水") for _ in range(r.randint(1, 10))) for _ in range(60)})
    words = spark.createDataFrame(list(score.items()), "word string, score long")
    for row in G.paths(spark.createDataFrame([(x,) for x in runs + runs[:5]], "run string"), words).collect():
        want, total = all_paths(row.run, {k: v for k, v in score.items() if k}, -9000)
        assert (row.words, row.score) == (want, total), row.run
        at, tokens = 0, []
        for w in want:
            for k in (2, 3):
                tokens += [row.run[i : i + k] for i in range(at, at + len(w) - k + 1) if len(w) > k and row.run[i : i + k] in score]
            tokens.append(w)
            at += len(w)
        assert row.tokens == list(dict.fromkeys(tokens))


def test_lexicon_finds_words_and_lifts_the_glossary(spark):
    r = random.Random(2)
    words = ["火车", "图书馆", "天气", "很", "好", "在", "去", "我", "你", "他"]
    texts = ["".join(r.choice(words) for _ in range(12)) for _ in range(400)] + [None, "", "no signs"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    lex = {x.word: x.score for x in G.lexicon(df, spark.createDataFrame([("好天气",), ("plain",), ("火车图书馆",)], "keyword string"), cohesion=5.0).collect()}
    assert {"火车", "图书馆", "天气", "好天气", "火车图书馆"} <= set(lex) and "车图" not in lex and "plain" not in lex
    total = sum(t.count("火") for t in texts if t)
    assert lex["火车"] == lex["火"] and total > 100
    assert lex["火车图书馆"] > lex["火车"] + lex["图书馆"]
    words = spark.createDataFrame(list(lex.items()), "word string, score long")
    got = G.tokens(spark.createDataFrame([(1, "我在图书馆 read_me v2"), (2, "去火车图书馆"), (3, None), (4, "鑫"), (4, "鑫")], "k long, t string"), "k", F.col("t"), words)
    rows = sorted((x.k, x.tokens) for x in got.collect())
    assert rows == [(1, ["我", "在", "图书", "书馆", "图书馆", "read_me", "v2"]), (2, ["去", "火车", "图书", "书馆", "图书馆", "火车图书馆"]), (3, []), (4, ["鑫"]), (4, ["鑫"])]
    assert math.isclose(lex[""], min(lex.values()))


def test_search_finds_a_word_inside_a_run(spark):
    r = random.Random(3)
    words = ["火车", "图书馆", "天气", "很", "好", "在", "去", "我"]
    docs = [(k, "".join(r.choice(words[2:]) for _ in range(9))) for k in range(60)] + [(100, "我去火车很好")]
    df = spark.createDataFrame(docs, "doc_id long, content string").select("*", F.lit("p").alias("path"), F.lit("u").alias("uri"), F.lit(0).alias("priority"), F.concat(F.lit("d-"), "doc_id").alias("node_uuid"))
    more = spark.createDataFrame([("火车在" * 8,)], "text string").unionAll(df.select("content"))
    lex = G.lexicon(more, spark.createDataFrame([("火车",)], "keyword string"))
    none = spark.createDataFrame([], "node_uuid string, keyword string")
    asked = spark.createDataFrame([(1, "火车")], "query_id int, query string")
    plain = S.search(S.search_documents(df, none), asked).collect()
    found = S.search(S.search_documents(df, none, lex), asked, words=lex).collect()
    assert plain == [] and [x.doc_id for x in found] == [100]
