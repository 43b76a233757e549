"""Words of texts that are written without spaces: a lexicon from corpus counts and a glossary, and the most probable path.

A run of CJK signs is a graph of places with an edge for every lexicon word that stands in it. Edges weigh
1000 ln(n / all), and the path of largest weight gives the run's words. Edges come from a join of a run's substrings with
the lexicon, so neither needs to fit in a task; only one run's own edges meet, for the walk along it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import cut

#: The signs of one run, which are CJK ideographs, kana and hangul.
RUN = "[㐀-䶿一-鿿豈-﫿぀-ヿㇰ-ㇿ가-힯]+"
#: What a query or a text is split into: ASCII words and runs; joiners of URIs split.
TOKEN, JOINERS = f"([A-Za-z0-9_]+|{RUN})", r"[:/.\-]+"
#: Longest corpus word; times it must occur; how much more often than its parts by chance.
LONGEST, LEAST, COHESION = 4, 5, 20.0


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({RUN})"), F.lit(1))


def substrings(run: Column, longest: int) -> Column:
    """Array of (start, k, word): all substrings of 1 to ``longest`` signs."""
    size = F.length(run)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.struct(i.alias("i"), k.alias("k"), F.substring(run, i, k).alias("word")))
    return F.flatten(F.transform(F.sequence(F.lit(1), size), at))


def lexicon(texts: DataFrame, glossary: DataFrame, least: int = LEAST, cohesion: float = COHESION) -> DataFrame:
    """(word, score) from texts(text) and glossary(keyword): every sign; substrings of up to ``LONGEST`` signs that
    occur ``least`` times, ``cohesion`` times as often as any two parts would meet by chance; and the glossary's words that are
    one run, which weigh a little more than the path that they would fall apart into. The row of the empty word has the
    score of a sign that nothing is known of."""
    runs = texts.select(F.explode(runs_of(F.col("text"))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    grams = runs.select("n", F.explode(substrings(F.col("run"), LONGEST)).alias("g")).groupBy(F.col("g.word").alias("word")).agg(F.sum("n").alias("n"))
    grams = cut(grams)
    signs = grams.where(F.length("word") == 1)
    total = signs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    parts = grams.where((F.length("word") > 1) & (F.col("n") >= least)).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("s"))
    parts = parts.select("word", "n", F.substring("word", F.lit(1), F.col("s")).alias("l"), F.substring("word", F.col("s") + 1, F.length("word")).alias("r"))
    parts = parts.join(grams.select(F.col("word").alias("l"), F.col("n").alias("nl")), "l").join(grams.select(F.col("word").alias("r"), F.col("n").alias("nr")), "r")
    bound = F.col("n").cast("double") * F.col("t") >= F.lit(cohesion) * F.col("nl").cast("double") * F.col("nr")
    kept = parts.join(F.broadcast(total), F.lit(True)).groupBy("word").agg(F.first("n").alias("n"), F.min(bound).alias("ok")).where("ok").select("word", "n")
    known = signs.unionByName(kept)
    named = glossary.select(F.col("keyword").alias("word")).where(F.col("word").rlike(f"^{RUN}$")).distinct()
    added = named.join(known, "word", "left_anti").join(grams, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n"))
    all_words = cut(known.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False))))
    whole = all_words.agg(F.coalesce(F.sum("n"), F.lit(1)).cast("double").alias("w"))
    score = lambda n: F.floor(1000 * F.log(n / F.col("w"))).cast("long")
    scored = cut(all_words.join(F.broadcast(whole), F.lit(True)).select("word", score(F.col("n")).alias("score"), "base"))
    unknown = whole.select(F.lit("").alias("word"), score(F.lit(0.5)).alias("score"))
    base = scored.where("base").select("word", "score").unionByName(unknown)
    apart = paths(named.withColumnRenamed("word", "run"), base).select(F.col("run").alias("word"), (F.col("score") + 1).alias("apart"))
    raised = scored.join(apart, "word", "left").select("word", F.greatest("score", "apart").alias("score"))
    return cut(raised.unionByName(unknown))


def paths(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words, tokens, score) of every distinct run of runs(run): the words of the best path, of equal ones that
    with the longest last word; and the tokens for a search: before each word of over two signs the lexicon words of two
    signs in it, before one of over three those of three, too. Each token once."""
    runs = runs.select("run").distinct()
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(1)).alias("n")).first().n or 1
    unknown = words.where("word = ''").agg(F.max("score").alias("unknown"))
    each = runs.select("run", F.explode(substrings(F.col("run"), longest)).alias("g")).select("run", (F.col("g.i") + F.col("g.k") - 1).alias("e"), F.col("g.k").alias("k"), F.col("g.word").alias("word"))
    edges = each.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("e", "k", "score")).alias("edges"))
    both = runs.join(edges, "run", "left").join(F.broadcast(unknown), F.lit(True))

    @F.pandas_udf("struct<words: array<string>, tokens: array<string>, score: long>")
    def walk(run: pd.Series, edges: pd.Series, unknown: pd.Series) -> pd.DataFrame:
        out = []
        for text, found, low in zip(run, edges, unknown):
            n = len(text)
            here = [{} for _ in range(n + 1)]
            for x in found if found is not None else ():
                here[x["e"]][x["k"]] = x["score"]
            best, back = [0] * (n + 1), [0] * (n + 1)
            for e in range(1, n + 1):
                options = {1: int(low), **here[e]}
                best[e], back[e] = max((best[e - k] + s, k) for k, s in options.items())
            cuts, e = [], n
            while e:
                cuts.append((e - back[e], e))
                e -= back[e]
            tokens: dict[str, None] = {}
            for a, b in reversed(cuts):
                for k in (2, 3):
                    if b - a > k:
                        tokens.update((text[i : i + k], None) for i in range(a, b - k + 1) if k in here[i + k])
                tokens[text[a:b]] = None
            out.append(([text[a:b] for a, b in reversed(cuts)], list(tokens), best[n]))
        return pd.DataFrame(out, columns=["words", "tokens", "score"])

    return both.select("run", walk("run", "edges", "unknown").alias("x")).select("run", "x.*")


def tokens(df: DataFrame, key: str, text: Column, words: DataFrame) -> DataFrame:
    """(key, tokens): the distinct search tokens of each row's text in their order, runs split into their words. Only
    distinct runs are walked. A null text has no tokens; rows that repeat a key each keep a row."""
    parts = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), JOINERS, " "), F.lit(TOKEN), F.lit(1))
    rows = df.select(F.col(key), parts.alias("parts")).withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows)
    each = rows.select("_row", F.posexplode("parts").alias("pos", "part"))
    isrun = F.col("part").rlike(f"^{RUN}$")
    split = paths(each.where(isrun).select(F.col("part").alias("run")), words).select(F.col("run").alias("part"), F.col("tokens").alias("own"))
    # a common run is one row of the right side; AQE splits it on the left
    got = each.where(isrun).join(split, "part").select("_row", "pos", "own").unionByName(each.where(~isrun).select("_row", "pos", F.array("part").alias("own")))
    lists = got.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "own"))).alias("x"))
    listed = lists.select("_row", F.array_distinct(F.flatten(F.transform("x", lambda y: y["own"]))).alias("tokens"))
    return rows.join(listed, "_row", "left").select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
