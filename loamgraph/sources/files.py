"""Files in and out: versioned table snapshots, JSON, Markdown and character cards."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def save(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Writes every table of one version; the version's marker comes last, so readers never see half of it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    spark.range(1).select(F.lit(version).alias("version"), F.array(*[F.lit(n) for n in sorted(tables)]).alias("tables")).coalesce(1).write.mode("append").json(f"{root}/versions")


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the newest whole one."""
    done = spark.read.schema("version int, tables array<string>").json(f"{root}/versions")
    if version is not None:
        done = done.where(F.col("version") == version)
    at = done.orderBy(F.col("version").desc()).first()
    return {n: spark.read.parquet(f"{root}/v{at.version}/{n}") for n in at.tables}


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of ``write_json``; the schema is stated, so nothing is read twice and fields left out are null."""
    return spark.read.schema(schema).json(path)


def write_glossary(words: DataFrame, path: str) -> None:
    """words(keyword, uri) as JSON lines; keywords that lead nowhere are left out."""
    write_json(words.where(~F.col("uri").startswith("unlinked://")).select("keyword", "uri"), path)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Keywords without blanks around them, each pair once; blank ones and those without an address are left out."""
    raw = read_json(spark, path, "keyword string, uri string").select(F.regexp_replace("keyword", r"^\s+|\s+$", "").alias("keyword"), F.trim("uri").alias("uri"))
    return raw.where("keyword <> '' and uri <> ''").dropDuplicates(["keyword", "uri"])


HEADING = r"(?m)^#{1,6} (\S+://.+)$"


def parse_markdown(text: Column) -> Column:
    """Sections (uri, priority, disclosure, content) of an exported page; sections without content are left out."""
    parts = F.split(text, r"(?m)^(?=#{1,6} \S+://)")

    def section(p):
        body = F.regexp_replace(p, r"(?m)\A#{1,6} \S+://.*$", "")
        clean = F.btrim(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), F.lit(" \n\t\r"))
        priority = F.coalesce(F.regexp_extract(body, r"<!--\s*priority:\s*(\d+)\s*-->", 1).try_cast("int"), F.lit(5))
        note = F.nullif(F.regexp_extract(body, r"<!--\s*disclosure:\s*(.*?)\s*-->", 1), F.lit(""))
        return F.struct(F.btrim(F.regexp_extract(p, HEADING, 1)).alias("uri"), priority.alias("priority"), note.alias("disclosure"), clean.alias("content"))

    return F.filter(F.transform(parts, section), lambda s: (s["uri"] != "") & (s["content"] != ""))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(parse_markdown(F.col("value"))).alias("s")).select("s.*")


def write_markdown(sections: DataFrame, path: str) -> None:
    """One text file per partition, sections in the order of their uri."""
    head = F.concat(F.repeat(F.lit("#"), F.least(F.size(F.split("uri", "/")) - 2, F.lit(6))), F.lit(" "), "uri", F.lit("\n"))
    meta = F.concat(F.lit("<!-- priority: "), F.col("priority").cast("string"), F.lit(" -->\n"), F.coalesce(F.concat(F.lit("<!-- disclosure: "), "disclosure", F.lit(" -->\n")), F.lit("")))
    sections.repartitionByRange("uri").sortWithinPartitions("uri").select(F.concat(head, meta, F.lit("\n"), "content", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


@F.pandas_udf(StringType())
def card_text(png: pd.Series) -> pd.Series:
    """The base64 text of a PNG's ``chara`` chunk, or null."""

    def one(raw):
        raw, at = bytes(raw), 8
        while at + 8 <= len(raw):
            n, kind = struct.unpack_from(">I4s", raw, at)
            if kind == b"tEXt" and raw[at + 8 :].startswith(b"chara\0"):
                return raw[at + 14 : at + 8 + n].decode("latin-1")
            at += 12 + n
        return None

    return png.map(one)


CARD = "struct<name:string,description:string,personality:string,scenario:string,mes_example:string,first_mes:string>"


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per image with its character's fields; nested cards (``data``) and flat ones alike."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode(F.unbase64(card_text("content")), "UTF-8").alias("json"))
    nested, flat = F.from_json("json", f"struct<data:{CARD}>")["data"], F.from_json("json", CARD)
    return raw.select("path", F.coalesce(nested, flat).alias("card")).select("path", "card.*")


def card_memories(cards: DataFrame) -> DataFrame:
    """(title, section, priority, content) rows of cards; blank sections are left out."""
    parts = [("profile", "description", 4), ("personality", "personality", 4), ("scenario", "scenario", 5), ("dialogue", "mes_example", 6), ("greeting", "first_mes", 6)]
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("priority"), F.col(c).alias("content")) for s, c, p in parts])
    title = F.btrim(F.regexp_replace(F.regexp_replace("name", r"[^A-Za-z0-9_\- ]", ""), r"[\s_]+", "_"), F.lit("_"))
    return cards.select(title.alias("title"), F.explode(rows).alias("s")).select("title", "s.*").where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0)
