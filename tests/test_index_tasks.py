"""The work of the index and of covers: dealt to tasks whatever the files, and one row a query and document."""

from pyspark.sql import functions as F
from test_shuffled import sent

from loamgraph import registry
from loamgraph.operators import phrases as P
from loamgraph.operators import search as S


def test_one_file_of_texts_is_indexed_by_many_tasks(spark):
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("p").alias("path"), F.lit("u").alias("uri"), F.repeat(F.concat(F.lit("word "), "id", F.lit(" ")), 15_000).alias("content"), F.concat(F.lit("d-"), "id").alias("node_uuid"))
    posts = P.positions(S.search_documents(docs, spark.createDataFrame([], "node_uuid string, keyword string")))
    got = posts.where("term = 'word'").select(F.spark_partition_id().alias("task"), "doc_id", "n").collect()
    assert len({x.task for x in got}) >= 4 and {x.doc_id for x in got} == set(range(40))


def test_covers_send_a_row_for_each_token_of_a_document(spark, sf):
    """Before, every place of a query's token was sent, several times: 320 rows a document at scale 0.001, and 2.8 now."""
    run = lambda: registry.QUERIES["f7_cover_search"](spark, sf).write.format("noop").mode("overwrite").save()
    run()
    assert sent(spark, run) <= 10 * spark.read.parquet(f"{sf}/documents.parquet").count()


def test_phrases_send_no_places_one_by_one(spark):
    """A row for each term and document, with all places, instead of a row for each place."""
    text = F.repeat(F.lit("a b c "), 500)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("p").alias("path"), F.lit("u").alias("uri"), text.alias("content"), F.lit(None).cast("string").alias("disclosure"), F.lit(None).cast("string").alias("terms"))
    P.positions(docs).write.mode("overwrite").parquet(path := spark.sparkContext.getCheckpointDir() + "/few-posts")
    posts, asked = spark.read.parquet(path), spark.createDataFrame([("a b", ["a", "b"]), ("b a", ["b", "a"])], "phrase string, terms array<string>")
    got = []
    rows = sent(spark, lambda: got.extend(P.phrase_postings(posts, asked).collect()))
    assert {(x.phrase, x.n) for x in got} == {("a b", 500)} and len(got) == 20 and rows <= 500
