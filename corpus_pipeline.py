"""Corpus pipeline: the stages applied to the documents, each written and read again by the next.

Every stage but the last returns the columns of `documents`; null and empty texts, repeated rows and extra columns are handled as the
operators' docstrings say.  Extra columns are not carried on.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.llm import linededup, mixing, packing, quality, setjoin
from placeproof.llm.base import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote does not reject (score 0.3 or more), unchanged."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), model, out="_quality").filter(F.col("_quality") >= 0.3).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines of which an earlier similar line stays; a document may end up with an empty text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_kept") < F.col("n_lines"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id, then the smallest hash of the text.

    A row is told by id and text, so an id that stands on several texts loses none that has no duplicate.  Of rows that repeat id and
    text one stays; rows without an id come last in their group; texts without words all stay.
    """
    groups = stage(setjoin.near_duplicates(docs, k=5, num=80, den=100, detail=True), "groups").filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    row = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = groups.groupBy("component").agg(F.min(order).alias("first"))
    marks = row.join(first, "component").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("t"), F.when(~order.eqNullSafe(F.col("first")), "gone").when(F.col("n") > 1, "repeated").alias("mark"))
    own = docs.select(*COLUMNS).withColumn("hash", F.xxhash64("text"))
    joined = own.join(marks.filter("mark is not null"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("t")), "left").filter("mark is null or mark = 'repeated'")
    return joined.filter("mark is null").select(*COLUMNS).union(joined.filter("mark is not null").dropDuplicates(["doc_id", "hash"]).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its shards: a row for each pass that takes a document, one cut document per source; texts without words give nothing."""
    out = mixing.mix_rows(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and padding of every row of the mix."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", keep_one_of_each_group), ("mixing sources", mix_sources), ("packing", pack_batches)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}")
    return docs
