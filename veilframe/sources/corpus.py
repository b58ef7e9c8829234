"""Reading and writing labelled corpora and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SCHEMA = (
    "doc_id long, source_text string, "
    "privacy_mask array<struct<start:int,end:int,label:string>>, split string"
)
VOCAB_SCHEMA = "label string, label_id int, entity string, bio string"
LABEL_INFO_SCHEMA = (
    "entities array<string>, label2id map<string,int>, id2label map<string,string>, "
    "all_entities_counted map<string,bigint>, train_counted_entities map<string,bigint>"
)


def read_corpus(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A corpus of splits; naming one reads that partition only."""
    rows = spark.read.schema(CORPUS_SCHEMA).parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def write_corpus(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_vocab(vocab: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON row per label; a vocabulary is small, so one file holds it."""
    vocab.coalesce(1).write.mode(mode).json(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).json(path)


def label_info(vocab: DataFrame, all_counts: DataFrame, train_counts: DataFrame) -> DataFrame:
    """One row with the entity list, both label maps and both count maps.

    Every part is already reduced to one row per label, so gathering is bounded
    by the vocabulary.
    """
    blank = F.lit(None)
    tags = vocab.select(F.lit("tag").alias("part"), "label", "label_id", "entity", "bio", blank.cast("long").alias("n"))
    counts = [
        df.select(
            F.lit(part).alias("part"), "label", blank.cast("int").alias("label_id"),
            blank.cast("string").alias("entity"), blank.cast("string").alias("bio"), "n",
        )
        for part, df in (("all", all_counts), ("train", train_counts))
    ]
    rows = tags.unionByName(counts[0]).unionByName(counts[1])

    def gathered(part: str, *fields: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct(*fields))))

    lists = rows.agg(
        gathered("tag", "label_id", "label", "bio", "entity").alias("tags"),
        gathered("all", "label", "n").alias("all"),
        gathered("train", "label", "n").alias("train"),
    )
    begun = F.filter("tags", lambda t: t["bio"] == "B")
    return lists.select(
        F.transform(begun, lambda t: t["entity"]).alias("entities"),
        F.map_from_entries(F.transform("tags", lambda t: F.struct(t["label"], t["label_id"]))).alias("label2id"),
        F.map_from_entries(F.transform("tags", lambda t: F.struct(t["label_id"], t["label"]))).alias("id2label"),
        F.map_from_entries("all").alias("all_entities_counted"),
        F.map_from_entries("train").alias("train_counted_entities"),
    )


def write_label_info(info: DataFrame, path: str, mode: str = "error") -> None:
    info.coalesce(1).write.mode(mode).json(path)


def read_label_info(spark: SparkSession, path: str) -> DataFrame:
    """Ids are text in JSON and come back as integers."""
    info = spark.read.schema(LABEL_INFO_SCHEMA).json(path)
    return info.withColumn("id2label", F.transform_keys("id2label", lambda k, _: k.cast("int")))
