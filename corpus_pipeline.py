"""Corpus pipeline: the stages that turn raw documents into a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and read again before the next.
All but the last return the columns of ``documents``; the last adds the pieces of each text.

Every stage treats rows as rows: null doc_ids and rows with one doc_id are each judged, kept or taken for themselves.  Null texts count as
empty (scored by the classifier, near to nothing, no spans, size 0 in the mix and so never taken).  Very long texts are read whole.  Ties go
to the smaller doc_id, then by text.  An empty table gives an empty result with all columns.  Extra columns are carried, whatever
their names, except that the last stage's own columns take the place of those of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import common, mixing, near_dedup, pieces, pii, quality

#: factorisation machines and searches have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def _quoted(name: str) -> Column:
    return F.col("`{}`".format(name.replace("`", "``")))


def _given(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no name of its columns can clash."""
    return F.struct(*map(_quoted, docs.columns)).alias("given")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores under its threshold.  It learns from the labelled rows of the input."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("text", _given(docs)), model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select("given.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays (five words, 0.8): the one with the smallest doc_id, null last, then by text.

    Rows get a number of their own here, so exact copies without an id, and different texts with one id, are what their texts are.
    """
    whole = common.cut(docs.select(_given(docs), F.monotonically_increasing_id().alias("row")))
    found = near_dedup.near_duplicates(whole.select(F.col("row").alias("doc_id"), F.col("given.text").alias("text")), k=5, per_cent=80)
    first = F.struct(F.col("given.doc_id").isNull(), F.col("given.doc_id"), F.xxhash64("given.text"), F.col("row").alias("row"))
    ranked = whole.select("row", first.alias("first")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    kept = ranked.groupBy("component_id").agg(F.min("first").alias("first")).select("first.row")
    return whole.join(kept.hint("merge"), "row", "left_semi").select("given.*")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it give way to their kind."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: its taken words over its size, rounded (a text cut by its source's target counts from one half).

    Rows are laid out in the order of the schedule's slots: the sources come in turn, in their target shares, from the first file to the last.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text's pieces: ids of the best way, their number and score, the scores of the best ways, and whether decoding gives the text back."""
    out = pieces.encode(docs.select("text", _given(docs)), n=pieces.BEST)
    own = ("ids", "n_pieces", "score", "nbest_scores", "round_trip")
    scores, back = F.col("nbest.score").alias("nbest_scores"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    return out.select(*(F.col("given").getField(c).alias(c) for c in docs.columns if c not in own), "ids", "n_pieces", "score", scores, back)


STAGES = [
    ("quality classifier", filter_quality),
    ("near dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("source mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
