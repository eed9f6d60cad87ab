"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and gets all that the one before it kept; ``run``
writes what a stage returns as Parquet and gives the next one what it reads back.

All stages take any rows: null ids are ids like others, null and empty texts are texts without words (they are not toxic,
have no line that goes, are near-duplicates of one another, hold no passage and have no pieces), very long texts are read
whole, in one task, an empty table gives an empty one. Rows that repeat are judged alike and stay, but the near-duplicate
stage keeps one row of a group. Stages return the columns of ``documents``; other columns of their input, whatever their
names, are not carried on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, lines, pieces, simhash, toxicity
from tessella.llm._shared import fold_of, give_back, stored, table, without
from tessella.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECT_FROM = 0.7  # toxicity score
WINDOW = 13  # consecutive words of a benchmark item that no document may hold
SHINGLE, BITS = 5, 24  # words of a shingle; differing bits of 64 up to which pairs are verified on their shingles


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``REJECT_FROM``. The model learns from the labels of two folds of three."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < REJECT_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats; documents may be left with an empty text. ``n_chars`` is
    counted anew, but for null texts."""
    give_back(spark)
    left = lines.dedup_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, ``simhash.SHARE`` of the shingles being the same, one row: that with the least id
    that is not null, and of rows with one id that with the least hash of its text."""
    give_back(spark)
    groups = stored(simhash.near_duplicates(docs, width=SHINGLE, k=BITS).select("doc_id", "th", "root"), "groups")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = groups.groupBy("root").agg(F.min(own).alias("m")).select("m.doc_id", "m.th")
    others = groups.select("doc_id", "th").distinct().exceptAll(first)
    left = without(docs.select(*COLUMNS), others)
    again = stored(groups.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th"), "again")
    if not again.head(1):
        return left
    # rows that repeat id and text: the first of them in the order of the other columns
    once = without(left, again)
    keys = again.select(F.col("doc_id").alias("id"), F.col("th").alias("hash"))
    rest = left.join(keys, left.doc_id.eqNullSafe(keys.id) & (F.xxhash64(left.text.cast("binary")) == keys.hash), "left_semi")
    rest = rest.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("m"))
    return once.unionByName(rest.select("doc_id", "text", "m.*").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of ``WINDOW`` words from benchmark passages, however long they are, and of which less than a
    twentieth are words of items shorter than that; so a short item, which may be a common phrase, condemns no long text."""
    give_back(spark)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), window=WINDOW)
    return without(docs.select(*COLUMNS), found.where((F.col("longest_hit") >= WINDOW) | F.col("contaminated")).select("doc_id", "th"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with sampled pieces, and whether decoding them gives the text back."""
    give_back(spark)
    return pieces.segment(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"), slice_bytes=256 << 10)  # workers already hold what the stages before left


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: SQL cannot express these stages; the tests hold each against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
