"""The corpus pipeline: language ID, near-duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; columns of other names pass through all of them. Every stage gives
an empty table for an empty one, and treats rows that are equal in all columns alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, pii, ppm, simhash, unigram
from .common import discard, scratch, unused

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the model rejects, and sets lang to the language told.

    Rejected are null and empty texts, texts without a letter, and those whose best language isn't likelier than all others
    together (ties between two languages among them). A null id is kept; a null lang or source is neither learnt from nor a
    reason to reject. Without a labelled text nothing can be told, and nothing is kept.
    """
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    told = ppm.identify(docs, ppm.fit(docs.where(ppm.trainable())), lang_out=lang, score_out=score)
    kept = told.where((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE))
    return kept.select(*[F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id: five-word shingles, similarity 0.8.

    Texts of fewer words are one shingle; null texts and those without a word resemble each other. Rows of null id stay.
    Rows that repeat the id and text that stays are repeated in the result.
    """
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes terms that disclose it; n_chars follows the text (null for a null one).

    No row is dropped. Null and empty texts stay as they are, rows of null id are treated like others.
    """
    clean = pii.sanitize(docs, window=None)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Temperature mixture with at most two passes over any source and one full pass over each: no document is lost.

    The null source is a source of its own. Sources without a word pass once. Rows of one id and source have equal copies.
    """
    copied = mixing.mix(docs, mixing.plan(docs, max_repeats=2.0), epoch_out=unused(docs, "__epoch"), key_out=unused(docs, "__place"))
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document (ids, log_score), with the columns of documents but the text, which the ids decode to.

    Null texts have null ids, empty ones no ids.
    """
    return unigram.encode(docs, unigram.load(VOCABULARY)).drop("text")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("pieces", pieces)]

#: Hashing, the byte model, the connected components and the Viterbi search can't be said in SQL; tests/llm/test_pipeline.py
#: holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read is deleted once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
