"""The thin registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, backoff, mixing, pii, ppm, quality, simhash, unigram, urlfilter, warc
from .common import scratch, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ALLOW = [("example.com", "/en/7"), ("net", "/de/")]
BLOCK = [("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/")]


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), window=None))


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs)).withColumnRenamed("id", "doc_id")


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), ALLOW, BLOCK).withColumnRenamed("id", "page_id")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = backoff.score(table(spark, sf_dir, "documents"), min_count=2, backoff=0.4)
    return told.select(F.col("id").alias("doc_id"), "n_scored", F.round("log_score", 4).alias("log_score"))


def op5_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = ppm.trainable("doc_id")
    model = ppm.fit(docs.where(learn))
    told = ppm.identify(docs, model, columns=["doc_id"])
    return told.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = ann.fit(vectors)
    index = ann.encode(vectors, model)
    asked = index.where(F.pmod("id", F.lit(20)) == 0).select("id", "vec")
    return ann.search(index, asked, model, k=20)


def op8_sentencepiece_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    vocab = unigram.load(vocabulary)
    coded = unigram.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab)
    first, last = (int(vocab.byte_id[[0, 255]][i]) for i in (0, 1))
    told = coded.withColumns({"n_pieces": F.size("ids").cast("long"), "n_bytes": F.size(F.filter("ids", lambda x: x.between(first, last))).cast("long"), "ids_hash": F.xxhash64("ids")})
    back = unigram.decode(told, vocab)
    return back.select("doc_id", "n_pieces", "n_bytes", "ids_hash", F.round("log_score", 3).alias("log_score"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = mixing.plan(docs, max_repeats=2.0)
    return mixing.mix(docs.select("doc_id", "source"), lines)


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), "component_id")
