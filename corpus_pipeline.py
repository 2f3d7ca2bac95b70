"""Corpus preparation in five stages, each over all that the one before kept:
quality filter, line deduplication, near-duplicates, mixing to target weights,
token ids.

A stage takes (spark, docs, sf_dir) and returns a frame; it is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.  Null texts, null ids, repeated rows, empty tables and
extra columns are handled as each operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, linededup, mixing, quality, simhash
from tessera.llm.catalog import DOMAINS
from tessera.llm.tables import free_name, row_struct, written
from tessera.session import ship_package
from tessera.sources.tables import table

MIN_QUALITY = 0.3
DOMAIN = "__domain"
#: weights among siblings; what is not named has weight 1
WEIGHTS = {DOMAIN: {"web": 5, "reference": 2, "other": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}
#: tokens wanted, of the tokens there are
BUDGET = "tokens * 9 div 10"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is MIN_QUALITY at least."""
    ship_package(spark)
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return quality.score(docs, model, out_col=score).where(F.col(score) >= MIN_QUALITY).drop(score)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines deleted from later documents; a document that
    loses its last word so is dropped, and n_chars follows the text."""
    ship_package(spark)
    got = linededup.dedup_lines(docs.select("doc_id", "text", row_struct(docs).alias("row")))
    gone = (F.col("n_removed") > 0) & (F.col("text") == "")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": chars}
    return got.where(~F.coalesce(gone, F.lit(False))).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays,
    among rows of one id the one whose text has the smallest hash.  Documents
    without an id belong to no group and stay."""
    ship_package(spark)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), row_struct(docs).alias("row"))
    groups = simhash.near_duplicates(own, shingle_words=4, max_bits=4, segments=3, keep=("th",))
    first = groups.where(F.col("doc_id").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("least")).select("least.*").distinct()
    kept = own.join(first, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budget of BUDGET tokens takes under WEIGHTS, each once at most."""
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), F.lit(name)).otherwise(domain)
    rows = docs.select("doc_id", "text", "lang", "source", domain.alias(DOMAIN), row_struct(docs).alias("row"))
    taken = mixing.mix(rows, [DOMAIN, "lang", "source"], WEIGHTS, F.expr(BUDGET), epochs=1)
    return taken.select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the SHA-256 of the bytes that the ids decode to."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, ranks, keep=["doc_id", "lang", "source"]), ranks)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: the classifier, the alignment and the tokeniser are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
