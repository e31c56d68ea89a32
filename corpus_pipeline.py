"""From raw documents to training sequences, one operator after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafill.llm import langid
from stratafill.llm.common import KEY, document_key, same, set_aside, small_batches
from stratafill.llm.decontaminate import contamination
from stratafill.llm.linededup import dedup_lines
from stratafill.llm.minhash import near_duplicates
from stratafill.llm.packing import pack_documents
from stratafill.sources.staging import stage

TOKENIZER = "byte_bpe_50k.json"
LEAST_LANGUAGE_SCORE = 0.5


def _unchanged(docs: DataFrame, names: list[str], apply) -> DataFrame:
    """``apply`` to ``docs`` while columns of these names are called something else."""
    safe, back = set_aside(docs, names)
    return apply(safe).select(*safe.columns).withColumnsRenamed(back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised with a calibrated probability of a half.

    Null and empty texts, and texts without a letter, go. Each repeated row is judged alike.
    Columns of any name are kept as they are. The model is learned from the rows that it judges.
    """
    small_batches(spark)
    model = langid.train(docs.select("text", "lang"))

    def keep(rows: DataFrame) -> DataFrame:
        return langid.predict(rows, model).where(
            (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _unchanged(docs, ["lang_pred", "score"], keep)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that match an earlier line; documents that lose every word go.

    So do null and empty texts. ``n_chars`` follows the text, other columns are kept as they are.
    Rows that repeat a document lose the same lines.
    """
    small_batches(spark)

    def keep(rows: DataFrame) -> DataFrame:
        left = dedup_lines(rows).where(F.col("_lines") > F.col("_removed"))
        return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _unchanged(docs, ["_lines", "_removed", "_links"], keep)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (of equal rows, any one).

    Each null text, or text without a word, is a group of its own; a null id is the least.
    """
    small_batches(spark)

    def keep(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumns(document_key(rows))
        # written, so that the rows of a document that repeats can be split
        kept = stage(near_duplicates(rows).where("keep").select(*KEY), "kept")
        # copies of a row go before the shuffle
        return keyed.join(kept, same(keyed, kept, KEY), "left_semi").dropDuplicates(KEY)
    return _unchanged(docs, KEY, keep)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item; null and empty texts hold none."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def keep(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumns(document_key(rows))
        hit = stage(contamination(rows, benchmark).where("n_hit > 0").select(*KEY), "hit")
        return keyed.join(hit, same(keyed, hit, KEY), "left_anti")
    return _unchanged(docs, KEY, keep)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in sequences of at most 2048 tokens.

    ``ids`` are little-endian 32-bit numbers; the pieces of a sequence_id in the order of their
    offsets are the sequence. A null or empty text is the end id alone, repeated rows are packed
    each, and other columns play no part.
    """
    import public_tokenizers

    small_batches(spark)
    packed = pack_documents(docs, public_tokenizers.path(TOKENIZER))
    return packed.select(F.col("_id").alias("doc_id"), "piece", "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]

#: no SQL: a trained model decides in the first stage, and the last one runs a tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
