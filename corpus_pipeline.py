"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents, the last one
the pieces of packed sequences. Between stages run() writes Parquet to the shared folder and reads it again.

Defined results, in every stage: an empty table gives an empty one; columns besides those of documents go, whatever
their names, so none can clash; null lang, source and n_chars stay null. A null doc_id counts as the largest and stays
null. Rows that are alike in id and text share one fate in each stage. What becomes of null and empty texts, ties and
repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table
from tidemark.llm.decontamination import matches
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.packing import pack
from tidemark.llm.quality import accepted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, as they are. A null text is scored as an empty one; equal texts get equal scores."""
    return accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which no line but blank ones stays go, if they had any.

    Of alike lines the first by id, then by a hash of the text, then by place stays. Null and empty texts have no lines to
    lose and stay; n_chars is counted anew where lines went.
    """
    out = line_dedup(docs, keep=_REST)
    gone = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\r\f\x0b", "")) == "")
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast("long")
    return out.where(~F.coalesce(gone, F.lit(False))).select("doc_id", "text", "rest.lang", "rest.source", changed.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked ones. Rows with that id stay together; documents without a word, null ones too, link with nothing and stay."""
    groups = jaccard_components(docs)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("rk")
    # jaccard_components names a row by its id and its text, null as empty
    named = docs.select(*COLUMNS).withColumn("rk", F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return named.join(stays, "rk", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts hold none, null and wordless items match nothing."""
    found = matches(docs, table(spark, sf_dir, "benchmark"), keep=_REST)
    return found.where(F.size("matches") == 0).select("doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end token alone; repeated rows are pieces each."""
    return pack(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("best_fit_packing", packing)]

#: Scores, sketches and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
