"""Documents to packed sequences in five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlens.llm.common import Scratch, documents
from weftlens.llm.line_windows import without_repeats
from weftlens.llm.minhash_stars import MinHashParams, without_near_duplicates
from weftlens.llm.packing import pack
from weftlens.llm.pii_crf import redacted, train
from weftlens.llm.quality_repeats import good_documents


#: Near copies are those at a similarity of 0.8; so many bands miss such a pair with probability below 1e-8.
NEAR = MinHashParams(percent=80, bands=35)


# All stages: an empty table gives an empty one; other columns of docs come along unchanged, whatever their names; texts are
# worked on whole, a very long one as a chunk of its own.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the repetition limits keep.

    Null and empty texts have no words and go; rows that repeat are judged each, so all or none of them stay.
    """
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of windows that stood earlier in the corpus.

    Null texts stay null, texts of fewer than three lines as they are; a text may become empty. Rows equal in doc_id and text
    are one place and keep the same lines.
    """
    return without_repeats(docs, counted=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates at a similarity of 0.8.

    Texts without words, null ones and rows without a doc_id stay; of rows equal in doc_id and text one stays.
    """
    return without_near_duplicates(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null and empty texts stay so, rows that repeat stay apart."""
    return redacted(docs, train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences; null and empty texts are one token, rows that repeat are packed each."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]

#: Suffix arrays, message passing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
