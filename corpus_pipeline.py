"""The corpus pipeline: STAGES in order, each (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept.

All stages but the last return the columns of documents.  The driver of a run writes every stage's result as Parquet and reads it again as the next one's docs; `run` does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretell.llm.common import load, materialise
from foretell.llm.exact_dedup import drop_exact_duplicates
from foretell.llm.kneser_ney import keep_good
from foretell.llm.mixing import mix
from foretell.llm.packing import pack_documents
from foretell.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model does not reject."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks the longest, then the smallest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset; sequences come in the order of the mix, which is that of the rows of the table it was written to."""
    file, row = F.substring_index("_metadata.file_path", "/", -1), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")
    return pack_documents(docs, place=F.concat(file, F.lit(":"), row))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language-model scores and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
