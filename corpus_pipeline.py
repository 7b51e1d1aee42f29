"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup and best-fit packing over documents.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of
documents, the last one row for each packed piece. Every stage reads doc_id and text of its rows (line dedup source too, the
classifier labels beside them) and passes all other columns through, whatever their names. Null, empty and very long texts,
null doc_ids, ties, repeated rows and empty tables have the results that the stages' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import line_dedup, near_dedup, packing, quality, shared, token_files


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row by its own text.

    A null text is judged as an empty one; a tie (a score of exactly the threshold) stays; repeated rows share their fate; a null
    doc_id is judged, but not learned from; an empty table stays empty.
    """
    return quality.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go but for their first place, and so do documents in which nothing else stood; n_chars follows the text.

    A null text stays null and an empty one empty, and both stay; a null source is a site of its own; the first place is the smallest
    doc_id (null first), then line; a repeated row that holds it keeps it each time; an empty table stays empty.
    """
    kept = line_dedup.remove_boilerplate(docs, drop_emptied=True)
    return kept.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies stays.

    Null and empty texts have no copies and stay; so do rows with a null doc_id; rows that repeat one doc_id are one document and stay or
    go together; ties go to the smaller doc_id; an empty table stays empty.
    """
    return near_dedup.remove_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences and offsets.

    A null or empty text is its end id alone; a text longer than a sequence is cut; repeated rows and null doc_ids are packed each on
    its own; an empty table gives no pieces.
    """
    return packing.pack(docs, token_files.vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
