"""From raw documents to token samples: toxicity, exact dedup, near dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next takes as
docs; all but the last return the columns of documents.

For every stage: other columns are carried along, whatever their names; null ids are kept as ids;
an empty table gives an empty result; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualweave.llm import exact_dedup, mixing, near_dedup, sentencepiece_lattice, toxicity
from qualweave.session import cut, ensure_workers, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.

    Null and empty texts have no features and are scored by the bias alone, so they stay
    unless most labelled rows are toxic. Repeated rows are scored alike.
    """
    ensure_workers(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null and empty texts are one text, of which one row stays; a null id is smaller than all
    others; of rows that repeat an id and text one stays.
    """
    ensure_workers(spark)
    return exact_dedup.exact_keep(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts the row with the smallest doc_id stays.

    Texts without words, null ones too, have no near-duplicates and stay; texts of 1 to 4
    words have one shingle of them all.
    """
    ensure_workers(spark)
    return near_dedup.near_keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (0 to 2) as its source's target takes it.

    A null source is a source, the last by name. Documents without words have size 0 and
    go by the same threshold as others of their source; copies of a row are rows that repeat its id.
    """
    ensure_workers(spark)
    return mixing.mixed(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of each document with inclusion scores.

    A null or empty text has one segmentation, without pieces. Rows that repeat an id and
    text, as the mix makes them, give equal samples.
    """
    ensure_workers(spark)
    return sentencepiece_lattice.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("sentencepiece", sample_pieces),
]

#: SQL can't express the trained classifier, the sampled signatures or the perturbed search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
