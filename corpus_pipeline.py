"""A corpus pipeline of four numbered operators: clean languages, drop near-duplicates, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, mixing, packing, simhash
from larkspur.llm.shared import fresh, stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those unlike all learned languages, by a bound for their length.

    If no language could be learned, all documents with letters are kept. Null
    and empty texts go; a text of any length is read whole; repeated rows are kept
    each; an empty table stays empty; other columns pass through, whatever their names.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    lang, sure, belongs = (fresh(docs, name) for name in ("_pred", "_score", "_belongs"))
    found = langid.identify(docs, model, lang_col=lang, score_col=sure, belongs_col=belongs)
    return found.where(F.col(belongs)).select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of their own, written once so that it stays; ids may be missing or shared."""
    row = fresh(docs, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts whose sets of five-word shingles have a similarity of 0.8 or more.

    It is the one with the least id, a missing id being the last. Texts without
    words are one group; repeated rows are copies; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    root = fresh(keyed, "_root")
    found = simhash.similar_texts(keyed, row).withColumnRenamed("root", root)
    least = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(row)
    kept = keyed.select(row, "doc_id").join(found, row).groupBy(root).agg(least)
    return keyed.join(kept.select(row), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: up to three times, or never.

    Null and empty texts have no words and are taken as often as their source
    takes each for certain; null sources are one source; null ids and repeated
    rows are rows of their own; an empty table stays empty.
    """
    keyed, row = _keyed(docs)
    return mixing.repeat_documents(keyed, mixing.mix(keyed, id_col=row), id_col=row, unique=True).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, as ``packing.pack`` gives them: each row for itself, null and empty texts as one id."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The mix draws at random and the classifier is learned: SQL cannot express them. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "stage")
    return docs
