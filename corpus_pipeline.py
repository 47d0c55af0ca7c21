"""A training-data pipeline: toxic documents go, one of each group of near duplicates stays, repeated passages and
personal data are removed, and what is left is packed into token sequences.

Each stage reads what its predecessor kept, written as Parquet to the shared folder, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import ship
from corpusloom.llm.common import released, shared_folder, table
from corpusloom.llm.ngram_join import ngram_jaccard_components
from corpusloom.llm.packing import packed_documents
from corpusloom.llm.pii import redact
from corpusloom.llm.suffix_dedup import without_repeats
from corpusloom.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the scorer learns from ``labels``, ids that are held out aside."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=docs.columns).where(F.col("score") < 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8
    or more); documents without words stay.  Of rows with one id, one stays."""
    groups = ngram_jaccard_components(docs, words=5, percent=80)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = released(kept.select(F.col("doc_id").alias("_kept"), "_rows"))
    chosen = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")))
    once = chosen.where("_rows = 1").select(*docs.columns)
    if kept.where("_rows > 1").isEmpty():
        return once
    return once.union(chosen.where("_rows > 1").dropDuplicates(["doc_id"]).select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 400-byte strings, and without passages of over 50 words, that occur elsewhere too."""
    kept = without_repeats(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")], as_text=True, words=51)
    return renewed(kept, docs, F.col("kept"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose personal data are replaced by their kinds."""
    return renewed(redact(docs), docs, F.col("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2,048 ids."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def renewed(df: DataFrame, docs: DataFrame, text) -> DataFrame:
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


#: Columns that stages name; others may have any names, also those that operators give.
OWN = ("doc_id", "text", "n_chars")


def shipped(stage):
    """``stage`` with the package at hand on executors, and with the documents' further columns under names of their own meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        names = docs.columns
        inner = [c if c in OWN else f"_c{i}" for i, c in enumerate(names)]
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.select(*inner).toDF(*names) if out.columns == inner else out

    return run


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("ngram_join", shipped(one_of_each_group)),
    ("suffix_dedup", shipped(cut_repeats)),
    ("pii", shipped(hide_personal_data)),
    ("packing", shipped(pack_sequences)),
]

#: No stage but the personal data has an SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents; each one's result is stored and read again.  An empty table gives no
    pieces; null texts are empty ones, and so give one piece with the end id alone."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
