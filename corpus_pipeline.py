"""A training corpus from `documents`: five stages, each one operator, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldspark.llm import decontam, langid, linededup, neardup, packing
from ldspark.llm.tables import at_end, collecting, delete, prepare, read, shared_dir

#: Documents whose n-grams are a language's to a lesser share are rejected: no text of any language, such
#: as keys, markup or random letters. Prose scores about 0.9, prose with much else in it above 0.5.
LEAST_LANGUAGE_SCORE = 0.15


#: Tables that the last stage of an application built on.
_MADE: dict[str, list[str]] = {}


@contextmanager
def _tables(spark: SparkSession) -> Iterator[None]:
    """The result of the stage before is stored, so its tables go; those made meanwhile wait for the next stage."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    delete(spark, made)
    with collecting(made):
        yield


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach. Null, empty and letterless texts are in none
    and go; repeated rows and ties of ids are judged alike. More columns are kept, whatever their names."""
    with _tables(spark):
        model = langid.fit(docs.filter(~langid.held_out()))
        found = langid.identify(docs, model, docs.columns, ("__language", "__score"))
        return found.filter((F.col("__language") != langid.UNKNOWN) & (F.col("__score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; those left without any go. Null texts and texts without
    words stay. Rows alike in id and text keep the same lines. n_chars, if there, is that of the text that is left."""
    with _tables(spark):
        out = linededup.without_repeated_lines(docs)
        if "n_chars" not in docs.columns:
            return out
        return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the least doc_id; rows with that id all stay. Texts that
    are null or without words are in no class."""
    with _tables(spark):
        return neardup.without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Rows are judged each."""
    with _tables(spark):
        return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids and their places in sequences of 2048; a null text is as empty."""
    with _tables(spark):
        return packing.pack(packing.cut_pieces(docs, with_ids=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("decontamination", benchmark),
    ("packing", sequences),
]

#: Tokens and trained models are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is stored in the shared folder before the next stage reads it, and goes
    when the next one is stored; the last goes when the application ends."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(prepare(spark))}/pipeline-{uuid.uuid4().hex}"
    stored: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        delete(spark, stored)
        stored.append(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    at_end(spark, folder)
    delete(spark, _MADE.setdefault(spark.sparkContext.applicationId, []))
    return docs
