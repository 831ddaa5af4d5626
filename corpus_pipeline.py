"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, packing.

Every stage works on all that its predecessor kept. A stage's result must be written before the next stage is called on
what was written, in the same session; frames that are chained unwritten keep their tables. STAGES' functions take (spark, docs,
sf_dir); all but the last return the columns of documents. run() chains them over the documents of a folder.

Cases, as the operators have them: a null or empty text fails the quality rules; a null source has no host verdict; rows with
equal ids stay or go together as near-duplicates and don't remove each other's passages; a null id is larger than all others;
an empty table gives empty results at every stage; extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import neardup, packing, quality, substrings
from terrafold.llm.queries import PACK_END, tokenizer
from terrafold.session import discard, made, materialize, shrink_heaps

#: Near-duplicates here are documents whose sets of five-word shingles have a similarity of 0.8 or more.
SHINGLE = 5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that earlier stages of a session have put into the shared folder.
_HELD: dict[tuple[str, int], list[str]] = {}


def stage(fn: Stage) -> Stage:
    """Deletes what earlier stages left in the shared folder, if docs doesn't read it: then their results are written.

    The heaps that they have grown are shrunk, since what follows has Python workers beside them.
    """

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = _HELD.setdefault((spark.sparkContext.applicationId, id(spark)), [])
        files = docs.inputFiles() if held else []
        if held and not any(path.rpartition("/")[2] in file for file in files for path in held):
            discard(spark, held)
            held.clear()
        shrink_heaps(spark)
        before = len(made())
        out = fn(spark, docs, sf_dir)
        held.extend(made(before))
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of their own or whose host is rejected."""
    return quality.apply(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least id, of each group of near-duplicates."""
    return neardup.apply(docs, shingle=SHINGLE)


@stage
def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of passages that start in an earlier document too; n_chars follows the text."""
    out = substrings.apply(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=PACK_END)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("best_fit_packing", best_fit_packing)]

#: SQL has no tokenizer and no packer: the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = materialize(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
