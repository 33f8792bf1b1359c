"""The corpus pipeline: five of the training-data operators, one after another, over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as Parquet in the shared folder and
read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common, decontam, line_dedup, mixing, near_dup, quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


#: What the last stage of this thread has stored on its way, which its result is read from.
_LEFT: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stage(f: Stage) -> Stage:
    """A stage that first deletes what the one before it has stored on its way, as its result is written by then; unless docs are read from that."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = list(_LEFT.get())
        names = [p.rsplit("/", 1)[-1] for p in left]
        if left and not any(n in file for file in docs.inputFiles() for n in names):
            common.forget(spark, left)
        with common.recorded() as made:
            out = f(spark, docs, sf_dir)
        _LEFT.set(tuple(made))
        return out

    return run_stage


@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs.select(*DOCUMENT))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do documents of which nothing is left by that."""
    out = line_dedup.dedup_lines(docs.select(*DOCUMENT))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\t-\r]", " ")) == "", F.lit(False))
    return out.where((F.col("n_removed") == 0) | ~blank).withColumn("n_chars", n_chars).select(*DOCUMENT)


def numbered(docs: DataFrame) -> DataFrame:
    """Stored documents with _row, a number of each row: ids may be null or repeat."""
    return common.stored(docs.select(*DOCUMENT).withColumn("_row", F.monotonically_increasing_id()), "numbered")


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows (five-word shingles, similarity 0.8 or more) the one with the smallest doc_id stays, whatever others share that id; a row without id only if all are."""
    docs = numbered(docs)
    # stored, as it is read twice and its plan is a large one
    near = common.stored(near_dup.near_duplicates(docs, id_col="_row", k=5, percent=80).select("_row", "component_id", "kept"), "near")
    members = near.join(near.where("not kept").select("component_id").distinct(), "component_id", "left_semi")
    members = common.stored(members.select("_row", "component_id").join(docs.select("_row", "doc_id"), "_row"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    best = members.groupBy("component_id").agg(first).select(F.col("first._row").alias("_row"))
    others = members.select("_row").join(best, "_row", "left_anti")
    return docs.join(others, "_row", "left_anti").select(*DOCUMENT)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ten successive words (or the whole) of a benchmark item go, and no others, whatever their ids."""
    docs = numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.contamination(docs, benchmark, id_col="_row").where("contaminated").select("_row")
    return docs.join(hit, "_row", "left_anti").select(*DOCUMENT)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of the sources, with weights by the square roots of their sizes."""
    return mixing.mix_sources(docs.select(*DOCUMENT))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Several stages (EM, a fitted model, Pfair scheduling) have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            kept = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(kept)
        common.drop(docs)
        docs = kept
    return docs
