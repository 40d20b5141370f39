"""From raw documents to packed training sequences, one staged operator after another."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import collecting, deleted, read, shared_folder, staged
from quantloom.llm.decontaminate import decontaminate
from quantloom.llm.line_dedup import line_dedup
from quantloom.llm.minhash import near_duplicates
from quantloom.llm.packing import pack
from quantloom.llm.quality_rules import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Paths of the tables that the last stage has staged, for each thread that runs a pipeline.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def stage(f: Stage) -> Stage:
    """Delete what the stage before has staged, if its output is written by then, and note what this one stages.

    Where docs still reads those tables, since stages are chained without writing between them, they stay.
    """

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before, own = _STAGED.get() or [], []
        read_yet = docs.inputFiles() if before else []
        if any(path.rsplit("/", 1)[1] in name for path in before for name in read_yet):
            own = before
        else:
            deleted(spark, before)
        _STAGED.set(own)
        with collecting(own):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality_rules(docs, carry=COLUMNS).filter("kept").select("carried.*")


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; all documents stay, with n_chars of what is left."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the least id; rows are told by a number that is written with them."""
    rows = staged(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    kept = near_duplicates(rows, row="row").filter("kept").select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"), unnamed=True, carry=COLUMNS)
    return found.filter("n_hit = 0").select("carried.*")


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The last stage's token ids come from a tokenizer library, which SQL has not.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's output is written as Parquet to the shared folder and read again.

    Once a stage's output is written, what it has staged and the output before it are deleted.
    """
    docs, before = read(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, apply in STAGES:
        path = f"{shared_folder(spark)}/quantloom/pipeline-{name}-{uuid.uuid4().hex}"
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        deleted(spark, _STAGED.get() or [])
        deleted(spark, before)
        before = [path]
    return docs
