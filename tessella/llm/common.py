"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds besides its model.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package.

    Workers get the package's parent folder on their path; on a cluster where the
    code is shipped with ``--py-files`` the extra path entry is harmless.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        spark.sparkContext.setCheckpointDir(conf or os.path.join(os.path.abspath("spark-warehouse"), "checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; survives the loss of executors.

    A checkpoint carries on its plan's estimates of size, which joins multiply: in a loop they get
    as many digits as it has rounds, to a power.  The rows are taken up without them; adaptive
    execution measures what it needs.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    held = df.checkpoint(eager)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which a loop of small plans hardly causes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give back to the system the memory that a task has freed: its worker is kept for the stages that follow.

    Does nothing where the C library can't.
    """
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(c.cast("string").cast("binary")) % modulus).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_text(
    docs: DataFrame,
    work: Callable[[list, list[str | None]], dict[str, Iterable]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Run ``work(ids, texts) -> columns`` over Arrow batches of (id, text).

    Only those two columns reach Python, so extra or clashing columns play no part.
    ``schema`` is DDL; the first output column is the id, given by this function.
    """
    spark = prepare(docs.sparkSession)
    parsed = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            cols = work(ids, texts)
            arrays = [ids.cast(arrow.field(0).type)] + [
                c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type)
                for f in list(arrow)[1:]
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, parsed)


class TwoGenerations:
    """A word cache of bounded size: a full young generation becomes the old one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, words: set) -> list:
        """Words to compute; those found in the old generation move to the young."""
        out = []
        young, old = self.young, self.old
        for w in words.difference(young):
            v = old.get(w)
            if v is None:
                out.append(w)
            else:
                young[w] = v
        return out

    def age(self) -> None:
        """Call between batches only: the batch at hand needs all its words in ``young``."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def labelled(labels: DataFrame, label: str, out_fold: tuple[int, int]) -> DataFrame:
    """(_l, y): each labelled id that is not held out, once.

    ``out_fold``: (modulus, remainder) of ids that are held out.  Several labels of an id count
    as their largest; null ids and null labels play no part.
    """
    modulus, out = out_fold
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != out))
        .groupBy(F.col("doc_id").cast("long").alias("_l"))
        .agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    )


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    out_fold: tuple[int, int],
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of about ``per_class`` rows of each class of ``labelled``, and the class sizes.

    A hash of the id picks the rows, so every run picks the same.  The picked ids number about
    ``2 * per_class`` at any size of the input, which bounds what is broadcast.
    """
    known = labelled(labels, label, out_fold)
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, min(1.0, per_class / n)).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(picked), rows.doc_id == picked._l).select("doc_id", "text", "y"), sizes


def logistic(x, y, weight, l2: float = 1e-2, steps: int = 40):
    """Weights of a logistic regression by Newton steps; the last one is the intercept."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * h[:, None]) + ridge, x.T @ (weight * (p - y)) + l2 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def least(at: Callable, w, steps: int = 60):
    """Where a convex function is least, by Newton steps that never raise it.

    ``at(w)`` gives its value, gradient and curvature; the curvature may be approximate.
    """
    import numpy as np

    value, slope, curve = at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        if size < 1e-5:
            return w - step
        step *= min(1.0, 5 / size)
        for _ in range(20):
            new = at(w - step)
            if new[0] <= value + 1e-10 * (1 + abs(value)):
                break
            step = step / 2
        w, (value, slope, curve) = w - step, new
    return w
