"""Shared helpers: memory of worker processes, Arrow row loops, heavy-light joins and components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import star_components
from ..storage import saved, scratch  # noqa: F401

#: Word separators of every contract here: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


_STATE: dict[str, object] = {}


def worker_state(owner: str, make: Callable[[], object]):
    """What a worker process keeps between the tasks of one operator; the first task of another owner drops it."""
    if owner not in _STATE:
        _STATE.clear()
        release_memory()
        _STATE[owner] = make()
    return _STATE[owner]


def release_memory() -> None:
    """Give freed memory of this process back: workers outlive their tasks, and what one operator freed the next one can't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows`` for an Arrow map; memory goes back after its last batch, when all that it held (that batch too) is gone."""

    def run(batches: Iterator) -> Iterator:
        yield from rows(batches)
        release_memory()

    return run


def collect_executors(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage: heap that they no longer fill, and buffers outside it that wait for a collection, go
    back before a stage whose memory is that of Python workers beside them. A task a core; an executor without a free core may be
    missed, which costs memory and no rows."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T.StructType.fromDDL(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def map_columns(df: DataFrame, ddl: str, make: Callable[[], Callable[..., list]], owner: str | None = None) -> DataFrame:
    """Arrow map over ``df``. ``make`` runs once a task and returns a function from the batch's column lists to output column lists.

    Batches are cut into slices so that Python objects of only a few hundred rows exist at a time.
    """
    schema, out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if owner is None:  # drops what another operator left in this worker; an owner keeps its own state
            worker_state(ddl, bool)
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)
        finish = getattr(fn, "finish", None)
        if finish is not None:
            cols = finish()
            if cols and len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(releasing(run), schema)


#: Keys with more than this share of the matching rows are at most 1/HOT_SHARE many.
HOT_SHARE = 1 / 2000


def heavy_light_join(rows: DataFrame, dims: DataFrame, on: list[str], count_col: str, least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``dims`` (unique by ``on``), whose ``count_col`` tells how many rows each key has.

    Keys with more than HOT_SHARE of the matching rows are so few that their broadcast has a proven bound, and their rows stay
    where they are; the rest meets by shuffle, no key of it being large. ``count_col`` must be cheap to read: ``dims`` is a saved table.
    """
    total = dims.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > max(least, total * HOT_SHARE)
    few = dims.where(hot)
    direct = rows.join(F.broadcast(few), on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(dims.where(~hot), on)
    return direct.unionByName(rest)


def crc_mod(column: str, k: int):
    """crc32 of an id's text modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def word_count(column):
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def min_label_components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as ``(node, component)`` with the smallest node as component."""
    return star_components(links.select(F.col("a").alias("s"), F.col("b").alias("d"))).withColumnRenamed("root", "component")
