"""Rows of two sides that meet under a key, block by block inside tasks: a large key is many small pieces of work."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Rows of a side that one piece holds, about.
ROWS = 2048
#: Tasks that the pieces are dealt to, for each core: their work does not show in their bytes, by which tasks would be put together.
TASKS = 4


def meet(a: DataFrame, b: DataFrame, keys: list[str], by: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, rows: int = ROWS, rows_b: int | None = None) -> DataFrame:
    """``run`` of every block of ``a`` with every block of ``b`` of the same key; blocks are dealt by a hash of ``by``.

    Each pair of rows of a key comes together in exactly one piece, and no piece holds more than about ``rows`` of a side
    (``rows_b`` of ``b``, if given).
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    a, b = written(a.repartition(tasks, by)), written(b.repartition(tasks, by))  # many tasks then repeat rows for the other side's blocks
    blocks = lambda df, name, rows: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = written(blocks(a, "__na", rows).join(blocks(b, "__nb", rows_b or rows), keys))
    block = lambda n: F.pmod(F.xxhash64(by, F.lit(11)), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = a.join(sizes, keys).withColumn("__a", block("__na")).withColumn("__b", all_("__nb")).drop("__na", "__nb")
    two = b.join(sizes, keys).withColumn("__b", block("__nb")).withColumn("__a", all_("__na")).drop("__na", "__nb")
    at = [*keys, "__a", "__b"]
    one, two = one.repartition(tasks, *at), two.repartition(tasks, *at)
    return one.groupBy(*at).cogroup(two.groupBy(*at)).applyInArrow(run, schema)


def columns_of(df: DataFrame, names: list[str]) -> str:
    """The named columns as a schema text."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
