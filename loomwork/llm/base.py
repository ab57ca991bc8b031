"""What the corpus operators share: shipping code, Arrow maps, lineage cuts.

All operators read only the columns they name, so further columns of any name
do no harm, and emit columns of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.plans.shipping import ship

#: Text bytes handled at once inside a task; a single longer text makes its own group.
GROUP_BYTES = 4 << 20


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow with the package shipped; `fn` gets and yields record batches."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string (usable on executors without a session)."""
    fields = []
    for part in ddl.split(","):
        name, kind = part.strip().split(" ")
        fields.append((name, _ARROW[kind]))
    return pa.schema(fields)


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<long>": pa.list_(pa.int64()),
}


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(sizes: Iterable[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most `limit` bytes together (one row at least)."""
    start = total = 0
    last = -1
    for last, n in enumerate(sizes):
        if last > start and total + n > limit:
            yield start, last
            start, total = last, 0
        total += n
    if last >= start:
        yield start, last + 1


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where it is not set.

    The warehouse is by default a folder of the driver's own disk: on a cluster set one of the two to a shared folder.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


#: Keys that hold more than one in so many rows are common: at most as many are broadcast.
COMMON = 1000


def labelled(rows: DataFrame, labels: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """rows (all of them) with the columns of labels (one row a key, with `n`, how many of `total` rows have it; dropped).

    The labels of common keys are broadcast, `COMMON` at most; their rows pass the shuffle under the hash `spread`
    instead of their key, so that no task gets the rows of one key.
    """
    names = [c for c in labels.columns if c not in (key, "n")]
    common = labels.where(F.col("n") * COMMON > total).select(key, F.lit(True).alias("is_common"), *(F.col(c).alias(f"common_{c}") for c in names))
    dealt = rows.join(F.broadcast(common), key, "left").withColumn("dealt", F.when(F.col("is_common").isNull(), F.col(key)).otherwise(spread))
    other = labels.where(F.col("n") * COMMON <= total).select(F.col(key).alias("dealt"), *(F.col(c).alias(f"other_{c}") for c in names))
    joined = dealt.join(other, "dealt", "left")
    picked = [F.when(F.col("is_common"), F.col(f"common_{c}")).otherwise(F.col(f"other_{c}")).alias(c) for c in names]
    return joined.select(*rows.columns, *picked)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
