"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A word: a run of anything but space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to Python, unless the application says otherwise: texts vary too much for a count of rows.
BATCH = 4 << 20


def session(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, in batches of bounded bytes."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH))
    return spark


def release() -> None:
    """Give memory that a worker has freed back to the system: executors share it with their JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and all runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfew-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = session(df.sparkSession)
    path = f"{shared_dir(spark)}/lumenfew/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` has made, once what was made of them is written."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lumenfew/" in path:
                hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def append_arrow(df: DataFrame, column: str, fields: list[tuple[str, str]], fn, keep: list[str] | None = None, limit: int = 2 << 20) -> DataFrame:
    """Add the columns that ``fn`` makes of a string column, in Arrow batches of about ``limit`` text bytes.

    ``fn(array)`` returns one array for each of ``fields``. Columns of ``df`` that have
    a result's name are replaced. ``keep`` lists the columns to pass on (all by default).
    """
    import pyarrow as pa

    names = [name for name, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    # plain names on the way, whatever the columns are called
    source = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], F.col(column).alias("__text"))
    schema = ", ".join([f"`{name}` {f.dataType.simpleString()}" for name, f in zip(kept, source.schema, strict=False)] + [f"`{n}` {t}" for n, t in fields])

    def run(batches):
        from lumenfew.llm.textvec import slices

        for batch in batches:
            for part in slices(batch, "__text", limit):
                made = fn(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *(pa.array(x) for x in made)], names=[*kept, *names])
        release()

    return source.mapInArrow(run, schema)
