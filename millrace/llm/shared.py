"""What the corpus operators share: the shared working folder, word splitting, sizes.

Words are maximal runs of `[^\\x20\\x09-\\x0D]+`, everywhere in this package.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, without the blank itself.
SPACES = "\t\n\x0b\x0c\r"


_LOCAL: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
    return _LOCAL[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: this cuts the lineage,
    and a lost executor costs no more than the task it ran."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    WRITTEN[path] = df.sparkSession
    made._millrace_path = path
    return made


#: Folders of this driver's runs that still stand.
WRITTEN: dict[str, SparkSession] = {}


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = df.__dict__.get("_millrace_path")
        if path in WRITTEN:
            _delete(WRITTEN.pop(path), path)


def sweep() -> None:
    """Delete all that this driver's runs wrote, once their results have been saved."""
    for path, spark in list(WRITTEN.items()):
        del WRITTEN[path]
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column = "text") -> Column:
    """array<string> of a text's words (null: none)."""
    return F.array_remove(F.split(F.translate(text_of(column), SPACES, " " * len(SPACES)), " "), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learned(column: str | Column, modulus: int, held_out: int) -> Column:
    """Whether a row belongs to the learning side: crc32 of its id as text, modulo modulus."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


_REMEMBERED: dict[str, dict] = {}


def remembered(kind: str, most: int) -> dict:
    """What a Python worker remembers between its tasks for one operator, emptied above `most` entries.

    A worker runs one task at a time, so what other operators remembered is dropped: a worker
    that serves many stages holds the memory of one."""
    for other in [k for k in _REMEMBERED if k != kind]:
        del _REMEMBERED[other]
    known = _REMEMBERED.setdefault(kind, {})
    if len(known) > most:
        known.clear()
    return known
