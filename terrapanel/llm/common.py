"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order key of a row whose doc_id is null: such rows come before all others.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one named by spark.checkpoint.dir. Where that is unset, a local session gets a temporary one;
    on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage and survives lost executors."""
    return staged_at(df, label)[0]


def staged_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As staged, with the table's path."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of staged_at that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def limited_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df (a written table of narrow rows), with a broadcast hint if it has at most ``rows`` rows; else Spark joins by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(doc_id: Column, text: Column) -> Column:
    """Key of a row by doc_id and text: rows that share a doc_id but not their text stay apart (96 bits of the text's hashes)."""
    return F.struct(
        F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), text.isNull().alias("z")
    )


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that extra columns of any name can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list:
    """UTF-8 bytes of each text; None where it is null."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


def parts(batches, most: int = 4 << 20, column: str = "text"):
    """Slices of the batches that hold about ``most`` bytes of text (one row at least), so that a task's memory doesn't grow with
    the length of texts in a batch."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Maps A-Z to a-z, keeps 0-9, a-z and every byte of a non-ASCII character, makes all else a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after A-Z is lower-cased."""
    return text.translate(WORD_TABLE).split() if text else []


def blank_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text, unchanged."""
    return text.split() if text else []


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def keep_rows(docs: DataFrame, keeper) -> DataFrame:
    """The rows of docs for which the function made by keeper() (once a task) says true of the text (None where it is null); all
    columns stay, whatever their names: they are numbered on the way through the workers."""
    plain = docs.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])

    def run(batches):
        keep = keeper()
        for batch in parts(batches):
            yield batch.filter(pa.array(keep(text_bytes(batch)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
