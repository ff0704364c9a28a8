"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but the ASCII white space 0x20, 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local
    session may go without it; on a cluster its absence is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="textrisk-llm-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the
    lineage is cut, and a lost executor costs a re-read, not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose last reader has been written itself."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage; a chain
    of written steps asks for that, so that their disk use does not add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(c: Column) -> Column:
    """``c`` with A-Z lower-cased and nothing else; null counts as empty. A text of
    single-byte characters goes through the much faster general ``lower``."""
    t = F.coalesce(c, F.lit(""))
    return (F.when(F.octet_length(t) == F.char_length(t), F.lower(t))
            .otherwise(F.translate(t, UPPER, UPPER.lower())))


def words(c: Column) -> Column:
    """Array of the words of ``c`` (null: empty array)."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def worker_cache(owner: str) -> dict:
    """A dictionary of operator ``owner`` that outlives the task in a reused Python worker. (Functions
    are pickled by value, so module globals are new in every task.) A worker holds one owner's
    at a time: when another operator starts in it, the memory of the one before is given back."""
    holder = sys.modules.setdefault("_textrisk_worker", types.ModuleType("_textrisk_worker")).__dict__
    if holder.get("owner") != owner:
        holder.update(owner=owner, held={})
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc can be asked for it
            ctypes.CDLL(None).malloc_trim(0)
    return holder["held"]


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer's file in this process: ``name`` is a path, or a name that
    the public tokenizers' package resolves."""
    if "/" in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_level_alphabet() -> dict[str, int]:
    """Sign -> byte of byte-level tokenizers: visible Latin-1 signs stand for themselves, the
    other bytes in order for the signs from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}
