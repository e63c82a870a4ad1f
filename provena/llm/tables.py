"""Reading tables, checkpoints and checked broadcasts for the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its estimated bytes, measured at run time, stay below this.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: lineage ends there.

    The folder is the session's spark.checkpoint.dir.  Only a session whose executors
    run in the driver's own process may go without; it gets a temporary one.  Spark's
    cleaner deletes the files once nothing refers to them.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a broadcast hash table: a word of null bits, eight bytes a field, key and pointer; longer fields are to be added."""
    return 8 + 8 * sum(len(t.dataType.fields) + 2 if hasattr(t.dataType, "fields") else 1 for t in df.schema.fields) + 24


def small(df: DataFrame, rows: int | None = None, extra: int = 0) -> DataFrame:
    """df with a broadcast hint if its rows, counted, stay below the bound with `extra` bytes for fields of no fixed length; df itself otherwise."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes(df) + extra <= BROADCAST_BYTES else df


def by_key(rows: DataFrame, keyed: DataFrame, key: str, members: str) -> DataFrame:
    """rows inner-joined with keyed, which has a row a key and says in `members` how many rows bear it.

    Where keyed is too large to broadcast, keys of more than a 2048th of the rows,
    hence fewer than 2048, are broadcast all the same, so that no task gets all rows of one.
    """
    if keyed.count() * row_bytes(keyed) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keyed), key)
    most = keyed.agg(F.sum(members)).first()[0] // 2048 + 1
    hot, rest = keyed.where(F.col(members) > most), keyed.where(F.col(members) <= most)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold_rows.join(rest, key))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
