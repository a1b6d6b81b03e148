"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts of one numpy pass hold about this many characters, so memory does not follow the number of rows in a batch.
CHUNK_CHARS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place, on one machine only: a cluster's executors would
    not see it, so there ValueError is raised.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvina-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Paths of the tables that this process has written, in order.
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs no more than the tasks it ran, and it gives the
    optimizer true sizes: a join on the table is broadcast only when the table is small as a fact.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `cleared`."""
    return len(_made)


def cleared(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables written since a mark, but for the last `keep` ones: for steps whose result is written, so that nothing reads the others again."""
    for path in _made[since : len(_made) - keep]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _made.remove(path)


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def quiet_numpy():
    import numpy as np

    with np.errstate(all="ignore"):
        yield


def chunks(batches: Iterable[pa.RecordBatch], column: str, chars: int = CHUNK_CHARS, row: int = 64) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of `column` in one piece come to about `chars` bytes; `row` is what a row counts besides.

    A single longer string stays whole: no operator here reads a prefix.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        part = np.cumsum(sizes + row) // chars
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    # A worker lives on after its task; what the task's batches took goes back.
    pa.default_memory_pool().release_unused()
