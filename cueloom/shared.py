"""The folder every executor can reach, and tables pinned there to cut lineage."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}
_made: list[str] = []
_shipped: set[str] = set()
#: What goes to a Python worker at once, unless the session says otherwise.  Both sides hold a batch several times,
#: and 64 MB, Spark's own limit, in every core leave little of an executor beside its heap.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound the batches they get.

    Worker functions call helpers of the package; a session started from another folder, or on a
    cluster, has no other way to import them.
    """
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = pathlib.Path(__file__).resolve().parent
    packed = pathlib.Path(tempfile.mkdtemp(prefix="cueloom-code-")) / "cueloom.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, str(path.relative_to(home.parent)))
    spark.sparkContext.addPyFile(str(packed))


def by_size(batch: pa.RecordBatch, column: int, limit: int = 65_536) -> Iterator[pa.RecordBatch]:
    """A batch in stretches whose texts in ``column`` have ``limit`` bytes together, or one row if that has more.

    What a worker makes of a text may be many times its size; so it holds that of one stretch, not of a batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def in_pieces(made: Callable[..., pa.Array], *columns: pa.Array, rows: int = 64) -> pa.Array:
    """``made`` of a few rows at a time; only Arrow data is held for a whole batch."""
    pieces = [made(*(c.slice(at, rows) for c in columns)) for at in range(0, max(1, len(columns[0])), rows)]
    return pa.concat_arrays(pieces)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Unset, a local master gets a temporary folder of its own; any other master is refused, since
    a machine-local folder is invisible to the rest of a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = "file://" + tempfile.mkdtemp(prefix="cueloom-")
    return _local_fallback[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/cueloom-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables this process pinned, once their results are no longer needed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the pinned tables these read, as no plan still to run needs them."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("cueloom-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries made meanwhile go when these end, not when the driver next collects its garbage."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def pin(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write once, read back: downstream branches see one fixed set of rows.

    Needed where a column is only stable once computed (a range partition id) or where
    several branches would otherwise repeat an expensive upstream plan.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
