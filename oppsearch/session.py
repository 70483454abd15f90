"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch that goes to Python. A row here holds a whole text or a vector of thousands
#: of numbers, and a worker holds a batch several times over.
ARROW_ROWS = 1000
#: Its bytes, where rows are blocks of many records, and rows that a Parquet reader unpacks at once.
ARROW_BYTES, COLUMN_ROWS = 4 << 20, 1024
#: Settings that bound them, and their values. A session of somebody else's may have lower ones.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS,
           "spark.sql.execution.arrow.maxBytesPerBatch": ARROW_BYTES,
           "spark.sql.parquet.columnarReaderBatchSize": COLUMN_ROWS}
#: A page or row group of large values ends where it is full, and not after a hundred of them.
FULL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
#: Of stored texts and vectors, which are most of what a run writes.
COMPRESSION = "zstd"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "oppsearch", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators are written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces small
    shuffle partitions and splits skewed ones, so the shuffle width only needs to be large enough.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    # a row of a vector table has thousands of numbers: fewer rows at once fit any heap
    for name, most in BATCHES.items():
        b = b.config(name, str(most))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
        if master.startswith("local"):  # the driver is the only process, with all tasks in it
            b = b.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core, for work that is heavy per row.

    A table in many files or row groups has them already and is returned as it is; only one in few
    files, which is small or badly laid out, is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def _one_machine(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


@functools.cache
def _local_base() -> str:
    base = tempfile.mkdtemp(prefix="oppsearch-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run, under the shared folder the session names.

    Every executor must be able to read it, so a machine-local folder is only used when the
    session itself is local and names no folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings of what runs inside."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is written inside leaves no shuffle files behind: they are deleted when a write ends and
    not when the driver's memory is next cleaned."""
    return settings(spark, {SHUFFLE_CLEANUP: "true"})


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder: for a result that is read more than once and
    small next to the work that makes it. Survives the loss of executors and has a known size."""
    path = scratch_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.options(compression=COMPRESSION, **FULL_PAGES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memory_returned(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches after which its worker, which waits for the next task, gives what
    its allocators keep back to the system: a core may have several such workers."""
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def folder(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing will read again."""
    files, place = folder(spark, path)
    files.delete(place, True)


@functools.cache
def _package_archive() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(), "oppsearch"), "zip",
                               os.path.dirname(root), os.path.basename(root))


_shipped: set[str] = set()


def _number(value: str) -> int:
    """Of a setting, with its unit if it has one."""
    digits, unit = re.fullmatch(r"(-?\d+) *([kmgtp]?)i?b?", value.strip().lower()).groups()
    return int(digits) << 10 * "kmgtp".find(unit or "-") + 10


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; local ones need it too when
    the session was started in another folder. Their batches are bounded as ``build_session`` does."""
    # a session that somebody else built: its batches would hold 10,000 texts or vectors each
    for name, most in BATCHES.items():
        if not 0 < _number(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_package_archive())
        _shipped.add(app)
