"""Session-aware helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python finds it."""
    if spark.conf.get("ferrule.shipped", None) == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ferrule-")) / "ferrule_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".npz"):
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("ferrule.shipped", spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of ``sf_dir``; naive timestamps come out as UTC timestamps."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of
    its own; a cluster has no folder of which that would be true, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="ferrule-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage that survives
    the loss of executors and keeps an expensive stage from running twice. The tables of a session stay
    until ``clean`` or the end of the session's process, as later reads of results need them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(clean, spark)
    _WRITTEN[app].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    own = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
    for path in [p for p in own if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in df.inputFiles())]:
        own.remove(path)
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this session's queries wrote; results not yet read are lost."""
    try:
        for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001 - at the end of the process the session may be gone
        return


def spread(df: DataFrame) -> DataFrame:
    """More partitions for a Python-heavy stage, only where the input has fewer than the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def built(sent: Broadcast, make: Callable):
    """What ``make`` builds of a broadcast's value, once in each Python worker and not once a task: the
    broadcast object lives in the worker as long as jobs use it."""
    if not hasattr(sent, "_built"):
        sent._built = make(sent.value)
    return sent._built


def by_size(texts: list[str | None], most: int) -> Iterator[slice]:
    """Slices of a batch of texts with at most ``most`` characters each, or a single text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
            size += len(texts[to] or "")
            to += 1
        yield slice(at, to)
        at = to


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to Arrow batches given and returned as columns of Python lists."""
    struct = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)
