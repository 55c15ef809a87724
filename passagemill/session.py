"""Session helpers: table access, checkpoint folder, bounded driver-side lookups."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One parquet table of a data directory; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer than half as many partitions; select what is needed first.

    Only small inputs have so few partitions, so only they are moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into the session's shuffle partitions, which AQE then leaves as they are.

    For stages that cost more CPU than bytes: a later ``distinct`` or aggregate by them needs no shuffle of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (a local session, as in tests) a temporary folder is made.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return os.path.dirname(jsc.getCheckpointDir().get())
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    made = getattr(shared_dir, "_made", None)
    if made is None:
        made = shared_dir._made = tempfile.mkdtemp(prefix="passagemill-")
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a table in the shared folder, so later stages survive lost executors.

    A written table keeps its statistics, so joins after it can still be planned by size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


_kept: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _kept.pop(path, None)


def clear_scratch() -> None:
    """Delete every table written into the shared folder and not yet released. Results that were not yet read lose
    their input, so call it between jobs; it also runs when the driver's interpreter ends."""
    for path, spark in list(_kept.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and with it the way to the folder
            _kept.pop(path, None)


atexit.register(clear_scratch)


def release(df: DataFrame) -> None:
    """Delete the table behind a ``cut_lineage`` result that nothing will read again."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written into the shared folder; ``clear_scratch`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def read_part(path: str, part: int, columns: list[str]):
    """For tasks: the rows of one part of a table written with ``partitionBy("part")``, in their order; None if it has none."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(where.open_input_file(f)).read(columns) for f in files]) if files else None


def kept_table(df: DataFrame, name: str, write) -> str:
    """The path of what ``write(path)`` made of the files behind ``df``, made anew only when the files have changed.

    It stays in the shared folder beyond the session; ``write`` must end with the table ``meta``, which marks it complete.
    """
    spark = df.sparkSession
    seen = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    # no column of the data is read, only which files there are
    n, mixed, total = df.select(seen.alias("h")).distinct().agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1_000_003)))).first()
    start = f"{shared_dir(spark).rstrip('/')}/{name}-{hashlib.md5(f'{n}|{mixed}|{total}'.encode()).hexdigest()}"
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = path_of(f"{start}-*/meta/_SUCCESS")
    done = pattern.getFileSystem(conf).globStatus(pattern)
    if done:
        return str(done[0].getPath().getParent().getParent())
    path = f"{start}-{uuid.uuid4().hex}"
    write(path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="passagemill-code-"))
    target = folder / "passagemill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
