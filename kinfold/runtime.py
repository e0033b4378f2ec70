"""Session settings and the shared scratch space that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list = []


def session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "kinfold") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's own session is used as it is."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kinfold-scratch-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def parts(df: DataFrame, mb: float = 4.0) -> int:
    """Partitions for work on df that should not grow with the input: as many as shuffles have, and one for each `mb` MB of files that df reads at least."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    read = sum(n for n in sizes if n < 1 << 50)  # what is not a file has no known size
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, int(read / (mb * 1e6)) + 1))


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at interpreter exit; the folder is scratch
        return


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the shared scratch folder and read it back.

    Unlike DataFrame.checkpoint() this computes df a single time, keeps its columnar
    statistics, and survives a lost executor because the files are shared.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kinfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(lambda: [_forget(*x) for x in _WRITTEN])
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing lazily reads it any more."""
    for f in df.inputFiles()[:1]:
        for spark, path in list(_WRITTEN):
            if path.rsplit("/", 1)[1] in f:
                _forget(spark, path)
                _WRITTEN.remove((spark, path))
