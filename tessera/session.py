"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session; only when nothing is configured (local runs,
    tests) a local temporary folder is set as the checkpoint dir.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: on a cluster it must name a folder "
                f"that the driver and all executors share (master is {master!r})")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared folder (used
    where one intermediate feeds several branches or iterative solvers)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SOLVER_PARTITIONS, SOLVER_BYTES = 12, 64 << 20


def for_solver(df):
    """``df`` materialized, in no more partitions than its size or the cores ask
    for.  A solver runs jobs by the hundred over these rows, and each of their
    tasks allocates and ships its statistics or gradients whole, however few
    rows it has: that cost grows with the partitions."""
    rows = materialize(df)
    values = [F.coalesce(F.size(c), F.lit(0)) for c, t in df.dtypes if t.startswith("array")]
    size = rows.agg(F.sum(sum(values, F.lit(len(df.columns)))).cast("long") * 8).first()[0] or 0
    wanted = max(SOLVER_PARTITIONS, df.sparkSession.sparkContext.defaultParallelism, -(-size // SOLVER_BYTES))
    return rows.coalesce(wanted) if rows.rdd.getNumPartitions() > wanted else rows


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``tessera`` importable in executor Python workers (Arrow UDFs
    reference its modules): zip the package once per application beside the
    driver and hand it to ``addPyFile``, which serves it to every executor,
    as ``--py-files`` would."""
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-pkg-"), f"tessera-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
