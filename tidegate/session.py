"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "tidegate", **conf) -> SparkSession:
    """A session with adaptive execution on and UTC dates.

    ``master`` is left to ``spark-submit`` unless given.  On a cluster set
    ``spark.sql.shuffle.partitions`` high (a few per core) and let adaptive
    execution coalesce; ``conf`` entries override everything here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    A session on one machine without one gets a temporary folder; on a cluster
    nothing is made up, since other executors would not see it: that is an error.
    """
    context = session.sparkContext
    folder = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="spark-tidegate-")
    return _LOCAL_FOLDERS[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    The file format keeps column pruning, pushed filters and size statistics,
    and the table outlives the executors that wrote it.  ``clear`` deletes what
    an application has written.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(session: SparkSession) -> str:
    """A path of its own in the application's shared folder."""
    return f"{_application_folder(session)}/{uuid.uuid4().hex}"


def _application_folder(session: SparkSession) -> str:
    return f"{shared_folder(session)}/panels-{session.sparkContext.applicationId}"


def clear(session: SparkSession) -> None:
    """Delete the application's intermediate tables; frames that read them can no longer be evaluated."""
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(_application_folder(session))
    path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
