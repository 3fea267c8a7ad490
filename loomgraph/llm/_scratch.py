"""Intermediate tables that survive the loss of an executor.

Tables go to the shared folder the cluster names in ``spark.checkpoint.dir``
and are read back as plain Parquet, which cuts the lineage.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a local one if all of Spark runs in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"loom-{os.getpid()}")
    return found.rstrip("/")


class Scratch:
    """A folder of Parquet tables under :func:`shared_dir` for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()
        self.tables: list[DataFrame] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loom_path = path
        self.tables.append(out)
        return out

    def named(self, name: str) -> list[DataFrame]:
        """The tables written under a name."""
        return [t for t in self.tables if t._loom_path.endswith(f"-{name}")]

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but those that a result still reads, and the numbers of rows. They go with the shared folder."""
        kept = {t._loom_path for t in (*tables, *self.named("numbered"))}
        for path in self.paths - kept:
            self._delete(path)
        self.paths &= kept

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Plans in which a row of a file is one row at most.
_ONE_TO_ONE = {"LogicalRelation", "Project", "SubqueryAlias", "Filter"}


def numbered(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` (long), a number of each row that is the same however often the rows are read.

    Rows of Parquet files are numbered by file and place, and nothing is written but the list of files. Other rows
    are numbered and written.
    """
    file, place, number = (f"{name}_{x}" for x in ("file", "place", "number"))
    plan, plain = df._jdf.queryExecution().analyzed(), "_metadata" not in df.columns
    while plain and plan.nodeName() != "LogicalRelation":
        plain = plan.nodeName() in _ONE_TO_ONE and plan.children().size() == 1
        plan = plan.children().head() if plain else plan
    if plain:
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        except AnalysisException:  # not Parquet: its rows have no places
            plain = False
    if not plain:
        return scratch.save(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    order = Window.orderBy(file)  # of files, a row each
    files = scratch.save(placed.select(file).distinct().select(file, F.row_number().over(order).cast("long").alias(number)), "numbered")
    return placed.join(F.broadcast(files), file).select(*df.columns, (F.shiftleft(number, 40) + F.col(place)).alias(name))


#: Bytes of one Arrow batch, where the session has Spark's own default: long texts come in small batches.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> None:
    """Before Python runs on executors: bound its batches, and send this package unless PYTHONPATH already names its folder."""
    for name, (default, wanted) in _BATCH.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, wanted)
    root = Path(__file__).resolve().parents[2]
    on_path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == root for p in on_path):
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="loomgraph-")
    target = os.path.join(folder, "loomgraph.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "loomgraph").rglob("*")):
            if p.suffix in {".py", ".npz"}:
                z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target
