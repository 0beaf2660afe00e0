"""Working tables in the folder that all executors share.

Iterative and stateful operators cut their lineage by writing a table and reading it back, so that a lost
executor never costs more than the current step.  The folder comes from ``spark.checkpoint.dir``; only where
that is unset (tests on one machine) a temporary folder is made.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session, else (local masters only) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="seqloom-"))
    return _LOCAL_ROOT[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session on the same application with settings of its own, so that those of the caller stay as they are."""
    own = spark.__class__(spark.sparkContext, jsparkSession=spark._jsparkSession.cloneSession())
    for name, value in settings.items():
        own.conf.set(name.replace("__", "."), value)
    return own


class Workspace:
    """A private folder of written tables; it is removed when the application ends.

    With ``path`` the folder is the caller's: it may hold tables of an earlier application and is never removed.
    """

    def __init__(self, spark: SparkSession, label: str, path: str | None = None):
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        fs, folder = self._fs(self.path)
        fs.mkdirs(folder)
        if not path:
            fs.deleteOnExit(folder)

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def where(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return the table read back: same rows, no lineage."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.where(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        if like is not None:
            reader = reader.schema(like.schema)
        return reader.parquet(self.where(name))

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, by: list[str], sort: bool = True) -> DataFrame:
        """Write ``df`` once, bucketed (and sorted) by some columns. The entry in the catalogue that this needs is gone afterwards."""
        entry = f"seqloom_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("path", self.where(name)).option("compression", "zstd").bucketBy(buckets, *by)
        try:
            (writer.sortBy(*by) if sort else writer).saveAsTable(entry)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {entry}")
        return self.read_bucketed(name, df.schema, buckets, by, sort)

    def read_bucketed(self, name: str, schema, buckets: int, by: list[str], sort: bool = True, session: SparkSession | None = None) -> DataFrame:
        """A table of write_bucketed, in this or another session. The catalogue only knows it while it is being resolved."""
        spark, entry, keys = session or self.spark, f"seqloom_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in by)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY ({keys}) {f'SORTED BY ({keys})' if sort else ''} "
            f"INTO {buckets} BUCKETS LOCATION '{self.where(name)}'"
        )
        try:
            return spark.table(entry)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {entry}")

    def note(self, state: dict) -> None:
        """Keep a small state beside the tables. It is written under a new number and renamed into place, so a reader finds
        the last whole one; the one before is kept as well."""
        numbers = self._notes()
        n = (numbers[-1] if numbers else 0) + 1
        fs, part = self._fs(self.where(f"note-{n}.part"))
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        fs.rename(part, self._fs(self.where(f"note-{n}.json"))[1])
        for old in numbers[:-1]:
            self.drop(f"note-{old}.json")

    def noted(self) -> dict | None:
        """The state last kept, or None."""
        numbers = self._notes()
        if not numbers:
            return None
        fs, p = self._fs(self.where(f"note-{numbers[-1]}.json"))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _notes(self) -> list[int]:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[5:-5]) for n in names if n.startswith("note-") and n.endswith(".json"))

    def drop(self, name: str) -> None:
        fs, p = self._fs(self.where(name))
        fs.delete(p, True)

    def size(self, name: str) -> int:
        """Bytes of a written table."""
        fs, p = self._fs(self.where(name))
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0
