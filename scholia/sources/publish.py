"""Tables that are published whole: written aside, then made known by one small file.

A published table is a folder of data folders and of manifests, numbered from 1; a manifest names the data folders that
make up the table from then on.  A job writes its rows to a folder of its own and then creates the next manifest, by a
rename that fails if that number is taken.  So readers see the table before or after a job, never between; a job
that dies leaves the table as it was, with at most a data folder that no manifest names; and a job that runs again
under the same name does nothing once it is published.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.io import with_provenance

#: attempts to take the next number while others publish too.
ATTEMPTS = 100
_MANIFESTS = "_manifests"


class _Files:
    """The few file operations that a manifest needs, by Hadoop's file contexts."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.fs = self.jvm.org.apache.hadoop.fs
        first = self.fs.Path(root)
        conf = spark._jsc.hadoopConfiguration()
        self.context = self.fs.FileContext.getFileContext(first.getFileSystem(conf).getUri(), conf)
        self.root = first.getFileSystem(conf).makeQualified(first).toString()

    def path(self, *parts: str):
        return self.fs.Path("/".join((self.root, *parts)))

    def numbers(self) -> list[int]:
        folder = self.path(_MANIFESTS)
        if not self.context.util().exists(folder):
            return []
        names = [x.getPath().getName() for x in self.context.util().listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        stream = self.context.open(self.path(_MANIFESTS, f"{number:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, number: int, manifest: dict) -> bool:
        """Whether the manifest is the one of its number now."""
        aside, final = self.path(_MANIFESTS, f".{uuid.uuid4().hex}"), self.path(_MANIFESTS, f"{number:012}.json")
        flags = self.jvm.java.util.EnumSet.of(self.fs.CreateFlag.CREATE)
        parents = self.gateway.new_array(self.fs.Options.CreateOpts, 1)
        parents[0] = self.fs.Options.CreateOpts.createParent()
        out = self.context.create(aside, flags, parents)
        out.write(json.dumps(manifest).encode())
        out.close()
        plain = self.gateway.new_array(self.fs.Options.Rename, 1)
        plain[0] = getattr(self.fs.Options.Rename, "NONE")
        try:
            self.context.rename(aside, final, plain)
            return True
        except Py4JJavaError as e:
            self.context.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The present manifest: number, folders (relative to root), runs (names of the jobs that are published); None before the first."""
    files = _Files(spark, root)
    numbers = files.numbers()
    return {**files.read(numbers[-1]), "number": numbers[-1]} if numbers else None


def write_aside(df: DataFrame, root: str, partition_by: tuple[str, ...] = (), format: str = "parquet") -> str:
    """Write the rows to a data folder that no one knows yet; its name."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).format(format).save(f"{root}/{folder}")
    return folder


def commit(spark: SparkSession, root: str, folder: str, run: str, append: bool = False, format: str = "parquet") -> bool:
    """Make a data folder known, instead of or beside what is there; False if a job of this name is published already."""
    files = _Files(spark, root)
    for _ in range(ATTEMPTS):
        numbers = files.numbers()
        now = files.read(numbers[-1]) if numbers else {"folders": [], "runs": []}
        if run in now["runs"]:
            return False
        folders = [*now["folders"], folder] if append else [folder]
        if files.create((numbers[-1] if numbers else 0) + 1, {"folders": folders, "runs": [*now["runs"], run], "format": format}):
            return True
    raise RuntimeError(f"no manifest of {root} could be created in {ATTEMPTS} attempts")


def publish(df: DataFrame, root: str, run: str, append: bool = False, partition_by: tuple[str, ...] = (), format: str = "parquet") -> bool:
    """Write the rows and make them known as one step; a job of a name that is published already is not run again."""
    spark = df.sparkSession
    now = manifest(spark, root)
    if now and run in now["runs"]:
        return False
    return commit(spark, root, write_aside(df, root, partition_by, format), run, append, format)


def read_published(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The table as its present manifest has it; with a schema, an empty one before the first."""
    now = manifest(spark, root)
    if now is None:
        if schema is None:
            raise ValueError(f"nothing is published in {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read.format(now["format"])
    parts = [(reader.schema(schema) if schema else reader).load(f"{root}/{f}") for f in now["folders"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def publish_papers(papers: DataFrame, root: str, run: str) -> bool:
    """Papers by language, one folder each, in place of those published before."""
    return publish(papers, root, run, partition_by=("lang",))


def publish_extractions(extractions: DataFrame, root: str, run: str, method: str, version: str) -> bool:
    """Extractions with where they come from, beside those published before."""
    return publish(with_provenance(extractions, method, version), root, run, append=True)


def sweep(spark: SparkSession, root: str, running: tuple[str, ...] = ()) -> int:
    """Remove data folders that the present manifest does not name (of jobs that died, or replaced ones), but for those of
    `running` jobs; the number removed.  For a time when no one reads an older state."""
    files, now = _Files(spark, root), manifest(spark, root)
    keep = {*(now["folders"] if now else ()), *running}
    gone = [x.getPath() for x in files.context.util().listStatus(files.path()) if x.getPath().getName().startswith("data-") and x.getPath().getName() not in keep]
    for p in gone:
        files.context.delete(p, True)
    return len(gone)


def published_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, content_md5 of the extractions published, for pending_documents."""
    return read_published(spark, root, "doc_id long, content_md5 string").select("doc_id", "content_md5")
