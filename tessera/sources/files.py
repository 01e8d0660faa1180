"""Files of any Hadoop file system, by the session's own connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.documents import as_map, from_map, put


class Files:
    """File operations below a root path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str = ""):
        if ".." in name.split("/"):
            raise ValueError(f"path leaves its root: {name}")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self.path().getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, sorted; none where it doesn't exist."""
        return sorted(f.getPath().getName() for f in self._fs().listStatus(self.path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs().getFileStatus(self.path(name)).getLen()

    def delete(self, name: str) -> bool:
        return self._fs().delete(self.path(name), True)

    def rename(self, a: str, b: str) -> None:
        self._fs().mkdirs(self.path(b).getParent())
        if not self._fs().rename(self.path(a), self.path(b)):
            raise OSError(f"can't rename {a} to {b}")

    def write(self, name: str, data: bytes, overwrite: bool = True) -> None:
        """A small file. Without ``overwrite`` an existing one is an error, so that two writers can't take one name."""
        out = self._fs().create(self.path(name), overwrite)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        stream = self._fs().open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def json_lines(spark: SparkSession, path: str, key: str = "_id") -> DataFrame:
    """_id, doc (JSON text), file, line: records of JSON Lines files; broken lines and such without id are left out.

    file and line order them: by modification time and name of the file, then by place in it.
    """
    rows = spark.read.text(path).select(F.col("value").alias("doc"), F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f")).alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n"))
    rows = rows.select(F.get_json_object("doc", f"$.{key}").alias("_id"), "doc", "file", F.struct(F.col("_b"), F.col("_n")).alias("line"))
    return rows.where("_id is not null and try_parse_json(doc) is not null")


def last_lines(rows: DataFrame) -> DataFrame:
    """_id, doc: the last line of every id."""
    return rows.groupBy("_id").agg(F.max_by("doc", F.struct("file", "line")).alias("doc"))


def record_store(df: DataFrame, path: str) -> None:
    """One JSON object a line: the document with its _id and _version (rows _id, _version, doc as JSON text or VARIANT)."""
    m = as_map(F.col("doc") if dict(df.dtypes)["doc"] == "variant" else F.parse_json("doc"))
    for name in ("_version", "_id"):
        m = put(m, name, F.col(name).cast("variant"))
    df.select(from_map(m).alias("value")).write.text(path)


def legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    """_id, doc (JSON text) of Parquet files of the old layout: columns _id and _data."""
    return spark.read.parquet(path).select(F.col("_id").cast("string").alias("_id"), F.col("_data").cast("string").alias("doc")).where("_id is not null and try_parse_json(doc) is not null")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file, size, rows of the Parquet files under a path; rows come from the footers."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """record_id, name, content of files ``<path>/<record_id>/<name>``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -2).alias("record_id"), F.element_at(parts, -1).alias("name"), "content")
