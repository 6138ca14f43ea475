"""Files as tables, by Spark's binaryFile reader: nothing is opened on the driver."""

from __future__ import annotations

import hashlib
import io
import posixpath
import tarfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def _utf8(data: pa.Array) -> pa.Array:
    def read(x):
        try:
            return x.decode("utf-8")
        except UnicodeDecodeError:
            return None

    return pa.array([None if x is None else read(x) for x in data.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _pdf(data: pa.Array) -> pa.Array:
    """Text of PDF bytes by pypdf where it is installed; null where it isn't or the bytes can't be read."""
    try:
        import pypdf
    except ImportError:
        return pa.nulls(len(data), pa.string())

    def read(x):
        try:
            return "\n\n".join(page.extract_text() for page in pypdf.PdfReader(io.BytesIO(x)).pages)
        except Exception:  # noqa: BLE001  a broken file is a row with a cause, not a failed job
            return None

    return pa.array([read(x) for x in data.to_pylist()], pa.string())


def papers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), format, content, text, cause of each .md and .pdf file below a path; unreadable ones have no text
    and the cause PAPER_UNREADABLE."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)\z", 1))
    d = d.select(F.col("path").alias("doc_id"), suffix.alias("format"), "content").where(F.col("format").isin("md", "pdf"))
    d = d.withColumn("text", F.when(F.col("format") == "md", _utf8("content")).otherwise(_pdf("content")))
    return d.withColumn("cause", F.when(F.col("text").isNull(), "PAPER_UNREADABLE"))


def modified(spark: SparkSession, path: str) -> DataFrame:
    """run_id, relpath, mtime_ns of the files of runs below a local folder, in whole nanoseconds, as their capture writes them."""
    root = Path(path)
    found = [p for p in sorted(root.glob("*/**/*")) if p.is_file() and not p.is_symlink()]
    rows = [(p.relative_to(root).parts[0], "/".join(p.relative_to(root).parts[1:]), p.stat().st_mtime_ns) for p in found]
    return spark.createDataFrame(rows, "run_id string, relpath string, mtime_ns long")


def artifacts(spark: SparkSession, path: str, times: DataFrame | None = None) -> DataFrame:
    """run_id (the folder below path), relpath, size, mtime_ns, content, sha256 of the .json, .csv and .ipynb outputs of runs.

    mtime_ns comes from times (run_id, relpath, mtime_ns: see modified()), and is null without: a timestamp of a listing
    has no nanoseconds, and would call an output stale that was written just after its run began.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1]
    inner = F.regexp_replace("path", rf"^.*?{root}/", "")
    d = d.select(
        F.regexp_extract(inner, r"^([^/]+)/", 1).alias("run_id"),
        F.regexp_replace(inner, r"^[^/]+/", "").alias("relpath"),
        F.col("length").alias("size"),
        "content",
        F.sha2("content", 256).alias("sha256"),
    )
    d = d.where(F.lower("relpath").rlike(r"\.(json|csv|ipynb)\z"))
    d = d.withColumn("mtime_ns", F.lit(None).cast("long")) if times is None else d.join(times, ["run_id", "relpath"], "left")
    return d.select("run_id", "relpath", "size", "mtime_ns", "content", "sha256")


def _escapes(name: str) -> bool:
    clean = posixpath.normpath(name)
    return name.startswith("/") or clean == ".." or clean.startswith("../")


_MEMBERS = T.ArrayType(T.StructType().add("relpath", "string").add("content", "binary").add("cause", "string"))
_MEMBERS_ARROW = pa.list_(pa.struct([("relpath", pa.string()), ("content", pa.binary()), ("cause", pa.string())]))


def members_of(path: str, data: bytes) -> list[dict]:
    """Regular members of a .tar.gz, .tgz or .zip; one that leaves the archive's folder is refused by cause."""
    row = lambda name, content, cause=None: {"relpath": name, "content": content, "cause": cause}
    try:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [i for i in z.infolist() if not i.is_dir() and (i.external_attr >> 28) != 0xA]
                return [row(i.filename, None, "UNSAFE_MEMBER") if _escapes(i.filename) else row(i.filename, z.read(i)) for i in names]
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            out = []
            for m in t.getmembers():
                if _escapes(m.name) or ((m.issym() or m.islnk()) and _escapes(posixpath.join(posixpath.dirname(m.name), m.linkname))):
                    out.append(row(m.name, None, "UNSAFE_MEMBER"))
                elif m.isfile():
                    out.append(row(m.name, t.extractfile(m).read()))
            return out
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
        return [row(path, None, "UNSUPPORTED_ARCHIVE")]


@F.arrow_udf(_MEMBERS)
def _members(paths: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([members_of(p, d) for p, d in zip(paths.to_pylist(), data.to_pylist(), strict=True)], _MEMBERS_ARROW)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, relpath, content, cause of the members of all archives below a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    d = d.where(F.lower("path").rlike(r"\.(tar\.gz|tgz|zip)\z"))
    return d.select(F.col("path").alias("archive"), F.inline(_members("path", "content")))


def _tree(keys: list[str]):
    def digest(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["relpath"].to_pylist(), table["content"].to_pylist(), strict=True))
        h = hashlib.sha256()
        for name, content in rows:
            raw = name.encode()
            h.update(len(raw).to_bytes(4, "big") + raw + b"f" + len(content).to_bytes(8, "big") + content)
        return pa.table({keys[0]: [table[keys[0]][0].as_py()], "files": pa.array([len(rows)], pa.int64()), "tree_hash": [h.hexdigest()]})

    return digest


def tree_hash(files: DataFrame, key: str) -> DataFrame:
    """key, files, tree_hash: a framed digest over a checkout's files in order of path, .git left out at every depth."""
    kept = files.where(~F.col("relpath").rlike(r"(^|/)\.git(/|\z)")).select(F.col(key).cast("string").alias(key), "relpath", "content")
    return kept.groupBy(key).applyInArrow(_tree([key]), f"{key} string, files long, tree_hash string")


def record(spark: SparkSession, path: str) -> DataFrame:
    """record (folder), member, content of every file of the records below a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select(F.regexp_extract("path", r"([^/]+)/(?:objects/)?[^/]+\z", 1).alias("record"), F.regexp_extract("path", r"((?:objects/)?[^/]+)\z", 1).alias("member"), "content")
