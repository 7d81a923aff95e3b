"""Script corpus source and bundle sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revledger.functions.keys import file_safe_key
from revledger.session import written


def _uri(spark: SparkSession, path: str):
    """The full URI of a path on its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()


def scan_scripts(spark: SparkSession, roots: list[str], suffix: str = ".sql", order: list | None = None) -> DataFrame:
    """Whole ``.sql`` files under ``roots`` (recursively), one row per file:
    root, path (relative to the root), text. Empty and hidden files are
    passed over, as the file source does.

    Folders are listed and files are read by tasks. The file source lists
    them on the driver and opens each at many times the cost of reading it;
    it serves roots that tasks cannot open themselves: of a file system that
    Arrow does not know, single files, and patterns.

    With ``order`` (columns over root and path) the partitions are ranges of
    it, in its order: paths are dealt before their files are read, so that no
    text is shuffled."""
    listed, out = None, None
    for root in roots:
        uri = _uri(spark, root).toString()
        if _is_arrow_folder(uri):
            files = list_files(spark, uri, suffix).select(F.lit(root).alias("root"), F.lit(uri).alias("uri"), "path", "size")
            listed = files if listed is None else listed.unionByName(files)
        else:
            df = _read_by_source(spark, root, suffix).select(F.lit(root).alias("root"), "path", "text")
            out = df if out is None else out.unionByName(df)
    if out is None:
        return None if listed is None else _read_by_tasks(listed, order)
    if listed is not None:
        out = out.unionByName(_read_by_tasks(listed))
    # texts of the file source have no listing to deal
    return out.repartitionByRange(*order).sortWithinPartitions(*order) if order else out


def _is_arrow_folder(uri: str) -> bool:
    import pyarrow as pa
    import pyarrow.fs as pafs

    try:
        fs, base = pafs.FileSystem.from_uri(uri)
        return fs.get_file_info(base).type == pafs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def _read_by_source(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, text) by the file source. It names a file by its URI, in which a
    space is ``%20``; it is decoded (a ``+`` is itself), freed of scheme and
    authority, and the root is cut off by its length, whatever signs it
    holds."""
    df = (spark.read.option("recursiveFileLookup", True)
          .option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
          .select(F.col("_metadata.file_path").alias("_full"), F.col("value").alias("text")))
    decoded = F.url_decode(F.replace(F.col("_full"), F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = _uri(spark, root).getPath().rstrip("/")
    return df.select(F.substring(plain, len(base) + 2, 1 << 30).alias("path"), "text")


def list_files(spark: SparkSession, uri: str, suffix: str) -> DataFrame:
    """(path, size) of the files under the folder ``uri`` that are neither
    hidden nor empty. Tasks list the folders of a level; what they find is
    written, and its folders are the next level."""
    import pyarrow as pa

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        base = base.rstrip("/")
        for b in batches:
            for folder in b.column("path").to_pylist():
                found = []
                for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}")):
                    name = info.base_name
                    if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
                        continue
                    inner = info.type == pafs.FileType.Directory
                    if inner or (name.endswith(suffix) and info.size):
                        found.append((f"{folder}/{name}" if folder else name, inner, info.size or 0))
                for i in range(0, len(found), 10_000):
                    part = list(zip(*found[i : i + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.bool_()),
                                                      pa.array(part[2], pa.int64())], names=["path", "folder", "size"])

    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        level = level.repartition(spark.sparkContext.defaultParallelism, "path")
        found = written(level.mapInArrow(run, "path string, folder boolean, size long"), "listing")
        files = found.filter(~F.col("folder")).select("path", "size")
        out = files if out is None else out.unionByName(files)
        level = found.filter("folder").select("path")
        if level.isEmpty():
            return out


#: files, and bytes of files, that a task reads
TASK_FILES = 5_000
TASK_BYTES = 128 << 20
#: bytes of texts in one batch
_BATCH_BYTES = 4 << 20


def _read_by_tasks(files: DataFrame, order: list | None = None) -> DataFrame:
    """(root, path, text) of the files (root, uri, path, size), dealt over
    tasks: by ranges of ``order`` and read in its order, else by path."""
    import pyarrow as pa

    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)
    batch_bytes = _BATCH_BYTES

    def run(batches):
        import pyarrow.fs as pafs

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(roots, pa.string()), pa.array(paths, pa.string()),
                                               pa.array(texts, pa.binary())], names=["root", "path", "text"])

        opened = {}
        for b in batches:
            roots, paths, texts, held = [], [], [], 0
            for root, uri, path in zip(*(b.column(c).to_pylist() for c in ("root", "uri", "path"))):
                if uri not in opened:
                    fs, base = pafs.FileSystem.from_uri(uri)
                    opened[uri] = fs, base.rstrip("/")
                fs, base = opened[uri]
                with fs.open_input_stream(f"{base}/{path}") as f:
                    texts.append(f.read())
                roots.append(root)
                paths.append(path)
                held += len(texts[-1])
                if held >= batch_bytes:
                    yield batch()
                    roots, paths, texts, held = [], [], [], 0
            if paths:
                yield batch()

    files = files.select("root", "uri", "path")
    dealt = (files.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order
             else files.repartition(tasks, "path"))
    read = dealt.mapInArrow(run, "root string, path string, text binary")
    return read.select("root", "path", F.col("text").cast("string").alias("text"))


def write_scripts(files: DataFrame, root: str) -> DataFrame:
    """Write each row's ``text`` as the file ``path`` under ``root`` and
    return the paths written. Tasks write through the file system of the
    root's URI; a repeated task writes the same files again."""
    import pyarrow as pa

    uri = _uri(files.sparkSession, root).toString()

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        made = set()
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(target, compression=None) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([b.column("path")], names=["path"])

    return files.select("path", "text").mapInArrow(run, "path string")


def keep_suffix(df: DataFrame, path: str = "path", suffix: str = ".sql") -> DataFrame:
    """Only files whose name ends with ``suffix``."""
    return df.filter(F.col(path).endswith(suffix))


def bundle_keys(df: DataFrame, host, kind) -> DataFrame:
    """File-safe bundle keys (F2): '/' and '.' in key parts become '-'."""
    return df.withColumn("host_key", file_safe_key(host)).withColumn("type_key", file_safe_key(kind))


def write_bundles(df: DataFrame, path: str, text: str = "text", seq: str = "seq", dealt: bool = False) -> None:
    """One output folder per (host_key, type_key) holding the fragments in
    ``seq`` order (S4). Rows are range-partitioned on (host_key, type_key,
    seq), unless they are ``dealt`` so already, so a large bundle is split
    over several tasks; each writes its own part file, and part files in name
    order continue the sequence. Nothing passes through the driver; a rerun
    overwrites the folders."""
    keys = ["host_key", "type_key", seq]
    ((df if dealt else df.repartitionByRange(*keys))
       .sortWithinPartitions(*keys)
       .select("host_key", "type_key", text)
       .write.mode("overwrite").partitionBy("host_key", "type_key").text(path))
