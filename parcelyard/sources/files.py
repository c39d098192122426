"""Lists of files and packages, and files as content: walks, explicit lists, digests, batch files of manifest changes."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions import codes, paths


#: What the path of a module document contains.
MODULE_FILES = ("modules.yaml", ".modulemd.yaml", ".modulemd-defaults.yaml")


def read_lines(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """Lines of a text file without empty ones, such as lists of packages or of blocked source names."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def listed(files: DataFrame, names: DataFrame) -> DataFrame:
    """Files of an explicit list of repo-relative paths (column ``name``), instead of a walk's result."""
    wanted = names.select(paths.clean_href(F.col("name")).alias("_n")).distinct()
    return files.join(wanted, paths.clean_href(F.col("path")) == F.col("_n"), "left_semi")


def recycled_list(old: DataFrame) -> DataFrame:
    """The list of packages that old metadata names."""
    return old.select(F.col("href").alias("name")).distinct()


def routed(files: DataFrame) -> DataFrame:
    """Files with ``role``: package, modules (module documents, told by their path), or null for files that a build does not read."""
    modules = F.lit(False)
    for part in MODULE_FILES:
        modules = modules | F.col("path").contains(part)
    return files.withColumn("role", F.when(modules, "modules").when(F.col("path").endswith(".rpm"), "package"))


def task_order() -> list[Column]:
    """Order in which packages are numbered: file name, then path."""
    return [paths.base_name(F.col("path")), F.col("path")]


def digest(content: Column, algorithm: str) -> Column:
    made = {"md5": F.md5, "sha1": F.sha1, "sha": F.sha1}.get(algorithm) or (lambda c: F.sha2(c, int(algorithm.removeprefix("sha"))))
    return made(content)


def old_packages(spark: SparkSession, folders: list[str], max_size: int) -> DataFrame:
    """Rows (folder, path, size): package files right in the folders of old packages, none larger than max_size. No file is opened."""
    out = spark.createDataFrame([], "folder string, path string, size bigint")
    for folder in folders:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rpm").load(folder)
        out = out.unionByName(files.select(F.lit(folder).alias("folder"), "path", F.col("length").alias("size")))
    return out.where(F.col("size") <= max_size)


def package_count(pkgs: DataFrame) -> DataFrame:
    """One row (n): packages by id."""
    return pkgs.agg(F.countDistinct("pkgid").alias("n"))


def content_stats(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Files (path, content) with checksum, size, and the compression that the suffix or the first bytes tell."""
    kind = codes.detect_compression(F.col("path"), F.hex(F.substring("content", 1, 5)))
    return files.select("path", digest(F.col("content"), algorithm).alias("checksum"), F.length("content").cast("long").alias("size"), kind.alias("compression"))


def open_content_stats(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """As content_stats, with checksum_open and size_open of what a file holds unpacked; null where nothing is packed.

    Unpacked piece by piece in the task, so that a file's content is never held whole beside its row.
    """
    import hashlib

    import pyarrow as pa

    from parcelyard.sources.unpack import pieces

    rows = content_stats(files, algorithm).join(files.select("path", "content"), "path")

    def run(batches):
        for batch in batches:
            sums, sizes = [], []
            for kind, content in zip(batch.column(3).to_pylist(), batch.column(4)):
                if kind not in ("gz", "bz2", "xz", "zstd"):
                    sums.append(None)
                    sizes.append(None)
                    continue
                made, size = hashlib.new("sha1" if algorithm == "sha" else algorithm), 0
                for piece in pieces(kind, content.as_buffer()):
                    made.update(piece)
                    size += len(piece)
                sums.append(made.hexdigest())
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.string()), pa.array(sizes, pa.int64())], ["path", "checksum", "size", "compression", "checksum_open", "size_open"])

    return rows.select("path", "checksum", "size", "compression", "content").mapInArrow(run, "path string, checksum string, size bigint, compression string, checksum_open string, size_open bigint")


def cached_key(signatures: Column, header_id: Column) -> Column:
    """Name under which a package's checksum is cached: digest over its signatures and header id."""
    return F.sha2(F.concat(F.coalesce(signatures, F.lit("")), F.coalesce(header_id, F.lit(""))), 256)


def with_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (key, ...) with the checksum of the cache (key, checksum), null where it has to be computed."""
    return files.join(cache.select("key", F.col("checksum").alias("cached")).dropDuplicates(["key"]), "key", "left")


def batch_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Manifest changes of a batch file, a section each: place, path, type, remove, compress, compress_type, unique, checksum, new_name.

    The section's name stands for a missing path. The file is an option file for one command, so it is read on the driver.
    """
    parser = configparser.ConfigParser(interpolation=None, delimiters=("=",), comment_prefixes=("#",), default_section="\0", strict=False)
    parser.optionxform = str
    parser.read_string("\n".join(r.value for r in spark.read.text(path).coalesce(1).collect()))
    rows = []
    for name in parser.sections():
        s = parser[name]
        rows.append((len(rows), s.get("path", name), s.get("type"), s.getboolean("remove", False), s.getboolean("compress", True), s.get("compress-type"), s.getboolean("unique-md-filenames", True), s.get("checksum"), s.get("new-name")))
    return spark.createDataFrame(rows, "place int, path string, type string, remove boolean, compress boolean, compress_type string, unique boolean, checksum string, new_name string")
