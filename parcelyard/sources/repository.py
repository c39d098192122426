"""Whole-repository sources: manifest, advisories, package parts, and the keyed load of all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions.codes import distro_tag, parse_long
from parcelyard.operators.dedup import load_keyed, load_sources, unique_pkgid
from parcelyard.operators.metadata import join_parts, join_parts_append, listed_only
from parcelyard.sources.snippets import FILELISTS, OTHER, PRIMARY, filelists_fields, other_fields, primary_fields, scan_chunks

_CHECKSUM = "struct<_VALUE: string, _type: string>"
_TAG = "struct<_VALUE: string, _cpeid: string>"
MANIFEST = f"""struct<revision: string, repoid: {_CHECKSUM}, contenthash: {_CHECKSUM}, tags: struct<repo: array<string>, content: array<string>, distro: array<{_TAG}>>,
data: array<struct<_type: string, checksum: {_CHECKSUM}, `open-checksum`: {_CHECKSUM}, `header-checksum`: {_CHECKSUM}, location: struct<_href: string, `_xml:base`: string>,
timestamp: string, size: string, `open-size`: string, `header-size`: string, database_version: string>>>"""
ADVISORY = """struct<_from: string, _status: string, _type: string, _version: string, id: string, title: string, issued: struct<_date: string>, updated: struct<_date: string>, rights: string, release: string,
pushcount: string, severity: string, summary: string, description: string, solution: string, reboot_suggested: string, references: struct<reference: array<struct<_href: string, _id: string, _type: string, _title: string>>>,
pkglist: struct<collection: array<struct<_short: string, name: string, module: struct<_name: string, _stream: string, _version: decimal(20,0), _context: string, _arch: string>,
package: array<struct<_name: string, _version: string, _release: string, _epoch: string, _arch: string, _src: string, filename: string, sum: struct<_VALUE: string, _type: string>,
reboot_suggested: string, restart_suggested: string, relogin_suggested: string>>>>>>"""


def fields_of(struct: str):
    """The DDL of a struct's fields, as a reader's schema takes it."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"x {struct}")["x"].dataType


def read_xml(spark: SparkSession, path: str, tag: str, struct: str) -> DataFrame:
    """Rows of one element; plain, gz, bz2 and zst files. Schemas are declared, never inferred."""
    return spark.read.format("xml").option("rowTag", tag).schema(fields_of(struct)).load(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def _whole_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, f"{path}/repodata/repomd.xml", "repomd", MANIFEST)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row of each record of a repository's manifest, with the manifest's revision. A record without a type is ``unknown``."""
    x = _whole_manifest(spark, path).select("revision", F.explode("data").alias("d"))
    checksums = [F.col(f"d.`{a}checksum`.{f}").alias(n) for a, n0 in (("", "checksum"), ("open-", "checksum_open"), ("header-", "checksum_header")) for f, n in (("_VALUE", n0), ("_type", f"{n0}_type"))]
    number = lambda c: F.when(F.col(c).isNotNull(), parse_long(F.col(c)))
    numbers = [number(f"d.`{a}`").alias(n) for a, n in (("timestamp", "timestamp"), ("size", "size"), ("open-size", "size_open"), ("header-size", "size_header"), ("database_version", "database_version"))]
    return x.select("revision", F.coalesce("d._type", F.lit("unknown")).alias("type"), F.col("d.location._href").alias("href"), F.col("d.location.`_xml:base`").alias("base"), *checksums, *numbers)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, cpeid, value): the manifest's repository, content and distribution tags, its id and its content hash."""
    x = _whole_manifest(spark, path)
    none = F.lit(None).cast("string")
    plain = lambda kind: F.transform(F.coalesce(f"tags.{kind}", F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), none.alias("cpeid"), t.alias("value")))
    distro = F.transform(F.coalesce("tags.distro", F.array().cast(f"array<{_TAG}>")), lambda t: F.struct(F.lit("distro").alias("kind"), t["_cpeid"].alias("cpeid"), t["_VALUE"].alias("value")))
    single = lambda c: F.filter(F.array(F.struct(F.lit(c).alias("kind"), F.col(f"{c}._type").alias("cpeid"), F.col(f"{c}._VALUE").alias("value"))), lambda t: t["value"].isNotNull())
    return x.select(F.inline(F.concat(plain("repo"), plain("content"), distro, single("repoid"), single("contenthash"))))


def given_tags(spark: SparkSession, repo: list[str], content: list[str], distro: list[str]) -> DataFrame:
    """Tags (kind, cpeid, value) of a command's options; distribution tags may have a cpeid before a comma."""
    rows = spark.createDataFrame([("repo", t) for t in repo] + [("content", t) for t in content] + [("distro", t) for t in distro], "kind string, tag string")
    parts = distro_tag(F.col("tag"))
    return rows.select("kind", F.when(F.col("kind") == "distro", parts["cpeid"]).alias("cpeid"), F.when(F.col("kind") == "distro", parts["value"]).otherwise(F.col("tag")).alias("value"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """One row of each advisory, references and packages nested."""
    x = read_xml(spark, path, "update", ADVISORY)
    texts = ("id", "title", "rights", "release", "pushcount", "severity", "summary", "description", "solution")
    return x.select(
        *(F.col(f"_{a}").alias(a) for a in ("from", "status", "type", "version")), F.col("issued._date").alias("issued"), F.col("updated._date").alias("updated"), *texts,
        (F.lower("reboot_suggested") == "true").alias("reboot_suggested"), F.col("references.reference").alias("references"), F.col("pkglist.collection").alias("collections"),
    )


def advisory_packages(advisories: DataFrame) -> DataFrame:
    """Rows of the packages that advisories name, with what each suggests after its update."""
    rows = advisories.select("id", F.explode_outer("collections").alias("c")).select("id", F.col("c.name").alias("collection"), F.explode_outer("c.package").alias("p"))
    names = ("name", "epoch", "version", "release", "arch", "src")
    suggested = lambda c: F.coalesce(F.lower(f"p.{c}") == "true", F.lit(False)).alias(c)
    flags = [suggested(f"{k}_suggested") for k in ("reboot", "restart", "relogin")]
    return rows.select("id", "collection", *(F.col(f"p._{n}").alias(n) for n in names), F.col("p.filename").alias("filename"), F.col("p.sum._VALUE").alias("sum"), F.col("p.sum._type").alias("sum_type"), *flags)


class Repository:
    """A published repository: manifest first, then the parts it names; packages are joined on pkgid.

    ``from_files`` stands for a manifest by the files' paths. Parts may be absent: without file lists the primary part's files
    count, without the other part there are no changelogs. Reading is lazy; iterate over ``packages().toLocalIterator()`` to
    have one package after the other on the driver.
    """

    def __init__(self, spark: SparkSession, path: str, hrefs: dict[str, str] | None = None):
        self.spark, self.path, self._hrefs = spark, path.rstrip("/"), hrefs

    @classmethod
    def from_files(cls, spark: SparkSession, primary: str, filelists: str | None = None, other: str | None = None, updateinfo: str | None = None) -> Repository:
        named = {"primary": primary, "filelists": filelists, "other": other, "updateinfo": updateinfo}
        return cls(spark, "", {k: v for k, v in named.items() if v})

    @staticmethod
    def empty(spark: SparkSession) -> DataFrame:
        """No packages, with the columns that packages have."""
        rows = spark.createDataFrame([], fields_of(PRIMARY)).select(*primary_fields())
        return rows.withColumn("changelogs", F.array().cast("array<struct<author:string,date:bigint,changelog:string>>"))

    @property
    def records(self) -> DataFrame:
        return read_manifest(self.spark, self.path)

    @property
    def hrefs(self) -> dict[str, str]:
        """Paths by record type. The manifest has a few dozen records and is read once."""
        if self._hrefs is None:
            self._hrefs = {r.type: f"{self.path}/{r.href}" for r in self.records.select("type", "href").collect() if r.href}
        return self._hrefs

    def located(self, ignore_tables: bool = False) -> dict[str, str]:
        """Paths of the parts, and of the additional documents; those of the tables on request not."""
        return {k: v for k, v in self.hrefs.items() if not (ignore_tables and k.endswith("_db"))}

    def additional(self) -> dict[str, str]:
        """Documents that are no part of the packages' metadata."""
        parts = ("primary", "filelists", "filelists-ext", "other")
        return {k: v for k, v in self.hrefs.items() if k not in parts and not k.startswith(tuple(f"{p}_" for p in parts))}

    def part(self, kind: str, struct: str, columns: list[Column]) -> DataFrame | None:
        """Rows of a part with ``ord``, their order in the document, or None where the manifest has no such part.

        A part is one XML file, or a folder of a container's part files, which are read line by line.
        """
        if kind not in self.hrefs:
            return None
        path = self.hrefs[kind]
        # Files are read in any order, so a row's place is told by file, block and number.
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord")
        if is_folder(self.spark, path):
            return scan_chunks(self.spark.read.option("recursiveFileLookup", True).text(path).select("value", place), struct, columns)
        return read_xml(self.spark, path, "package", struct).select(*columns, place)

    def primary(self) -> DataFrame:
        found = self.part("primary", PRIMARY, primary_fields())
        if found is None:
            raise FileNotFoundError(f"{self.path} has no primary part")
        return found

    def packages(self, only_primary: bool = False, append: bool = True, only_files: DataFrame | None = None) -> DataFrame:
        """Packages with files and changelogs, in ``ord`` of the primary part; ``filelists-ext`` goes before ``filelists``.

        Repeated rows of a package in another part append to each other, or with ``append=False`` the first one counts.
        ``only_files`` (column file) restricts the load to packages of these file names before anything is joined.
        """
        primary = self.primary()
        if only_files is not None:
            primary = listed_only(primary, only_files)
        if only_primary:
            return primary
        fil = next((x for x in (self.part(k, FILELISTS, filelists_fields()) for k in ("filelists-ext", "filelists")) if x is not None), None)
        oth = self.part("other", OTHER, other_fields())
        if fil is None:
            fil = primary.select("pkgid", "ord", "files")
        if oth is None:
            oth = primary.limit(0).select("pkgid", "ord", F.array().cast("array<struct<author:string,date:bigint,changelog:string>>").alias("changelogs"))
        join = join_parts_append if append else join_parts
        return join(primary.drop("files"), fil.select("pkgid", "ord", "files"), oth)

    def advisories(self) -> DataFrame | None:
        return read_advisories(self.spark, self.hrefs["updateinfo"]) if "updateinfo" in self.hrefs else None

    def package_count(self) -> int:
        return self.primary().select(F.countDistinct("pkgid")).first()[0]

    def load(self, kind: str = "hash", duplicates: str = "keepfirst", only_files: DataFrame | None = None) -> DataFrame:
        """The keyed load: one row of each package id (none of ids whose rows disagree), then of each key by the rule."""
        return load_keyed(unique_pkgid(self.packages(append=False, only_files=only_files)), kind, duplicates)


def load_all(repositories: list[Repository], kind: str = "href", duplicates: str = "removeall") -> DataFrame:
    """Several repositories as one keyed set, loaded in their order: see load_sources; with ``keepfirst`` the first row of a key stays."""
    rows = [unique_pkgid(r.packages(append=False)) for r in repositories]
    if duplicates == "removeall":
        return load_sources(rows, kind)
    every = reduce(DataFrame.unionByName, [r.withColumn("source", F.lit(k)) for k, r in enumerate(rows)])
    return load_keyed(every.withColumn("ord", F.struct("source", F.col("ord").alias("place"))), kind, duplicates)
