"""Whole jobs: build, merge, modify and convert repositories, made of the operators, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions import paths
from parcelyard.operators import dedup, merge, metadata
from parcelyard.operators.quality import BuildOptions, ConvertOptions, MergeOptions, ModifyOptions
from parcelyard.scratch import Scratch, delete
from parcelyard.sources import files, headers, writer
from parcelyard.sources.repository import Repository, is_folder


def cleaned(packages: DataFrame) -> DataFrame:
    """Parsed packages (one row of each pkgid) with their requires cleaned and reduced, as a build writes them."""
    long = lambda kind: packages.select(F.col("pkgid").alias("pkgkey"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "d")).select("pkgkey", "kind", "pos", "d.*")
    own = packages.select(F.col("pkgid").alias("pkgkey"), F.explode("files").alias("f")).select("pkgkey", "f.path")
    kept = metadata.highest_libc(metadata.clean_requires(long("requires").unionByName(long("provides")), own))
    entry = F.struct("pos", F.struct("name", "flags", "epoch", "version", "release", "pre").alias("d"))
    lists = kept.groupBy(F.col("pkgkey").alias("pkgid")).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["d"]).alias("requires"))
    joined = packages.drop("requires").join(lists, "pkgid", "left")
    return joined.withColumn("requires", F.coalesce("requires", F.array().cast(dict(packages.dtypes)["requires"])))


def parsed(spark: SparkSession, found: list[str], folder: str, options: BuildOptions, scratch: Scratch) -> DataFrame:
    """Packages of files, as rows of Repository.packages without ``ord``. Equal files are one package each.

    What the files hold is stored, so that each is read once.
    """
    content = spark.read.format("binaryFile").load(found)
    rows = scratch.store(headers.parse(content.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")))
    href = paths.rewrite_href(relative(F.col("path"), folder), "", options.cut_dirs, options.location_prefix)
    named = rows.withColumns({"href": href, "time_file": F.col("mtime"), "size_package": F.col("size"), "checksum_type": F.lit("sha256"), "location_base": F.lit(None).cast("string")})
    one = dedup.first_by(named, ["pkgid"], ["href"]).drop("path", "mtime", "size")
    whole = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["type"].alias("type"), F.lit(None).cast("string").alias("hash")))
    once = cleaned(one).withColumn("files", whole)
    again = named.select("pkgid", "href", "time_file").withColumnsRenamed({"href": "_href", "time_file": "_time"})
    return once.join(again, "pkgid").withColumns({"href": F.col("_href"), "time_file": F.col("_time")}).drop("_href", "_time")


def relative(path, folder: str):
    """Path below a folder, without the folder's scheme and name."""
    bare = F.regexp_replace(path, "^[a-z]+:/+", "/")
    inside = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return F.substring(bare, len(inside) + 1, 1 << 30)


def build(spark: SparkSession, folder: str, options: BuildOptions | None = None, update: bool = False) -> int:
    """Write the repository of all package files below a folder (an absolute path) into the folder; returns the number of packages.

    With ``update`` files that the present metadata know by place, time and size are taken over without being read. Of
    packages of one NEVRA the last stays if the options say so.
    """
    options = options or BuildOptions()
    with Scratch(spark) as scratch:
        listing = headers.list_files(spark, folder, content=False).withColumn("file", F.col("path"))
        listing = metadata.excluded(listing.withColumn("path", relative(F.col("path"), folder)), list(options.excludes))
        href = paths.rewrite_href(F.col("path"), "", options.cut_dirs, options.location_prefix)
        now = scratch.store(listing.select("file", href.alias("href"), "mtime", "size", F.lit("sha256").alias("checksum_type")))
        kept = None
        if update and is_folder(spark, f"{folder}/repodata"):
            names = now.select(paths.base_name(F.col("href")).alias("file")).distinct()
            old = scratch.store(Repository(spark, folder).load("href", "removeall", only_files=names).drop("key", "ord"))
            known = old.select("href", F.col("time_file").alias("mtime"), F.col("size_package").alias("size"), "checksum_type")
            kept = old.join(metadata.reuse(now, known).where("reused").select("href"), "href", "left_semi")
            now = metadata.changed(now, known)
        # Spark has listed the files on the driver anyway; only those that have to be read are opened.
        fresh = [r.file for r in now.select("file").collect()]
        packages = parsed(spark, fresh, folder, options, scratch) if fresh else Repository.empty(spark)
        if kept is not None:
            packages = _same_columns(kept, packages)
        if options.duplicates == "keep-last":
            packages = dedup.keep_last_nevra(packages).drop("nevra")
        made = writer.RepositoryWriter(spark, f"{folder}/.made", options.changelog_limit, checksum=options.checksum)
        n = made.add_packages(scratch.store(packages))
        made.finish()
    if is_folder(spark, f"{folder}/repodata"):
        writer.carry_over(spark, folder, f"{folder}/.made", options.retain_old)
    writer.publish(spark, f"{folder}/.made/repodata", f"{folder}/repodata")
    delete(spark, f"{folder}/.made")
    return n


def _same_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both with the columns of a; those that b lacks are null there."""
    return a.unionByName(b.select(*(F.col(c).cast(t).alias(c) if c in b.columns else F.lit(None).cast(t).alias(c) for c, t in a.dtypes)))


def merge_repositories(spark: SparkSession, sources: list[str], target: str, options: MergeOptions | None = None, blocked: DataFrame | None = None, noarch: str | None = None, urls: dict[int, str] | None = None) -> int:
    """Merge published repositories, the earlier ones going first; returns the number of packages.

    Rows pass in this order: noarch substitution, architectures, blocked and chosen sources and first seen builds (koji),
    location bases, the merge itself. The advisories of all sources are put together.
    """
    options = options or MergeOptions()
    read = [Repository(spark, s) for s in sources]
    with Scratch(spark) as scratch:
        packages = scratch.store(merge.union_repos([r.load() for r in read]))
        if noarch:
            designated = Repository(spark, noarch).load().withColumn("repo_id", F.lit(0))
            packages = merge.substitute_noarch(packages, designated, paths.base_name(F.col("href")))
        packages = merge.arch_filter(packages, list(options.archs), options.expand, options.multilib)
        if options.koji:
            chosen = merge.include_sources(packages if blocked is None else merge.block_sources(packages, blocked), merge.best_builds(packages))
            packages = chosen if options.simple else merge.first_seen(chosen)
        packages = merge.default_base(packages, urls or dict(enumerate(sources)), options.omit_base, options.koji)
        merged = scratch.store(merge.merge(packages, options.method))
        made = writer.RepositoryWriter(spark, target, changelog_limit=-1)
        n = made.add_packages(merged.drop("key", "is_dup"), ["name", "href", "location_base"])
        advisories = [a for a in (r.advisories() for r in read) if a is not None]
        if advisories:
            made.add_advisories(reduce(DataFrame.unionByName, advisories))
        if options.koji:
            made.add_document("origin", writer.origins(merged))
        made.finish()
    return n


def modify(spark: SparkSession, repository: str, changes: list[ModifyOptions]) -> DataFrame:
    """Add, replace and remove documents of a published repository; returns the new records.

    The documents are compressed by the driver, one after the other, as they are a handful of files beside the packages' parts.
    """
    kinds = "place int, path string, type string, remove boolean, compress boolean, compress_type string, unique boolean, checksum string, new_name string"
    rows = [(k, c.path or None, c.type, c.remove, c.compress, c.compression, c.unique, c.checksum, c.new_name) for k, c in enumerate(changes)]
    contents = [writer.put_document(spark, repository, c) for c in changes if not c.remove]
    made = spark.createDataFrame(contents, "path string, " + writer.RECORD.replace("type string, ", "", 1))
    tasks = spark.createDataFrame(rows, kinds)
    records = writer.modify(spark, repository, tasks.withColumn("path", F.coalesce("path", "type")), made)
    writer.unique_names(spark, repository, records, made)
    return records


def changes_of(tasks: DataFrame) -> list[ModifyOptions]:
    """The changes of a batch file (of files.batch_tasks)."""
    return [
        ModifyOptions(path=r.path, type=r.type, remove=r.remove, compress=r.compress, compression=r.compress_type or "zstd", checksum=r.checksum or "sha256", unique=r.unique, new_name=r.new_name)
        for r in tasks.orderBy("place").collect()
    ]


def convert(spark: SparkSession, repository: str, target: str, options: ConvertOptions | None = None) -> None:
    """The relational star of a published repository."""
    options = options or ConvertOptions()
    writer.convert_to_star(Repository(spark, repository), target, options.force)


def main(arguments: list[str] | None = None) -> None:
    """``python -m parcelyard build|merge|modify|convert``: the jobs from a shell."""
    import argparse
    import os

    top = argparse.ArgumentParser(prog="parcelyard")
    jobs = top.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("build")
    p.add_argument("folder")
    p.add_argument("--update", action="store_true")
    p.add_argument("--changelog-limit", type=int, default=10)
    p.add_argument("--excludes", action="append", default=[])
    p.add_argument("--cut-dirs", type=int, default=0)
    p.add_argument("--location-prefix", default="")
    p.add_argument("--checksum", default="sha256")
    p.add_argument("--retain-old-md", type=int, default=0)
    p.add_argument("--duplicated-nevra", default="keep")
    p = jobs.add_parser("merge")
    p.add_argument("--repo", action="append", required=True)
    p.add_argument("--outputdir", required=True)
    p.add_argument("--arch", action="append", default=[])
    p.add_argument("--arch-expand", action="store_true")
    p.add_argument("--multilib", action="store_true")
    p.add_argument("--method", default="repo")
    p.add_argument("--koji", action="store_true")
    p.add_argument("--simple", action="store_true")
    p.add_argument("--blocked")
    p.add_argument("--noarch-repo")
    p.add_argument("--omit-baseurl", action="store_true")
    p = jobs.add_parser("modify")
    p.add_argument("repository")
    p.add_argument("document", nargs="?")
    p.add_argument("--mdtype")
    p.add_argument("--remove", action="store_true")
    p.add_argument("--no-compress", action="store_true")
    p.add_argument("--compress-type", default="zstd")
    p.add_argument("--simple-md-filenames", action="store_true")
    p.add_argument("--new-name")
    p.add_argument("--batchfile")
    p = jobs.add_parser("convert")
    p.add_argument("repository")
    p.add_argument("target")
    p.add_argument("--force", action="store_true")
    a = top.parse_args(arguments)
    spark = SparkSession.builder.appName(f"parcelyard {a.job}").getOrCreate()
    if a.job == "build":
        print(build(spark, a.folder if ":" in a.folder else os.path.abspath(a.folder), BuildOptions(a.checksum, a.changelog_limit, a.cut_dirs, a.location_prefix, tuple(a.excludes), a.retain_old_md, None, a.duplicated_nevra), a.update))
    elif a.job == "merge":
        options = MergeOptions(tuple(a.arch), a.arch_expand, a.multilib, a.method, a.koji, a.simple, a.omit_baseurl)
        print(merge_repositories(spark, a.repo, a.outputdir, options, files.read_lines(spark, a.blocked) if a.blocked else None, a.noarch_repo))
    elif a.job == "modify":
        one = [ModifyOptions(a.document or "", a.mdtype, a.remove, not a.no_compress, a.compress_type, "sha256", not a.simple_md_filenames, a.new_name)] if a.document or a.mdtype else []
        modify(spark, a.repository, one + (changes_of(files.batch_tasks(spark, a.batchfile)) if a.batchfile else [])).show(truncate=False)
    else:
        convert(spark, a.repository, a.target, ConvertOptions(force=a.force))
