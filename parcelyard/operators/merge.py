"""Merging repositories: which package of a name and arch wins, and what is let through before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.functions.version import evr_key, merge_key, nvra, parse_nevr
from parcelyard.operators.dedup import first_by
from parcelyard.operators.ordering import changes

#: Architectures that an architecture also stands for when lists are expanded ("rmv5tel" is the table's own
#: spelling), and the second architecture of multilib ones.
ARCH_FAMILIES = {
    "i386": ["i486", "i586", "geode", "i686", "athlon"],
    "x86_64": ["ia32e", "amd64"],
    "ppc64": ["ppc64pseries", "ppc64iseries"],
    "sparc64": ["sparc64v", "sparc64v2"],
    "sparc": ["sparcv8", "sparcv9", "sparcv9v", "sparcv9v2"],
    "alpha": ["alphaev4", "alphaev45", "alphaev5", "alphaev56", "alphapca56", "alphaev6", "alphaev67", "alphaev68", "alphaev7"],
    "armhfp": ["armv7hl", "armv7hnl"],
    "arm": ["rmv5tel", "armv5tejl", "armv6l", "armv7l"],
    "sh4": ["sh4a"],
}
MULTILIB = {"x86_64": "i386", "ppc64": "ppc", "s390x": "s390"}


def union_repos(repos: list[DataFrame]) -> DataFrame:
    """All packages with the place of their repository; earlier repositories go first."""
    return reduce(DataFrame.unionByName, [r.withColumn("repo_id", F.lit(k)) for k, r in enumerate(repos)])


def expand_arch(archs: list[str], expand: bool = False, multilib: bool = False) -> list[str]:
    """The architectures to let through: those asked for and ``noarch``; on request the families, and multilib partners with theirs."""
    wanted = {a: expand for a in archs} | {MULTILIB[a]: True for a in archs if multilib and a in MULTILIB}
    return sorted({x for a, grown in wanted.items() for x in [a, *(ARCH_FAMILIES.get(a, []) if grown else [])]} | {"noarch"})


def arch_filter(pkgs: DataFrame, archs: list[str], expand: bool = False, multilib: bool = False) -> DataFrame:
    """Packages of the listed architectures; an empty list lets all through."""
    return pkgs.where(F.col("arch").isin(expand_arch(archs, expand, multilib))) if archs else pkgs


def default_base(pkgs: DataFrame, urls: dict[int, str], omit: bool = False, koji: bool = False) -> DataFrame:
    """Packages with the URL of their repository as location base where they have none.

    The first package of a name takes it for an empty base too, others only for a null one. Nothing is filled in with
    ``omit``, nor in the first repository with ``koji``. Comes after the filters and before the merge, as those see the rows.
    """
    if omit or not urls:
        return pkgs
    url = F.create_map(*(x for k, u in urls.items() for x in (F.lit(k), F.lit(u))))[F.col("repo_id")]
    url = F.when(F.lit(koji) & (F.col("repo_id") == 0), None).otherwise(url)
    firsts = pkgs.groupBy("name").agg(F.min(F.struct("repo_id", "ord")).alias("_first"))
    base = F.col("location_base")
    empty = base.isNull() | ((base == "") & (F.struct("repo_id", "ord") == F.col("_first")))
    named = pkgs.join(firsts.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")))
    return named.withColumn("location_base", F.when(empty, F.coalesce(url, base)).otherwise(base)).drop("_name", "_first")


def _evr() -> list[Column]:
    return [F.col("epoch"), F.col("version"), F.col("release")]


def merge(pkgs: DataFrame, method: str) -> DataFrame:
    """One row of each (name, arch): ``repo`` the first, ``ts`` the newest file, ``nvr`` the highest version.

    ``all`` keeps one row of each version too (equal versions, not equal strings); ``simple`` keeps all rows and marks
    repeats. The earliest repository, then the earliest row wins ties.
    """
    first = [F.col("repo_id"), F.col("ord")]
    key = merge_key(*_evr())
    if method == "repo":
        return first_by(pkgs, ["name", "arch"], first)
    if method == "ts":
        return first_by(pkgs, ["name", "arch"], [F.desc("time_file"), *first])
    if method == "nvr":
        return first_by(pkgs.withColumn("_k", key), ["name", "arch"], [F.desc("_k"), *first]).drop("_k")
    if method == "all":
        return first_by(pkgs.withColumn("_k", key), ["name", "arch", "_k"], first).drop("_k")
    if method == "simple":
        keyed = pkgs.withColumn("_k", key)
        counts = keyed.groupBy(F.col("name").alias("_name"), F.col("arch").alias("_arch"), F.col("_k").alias("_key")).agg(F.count("*").alias("_n"))
        same = F.col("name").eqNullSafe(F.col("_name")) & F.col("arch").eqNullSafe(F.col("_arch")) & (F.col("_k") == F.col("_key"))
        return keyed.join(counts, same).select(*pkgs.columns, (F.col("_n") > 1).alias("is_dup"))
    raise ValueError(method)


def source_name(srpm: Column) -> Column:
    """Name of the source package that a source file name stands for."""
    return parse_nevr(F.regexp_replace(srpm, "[.]src[.]rpm$", ""))["name"]


def best_builds(pkgs: DataFrame) -> DataFrame:
    """The build that stands for each source package: earliest repository, in it the highest version, then the first row."""
    named = pkgs.where(F.col("srpm").isNotNull()).withColumns({"srpm_name": source_name(F.col("srpm")), "_k": evr_key(*_evr())})
    return first_by(named, ["srpm_name"], ["repo_id", F.desc("_k"), "ord"]).drop("_k")


def block_sources(pkgs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Without packages of the blocked source names (column ``name``); packages without a source pass."""
    names = blocked.select(F.col("name").alias("_blocked"))
    return pkgs.join(names, source_name(F.col("srpm")) == F.col("_blocked"), "left_anti")


def include_sources(pkgs: DataFrame, builds: DataFrame) -> DataFrame:
    """Packages whose source is the chosen build exactly; packages without a source pass."""
    chosen = builds.select("srpm").distinct()
    return pkgs.where(F.col("srpm").isNotNull()).join(chosen, "srpm", "left_semi").select(pkgs.columns).unionByName(pkgs.where(F.col("srpm").isNull()))


def first_seen(pkgs: DataFrame) -> DataFrame:
    """The first row of each N-V-R.A string."""
    return first_by(pkgs.withColumn("_n", nvra(*(F.col(c) for c in ("name", "version", "release", "arch")))), ["_n"], ["repo_id", "ord"]).drop("_n")


def koji_merge(pkgs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Blocked sources out, chosen builds only, each N-V-R.A once, then one row of each version."""
    return merge(first_seen(include_sources(block_sources(pkgs, blocked), best_builds(pkgs))), "all")


def substitute_noarch(pkgs: DataFrame, designated: DataFrame, file: Column) -> DataFrame:
    """noarch rows become the designated repository's first row of the same file name, whole, if there is one.

    Only ``ord`` and ``repo_id``, a row's place in the merge, stay its own.
    """
    place = ("ord", "repo_id")
    taken = [c for c in pkgs.columns if c not in place]
    other = first_by(designated.withColumn("_file", file), ["_file"], ["repo_id", "ord"]).select("_file", F.struct(*taken).alias("_other"))
    joined = pkgs.join(other, (file == F.col("_file")) & (F.col("arch") == "noarch"), "left")
    use = lambda c: F.when(F.col("_other").isNotNull(), F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(c if c in place else use(c) for c in pkgs.columns))


def repo_counts(pkgs: DataFrame, merged: DataFrame) -> DataFrame:
    """Loaded and used packages of each repository."""
    loaded = pkgs.groupBy("repo_id").agg(F.count("*").alias("loaded"))
    used = merged.groupBy("repo_id").agg(F.count("*").alias("used"))
    return loaded.join(used, "repo_id", "left").select("repo_id", "loaded", F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def output_order() -> list[Column]:
    """Order in which a merged repository is written: name, location, base; nulls first."""
    return [F.col("name"), F.col("href"), F.col("location_base"), F.col("ord")]


def source_chunks(pkgs: DataFrame) -> DataFrame:
    """Chunk of each row in output order: a new one where the source package changes, or is not known."""
    return changes(pkgs, output_order(), "srpm", "chunk")
