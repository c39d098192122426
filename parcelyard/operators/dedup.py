"""Keyed loads and duplicate rules: which of several rows of a key stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.functions.paths import base_name, clean_href
from parcelyard.functions.version import nevra


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; the filter on row_number lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _identity() -> Column:
    return F.struct("time_file", "size_package", base_name(F.col("href")).alias("file"))


def unique_pkgid(pkgs: DataFrame) -> DataFrame:
    """First row of each pkgid; all rows of a pkgid go if any disagrees in (time, size, file name).

    Two partial aggregates find the disagreeing ids, so a hot id is never gathered in one window.
    """
    seen = pkgs.groupBy("pkgid").agg(F.min(_identity()).alias("lo"), F.max(_identity()).alias("hi"), F.min("ord").alias("ord"))
    return pkgs.join(seen.where(F.col("lo") == F.col("hi")).select("pkgid", "ord"), ["pkgid", "ord"], "left_semi")


def key_of(kind: str) -> Column:
    return {"hash": F.col("pkgid"), "name": F.col("name"), "filename": base_name(F.col("href")), "href": clean_href(F.col("href"))}[kind]


def load_keyed(pkgs: DataFrame, kind: str, duplicates: str = "keepfirst") -> DataFrame:
    """Rows by key: ``keepfirst`` keeps the first of each, ``removeall`` drops keys whose rows differ."""
    keyed = pkgs.withColumn("key", key_of(kind))
    if duplicates == "keepfirst":
        return first_by(keyed, ["key"], ["ord"])
    same = F.struct("time_file", "size_package", "pkgid", base_name(F.col("href")).alias("file"))
    seen = keyed.groupBy("key").agg(F.min(same).alias("lo"), F.max(same).alias("hi"), F.min("ord").alias("ord"))
    return keyed.join(seen.where(F.col("lo") == F.col("hi")).select("key", "ord"), ["key", "ord"], "left_semi")


def load_sources(sources: list[DataFrame], kind: str) -> DataFrame:
    """Several sources loaded one after the other into one keyed set, with ``source``; a key whose rows differ goes.

    A source whose rows of a key differ from each other, or from what the earlier ones left, takes the key out; a later source
    can put it in again. One row of each key and source is looked at, so what is folded is as short as the list of sources.
    """
    same = F.struct("time_file", "size_package", "pkgid", base_name(F.col("href")).alias("file"))
    rows = reduce(DataFrame.unionByName, [s.withColumns({"source": F.lit(k), "key": key_of(kind)}) for k, s in enumerate(sources)])
    seen = rows.groupBy("key", "source").agg(F.min(same).alias("lo"), F.max(same).alias("hi"), F.min("ord").alias("ord"))
    steps = seen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("source", "lo", "hi", "ord"))).alias("steps"))
    none = F.lit(None).cast(steps.select(F.get("steps", F.lit(0))).schema[0].dataType)

    def step(held, new):
        equal = held.isNull() | (held["lo"] == new["lo"])
        return F.when((new["lo"] == new["hi"]) & equal, F.coalesce(held, new)).otherwise(none)

    left = steps.select("key", F.aggregate("steps", none, step).alias("held")).where(F.col("held").isNotNull())
    return rows.join(left.select("key", "held.source", "held.ord"), ["key", "source", "ord"], "left_semi")


def with_nevra(pkgs: DataFrame) -> DataFrame:
    return pkgs.withColumn("nevra", nevra(*(F.col(c) for c in ("name", "epoch", "version", "release", "arch"))))


def nevra_duplicates(pkgs: DataFrame) -> DataFrame:
    """Groups of equal NEVRA with more than one row: nevra, n, locations (shortest first). Counted first, so that only rows of
    such groups are gathered."""
    named = with_nevra(pkgs)
    counts = named.groupBy("nevra").agg(F.count("*").alias("n")).where("n > 1")
    found = named.select("nevra", "href").join(counts, "nevra").groupBy("nevra", "n").agg(F.sort_array(F.collect_list(F.struct(F.length("href").alias("l"), F.col("href").alias("h")))).alias("x"))
    return found.select("nevra", "n", F.array_join(F.transform("x", lambda s: s["h"]), ",").alias("locations"))


def keep_last_nevra(pkgs: DataFrame, time: str = "time_build") -> DataFrame:
    """Of each NEVRA the row built last, then of greatest location, then the last in document order, if there is an ``ord``."""
    return first_by(with_nevra(pkgs), ["nevra"], [F.desc(c) for c in (time, "href", "ord") if c != "ord" or c in pkgs.columns])
