"""Binary package headers, read by native expressions: no Python touches a file's bytes.

A file is a 96-byte lead, a signature header, padding to eight bytes, and the main header; each header is 16 bytes
(number of entries and length of the store at 8 and 12), 16 bytes for every entry (tag, type, offset, count), and the store.
Numbers are big-endian. A file that is no package, or is cut short, gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.functions.version import parse_evr
from parcelyard.operators import headers

#: Tags of the header's entries. Dependencies have a name, a version and a flags tag each.
STRINGS = {"name": 1000, "version": 1001, "release": 1002, "summary": 1004, "description": 1005, "buildhost": 1007, "vendor": 1011, "license": 1014, "packager": 1015, "group": 1016, "url": 1020, "arch": 1022, "srpm": 1044}
NUMBERS = {"epoch": 1003, "time_build": 1006, "size_installed": 1009, "size_archive": 1046, "source_package": 1106}
DEPENDENCIES = {
    "provides": (1047, 1113, 1112),
    "requires": (1049, 1050, 1048),
    "conflicts": (1054, 1055, 1053),
    "obsoletes": (1090, 1115, 1114),
    "recommends": (5046, 5047, 5048),
    "suggests": (5049, 5050, 5051),
    "supplements": (5052, 5053, 5054),
    "enhances": (5055, 5056, 5057),
}
BASE_NAMES, DIR_NAMES, DIR_PLACES, FILE_MODES, FILE_FLAGS = 1117, 1118, 1116, 1030, 1037
CHANGE_TIMES, CHANGE_AUTHORS, CHANGE_TEXTS = 1080, 1081, 1082
MAGIC, SIGNATURE, ENTRY = "EDABEEDB", 112, 16
#: Type of 16-bit integers; all other integers that are read have 32 bits.
SHORT = 3


def number(content: Column, at: Column | int, width: int = 4) -> Column:
    """Big-endian unsigned integer at a place that counts from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(content, at + 1, F.lit(width))), 16, 10).cast("bigint")


def header_range(content: Column) -> Column:
    """struct<start, end> of the main header."""
    signature = number(content, 104) * ENTRY + number(content, 108)
    start = SIGNATURE + signature + F.pmod(-signature, F.lit(8))
    end = start + 16 + number(content, start + 8) * ENTRY + number(content, start + 12)
    good = F.hex(F.substring(content, 1, 4)) == MAGIC
    return F.struct(F.when(good, start).alias("start"), F.when(good, end).alias("end"))


def list_files(spark: SparkSession, path: str, suffix: str = ".rpm", content: bool = True) -> DataFrame:
    """Files below a folder whose names end in the suffix: path, mtime, size and, on request, content. Empty files are left out.

    Without content no file is opened, so files of any size are listed; with it a file has to fit into a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    columns = ["path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return files.select(*columns, "content") if content else files.select(*columns)


def _texts(store: Column, entries: Column, entry: Column) -> Column:
    """The entry's strings: each ends with a zero byte. What is not UTF-8 counts as Latin-1. Only the bytes up to the next entry are read."""
    later = F.filter(F.transform(entries, lambda e: e["offset"]), lambda o: o > entry["offset"])
    end = F.coalesce(F.array_min(later), F.length(store).cast("bigint"))
    rest = F.substring(store, entry["offset"].cast("int") + 1, (end - entry["offset"]).cast("int"))
    ends = F.split(F.decode(rest, "ISO-8859-1"), "\\x00")
    raw = F.slice(ends, F.lit(1), F.coalesce(entry["count"].cast("int"), F.lit(0)))
    back = F.transform(raw, lambda s: F.encode(s, "ISO-8859-1"))
    return F.when(entry.isNotNull(), F.transform(back, lambda b: F.coalesce(F.try_validate_utf8(b.cast("string")), F.decode(b, "ISO-8859-1"))))


def _numbers(store: Column, entry: Column) -> Column:
    width = F.when(entry["type"] == SHORT, 2).otherwise(4)
    places = F.when(entry["count"] > 0, F.sequence(F.lit(0), entry["count"].cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda k: F.conv(F.hex(F.substring(store, (entry["offset"] + k * width + 1).cast("int"), width)), 16, 10).cast("bigint")
    return F.when(entry.isNotNull(), F.transform(places, one))


def parse(files: DataFrame) -> DataFrame:
    """Packages of files (path, mtime, size, content): texts, numbers, dependencies, files and changelogs of the header.

    Arrays stand as in the header; cleaning of requires and limits of changelogs are operators of their own. pkgid is the
    SHA-256 of the whole file.
    """
    ranged = files.select("path", "mtime", "size", F.sha2("content", 256).alias("pkgid"), "content", header_range(F.col("content")).alias("range"))
    start = F.col("range.start")
    head = ranged.where(start.isNotNull()).select(
        "path", "mtime", "size", "pkgid", "range", number(F.col("content"), start + 8).alias("n"), F.substring("content", start.cast("int") + 1, (F.col("range.end") - start).cast("int")).alias("head")
    )
    at = lambda k, field: number(F.col("head"), 16 + k * ENTRY + 4 * field)
    entry = lambda k: F.struct(at(k, 0).alias("tag"), at(k, 1).alias("type"), at(k, 2).alias("offset"), at(k, 3).alias("count"))
    entries = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), entry)
    store = F.substring("head", (16 + F.col("n") * ENTRY).cast("int") + 1, F.length("head"))
    split = head.select("path", "mtime", "size", "pkgid", "range", entries.alias("entries"), store.alias("store"))
    find = lambda tag: F.get(F.filter("entries", lambda e: e["tag"] == tag), F.lit(0))
    texts = lambda tag: _texts(F.col("store"), F.col("entries"), find(tag))
    numbers = lambda tag: _numbers(F.col("store"), find(tag))
    raw = split.select(
        "path", "mtime", "size", "pkgid", F.col("range.start").alias("header_start"), F.col("range.end").alias("header_end"),
        *(F.get(texts(tag), F.lit(0)).alias(c) for c, tag in STRINGS.items()),
        *(F.get(numbers(tag), F.lit(0)).alias(c) for c, tag in NUMBERS.items()),
        *(F.arrays_zip(texts(a).alias("name"), texts(b).alias("evr"), numbers(c).alias("sense")).alias(kind) for kind, (a, b, c) in DEPENDENCIES.items()),
        texts(DIR_NAMES).alias("dirs"), F.arrays_zip(texts(BASE_NAMES).alias("base"), numbers(DIR_PLACES).alias("dir"), numbers(FILE_MODES).alias("mode"), numbers(FILE_FLAGS).alias("flags")).alias("files"),
        F.arrays_zip(numbers(CHANGE_TIMES).alias("date"), texts(CHANGE_AUTHORS).alias("author"), texts(CHANGE_TEXTS).alias("changelog")).alias("changelogs"),
    )

    def dependency(kind: str) -> Column:
        full = lambda d: parse_evr(d["evr"])
        made = lambda d: F.struct(
            d["name"].alias("name"), headers.sense_flags(d["sense"]).alias("flags"), full(d)["epoch"].alias("epoch"), full(d)["version"].alias("version"), full(d)["release"].alias("release"),
            (headers.sense_pre(d["sense"]) if kind == "requires" else F.lit(False)).alias("pre"),
        )
        out = F.transform(F.filter(kind, lambda d: headers.sound_version(d["evr"])), made)
        return F.coalesce(out, F.array().cast("array<struct<name:string,flags:string,epoch:string,version:string,release:string,pre:boolean>>"))

    file = lambda f: F.struct(F.concat(F.get("dirs", f["dir"].cast("int")), f["base"]).alias("path"), headers.file_type(f["mode"], f["flags"]).alias("type"))
    log = lambda c: F.struct(headers.trim_author(c["author"]).alias("author"), c["date"].alias("date"), c["changelog"].alias("changelog"))
    return raw.withColumns(
        {kind: dependency(kind) for kind in DEPENDENCIES}
        | {
            "arch": headers.package_arch(F.col("arch"), F.col("source_package")),
            "epoch": F.coalesce(F.col("epoch").cast("string"), F.lit("0")),
            "files": F.coalesce(F.transform("files", file), F.array().cast("array<struct<path:string,type:string>>")),
            "changelogs": F.coalesce(F.transform("changelogs", log), F.array().cast("array<struct<author:string,date:bigint,changelog:string>>")),
        }
    ).drop("dirs", "source_package")
