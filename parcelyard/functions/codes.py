"""Enumerations, flags and checked conversions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparison flags of dependencies.
FLAG_NAMES = {2: "LT", 4: "GT", 8: "EQ", 10: "LE", 12: "GE"}
CHECKSUMS = ("md5", "sha", "sha1", "sha224", "sha256", "sha384", "sha512")
SUFFIXES = {"gz": ".gz", "gzip": ".gz", "bz2": ".bz2", "bzip2": ".bz2", "xz": ".xz", "zck": ".zck", "zstd": ".zst"}
ALGORITHMS = {1: "md5", 2: "sha1", 8: "sha256", 9: "sha384", 10: "sha512", 11: "sha224"}
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def flag_name(flags: Column) -> Column:
    low = flags.bitwiseAND(F.lit(15))
    out = F.lit(None).cast("string")
    for code, name in FLAG_NAMES.items():
        out = F.when(low == code, name).otherwise(out)
    return out


def parse_pre(v: Column) -> Column:
    return F.when(v.isNull() | v.isin("0", "FALSE", "false", "False"), False).otherwise(True)


def checksum_type(name: Column) -> Column:
    return F.when(F.lower(name).isin(*CHECKSUMS), F.lower(name)).otherwise("unknown")


def compression_suffix(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SUFFIXES.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def digest_algorithm(number: Column) -> Column:
    out = F.lit("unknown")
    for k, v in ALGORITHMS.items():
        out = F.when(number == k, v).otherwise(out)
    return out


#: File name endings by which a compression is told, and first bytes (as hex) where no ending tells.
ENDINGS = {
    "gz": (".gz", ".gzip", ".gunzip"), "bz2": (".bz2", ".bzip2"), "xz": (".xz",), "zck": (".zck",), "zstd": (".zst",),
    "none": (".xml", ".tar", ".yaml", ".sqlite", ".txt"),
}
MAGIC = {"gz": "1F8B", "zstd": "28B52FFD", "bz2": "425A", "xz": "FD377A585A", "zck": "005A434B31"}


def detect_compression(path: Column, head: Column) -> Column:
    """By the ending of the name, else by the first five bytes (as hex); files of fewer bytes are plain.

    Where neither tells, a name with several endings is ``unknown``, any other ``none``.
    """
    stacked = F.size(F.split(F.substring_index(path, "/", -1), "[.]")) >= 3
    out = F.when(stacked, "unknown").otherwise("none")
    for name, start in reversed(MAGIC.items()):
        out = F.when(head.startswith(start), name).otherwise(out)
    out = F.when(F.length(head) < 10, "none").otherwise(out)
    for name, endings in ENDINGS.items():
        told = F.lit(False)
        for end in endings:
            told = told | path.endswith(end)
        out = F.when(told, name).otherwise(out)
    return out


def parse_long(v: Column) -> Column:
    """Leading integer of a text, 0 where there is none; beyond 64 bits the nearest number."""
    digits = F.regexp_extract(v, r"^\s*([+-]?[0-9]+)", 1)
    clamped = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1)).cast("bigint")
    return F.when(v.isNull() | (digits == ""), F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), clamped))


def number_fault(v: Column) -> Column:
    """What a scan warns of in a text that should be an integer: ``overflow``, ``garbage`` (nothing of it is a number), or null."""
    digits = F.regexp_extract(v, r"^\s*([+-]?[0-9]+)", 1)
    return F.when((digits != "") & digits.try_cast("bigint").isNull(), "overflow").when((v != "") & (parse_long(v) == 0) & ~v.rlike(r"^\s*[+-]?0+$"), "garbage")


def seconds(period: Column) -> Column:
    """``N``, ``Nm``, ``Nh``, ``Nd`` in seconds; null for anything else."""
    n = F.regexp_extract(period, "^([0-9]+)[mhd]?$", 1).try_cast("bigint")
    unit = F.substring(period, -1, 1)
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)


def has_control(c: Column) -> Column:
    """Whether a text holds a control character that the metadata format forbids."""
    return F.coalesce(c.rlike(CONTROL), F.lit(False))


def latin1_to_utf8(raw: Column) -> Column:
    """Bytes taken as Latin-1 where they are not valid UTF-8; control characters and 0x80-0xBF are left out."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(_latin1(raw))


def database_text(raw: Column) -> Column:
    """Bytes as tables of the star hold them: valid UTF-8 without control characters as it is, anything else taken as Latin-1."""
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text) & ~has_control(text), text).otherwise(_latin1(raw))


def _latin1(raw: Column) -> Column:
    return F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x80-\\xBF]", "")


def distro_tag(tag: Column) -> Column:
    """``cpeid,value`` or just ``value`` as struct<cpeid, value>."""
    parts = F.split(tag, ",", 2)
    return F.struct(F.when(F.size(parts) > 1, parts[0]).alias("cpeid"), F.element_at(parts, -1).alias("value"))


def unescape_ampersand(v: Column) -> Column:
    return F.replace(v, F.lit("#38;"), F.lit(""))


def force_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def prevent_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
