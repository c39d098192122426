"""What header fields mean: sense bits, file bits, architectures, authors; all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelyard.functions.codes import flag_name
from parcelyard.functions.version import parse_evr

#: Bits of a dependency's sense and of a file's mode and flags.
POSTTRANS, PREREQ, PRETRANS, SCRIPT_PRE, SCRIPT_POST = 1 << 5, 1 << 6, 1 << 7, 1 << 9, 1 << 10
MISSING_OK, STRONG = 1 << 19, 1 << 27
FILE_KIND, DIRECTORY, GHOST = 0o170000, 0o040000, 1 << 6


def _any(bits: Column, mask: int) -> Column:
    return F.coalesce(bits.bitwiseAND(F.lit(mask).cast("bigint")) != 0, F.lit(False))


def sense_flags(sense: Column) -> Column:
    """Comparison name of the low sense bits; null if there is no comparison."""
    return flag_name(sense)


def sense_pre(sense: Column) -> Column:
    """Whether a requirement is needed before installation."""
    return _any(sense, POSTTRANS | PREREQ | PRETRANS | SCRIPT_PRE | SCRIPT_POST)


def weak_kind(kind: Column, sense: Column) -> Column:
    """List that an old-style weak dependency belongs to: optional requires are recommends, strong suggests and enhances
    are recommends and supplements."""
    out = F.when((kind == "requires") & _any(sense, MISSING_OK), "recommends").when((kind == "oldsuggests") & _any(sense, STRONG), "recommends").when(kind == "oldsuggests", "suggests")
    return out.when((kind == "oldenhances") & _any(sense, STRONG), "supplements").when(kind == "oldenhances", "enhances").otherwise(kind)


def file_type(mode: Column, flags: Column) -> Column:
    """``dir`` by the mode, else ``ghost`` by the flags, else empty."""
    return F.when(mode.bitwiseAND(F.lit(FILE_KIND).cast("bigint")) == DIRECTORY, "dir").when(_any(flags, GHOST), "ghost").otherwise("")


def package_arch(arch: Column, source_package: Column) -> Column:
    return F.when(F.coalesce(source_package, F.lit(0)) != 0, "src").otherwise(arch)


def trim_author(author: Column) -> Column:
    return F.regexp_replace(author, " +$", "")


def sound_version(evr: Column) -> Column:
    """False where a dependency's version has an epoch that is no number."""
    return F.coalesce(evr == "", F.lit(True)) | parse_evr(evr)["epoch"].isNotNull()
