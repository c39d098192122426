"""Version precedence and package-name parsing as native columns.

``ver_key`` maps a version to a string whose byte order is the version order, so precedence is plain ORDER BY, window and
join work. Order of segments: ``~`` < end < ``^`` < letters < digits; digits compare by length without leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ver_key(v: Column) -> Column:
    """Order-preserving key; null stays null."""

    def segment(t: Column) -> Column:
        digits = F.regexp_replace(t, "^0+", "")
        numeric = F.concat(F.lit("4"), F.lpad(F.length(digits).cast("string"), 3, "0"), digits)
        return F.when(t == "~", "0").when(t == "^", "2").when(t.rlike("^[A-Za-z]"), F.concat(F.lit("3"), t)).otherwise(numeric)

    parts = F.regexp_extract_all(v, F.lit(r"(~|\^|[A-Za-z]+|[0-9]+)"), F.lit(1))
    return F.concat(F.array_join(F.transform(parts, segment), ""), F.lit("1"))


def compare(a: Column, b: Column) -> Column:
    """0 equal, 1 the first is newer, 2 the second is; null counts as empty."""
    x, y = ver_key(F.coalesce(a, F.lit(""))), ver_key(F.coalesce(b, F.lit("")))
    return F.when(x == y, 0).when(x > y, 1).otherwise(2)


def merge_key(epoch: Column, version: Column, release: Column) -> Column:
    """Key of the merge rules: a null part counts as empty, so a null epoch is below "0"."""
    return F.struct(*(ver_key(F.coalesce(c, F.lit(""))).alias(n) for n, c in (("e", epoch), ("v", version), ("r", release))))


def evr_key(epoch: Column, version: Column, release: Column) -> Column:
    """Key of build and delta comparisons: a null epoch equals "0", a null version or release is below any other."""
    return F.struct(ver_key(F.coalesce(epoch, F.lit("0"))).alias("e"), ver_key(version).alias("v"), ver_key(release).alias("r"))


def parse_evr(s: Column) -> Column:
    """``[E:]V[-R]`` to struct<epoch, version, release>; the empty string gives nulls, a non-numeric epoch null."""
    head = F.regexp_extract(s, "^([^:]*):", 1)
    rest = F.regexp_replace(s, "^[^:]*:", "")
    epoch = F.when(head.rlike("^[0-9]+$"), head).when(head == "", "0")
    release = F.nullif(F.regexp_extract(rest, "^[^-]*-(.*)$", 1), F.lit(""))
    version = F.regexp_extract(rest, "^([^-]*)", 1)
    return F.struct(*(F.when(s != "", c).alias(n) for n, c in (("epoch", epoch), ("version", version), ("release", release))))


def parse_nevr(s: Column) -> Column:
    """N-V-R with the epoch before the name, before the version or after the release; nulls if there are no two dashes."""
    part = lambda k: F.regexp_extract(s, "^(.*)-([^-]*)-([^-]*)$", k)
    name, version, release = part(1), part(2), part(3)
    after = lambda c: F.regexp_extract(c, "^[^:]*:(.*)$", 1)
    before = lambda c: F.regexp_extract(c, "^([^:]*)", 1)
    has = lambda c: F.instr(c, ":") > 0
    epoch = F.when(has(release), after(release)).when(has(version), before(version)).when(has(name), before(name))
    fields = {
        "name": F.when(~has(release) & ~has(version) & has(name), after(name)).otherwise(name),
        "epoch": epoch,
        "version": F.when(~has(release) & has(version), after(version)).otherwise(version),
        "release": F.when(has(release), before(release)).otherwise(release),
    }
    return F.struct(*(F.when(s.rlike("^(.*)-([^-]*)-([^-]*)$"), c).alias(n) for n, c in fields.items()))


def parse_nevra(s: Column) -> Column:
    """As parse_nevr with ``.arch`` at the end and, perhaps, ``:epoch`` after it; nulls if the arch holds a dash."""
    tail = F.regexp_extract(s, "^.*:([^:.-]*)$", 1)
    has_tail = s.rlike("^.*:[^:.-]*$")
    body = F.when(has_tail, F.regexp_replace(s, ":[^:.-]*$", "")).otherwise(s)
    arch = F.regexp_extract(body, "^.*[.]([^.]*)$", 1)
    good = body.rlike("^.*[.][^.-]*$")
    inner = parse_nevr(F.regexp_replace(body, "[.][^.]*$", ""))
    out = {"name": inner["name"], "epoch": F.when(has_tail, tail).otherwise(inner["epoch"]), "version": inner["version"], "release": inner["release"], "arch": arch}
    return F.struct(*(F.when(good, c).alias(n) for n, c in out.items()))


def split_filename(s: Column) -> Column:
    """Base name of a package file, with ``.rpm`` (and ``:epoch`` after it) taken off, parsed as parse_nevra."""
    base = F.regexp_extract(s, "([^/]*)$", 1)
    epoch = F.regexp_extract(base, "[.]rpm:([^:]*)$", 1)
    bare = F.regexp_replace(base, "[.]rpm(:[^:]*)?$", "")
    inner = parse_nevra(bare)
    return F.struct(
        F.coalesce(inner["name"], bare).alias("name"),
        F.coalesce(F.nullif(epoch, F.lit("")), inner["epoch"]).alias("epoch"),
        inner["version"].alias("version"),
        inner["release"].alias("release"),
        inner["arch"].alias("arch"),
    )


def parse_version(s: Column) -> Column:
    """``M.m.p`` and what follows: struct<major, minor, patch: int, suffix>; absent numbers are 0."""
    number = lambda k: F.coalesce(F.regexp_extract(s, "^([0-9]*)[.]?([0-9]*)[.]?([0-9]*)(.*)$", k).try_cast("int"), F.lit(0))
    suffix = F.nullif(F.regexp_extract(s, "^([0-9]*)[.]?([0-9]*)[.]?([0-9]*)(.*)$", 4), F.lit(""))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), suffix.alias("suffix"))


def nvra(name: Column, version: Column, release: Column, arch: Column) -> Column:
    return F.concat(name, F.lit("-"), version, F.lit("-"), release, F.lit("."), arch)


def nevra(name: Column, epoch: Column, version: Column, release: Column, arch: Column) -> Column:
    """A null or empty epoch is written as 0."""
    e = F.coalesce(F.nullif(epoch, F.lit("")), F.lit("0"))
    return F.concat(name, F.lit("-"), e, F.lit(":"), version, F.lit("-"), release, F.lit("."), arch)
