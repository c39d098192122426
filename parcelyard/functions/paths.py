"""Path and location functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def directory(p: Column) -> Column:
    """Everything up to and with the last slash."""
    return F.regexp_extract(p, "^(.*/)?([^/]*)$", 1)


def clean_href(p: Column) -> Column:
    return F.regexp_replace(p, r"^(\./)+", "")


def with_slash(p: Column) -> Column:
    """Exactly one slash at the end; the empty path is ``./``."""
    return F.when(p == "", "./").otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/")))


def list_directory(p: Column) -> Column:
    """Directory as file lists name it: no slash at the end, but the root stays; empty is ``.``."""
    return F.when(p == "", ".").when(p.rlike("^/+$"), "/").otherwise(F.regexp_replace(p, "/+$", ""))


def file_url(p: Column) -> Column:
    return F.when(p.startswith("/"), F.concat(F.lit("file://"), p)).otherwise(p)


def cut_dirs(p: Column, n: int) -> Column:
    """Without the first n directories; runs of slashes count once and the base name stays."""
    return p if n < 1 else F.regexp_replace(p, "^/*([^/]+/+){0,%d}" % n, "")


def is_primary(p: Column) -> Column:
    return p.startswith("/etc/") | (p == "/usr/lib/sendmail") | p.contains("bin/")


def rewrite_href(path: Column, root: str, cut: int = 0, prefix: str = "") -> Column:
    """Repo-relative location: root taken off, leading directories cut, prefix put before."""
    inner = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)
    return F.concat(F.lit(f"{prefix.rstrip('/')}/" if prefix else ""), cut_dirs(F.regexp_replace(inner, "^/+", ""), cut))


def media_base(base: Column, media: Column) -> Column:
    """Location base of a package on a split medium: ``media:#N``, ``base#N`` or ``proto:#N``."""
    n = F.concat(F.lit("#"), media.cast("string"))
    return F.when(base.isNull() | (base == ""), F.concat(F.lit("media:"), n)).when(base.endswith("://"), F.concat(F.regexp_replace(base, "//$", ""), n)).otherwise(F.concat(base, n))


def replace_prefix(base: Column, search: str, put: str) -> Column:
    """Base URLs without slashes at the end (the root stays); those that start with ``search`` get ``put`` instead of it."""
    bare = F.when(base.rlike("^/+$"), "/").otherwise(F.regexp_replace(base, "/+$", ""))
    if not search:
        return bare
    return F.when(bare.startswith(search), F.concat(F.lit(put), F.substring(bare, len(search) + 1, 1 << 30))).otherwise(bare)


def glob_regex(mask: str) -> str:
    """Regular expression of a file mask in which ``*`` also stands for slashes."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "_/" else f"[{c}]" if c not in "^\\]" else f"\\{c}") for c in mask) + "$"


def record_name(name: Column, checksum: Column) -> Column:
    """Manifest file name with its checksum before it; an outdated checksum goes, the present one is not repeated."""
    bare = F.regexp_replace(name, "^([^/]{32}|[^/]{40}|[^/]{64}|[^/]{128})-", "")
    return F.when(name.startswith(checksum), name).otherwise(F.concat(checksum, F.lit("-"), bare))


def strip_compression(name: Column) -> Column:
    return F.regexp_replace(name, "[.](gz|bz2|xz|zck|zst)$", "")


def derived_type(name: Column) -> Column:
    """Record type of a metadata file: its base name up to the first dot."""
    return F.substring_index(base_name(name), ".", 1)


def simple_file_name(href: Column) -> Column:
    """Whether a manifest's primary file is called by its kind, without a checksum before it."""
    return base_name(href).startswith("primary")
