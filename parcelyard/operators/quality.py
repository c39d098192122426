"""Data quality of scanned parts: warnings as rows, hard errors as a split, order of parts, options."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from parcelyard.functions import codes

#: Kinds of warnings.
UNKNOWN_TAG, MISSING_ATTRIBUTE, UNKNOWN_VALUE, BAD_NUMBER, MISSING_VALUE, BAD_TYPE = "unknown tag", "missing attribute", "unknown value", "bad attribute value", "missing value", "bad metadata type"
FILE_TYPES = ("", "dir", "ghost")


def file_type_warnings(files: DataFrame) -> DataFrame:
    """Rows (pkgkey, code, message) for files of a type that the format does not know."""
    bad = files.where(~F.coalesce("type", F.lit("")).isin(*FILE_TYPES))
    return bad.select("pkgkey", F.lit(UNKNOWN_VALUE).alias("code"), F.concat(F.lit("unknown file type: "), "type").alias("message"))


def number_warnings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, code, message) for texts that should be integers: absent ones, ones that overflow, and ones of which nothing
    is a number. What follows leading digits is passed over in silence."""
    checked = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    one = rows.select(key, F.explode(checked).alias("x")).select(key, "x.*")
    code = F.when(F.col("v").isNull(), MISSING_ATTRIBUTE).when(codes.number_fault(F.col("v")).isNotNull(), BAD_NUMBER)
    return one.withColumn("code", code).where(F.col("code").isNotNull()).select(key, "code", F.concat_ws(": ", "column", "v").alias("message"))


def missing_values(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, code, message) for elements that are there but hold nothing."""
    checked = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    one = rows.select(key, F.explode(checked).alias("x")).where(F.col("x.v") == "")
    return one.select(key, F.lit(MISSING_VALUE).alias("code"), F.col("x.column").alias("message"))


def element_paths(struct: StructType, at: str) -> list[str]:
    """Paths of all elements that a scan's schema knows, the outermost being ``at``."""
    out = [at]
    for f in struct:
        kind = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
        if f.name[0] != "_":
            out += element_paths(kind, f"{at}/{f.name}") if isinstance(kind, StructType) else [f"{at}/{f.name}"]
    return out


def unknown_elements(xml: Column, known: list[str]) -> Column:
    """Paths of the elements of a text that are not known, in order; what is inside of such an element is passed over.

    One fold over the tags of the text: it holds the open path and, inside an unknown element, how deep that is.
    """
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"""<(/?[^\s/>]+(?:"[^"]*"|'[^']*'|[^'">])*)>"""), F.lit(1))
    wanted = F.array(*map(F.lit, known))
    start = F.struct(F.lit("").alias("path"), F.lit(0).alias("inside"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, tag: Column) -> Column:
        path, inside, found = state["path"], state["inside"], state["found"]
        closing, alone = tag.startswith("/"), tag.endswith("/")
        name = F.regexp_extract(tag, r"^/?([^\s/]+)", 1)
        here = F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))
        strange = (inside == 0) & ~closing & ~F.array_contains(wanted, here)
        deeper = F.when(closing, -1).when(alone, 0).otherwise(1)
        new_inside = F.when(inside > 0, inside + deeper).when(strange & ~alone, 1).otherwise(0)
        above = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
        new_path = F.when(inside > 0, path).when(closing, above).when(alone | strange, path).otherwise(here)
        return F.struct(new_path.alias("path"), new_inside.alias("inside"), F.when(strange, F.array_append(found, here)).otherwise(found).alias("found"))

    return F.aggregate(tags, start, step)["found"]


def element_warnings(rows: DataFrame, key: str, xml: str, known: list[str]) -> DataFrame:
    """Rows (key, code, message): the unknown elements of XML texts."""
    found = rows.select(key, F.explode(unknown_elements(F.col(xml), known)).alias("message"))
    return found.select(key, F.lit(UNKNOWN_TAG).alias("code"), "message")


def root_warnings(rows: DataFrame, key: str, xml: str, root: str) -> DataFrame:
    """Rows (key, code, message): documents whose outermost element is not the expected one."""
    bare = F.regexp_replace(F.col(xml), r"(?s)<!--.*?-->|<[?!][^>]*>", "")
    name = F.regexp_extract(bare, r"<([^\s/>]+)", 1)
    return rows.select(key, name.alias("name")).where(F.col("name") != root).select(key, F.lit(BAD_TYPE).alias("code"), F.concat(F.lit("no root element "), F.lit(root)).alias("message"))


def quarantine(pkgs: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others; a null verdict counts as bad."""
    verdict = F.coalesce(good, F.lit(False))
    return pkgs.where(verdict), pkgs.where(~verdict)


def has_id(column: str = "pkgid") -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def assert_in_order(joined: DataFrame) -> DataFrame:
    """The rows of join_positional; a place where the parts name different packages fails the job."""
    return joined.where(F.when(F.col("in_order"), True).otherwise(F.raise_error(F.concat(F.lit("out of order metadata at "), F.col("ord").cast("string"))).cast("boolean")))


#: Checksum types and compressions that options name.
CHECKSUMS, COMPRESSIONS = ("md5", "sha", "sha1", "sha224", "sha256", "sha384", "sha512"), ("gz", "bz2", "xz", "zstd", "none")


def _known(kind: str, value: str, values: tuple[str, ...]) -> None:
    if value not in values:
        raise ValueError(f"unknown {kind}: {value}")


@dataclass(frozen=True)
class MergeOptions:
    """Options of a merge: ``archs`` are expanded on request; the noarch repository and the method are named."""

    archs: tuple[str, ...] = ()
    expand: bool = False
    multilib: bool = False
    method: str = "repo"
    koji: bool = False
    simple: bool = False
    omit_base: bool = False
    compression: str = "gz"

    def __post_init__(self):
        _known("merge method", self.method, ("repo", "ts", "nvr", "all", "simple"))
        _known("compression", self.compression, COMPRESSIONS)
        if self.simple and not self.koji:
            raise ValueError("simple needs koji")
        if self.koji:
            object.__setattr__(self, "method", "simple" if self.simple else "all")


@dataclass(frozen=True)
class ModifyOptions:
    """Options of one change of a manifest."""

    path: str = ""
    type: str | None = None
    remove: bool = False
    compress: bool = True
    compression: str = "zstd"
    checksum: str = "sha256"
    unique: bool = True
    new_name: str | None = None

    def __post_init__(self):
        _known("compression", self.compression, COMPRESSIONS)
        _known("checksum type", self.checksum, CHECKSUMS)
        if self.new_name == "":
            raise ValueError("a new name is not empty")
        if not self.path and not self.type:
            raise ValueError("a change names a file or a type")


@dataclass(frozen=True)
class ConvertOptions:
    """Options of a conversion into tables."""

    checksum: str | None = None
    force: bool = False
    keep_old: bool = False

    def __post_init__(self):
        if self.checksum is not None:
            _known("checksum type", self.checksum, CHECKSUMS)
        if self.keep_old and not self.force:
            raise ValueError("keep_old needs force")


@dataclass(frozen=True)
class BuildOptions:
    """Options of a build; wrong combinations fail at once, a wrong number of changelogs gives the default with a warning."""

    checksum: str = "sha256"
    changelog_limit: int = 10
    cut_dirs: int = 0
    location_prefix: str = ""
    excludes: tuple[str, ...] = field(default=())
    retain_old: int = 0
    retain_age: int | None = None
    duplicates: str = "keep"

    def __post_init__(self):
        _known("checksum type", self.checksum, CHECKSUMS)
        if self.changelog_limit < -1:
            warnings.warn(f"changelog_limit is -1 (all) or a number, not {self.changelog_limit}; 10 is used", stacklevel=2)
            object.__setattr__(self, "changelog_limit", 10)
        if self.cut_dirs < 0:
            raise ValueError("cut_dirs is not negative")
        if self.retain_old and self.retain_age is not None:
            raise ValueError("retain_old and retain_age exclude each other")
        if self.duplicates not in ("keep", "keep-last"):
            raise ValueError(f"unknown rule for duplicates: {self.duplicates}")
