"""Whole jobs: package files are built into a repository, which is updated, merged, changed and converted."""

import gzip
import hashlib
import lzma
import os
from pathlib import Path

import pytest
import test_headers
import zstandard
from pyspark.sql import functions as F

from parcelyard.operators.quality import BuildOptions, MergeOptions, ModifyOptions
from parcelyard.plans import commands
from parcelyard.sources import files, unpack
from parcelyard.sources.repository import Repository


def package(name, version, arch="x86_64", requires=(), built=5, srpm=None):
    entries = [(1000, "s", [name.encode()]), (1001, "s", [version.encode()]), (1002, "s", [b"1"]), (1022, "s", [arch.encode()]), (1006, "i", [built])]
    entries += [(1044, "s", [srpm.encode()])] if srpm else []
    if requires:
        entries += [(1049, "s", [r.encode() for r in requires]), (1050, "s", [b"" for _ in requires]), (1048, "i", [0 for _ in requires])]
    entries += [(1117, "s", [b"tool", b"conf"]), (1118, "s", [b"/usr/bin/", b"/etc/"]), (1116, "i", [0, 1]), (1030, "h", [0o100755, 0o100644]), (1037, "i", [0, 0])]
    entries += [(1080, "i", [30, 20, 10]), (1081, "s", [b"a", b"b", b"c"]), (1082, "s", [b"new", b"mid", b"old"])]
    return test_headers.package(entries)


NEEDS = ["libc.so.6()(64bit)", "libc.so.6(GLIBC_2.4)(64bit)", "rpmlib(x)", "/etc/conf", "dep", "dep"]


def test_build_and_update(spark, tmp_path):
    folder = str(tmp_path)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/one.rpm").write_bytes(package("one", "1.10", requires=NEEDS))
    (tmp_path / "two.rpm").write_bytes(package("two", "2"))
    (tmp_path / "same.rpm").write_bytes(package("two", "2"))
    (tmp_path / "debug.rpm").write_bytes(package("debug", "2"))
    options = BuildOptions(changelog_limit=2, excludes=("debug*",))
    assert commands.build(spark, folder, options) == 3
    read = Repository(spark, folder)
    one, two, same = read.packages().orderBy("name", F.desc("href")).collect()
    assert (one.href, one.version, one.size_package, one.pkgid) == ("sub/one.rpm", "1.10", len(package("one", "1.10", requires=NEEDS)), hashlib.sha256(package("one", "1.10", requires=NEEDS)).hexdigest())
    assert sorted(d.name for d in one.requires) == ["dep", "libc.so.6(GLIBC_2.4)(64bit)"] and [f.path for f in one.files] == ["/usr/bin/tool", "/etc/conf"]
    assert [(c.date, c.changelog) for c in one.changelogs] == [(20, "mid"), (30, "new")] and (two.href, same.href) == ("two.rpm", "same.rpm")
    # What is known by place, time and size is not read again: a file that has become junk, its time and size kept, stays.
    old = os.stat(tmp_path / "sub/one.rpm")
    (tmp_path / "sub/one.rpm").write_bytes(b"x" * old.st_size)
    os.utime(tmp_path / "sub/one.rpm", (old.st_mtime, old.st_mtime))
    (tmp_path / "three.rpm").write_bytes(package("three", "3"))
    (tmp_path / "same.rpm").unlink()
    assert commands.build(spark, folder, options, update=True) == 3
    assert [(p.name, len(p.files), len(p.changelogs)) for p in Repository(spark, folder).packages().orderBy("name").collect()] == [("one", 2, 2), ("three", 2, 2), ("two", 2, 2)]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["debug.rpm", "repodata", "sub", "three.rpm", "two.rpm"]
    assert len(list((tmp_path / "repodata").glob("*-primary.xml"))) == 1


def test_duplicates_and_empty(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.rpm").write_bytes(package("one", "1", built=k))
    assert commands.build(spark, str(tmp_path), BuildOptions(duplicates="keep-last")) == 1
    assert Repository(spark, str(tmp_path)).packages().first().href == "2.rpm"
    (tmp_path / "none").mkdir()
    assert commands.build(spark, str(tmp_path / "none")) == 0 and Repository(spark, str(tmp_path / "none")).package_count() == 0


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("sources")
    made = {"a": [("one", "1", "x86_64", "one-1-1.src.rpm"), ("two", "1", "noarch", None)], "b": [("one", "3", "x86_64", "one-3-1.src.rpm"), ("two", "2", "noarch", None), ("bad", "1", "i686", "bad-1-1.src.rpm")]}
    for repo, packages in made.items():
        (tmp_path / repo).mkdir()
        for n, v, a, s in packages:
            (tmp_path / repo / f"{n}.rpm").write_bytes(package(n, v, a, srpm=s))
        commands.build(spark, str(tmp_path / repo))
    return [str(tmp_path / r) for r in made]


def test_merge(spark, tmp_path, sources):
    read = lambda name: {(p.name, p.version): p.location_base for p in Repository(spark, str(tmp_path / name)).packages().collect()}
    assert commands.merge_repositories(spark, sources, str(tmp_path / "repo")) == 3
    assert set(read("repo")) == {("one", "1"), ("two", "1"), ("bad", "1")}
    commands.merge_repositories(spark, sources, str(tmp_path / "nvr"), MergeOptions(method="nvr", archs=("x86_64",)), urls={0: "http://a", 1: "http://b"})
    assert read("nvr") == {("one", "3"): "http://b", ("two", "2"): "http://b"}
    blocked = spark.createDataFrame([("bad",)], "name string")
    commands.merge_repositories(spark, sources, str(tmp_path / "koji"), MergeOptions(koji=True), blocked, urls={0: "http://a", 1: "http://b"})
    assert read("koji") == {("one", "1"): None, ("two", "1"): None, ("two", "2"): "http://b"}
    assert len(Repository(spark, str(tmp_path / "koji")).records.where("type = 'origin'").collect()) == 1
    commands.merge_repositories(spark, sources[:1], str(tmp_path / "noarch"), MergeOptions(omit_base=True), noarch=sources[1])
    assert read("noarch") == {("one", "1"): None, ("two", "2"): None}


def test_modify_and_convert(spark, tmp_path, sources):
    (tmp_path / "comps.xml").write_text("<comps/>")
    (tmp_path / "mods.yaml").write_text("---")
    commands.modify(spark, sources[0], [ModifyOptions(str(tmp_path / "comps.xml"), "group", compression="gz"), ModifyOptions(str(tmp_path / "mods.yaml"), compress=False, unique=False), ModifyOptions(type="other", remove=True)])
    records = {r.type: r for r in Repository(spark, sources[0]).records.collect()}
    assert set(records) == {"primary", "filelists", "group", "mods"} and records["mods"].href == "repodata/mods.yaml"
    group = records["group"]
    data = Path(sources[0], group.href).read_bytes()
    assert group.href == f"repodata/{group.checksum}-comps.xml.gz" and gzip.decompress(data) == b"<comps/>" and group.checksum == hashlib.sha256(data).hexdigest()
    assert (group.checksum_open, group.size_open, group["size"]) == (hashlib.sha256(b"<comps/>").hexdigest(), 8, len(data))
    assert Repository(spark, sources[0]).packages().where("changelogs is null").count() == 2
    commands.main(["convert", sources[0], str(tmp_path / "star")])
    assert spark.read.parquet(str(tmp_path / "star/packages")).count() == 2
    (tmp_path / "batch").write_text(f"[{tmp_path}/comps.xml]\ntype=extra\ncompress-type=xz\n[group]\ntype=group\nremove=true\n")
    commands.main(["modify", sources[0], "--batchfile", str(tmp_path / "batch")])
    records = {r.type: r for r in Repository(spark, sources[0]).records.collect()}
    assert set(records) == {"primary", "filelists", "extra", "mods"} and lzma.decompress(Path(sources[0], records["extra"].href).read_bytes()) == b"<comps/>"


def test_open_contents(spark, tmp_path):
    import bz2

    text = b"some text " * 30_000
    packed = {"a.gz": gzip.compress(text) + gzip.compress(b"tail"), "a.bz2": bz2.compress(text) + bz2.compress(b"tail"), "a.xz": lzma.compress(text) + lzma.compress(b"tail"), "a.zst": zstandard.compress(text) + zstandard.compress(b"tail"), "a.xml": text}
    for name, data in packed.items():
        (tmp_path / name).write_bytes(data)
        kind = {"gz": "gz", "bz2": "bz2", "xz": "xz", "zst": "zstd"}.get(name[2:])
        assert kind is None or b"".join(unpack.pieces(kind, data)) == text + b"tail"
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.open_content_stats(raw, "md5").collect()}
    for name, data in packed.items():
        whole = text + b"tail" if name != "a.xml" else None
        assert (got[name].checksum, got[name]["size"]) == (hashlib.md5(data).hexdigest(), len(data))
        assert (got[name].checksum_open, got[name].size_open) == ((hashlib.md5(whole).hexdigest(), len(whole)) if whole else (None, None))
