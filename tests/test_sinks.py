"""Sinks read back by the sources, publishing, batch files, options, quality."""

import pytest
from pyspark.sql import functions as F

from parcelyard.operators import metadata, quality
from parcelyard.sources import files, repository, snippets, writer


def test_manifest_round_trip(spark, tmp_path):
    rows = [
        ("updateinfo", "repodata/u.xml", None, "c3", "sha256", None, None, None, None, 5, 6, None, None, None),
        ("primary", "repodata/p&.xml", "http://b", "c1", "sha256", "o1", "md5", "h1", "sha1", 1, 2, 3, 4, 10),
        ("zz", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    records = spark.createDataFrame(rows, writer.RECORD)
    tags = repository.given_tags(spark, ["one"], ["two"], ["cpe:/o:x,three", "four"])
    (tmp_path / "repodata").mkdir()
    (tmp_path / "repodata/repomd.xml").write_text(writer.manifest_xml(records, F.lit("42"), tags).first().value)
    got = repository.read_manifest(spark, str(tmp_path)).collect()
    assert [r.type for r in got] == ["primary", "updateinfo", "zz"] and {r.revision for r in got} == {"42"}
    assert sorted((tuple(r[c.split()[0]] for c in writer.RECORD.split(", ")) for r in got), key=str) == sorted(rows, key=str)
    assert {tuple(t) for t in repository.read_tags(spark, str(tmp_path)).collect()} == {tuple(t) for t in tags.collect()} == {("repo", None, "one"), ("content", None, "two"), ("distro", "cpe:/o:x", "three"), ("distro", None, "four")}
    assert int(writer.manifest_xml(records).select(F.regexp_extract("value", "<revision>([0-9]+)", 1).alias("r")).first().r) > 1_700_000_000
    same = metadata.same_manifest(records, repository.read_manifest(spark, str(tmp_path)), tags, repository.read_tags(spark, str(tmp_path)))
    assert same.first().equal and not metadata.same_manifest(records, records, tags, tags.where("kind = 'repo'")).first().equal
    assert not metadata.unchanged(records, records, retain=True).first().equal and metadata.unchanged(records, records).first().equal


def test_advisory_round_trip(spark, tmp_path):
    text = """<updates><update from="a@b" status="final" type="security" version="3"><id>ID-1</id><title>t &amp; u</title><issued date="2012-12-12 00:00:00"/><updated date="2013"/><rights>free</rights><release>R</release><pushcount>3</pushcount><severity>high</severity><summary>s</summary><description>d</description><solution>update</solution><reboot_suggested>True</reboot_suggested>
    <references><reference href="http://x" id="7" type="bugzilla" title="&lt;bug&gt;"/></references><pkglist><collection short="c"><name>coll</name><module name="m" stream="1" version="20190101" context="c" arch="x"/>
    <package name="p" version="1.10" release="007" epoch="0" arch="x" src="p.src.rpm"><filename>p.rpm</filename><sum type="md5">s1</sum><reboot_suggested>True</reboot_suggested></package></collection></pkglist></update><update from="n"><id>ID-2</id></update></updates>"""
    (tmp_path / "a.xml").write_text(text)
    first = repository.read_advisories(spark, str(tmp_path / "a.xml"))
    (tmp_path / "b.xml").write_text("<updates>" + "".join(r.value for r in first.select(writer.advisory_xml().alias("value")).collect()) + "</updates>")
    again = repository.read_advisories(spark, str(tmp_path / "b.xml"))
    named = repository.advisory_packages(again).where("name is not null").first()
    assert (named.version, named["sum"], named.sum_type, named.reboot_suggested, named.relogin_suggested, named.src) == ("1.10", "s1", "md5", True, False, "p.src.rpm")
    known = lambda df: [(r.id, r.title, r.issued, r.severity, r.rights, r.release, r.pushcount, r.solution, r.reboot_suggested, tuple(map(tuple, r.references or [])), [(c.name, c.module._stream if c.module else None, [(p._name, p._version, p._release, p.filename) for p in c.package]) for c in r.collections or []]) for r in df.orderBy("id").collect()]
    assert known(first) == known(again) and known(first)[0][10] == [("coll", "1", [("p", "1.10", "007", "p.rpm")])]


def test_container(spark, tmp_path):
    rows = [(f"n{k % 7}", "x", "0", "1", "1", f"id{k}", k, k, f"{k}.rpm", None, "s") for k in range(40)]
    pkgs = spark.createDataFrame(rows, "name string, arch string, epoch string, version string, release string, pkgid string, time_file int, size_package int, href string, location_base string, srpm string")
    chunk = snippets.primary_chunk(pkgs.columns)
    assert writer.write_container(pkgs, chunk, "primary", str(tmp_path / "primary"), ["name", "href"]) == 40
    parts = [p for k in (0, 1, 2) for p in sorted((tmp_path / f"primary/part={k}").glob("part-*.gz"))]
    (tmp_path / "primary.xml.gz").write_bytes(b"".join(p.read_bytes() for p in parts))
    got = repository.read_xml(spark, str(tmp_path / "primary.xml.gz"), "package", snippets.PRIMARY)
    assert {r[0] for r in got.select("checksum._VALUE").collect()} == {f"id{k}" for k in range(40)}
    lines = [r.value for r in spark.read.text(str(tmp_path / "primary.xml.gz")).collect()]
    assert lines[2:-1] == [r.x for r in pkgs.orderBy("name", "href").select(chunk.alias("x")).collect()]
    assert 'packages="40"' in lines[1] and lines[-1] == "</metadata>" and len(lines) == 43
    assert writer.write_container(pkgs.limit(0), chunk, "other", str(tmp_path / "none"), ["name"]) == 0


def test_publish(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"stage{k}").mkdir()
        (tmp_path / f"stage{k}/f").write_text(str(k))
        writer.publish(spark, str(tmp_path / f"stage{k}"), str(tmp_path / "repo"))
    assert (tmp_path / "repo/f").read_text() == "2"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["repo"]
    (tmp_path / "repo.lock").write_text("")
    with pytest.raises(FileExistsError):
        writer.publish(spark, str(tmp_path / "repo"), str(tmp_path / "repo"))


def packages(spark):
    """Two packages with everything that parts hold."""
    dep, file, log = snippets.DEPENDENCY, "struct<path:string,type:string,hash:string>", "struct<author:string,date:bigint,changelog:string>"
    entry = lambda n, f=None, v=None, p=False: (n, f, None if v is None else "1", v, None, p)
    rows = [
        ("b", "x", "0", "1", "1", "id2", "sha256", "b.rpm", [entry("q", "GE", "2", True), entry(None)], [entry("b")], [("/etc/b", "", "h"), ("/usr/b", "dir", None), (None, "", None)], [("me", k, f"text {k}\n<package>\r\n") for k in (3, 1, 2)]),
        ("a", "x", None, "1<", "1", "id1", "sha256", "a&b.rpm", [], [], [], []),
    ]
    return spark.createDataFrame(rows, f"name string, arch string, epoch string, version string, release string, pkgid string, checksum_type string, href string, requires array<{dep}>, provides array<{dep}>, files array<{file}>, changelogs array<{log}>")


def test_repository_is_written_and_read_again(spark, tmp_path):
    made = writer.RepositoryWriter(spark, str(tmp_path / "repo"), changelog_limit=2, extended=True)
    assert made.add_packages(packages(spark)) == 2
    made.add_document("group", spark.createDataFrame([("<comps/>",)], "value string"))
    records = made.finish(F.lit("5"))
    with pytest.raises(RuntimeError):
        made.add_packages(packages(spark))
    read = repository.Repository(spark, str(tmp_path / "repo"))
    assert {r.type for r in read.records.collect()} == {"primary", "filelists", "filelists-ext", "other", "group"} and metadata.same_manifest(records, read.records).first().equal
    a, b = read.packages().orderBy("name").collect()
    assert (a.version, a.href, a.epoch) == ("1<", "a&b.rpm", "0") and [tuple(d) for d in b.requires] == [("q", "GE", "1", "2", None, True)]
    assert [(f.path, f.type, f.hash) for f in b.files] == [("/etc/b", "", "h"), ("/usr/b", "dir", None)] and [(c.date, c.changelog) for c in b.changelogs] == [(2, "text 2\n<package>\r\n"), (3, "text 3\n<package>\r\n")]
    assert [r.href for r in read.records.where("type = 'primary'").collect()][0].endswith("-primary.xml")
    bad = packages(spark).withColumn("name", F.concat("name", F.lit("\x01")))
    with pytest.raises(Exception, match="forbidden control character"):
        writer.RepositoryWriter(spark, str(tmp_path / "bad")).add_packages(bad)
    assert not (tmp_path / "bad").exists()
    kept = packages(spark).withColumn("skip_dump", F.col("name") == "a")
    assert writer.RepositoryWriter(spark, str(tmp_path / "few")).add_packages(kept) == 1
    # The same packages make an equal manifest, so that publishing can be left out.
    again = writer.RepositoryWriter(spark, str(tmp_path / "again"), changelog_limit=2, extended=True)
    again.add_packages(packages(spark))
    again.add_document("group", spark.createDataFrame([("<comps/>",)], "value string"))
    assert metadata.unchanged(read.records, again.finish(F.lit("6"))).first().equal


def test_star_of_a_repository(spark, tmp_path):
    made = writer.RepositoryWriter(spark, str(tmp_path / "repo"))
    made.add_packages(packages(spark))
    made.finish()
    read = repository.Repository(spark, str(tmp_path / "repo"))
    for _ in range(2):
        writer.convert_to_star(read, str(tmp_path / "star"))
    table = lambda name: spark.read.parquet(str(tmp_path / f"star/{name}"))
    assert [(r.pkgKey, r.name, r.rpm_vendor, r.url) for r in table("packages").orderBy("pkgKey").collect()] == [(1, "a", "", None), (2, "b", "", None)]
    assert [tuple(r) for r in table("files").collect()] == [("/etc/b", "file", 2)] and {(r.dirname, r.filenames, r.filetypes) for r in table("filelist").collect()} == {("/etc", "b", "f"), ("/usr", "b", "d")}
    assert [(r.name, r.pkgkey, r.pre) for r in table("requires").collect()] == [("q", 2, True)] and "pre" not in table("provides").columns and table("changelog").count() == 3
    assert table("db_info").first().checksum == read.records.where("type = 'primary'").first().checksum
    (tmp_path / "repo/repodata/.repomd.xml.crc").unlink()
    (tmp_path / "repo/repodata/repomd.xml").write_text((tmp_path / "repo/repodata/repomd.xml").read_text().replace("</repomd>", '<data type="primary_db"><location href="x"/></data></repomd>'))
    with pytest.raises(FileExistsError):
        writer.convert_to_star(read, str(tmp_path / "star"))
    writer.convert_to_star(read, str(tmp_path / "star"), force=True)


def test_modify_and_survivors(spark, tmp_path):
    made = writer.RepositoryWriter(spark, str(tmp_path / "repo"))
    made.add_packages(packages(spark))
    made.add_document("group", spark.createDataFrame([("<comps/>",)], "value string"))
    made.finish()
    (tmp_path / "batch").write_text("[x/comps.xml]\ntype=group\nunique-md-filenames=false\n[other]\ntype=other\nremove=true\n[y/new.info.xml]\n")
    tasks = files.batch_tasks(spark, str(tmp_path / "batch"))
    contents = spark.createDataFrame([("x/comps.xml", "repodata/comps.xml", "c1", "sha256", 7), ("y/new.info.xml", "repodata/new.info.xml", "c2", "sha256", 8)], "path string, href string, checksum string, checksum_type string, size bigint")
    writer.modify(spark, str(tmp_path / "repo"), tasks, contents)
    got = {r.type: r.href for r in repository.read_manifest(spark, str(tmp_path / "repo")).collect()}
    assert set(got) == {"primary", "filelists", "group", "new"} and got["group"] == "repodata/comps.xml" and got["new"] == "repodata/c2-new.info.xml"
    with pytest.raises(Exception, match="no such file"):
        writer.modify(spark, str(tmp_path / "repo"), tasks, contents.where("path <> 'y/new.info.xml'"))
    for k, names in (("old", ["a.xml", "b.xml", "repomd.xml"]), ("new", ["b.xml"])):
        (tmp_path / k).mkdir()
        for n in names:
            (tmp_path / k / n).write_text(k)
    rows = spark.createDataFrame([("a.xml",), ("b.xml",), ("repomd.xml",)], "href string")
    kept = metadata.survivors(rows, rows.limit(0), rows.where("href = 'b.xml'"))
    assert writer.copy_survivors(spark, kept.unionByName(rows.where("href = 'b.xml'")), str(tmp_path / "old"), str(tmp_path / "new")) == 1
    assert (tmp_path / "new/b.xml").read_text() == "new" and (tmp_path / "new/a.xml").read_text() == "old" and not (tmp_path / "new/repomd.xml").exists()


def test_star(spark, tmp_path):
    pkgs, deps = spark.createDataFrame([(1, "a")], "pkgkey int, name string"), spark.createDataFrame([(1, "d")], "pkgkey int, dep string")
    for checksum in ("one", "two"):
        writer.write_star(str(tmp_path / "star"), pkgs, {"requires": deps}, checksum)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "star/db_info")).collect()] == [(10, "two")]
    assert spark.read.parquet(str(tmp_path / "star/requires")).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["star"]


def test_old_packages(spark, tmp_path):
    for name, size in (("a.rpm", 5), ("b.rpm", 50), ("c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.path.rsplit("/", 1)[1] for r in files.old_packages(spark, [str(tmp_path)], 10).collect()] == ["a.rpm"]


def test_lists_and_batch(spark, tmp_path):
    (tmp_path / "list").write_text("a.rpm\n\n  \nb/c.rpm\n")
    assert [r.name for r in files.read_lines(spark, str(tmp_path / "list")).collect()] == ["a.rpm", "b/c.rpm"]
    (tmp_path / "batch").write_text("# changes\n[one.xml]\ntype=group\ncompress=false\n[two]\npath=x/two.xml\nremove=true\nnew-name=t\n")
    got = [tuple(r) for r in files.batch_tasks(spark, str(tmp_path / "batch")).collect()]
    assert [g[1:] for g in got] == [("one.xml", "group", False, False, None, True, None, None), ("x/two.xml", None, True, True, None, True, None, "t")]
    df = spark.createDataFrame([("a/b.rpm",), ("x.modulemd.yaml",), ("modules.yaml.gz",), ("README",)], "path string")
    assert [r.role for r in files.routed(df).collect()] == ["package", "modules", "modules", None]


def test_content(spark, tmp_path):
    import gzip
    import hashlib

    data = gzip.compress(b"text")
    (tmp_path / "a.bin").write_bytes(data)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    row = files.content_stats(raw.select("path", "content"), "sha1").first()
    assert (row.checksum, row["size"], row.compression) == (hashlib.sha1(data).hexdigest(), len(data), "gz")


def test_quality(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "ord int, in_order boolean")
    assert quality.assert_in_order(df.where("ord = 1")).count() == 1
    with pytest.raises(Exception, match="out of order metadata at 2"):
        quality.assert_in_order(df).collect()
    for kind, wrong in ((quality.BuildOptions, {"checksum": "crc"}), (quality.BuildOptions, {"cut_dirs": -1}), (quality.BuildOptions, {"retain_old": 1, "retain_age": 5}), (quality.BuildOptions, {"duplicates": "x"}), (quality.MergeOptions, {"method": "x"}), (quality.MergeOptions, {"simple": True}), (quality.ModifyOptions, {}), (quality.ModifyOptions, {"path": "a", "new_name": ""}), (quality.ModifyOptions, {"path": "a", "compression": "rar"}), (quality.ConvertOptions, {"keep_old": True}), (quality.ConvertOptions, {"checksum": "crc"})):
        with pytest.raises(ValueError):
            kind(**wrong)
    with pytest.warns(UserWarning, match="changelog_limit"):
        assert quality.BuildOptions(changelog_limit=-2).changelog_limit == 10
    assert quality.BuildOptions(changelog_limit=-1).checksum == "sha256" and quality.MergeOptions(koji=True, simple=True).method == "simple" and quality.MergeOptions(koji=True).method == "all"
