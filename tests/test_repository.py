"""Scalar vectors, merge rules against a sequential fold, the catalogue against SQL, XML and streams."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelyard.functions import paths, version
from parcelyard.operators import merge, metadata, ordering
from parcelyard.plans import catalogue
from parcelyard.sources.repository import Repository, load_all

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, rows, expr):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    return [r.x for r in df.select("k", expr(*(F.col(f"c{i}") for i in range(len(rows[0])))).alias("x")).orderBy("k").collect()]


def test_noarch_takes_the_first_row_of_a_file_name(spark):
    """A whole designated repository, in which file names repeat: document order decides, and the whole package is taken over."""
    rows = [(k, k % 2, f"p{k}", f"{'ab'[k % 2]}/{k % 7}.rpm", "noarch" if k % 3 else "x", f"v{k}") for k in range(60)]
    pkgs = spark.createDataFrame(rows[::-1], "ord long, repo_id int, pkgid string, href string, arch string, version string")
    got = {r.ord: tuple(r)[1:] for r in merge.substitute_noarch(pkgs, pkgs.where("repo_id = 1"), paths.base_name(F.col("href"))).collect()}
    first = {}
    for o, repo, *rest in rows:
        if repo == 1:
            first.setdefault(rest[1].split("/")[1], rest)
    assert got == {o: (repo, *(first[rest[1].split("/")[1]] if rest[2] == "noarch" else rest)) for o, repo, *rest in rows}


def order_of(a, b):
    """Version precedence segment by segment: 0 equal, 1 the first is newer, 2 the second."""
    x, y = (re.findall("[0-9]+|[a-zA-Z]+|~|[\\^]", v or "") for v in (a, b))
    for k in range(max(len(x), len(y)) + 1):
        p, q = x[k] if k < len(x) else None, y[k] if k < len(y) else None
        if p is None and q is None:
            return 0
        if "~" in (p, q):
            if p == q:
                continue
            return 2 if p == "~" else 1
        if "^" in (p, q):
            if p == q:
                continue
            if p is None or q is None:
                return 1 if p == "^" else 2
            return 2 if p == "^" else 1
        if p is None or q is None:
            return 2 if p is None else 1
        if p.isdigit() != q.isdigit():
            return 1 if p.isdigit() else 2
        if p.isdigit():
            p, q = int(p), int(q)
        if p != q:
            return 1 if p > q else 2
    return 0


def test_version_compare(spark):
    """Random versions against a comparator that walks both at once."""
    rng = random.Random(1)
    made = lambda: "".join(rng.choice(["0", "1", "10", "9", "07", "a", "ab", "Z", ".", "-", "_", "~", "^"]) for _ in range(rng.randrange(7)))
    pairs = [(made(), made()) for _ in range(3000)] + [(None, ""), (None, "1"), ("3.0", "3.00"), ("4~beta", "4"), ("4^git", "4"), ("4^git", "4.1")]
    assert values(spark, pairs, version.compare) == [order_of(a, b) for a, b in pairs]


def test_parse_evr(spark):
    """Random texts against a parser that looks for the first colon and the first dash after it."""
    rng = random.Random(2)

    def plain(s):
        if s == "":
            return (None, None, None)
        head, colon, rest = s.partition(":")
        rest = rest if colon else s
        epoch = ("0" if not colon or head == "" else head if re.fullmatch("[0-9]+", head) else None)
        v, _, r = rest.partition("-")
        return (epoch, v, r or None)

    texts = ["".join(rng.choice(["1", "23", "a", ":", "-", "."]) for _ in range(rng.randrange(6))) for _ in range(400)]
    assert [tuple(x) for x in values(spark, [(t,) for t in texts], version.parse_evr)] == [plain(t) for t in texts]


def test_parse_names(spark):
    """Names put together from parts, with the epoch at each place where it may stand."""
    rng = random.Random(3)
    parts = [("lib-x", "4", "1.2", "3.fc9", "noarch"), ("a", "0", "2024", "1", "x86_64"), ("perl-Foo-Bar", "12", "0.1~rc2", "5a", "src")]
    cases = []
    for n, e, v, r, a in parts:
        cases += [(f"{e}:{n}-{v}-{r}", (n, e, v, r)), (f"{n}-{e}:{v}-{r}", (n, e, v, r)), (f"{n}-{v}-{r}:{e}", (n, e, v, r)), (f"{n}-{v}-{r}", (n, None, v, r))]
    rng.shuffle(cases)
    assert [tuple(x) for x in values(spark, [(c,) for c, _ in cases], version.parse_nevr)] == [w for _, w in cases]
    full = [(f"{n}-{v}-{r}.{a}:{e}", (n, e, v, r, a)) for n, e, v, r, a in parts] + [(f"{n}-{e}:{v}-{r}.{a}", (n, e, v, r, a)) for n, e, v, r, a in parts]
    assert [tuple(x) for x in values(spark, [(c,) for c, _ in full], version.parse_nevra)] == [w for _, w in full]
    files = [(f"dir/{n}-{v}-{r}.{a}.rpm", (n, None, v, r, a)) for n, _, v, r, a in parts] + [(f"{n}-{v}-{r}.{a}.rpm:{e}", (n, e, v, r, a)) for n, e, v, r, a in parts] + [("word", ("word", None, None, None, None))]
    assert [tuple(x) for x in values(spark, [(c,) for c, _ in files], version.split_filename)] == [w for _, w in files]


def test_paths(spark):
    """Random paths against plain Python."""
    rng = random.Random(4)
    every = ["".join(rng.choice(["/", "etc", "bin", "a", "/usr/lib/sendmail", "//"]) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    assert values(spark, [(p,) for p in every], paths.is_primary) == [p.startswith("/etc/") or p == "/usr/lib/sendmail" or "bin/" in p for p in every]
    assert values(spark, [(p,) for p in [*every, ""]], paths.with_slash) == [p.rstrip("/") + "/" for p in every] + ["./"]
    for n in (0, 1, 2, 5):

        def cut(p, n=n):
            *dirs, name = [x for x in p.split("/")]
            return "/".join([d for d in dirs if d][n:] + [name])

        whole = [p for p in every if "//" not in p and not p.startswith("/")]
        assert values(spark, [(p,) for p in whole], lambda c, n=n: paths.cut_dirs(c, n)) == [cut(p) if n else p for p in whole]


def test_arch_lists():
    assert merge.expand_arch(["arm"]) == ["arm", "noarch"] and merge.expand_arch(["ppc64"], multilib=True) == ["noarch", "ppc", "ppc64"]
    assert "armv7l" in merge.expand_arch(["arm"], expand=True) and "i686" in merge.expand_arch(["x86_64"], multilib=True) and "amd64" not in merge.expand_arch(["x86_64"], multilib=True)


def test_libc_order(spark):
    """From the lowest to the highest; each beats those before it, ties go to the first."""
    names = ["libc.so.6", "libc.so.6(GLIBC_2", "libc.so.6()(64bit)", "libc.so.6(GLIBC_PRIVATE)(64bit)", "libc.so.6(GLIBC_2.4)", "libc.so.6(GLIBC_2.14)(64bit)"]
    for k in range(len(names)):
        for order in (names[: k + 1], names[: k + 1][::-1]):
            df = spark.createDataFrame([(1, n, p) for p, n in enumerate(order)], "pkgkey int, name string, pos int")
            assert [r.name for r in metadata.highest_libc(df).collect()] == [names[k]]


def test_requires_against_a_sequential_fold(spark):
    rng = random.Random(9)
    rows = []
    for k in range(2000):
        rows.append((rng.randrange(40), k, rng.choice(["requires", "requires", "requires", "provides"]), rng.choice(["a", "b", "/etc/x", "rpmlib(y)", "libc.so.6(A_1)", "libc.so.6()"]), rng.choice([None, "GE"]), rng.choice([None, "1"]), rng.choice(["1", None]), rng.choice([None, "2"]), rng.random() < 0.5))
    deps = spark.createDataFrame(rows, "pkgkey int, pos int, kind string, name string, flags string, epoch string, version string, release string, pre boolean")
    files = spark.createDataFrame([(k, "/etc/x") for k in range(0, 40, 2)], "pkgkey int, path string")
    full = lambda r: (f"{r[5]}:" if r[5] else "") + (r[6] or "") + (f"-{r[7]}" if r[7] else "")
    want, last = [], {}
    given = {(r[0], r[3], r[4] or "", full(r)) for r in rows if r[2] == "provides"}
    for r in rows:
        if r[2] != "requires" or r[3].startswith("rpmlib(") or (r[3] == "/etc/x" and r[0] % 2 == 0) or (r[0], r[3], r[4] or "", full(r)) in given:
            continue
        key, value = (r[0], r[3]), (r[4] or "", full(r), r[8])
        if not r[3].startswith("libc.so.6"):
            if last.get(key) == value:
                continue
            last[key] = value
        want.append(r[1])
    assert sorted(r.pos for r in metadata.clean_requires(deps, files).collect()) == sorted(want)


def test_base_default_is_the_sequential_fold(spark):
    rng = random.Random(12)
    rows = [(k, rng.randrange(3), rng.choice("abcdef"), rng.choice([None, "", "http://own"])) for k in range(80)]
    df = spark.createDataFrame(rows, "ord int, repo_id int, name string, location_base string")
    urls = {0: "u0", 1: "u1", 2: "u2"}
    for koji in (False, True):
        want, seen = {}, set()
        for o, r, n, b in sorted(rows, key=lambda r: (r[1], r[0])):
            url = None if koji and r == 0 else urls[r]
            empty = not b if n not in seen else b is None
            seen.add(n)
            want[o] = url if empty and url else b
        assert {r.ord: r.location_base for r in merge.default_base(df, urls, koji=koji).collect()} == want
    assert merge.default_base(df, urls, omit=True).collect() == df.collect()


def test_numbers_over_many_ranges(spark):
    rng = random.Random(10)
    rows = [(k, rng.randrange(50), rng.choice([None, "x", "y"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, a int, s string").repartition(7)
    place = {r.id: r.place for r in ordering.numbered(df, ["a", "id"]).collect()}
    by = sorted(rows, key=lambda r: (r[1], r[0]))
    assert place == {r[0]: k + 1 for k, r in enumerate(by)}
    run, want = 0, {}
    for k, r in enumerate(by):
        run += k == 0 or r[2] is None or r[2] != by[k - 1][2]
        want[r[0]] = run
    assert {r.id: r.run for r in ordering.changes(df, ["a", "id"], "s", "run").collect()} == want
    assert ordering.numbered(df.limit(0), ["a"]).count() == 0


def test_delta_topk_is_the_newest_of_all_pairs(spark):
    rng = random.Random(13)
    rows = [(k, rng.randrange(3), rng.choice("ab"), "x", rng.choice([None, "0", "1"]), rng.choice(["1", "1.0", "2~a", "2", "3"]), rng.choice(["1", "2"]), rng.choice([10, 30])) for k in range(150)]
    df = spark.createDataFrame(rows, "ord int, repo_id int, name string, arch string, epoch string, version string, release string, size_package int")
    targets, old = df.where("repo_id = 0"), df.where("repo_id > 0")
    for n in (1, 2, 5):
        want = metadata.newest_deltas(metadata.delta_candidates(targets, old, 30), n).select("target", "old", "dir", "place").collect()
        assert sorted(map(tuple, metadata.delta_topk(targets, old, 30, n).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("method", ["repo", "ts", "nvr", "all"])
def test_merge_is_the_sequential_fold(spark, method):
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), rng.choice("ab"), rng.choice("xy"), rng.choice([None, "", "0", "1"]), rng.choice(["1", "1.0", "01", "2~a", "2"]), rng.choice([None, "1", "1a"]), rng.randrange(4)) for k in range(120)]
    df = spark.createDataFrame(rows, "ord int, repo_id int, name string, arch string, epoch string, version string, release string, time_file int")
    keys = {r.ord: tuple(r.k) for r in df.select("ord", merge.merge_key(F.col("epoch"), F.col("version"), F.col("release")).alias("k")).collect()}
    kept: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        group = (r[2], r[3]) + ((keys[r[0]],) if method == "all" else ())
        old = kept.get(group)
        if old is None or method == "ts" and r[7] > old[7] or method == "nvr" and keys[r[0]] > keys[old[0]]:
            kept[group] = r
    assert sorted(r.ord for r in merge.merge(df, method).collect()) == sorted(r[0] for r in kept.values())


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("NULL" if pd.isna(v) else str(v) for v in row) for row in df.values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


PRIMARY = """<metadata packages="2"><package type="rpm"><name>a</name><arch>x</arch><version epoch="0" ver="1.10" rel="007"/><checksum type="sha1" pkgid="YES">id1</checksum><summary>s &amp; t</summary><description/>
<packager/><url>http://u</url><time file="5" build="99999999999"/><size package="1" installed="2" archive="3"/><location xml:base="http://b" href="a.rpm"/><format><rpm:license>MIT</rpm:license><rpm:vendor>v</rpm:vendor><rpm:group>g</rpm:group>
<rpm:buildhost>h</rpm:buildhost><rpm:sourcerpm>a.src.rpm</rpm:sourcerpm><rpm:header-range start="10" end="20"/><rpm:provides><rpm:entry name="p" flags="EQ" epoch="0" ver="1.0" rel="2"/></rpm:provides>
<rpm:requires><rpm:entry name="q" pre="1"/><rpm:entry name="r" flags="GE" ver="3" pre="0"/></rpm:requires><file>/bin/a</file><file type="dir">/etc/d</file></format></package>
<package type="rpm"><name>b</name><arch>x</arch><version epoch="0" ver="2" rel="1"/><checksum type="sha256" pkgid="YES">id2</checksum><location href="b.rpm"/><format/></package></metadata>"""


def repo(folder, *parts):
    """A repository with the given parts."""
    texts = {
        "primary": PRIMARY,
        "filelists": '<filelists><package pkgid="id1" name="a" arch="x"><file>/bin/a</file><file type="dir">/d</file></package><package pkgid="id1"><file>/again</file></package><package pkgid="zz"><file>/x</file></package></filelists>',
        "filelists-ext": '<filelists-ext><package pkgid="id1" name="a" arch="x"><checksum type="md5"/><file hash="h">/bin/ext</file></package></filelists-ext>',
        "other": '<otherdata><package pkgid="id1" name="a" arch="x"><changelog author="me" date="5">text</changelog></package></otherdata>',
        "primary_db": "", "group": "<comps/>",
    }
    (folder / "repodata").mkdir()
    for p in parts:
        (folder / f"repodata/{p}.xml").write_text(texts[p])
    records = "".join(f'<data type="{p}"><checksum type="sha256">aa</checksum><open-checksum type="md5">bb</open-checksum><location href="repodata/{p}.xml"/><timestamp>4</timestamp><size>3</size><database_version>10</database_version></data>' for p in parts)
    (folder / "repodata/repomd.xml").write_text(f'<repomd><revision>7</revision><repoid type="t">me</repoid><tags><content>c</content><repo>r</repo><distro cpeid="cpe">d</distro></tags>{records}</repomd>')
    return Repository(SPARK[0], str(folder))


SPARK = []


@pytest.fixture(autouse=True)
def session(spark):
    SPARK[:] = [spark]


def test_manifest_and_packages(spark, tmp_path):
    from parcelyard.sources.repository import read_tags

    r = repo(tmp_path, "primary", "filelists", "other", "primary_db", "group")
    a, b = sorted(r.packages().collect(), key=lambda p: p.name)
    assert (a.version, a.release, a.checksum_type, a.summary, a.time_build, a.header_end, a.srpm, a.location_base, a.license) == ("1.10", "007", "sha1", "s & t", 99999999999, 20, "a.src.rpm", "http://b", "MIT")
    assert [tuple(d) for d in a.requires] == [("q", None, None, None, None, True), ("r", "GE", None, "3", None, False)] and [tuple(d) for d in a.provides] == [("p", "EQ", "0", "1.0", "2", False)]
    assert [(f.path, f.type) for f in a.files] == [("/bin/a", ""), ("/d", "dir"), ("/again", "")] and [tuple(c) for c in a.changelogs] == [("me", 5, "text")]
    assert (b.time_build, b.requires, b.files, b.changelogs) == (0, [], None, None)
    assert [[f.path for f in p.files or []] for p in sorted(r.packages(append=False).collect(), key=lambda p: p.name)] == [["/bin/a", "/d"], []]
    row = r.records.where("type = 'primary'").first()
    assert (row.revision, row.checksum_open, row.checksum_open_type, row.database_version, row.timestamp) == ("7", "bb", "md5", 10, 4)
    assert {tuple(t) for t in read_tags(spark, str(tmp_path)).collect()} == {("content", None, "c"), ("repo", None, "r"), ("distro", "cpe", "d"), ("repoid", "t", "me")}
    assert set(r.additional()) == {"group"} and "primary_db" not in r.located(ignore_tables=True) and r.package_count() == 2
    assert [p.name for p in r.packages(only_files=spark.createDataFrame([("b.rpm",)], "file string")).collect()] == ["b"]
    assert [p.name for p in r.packages().orderBy("ord").toLocalIterator()] == ["a", "b"]


def test_absent_parts(spark, tmp_path):
    a, b = sorted(repo(tmp_path, "primary").packages().collect(), key=lambda p: p.name)
    assert ([f.path for f in a.files], a.changelogs, b.files) == (["/bin/a", "/etc/d"], None, [])
    only = Repository.from_files(spark, str(tmp_path / "repodata/primary.xml"))
    assert only.packages(only_primary=True).count() == 2 and only.advisories() is None
    with pytest.raises(FileNotFoundError):
        Repository(spark, str(tmp_path), {"other": "x"}).primary()


def test_extended_lists_go_first(tmp_path):
    a = repo(tmp_path, "primary", "filelists", "filelists-ext").packages().where("name = 'a'").first()
    assert [tuple(f) for f in a.files] == [("/bin/ext", "", "h")]


def test_keyed_load(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / str(k)).mkdir()
    one, two = (repo(tmp_path / str(k), "primary", "filelists") for k in (1, 2))
    assert {r.key for r in one.load("filename").collect()} == {"a.rpm", "b.rpm"}
    assert load_all([one, two]).count() == 2
    text = (tmp_path / "2/repodata/primary.xml").read_text()
    (tmp_path / "2/repodata/primary.xml").write_text(text.replace('size package="1"', 'size package="9"'))
    assert [r["name"] for r in load_all([one, two]).collect()] == ["b"] and load_all([one, two], "name", "keepfirst").where("size_package = 1").count() == 1


def test_upsert_stream(spark, tmp_path):
    from parcelyard.streaming.incremental import read_packages, read_table, upsert_stream

    schema, table = "href string, mtime bigint, v string", str(tmp_path / "table")
    want = {}
    for batch in range(4):
        rows = [(f"f{(7 * k + batch) % 40}", batch, f"{batch}-{k}") for k in range(25)] + [("tie", 1, f"t{batch}")]
        for h, m, v in rows:
            want[h] = max(want.get(h, (-1, "")), (m, v))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = upsert_stream(read_packages(spark, str(tmp_path / "in"), schema), table, str(tmp_path / "state"), ["href"], "mtime", parts=4)
        q.awaitTermination()
        assert {r.href: (r.mtime, r.v) for r in read_table(spark, table, schema, 4).collect()} == want
    assert all(len(list(p.glob("v=*"))) <= 2 for p in (tmp_path / "table").glob("part=*")) and not list((tmp_path / "table").glob("_staged*"))
    assert read_table(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_finished_parts(spark, tmp_path):
    """A package comes out when all three parts of it have arrived."""
    from parcelyard.streaming.incremental import finished

    def stream(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    from datetime import datetime

    now = datetime(2024, 1, 1)
    a = stream("a", "pkgid string, name string, ts timestamp", [("1", "x", now), ("2", "y", now)])
    b = stream("b", "pkgid string, files array<string>, ts timestamp", [("1", ["f"], now), ("2", ["g"], now)])
    c = stream("c", "pkgid string, changelogs array<string>, ts timestamp", [("1", ["t"], now)])
    q = finished(a, b, c).writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["name"], r.files) for r in spark.sql("SELECT * FROM done").collect()] == [("x", ["f"])]
