"""Binary headers: files built byte by byte are read back."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from parcelyard.operators import headers as meaning
from parcelyard.sources import headers


def header(entries):
    """A header of (tag, value): texts, lists of texts, and lists of numbers ("h" for 16 bits)."""
    index, store = b"", b""
    for tag, kind, value in entries:
        if kind == "s":
            data, number, count = b"".join(v + b"\0" for v in value), 8, len(value)
        else:
            width = {"h": 2, "i": 4}[kind]
            store += b"\0" * (-len(store) % width)
            data, number, count = struct.pack(f">{len(value)}{'H' if kind == 'h' else 'I'}", *value), {"h": 3, "i": 4}[kind], len(value)
        index += struct.pack(">IIII", tag, number, len(store), count)
        store += data
    return b"\x8e\xad\xe8\x01" + b"\0" * 4 + struct.pack(">II", len(entries), len(store)) + index + store


def package(entries):
    signature = header([(1000, "s", [b"abc"])])
    lead = b"\xed\xab\xee\xdb" + b"\0" * 92
    return lead + signature + b"\0" * (-(len(signature) - 16) % 8) + header(entries) + b"payload"


ENTRIES = [
    (1000, "s", [b"foo"]), (1001, "s", [b"1.10"]), (1002, "s", [b"007"]), (1003, "i", [3]), (1004, "s", ["Zusammenfassung ü".encode()]), (1011, "s", ["Händler".encode("latin-1")]), (1022, "s", [b"x86_64"]),
    (1006, "i", [1334664000]), (1049, "s", [b"bar", b"baz", b"bad"]), (1050, "s", [b"1:2-3", b"", b"x:1"]), (1048, "i", [8 | 1 << 9, 0, 8]),
    (1117, "s", [b"foo", b"bin", b"log"]), (1118, "s", [b"/usr/bin/", b"/usr/", b"/var/"]), (1116, "i", [0, 1, 2]), (1030, "h", [0o100755, 0o040755, 0o100644]), (1037, "i", [0, 0, 1 << 6]),
    (1080, "i", [20, 10]), (1081, "s", [b"Me <m@e>  ", b"You"]), (1082, "s", [b"- new", b"- old"]),
]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/foo.rpm").write_bytes(package(ENTRIES))
    (tmp_path / "src.rpm").write_bytes(package([(1000, "s", [b"only"]), (1022, "s", [b"i386"]), (1106, "i", [1])]))
    (tmp_path / "junk.rpm").write_bytes(b"no package")
    (tmp_path / "empty.rpm").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(package(ENTRIES))
    return tmp_path


def test_parse(spark, folder):
    rows = {r["name"]: r for r in headers.parse(headers.list_files(spark, str(folder))).collect()}
    assert set(rows) == {"foo", "only"}
    foo, only = rows["foo"], rows["only"]
    assert (foo.epoch, foo.version, foo.release, foo.arch, foo.summary, foo.vendor, foo.time_build) == ("3", "1.10", "007", "x86_64", "Zusammenfassung ü", "Händler", 1334664000)
    assert foo.pkgid == hashlib.sha256(package(ENTRIES)).hexdigest()
    assert [tuple(d) for d in foo.requires] == [("bar", "EQ", "1", "2", "3", True), ("baz", None, None, None, None, False)]
    assert [tuple(f) for f in foo.files] == [("/usr/bin/foo", ""), ("/usr/bin", "dir"), ("/var/log", "ghost")]
    assert [tuple(c) for c in foo.changelogs] == [("Me <m@e>", 20, "- new"), ("You", 10, "- old")]
    assert (only.arch, only.epoch, only.requires, only.files, only.changelogs) == ("src", "0", [], [], [])
    data = package(ENTRIES)
    assert data[foo.header_start : foo.header_start + 4] == b"\x8e\xad\xe8\x01" and data[foo.header_end :] == b"payload"


def test_junk_has_no_range(spark, folder):
    files = headers.list_files(spark, str(folder))
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("f"), headers.header_range(F.col("content")).alias("r")).collect()
    assert {r.f: r.r.start is None for r in found} == {"foo.rpm": False, "src.rpm": False, "junk.rpm": True}


def test_meaning(spark):
    df = spark.createDataFrame([("requires", 1 << 19), ("oldsuggests", 1 << 27), ("oldsuggests", 0), ("oldenhances", 1 << 27), ("oldenhances", 8), ("requires", 1 << 6)], "kind string, sense bigint")
    got = [tuple(r) for r in df.select(meaning.weak_kind(F.col("kind"), F.col("sense")), meaning.sense_pre(F.col("sense"))).collect()]
    assert got == [("recommends", False), ("recommends", False), ("suggests", False), ("supplements", False), ("enhances", False), ("requires", True)]
