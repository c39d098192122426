"""Package-shaped views over the benchmark tables, the same in Spark and in the checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ARCH = "CASE p_type WHEN 'STANDARD' THEN 'x86_64' WHEN 'ECONOMY' THEN 'i386' WHEN 'MEDIUM' THEN 'noarch' WHEN 'PROMO' THEN 'i686' WHEN 'LARGE' THEN 'sparc64v' ELSE 'aarch64' END"
#: Spark SQL and DuckDB both read these; sha256 is the only name that differs.
PKG = """SELECT p_partkey AS ord, CAST(p_partkey % 3 AS INT) AS repo_id, {sha256} AS pkgid, p_name AS name, {arch} AS arch,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 2 AS {text}) END AS epoch,
  concat(CAST(p_size AS {text}), '.', CAST(p_partkey % 11 AS {text})) AS version,
  concat(CAST(p_partkey % 7 AS {text}), 'a') AS release,
  p_partkey * 37 % 1000 AS time_file, CAST(round(p_retailprice * 100) AS BIGINT) AS size_package,
  concat(p_brand, '/', CAST(p_partkey % 1500 AS {text}), '.rpm') AS href,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat(replace(p_name, ' ', '_'), '-', CAST(p_size AS {text}), '.', CAST(p_partkey % 11 AS {text}), '-', CAST(p_partkey % 7 AS {text}), 'a.src.rpm') END AS srpm,
  CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'http://repo/a/' END AS location_base FROM part"""
#: All texts and numbers of a package.
FULL = """SELECT p_partkey AS ord, {sha256} AS pkgid, CASE p_partkey % 3 WHEN 0 THEN 'sha256' WHEN 1 THEN 'sha1' ELSE 'md5' END AS checksum_type, p_name AS name, {arch} AS arch,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 2 AS {text}) END AS epoch, concat(CAST(p_size AS {text}), '.', CAST(p_partkey % 11 AS {text}), '0') AS version, concat('00', CAST(p_partkey % 7 AS {text})) AS release,
  concat(p_brand, ' & "', p_name, '"') AS summary, concat('<', p_type, '> ', p_name, ' ') AS description, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS packager, concat('http://x/?a=1&b=', p_brand) AS url,
  p_partkey * 37 % 1000 AS time_file, p_partkey * 5000000000 AS time_build, CAST(round(p_retailprice * 100) AS BIGINT) AS size_package, p_partkey * 7 AS size_installed, CAST(0 AS BIGINT) AS size_archive,
  concat(p_brand, '/', CAST(p_partkey AS {text}), '.rpm') AS href, CASE WHEN p_partkey % 4 = 1 THEN 'http://repo/a/' WHEN p_partkey % 4 = 2 THEN '/srv/repo' END AS location_base,
  concat('MIT', CAST(p_partkey % 3 AS {text})) AS license, CASE WHEN p_partkey % 2 = 0 THEN 'v' END AS vendor, 'Applications/System' AS "group", concat('host', CAST(p_partkey % 9 AS {text})) AS buildhost,
  CASE WHEN p_partkey % 13 <> 0 THEN concat(replace(p_name, ' ', '_'), '-', CAST(p_size AS {text}), '-1.src.rpm') END AS srpm, p_partkey * 3 AS header_start, p_partkey * 3 + 4096 AS header_end FROM part"""
#: libc requires of every form, versions with epochs and releases, names that repeat, are empty or are own files.
DEP = """SELECT l_partkey AS pkgkey, l_orderkey * 10 + l_linenumber AS pos,
  CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'requires' WHEN 1 THEN 'provides' WHEN 2 THEN 'conflicts' WHEN 3 THEN 'obsoletes'
    WHEN 4 THEN 'suggests' WHEN 5 THEN 'enhances' WHEN 6 THEN 'recommends' ELSE 'supplements' END AS kind,
  CASE WHEN l_suppkey % 9 = 0 THEN concat('rpmlib(', CAST(l_suppkey AS {text}), ')')
    WHEN l_suppkey % 9 = 1 THEN CASE l_orderkey % 6 WHEN 0 THEN 'libc.so.6' WHEN 1 THEN 'libc.so.6()(64bit)' WHEN 2 THEN 'libc.so.6(GLIBC_PRIVATE)(64bit)' WHEN 3 THEN 'libc.so.6(GLIBC_2'
      ELSE concat('libc.so.6(GLIBC_2.', CAST(l_orderkey % 40 AS {text}), ')(64bit)') END
    WHEN l_suppkey % 9 = 2 THEN concat('/etc/s', CAST(l_suppkey % 3 AS {text})) ELSE concat('s', CAST(l_suppkey % 3 AS {text})) END AS name,
  CASE l_returnflag WHEN 'A' THEN 'GE' WHEN 'N' THEN 'EQ' END AS flags,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_orderkey % 3 = 0 THEN '1' WHEN l_orderkey % 3 = 1 THEN '0' END AS epoch,
  CASE WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS INT) % 2 AS {text}) END AS version, CASE WHEN l_returnflag <> 'R' AND l_linenumber % 2 = 0 THEN '1' END AS release, l_linestatus = 'O' AS pre FROM lineitem"""
FILE = """SELECT CAST(floor(page_id / 20) AS BIGINT) AS pkgkey, page_id AS pos, CASE WHEN page_id % 4 = 0 THEN concat('/etc', path) WHEN page_id % 4 = 1 THEN replace(path, '/en/', '/bin/') ELSE path END AS path,
  CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'dir' ELSE 'ghost' END AS type
  FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[a-z]*', '/'), '[?#].*$', '') AS path FROM pages) t"""
LOG = """SELECT conv_id AS pkgkey, turn AS pos, role AS author, 1334664000 - CAST(floor(turn / 3) AS BIGINT) AS date, text AS changelog FROM conversations"""
OLD = """SELECT concat('./', source, '/', CAST(doc_id AS {text}), '.rpm') AS href, doc_id % 97 AS mtime, n_chars AS size, CASE WHEN doc_id % 11 = 0 THEN 'md5' ELSE 'sha256' END AS checksum_type FROM documents WHERE doc_id % 10 < 7"""
NEW = """SELECT doc_id, concat(source, '/', CAST(doc_id AS {text}), '.rpm') AS href, doc_id % 97 AS mtime, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size, 'sha256' AS checksum_type FROM documents WHERE doc_id % 10 > 2"""
META = """SELECT event_type AS kind, event_id, concat(CAST(event_id AS {text}), '-', event_type, '.xml') AS href, {epoch} AS mtime FROM events"""
RECORD = """SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'primary' WHEN 1 THEN 'filelists' WHEN 2 THEN 'other' WHEN 3 THEN 'primary_db' WHEN 4 THEN 'filelists_db' WHEN 5 THEN 'other_db' WHEN 6 THEN 'primary_zck' WHEN 7 THEN 'filelists_zck' WHEN 8 THEN 'other_zck' WHEN 9 THEN 'updateinfo' WHEN 10 THEN 'group' ELSE 'modules' END AS type,
  concat('repodata/', CAST(event_id AS {text}), '-', event_type, '.xml.gz') AS href, {md5} AS checksum, CAST(user_id AS BIGINT) AS size, CASE WHEN event_id % 7 = 0 THEN 'http://other' END AS base, 'md5' AS checksum_type, event_id * 3 AS size_open, CASE WHEN event_id % 12 BETWEEN 3 AND 5 THEN CAST(10 AS BIGINT) END AS database_version FROM events"""
ADV = """SELECT o_orderkey AS id, o_orderpriority AS severity, CAST(CAST(o_orderdate AS DATE) AS {text}) AS issued, l_linenumber AS pos, CAST(l_partkey AS {text}) AS package FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

SPARK = {"arch": ARCH, "text": "STRING", "sha256": "sha2(CAST(p_partkey AS STRING), 256)", "md5": "md5(CAST(event_id AS STRING))", "epoch": "unix_seconds(CAST(ts AS TIMESTAMP))"}
DUCK = {"arch": ARCH, "text": "VARCHAR", "sha256": "sha256(CAST(p_partkey AS VARCHAR))", "md5": "md5(CAST(event_id AS VARCHAR))", "epoch": "CAST(floor(epoch(ts)) AS BIGINT)"}
VIEWS = {"pkg": PKG, "full_pkg": FULL, "dep": DEP, "file": FILE, "chlog": LOG, "old_files": OLD, "new_files": NEW, "mfile": META, "record": RECORD, "adv": ADV}
_TABLES = {"pkg": ["part"], "full_pkg": ["part"], "dep": ["lineitem"], "file": ["pages"], "chlog": ["conversations"], "old_files": ["documents"], "new_files": ["documents"], "mfile": ["events"], "record": ["events"], "adv": ["orders", "lineitem"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    text = VIEWS[name].format(**SPARK).replace('"group"', "`group`")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def duck(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**DUCK)})" for n in names)
