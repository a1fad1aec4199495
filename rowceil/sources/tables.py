"""Readers and writers: delimited files of known layouts, Parquet, query and result files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parser import parse
from ..plans.query import Query

#: The TPC-H tables' columns.
TPCH = {
    "region": "r_regionkey int, r_name string, r_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty int, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}

#: The STATS tables' columns.
STATS = {
    "badges": "Id int, UserId int, Date timestamp",
    "comments": "Id int, PostId int, Score smallint, CreationDate timestamp, UserId int",
    "postHistory": "Id int, PostHistoryTypeId smallint, PostId int, CreationDate timestamp, UserId int",
    "postLinks": "Id int, CreationDate timestamp, PostId int, RelatedPostId int, LinkTypeId smallint",
    "posts": "Id int, PostTypeId smallint, CreationDate timestamp, Score int, ViewCount int, OwnerUserId int, AnswerCount int, CommentCount int, FavoriteCount int, LastEditorUserId int",
    "tags": "Id int, Count int, ExcerptPostId int",
    "users": "Id int, Reputation int, CreationDate timestamp, Views int, UpVotes int, DownVotes int",
    "votes": "Id int, PostId int, VoteTypeId smallint, CreationDate timestamp, UserId int, BountyAmount smallint",
}

#: The tables' columns of the film data set.
IMDB = {
    "aka_name": "id int, person_id int, name string, imdb_index string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string",
    "aka_title": "id int, movie_id int, title string, imdb_index string, kind_id int, production_year int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, note string, md5sum string",
    "cast_info": "id int, person_id int, movie_id int, person_role_id int, note string, nr_order int, role_id int",
    "char_name": "id int, name string, imdb_index string, imdb_id int, name_pcode_nf string, surname_pcode string, md5sum string",
    "comp_cast_type": "id int, kind string",
    "company_name": "id int, name string, country_code string, imdb_id int, name_pcode_nf string, name_pcode_sf string, md5sum string",
    "company_type": "id int, kind string",
    "complete_cast": "id int, movie_id int, subject_id int, status_id int",
    "info_type": "id int, info string",
    "keyword": "id int, keyword string, phonetic_code string",
    "kind_type": "id int, kind string",
    "link_type": "id int, link string",
    "movie_companies": "id int, movie_id int, company_id int, company_type_id int, note string",
    "movie_info": "id int, movie_id int, info_type_id int, info string, note string",
    "movie_info_idx": "id int, movie_id int, info_type_id int, info string, note string",
    "movie_keyword": "id int, movie_id int, keyword_id int",
    "movie_link": "id int, movie_id int, linked_movie_id int, link_type_id int",
    "name": "id int, name string, imdb_index string, imdb_id int, gender string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string",
    "person_info": "id int, person_id int, info_type_id int, info string, note string",
    "role_type": "id int, role string",
    "title": "id int, title string, imdb_index string, kind_id int, production_year int, imdb_id int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, series_years string, md5sum string",
}


def read_parquet(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_imdb(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Headerless CSV with backslash escapes, one file for each table."""
    return {n: spark.read.csv(f"{folder}/{n}.csv", schema=IMDB[n], quote='"', escape="\\", multiLine=True) for n in names or IMDB}


def read_stats(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """CSV with a header."""
    return {n: spark.read.csv(f"{folder}/{n}.csv", schema=STATS[n], header=True) for n in names or STATS}


def read_tpch(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """.tbl files: pipes between and after the fields."""
    return {n: spark.read.csv(f"{folder}/{n}.tbl", schema=TPCH[n] + ", _end string", sep="|").drop("_end") for n in names or TPCH}


def read_tpcds(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """.dat files of the tables whose columns the caller gives: pipes between and after the fields."""
    return {n: spark.read.csv(f"{folder}/{n}.dat", schema=s + ", _end string", sep="|").drop("_end") for n, s in schemas.items()}


def read_renamed_csv(spark: SparkSession, path: str, prefix: str, drop: Sequence[str] = (), numeric: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """CSV with a header: some columns dropped, some read as numbers where they are numbers, all renamed to prefix.column."""
    df = spark.read.csv(path, header=True, sep=sep).drop(*drop)
    for c in numeric:
        df = df.withColumn(c, F.expr(f"try_cast(`{c}` as double)"))
    return df.withColumnsRenamed({c: f"{prefix}.{c}" for c in df.columns})


#: How column types of SQL are named here.
TYPES = {"integer": "int", "int": "int", "serial": "int", "bigint": "bigint", "smallint": "smallint", "text": "string", "character varying": "string", "varchar": "string", "character": "string", "char": "string", "double precision": "double", "real": "float", "numeric": "double", "decimal": "double", "date": "date", "timestamp": "timestamp", "timestamp without time zone": "timestamp", "boolean": "boolean"}


def read_ddl(text: str) -> dict[str, str]:
    """The schema of each table that CREATE TABLE statements declare; constraints and defaults are left out."""
    out = {}
    for name, body in re.findall(r"create\s+table\s+(?:if\s+not\s+exists\s+)?\"?(\w+)\"?\s*\((.*?)\)\s*;", text, re.IGNORECASE | re.DOTALL):
        columns = []
        for part in re.split(r",(?![^()]*\))", body):
            m = re.match(r"\s*\"?(\w+)\"?\s+([a-z ]+?)\s*(?:\([\d, ]+\)\s*)?(?:(?:not\s+null|null|primary|unique|references|default|check)\b.*)?$", part, re.IGNORECASE | re.DOTALL)
            if m and m[1].lower() not in ("primary", "foreign", "unique", "constraint", "check"):
                columns.append(f"{m[1]} {TYPES[' '.join(m[2].lower().split())]}")
        out[name] = ", ".join(columns)
    return out


def load_ddl(spark: SparkSession, text: str, folder: str) -> dict[str, DataFrame]:
    """The tables that CREATE TABLE statements declare, from the files that COPY name FROM 'file' statements name within folder: CSV, with a header if the statement says HEADER, else with its DELIMITER."""
    schemas, out = read_ddl(text), {}
    for name, path, how in re.findall(r"(?:copy|\\copy)\s+\"?(\w+)\"?\s+from\s+'([^']+)'((?:[^;']|'[^']*')*);", text, re.IGNORECASE):
        sep = re.search(r"delimiter\s+(?:as\s+)?'(.)'", how, re.IGNORECASE)
        out[name] = spark.read.csv(f"{folder}/{path}", schema=schemas[name], sep=sep[1] if sep else ",", header="header" in how.lower(), quote='"', escape='"', multiLine=True)
    return out


def as_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file, from any store that Spark reads if a session is given."""
    return Path(path).read_text() if spark is None else "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_queries(path: str, columns: Mapping[str, tuple[str, ...]] | None = None, spark: SparkSession | None = None) -> list[Query]:
    return parse(read_text(path, spark), dict(columns or {}))


def split_statements(text: str) -> list[str]:
    return [s.strip() for s in text.split(";") if s.strip()]


def read_results(path: str, spark: SparkSession | None = None) -> list[int]:
    """The last field, behind #, of each line."""
    return [int(line.rsplit("#", 1)[-1]) for line in read_text(path, spark).splitlines() if line.strip()]


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def write_sampled(df: DataFrame, path: str, key: str, most: int) -> None:
    """Parquet of df, or of a hash sample by key of about `most` rows if it has more."""
    n = df.count()
    (df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * most / n))).write.mode("overwrite").parquet(path)
