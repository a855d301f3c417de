"""Caches, projects and legacy library files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_DAYS = 30
#: How settings end that never leave the machine.
SECRET_ENDING = "api_key"
#: The newest project version that is understood.
PROJECT_VERSION = 2


def live_cache(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """The last value of each key that has not expired (key, value, ts); of equal times the greatest value."""
    fresh = cache.where(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return fresh.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("_l")).select("key", "_l.value", "_l.ts")


def stable_id(*parts: Column) -> Column:
    """A reproducible id in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def write_project(df: DataFrame, path: str) -> None:
    """Projects as JSON lines without secrets, with their version."""
    df.drop(*[c for c in df.columns if c.endswith(SECRET_ENDING)]).withColumn("version", F.lit(PROJECT_VERSION)).write.mode("overwrite").json(path)


def read_project(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Projects from JSON lines; one of a newer version is an error of the query, not silently misread."""
    rows = spark.read.schema(f"{schema}, version int").json(path)
    newer = F.raise_error(F.lit("the project was written by a newer version"))
    return rows.withColumn("version", F.when(F.col("version") > PROJECT_VERSION, newer).otherwise(F.coalesce("version", F.lit(1))))


LIBRARY_COLUMNS = ("key", "pmid", "doi", "title", "authors_json", "year", "journal", "journal_abbrev", "volume", "issue", "pages", "abstract", "source", "added_at", "updated_at", "pmcid")


def library_files(files: DataFrame, table: str = "references_library") -> DataFrame:
    """Rows of legacy single-file libraries (path, content from ``binaryFile``); a missing column is blank, broken JSON no authors.

    A file is opened by the task that holds it, in memory where the database library allows it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(bytes(content))
                    have = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
                    cols = ", ".join(f"CAST({c} AS TEXT) AS {c}" if c in have else f"'' AS {c}" for c in LIBRARY_COLUMNS)
                    got = pd.read_sql_query(f"SELECT {cols} FROM {table}", con) if have else None
                except sqlite3.DatabaseError:
                    got = None
                finally:
                    con.close()
                if got is not None and len(got):
                    got.insert(0, "path", path)
                    yield got

    raw = files.select("path", "content").mapInPandas(rows, "path string, " + ", ".join(f"{c} string" for c in LIBRARY_COLUMNS))
    people = F.coalesce(F.from_json("authors_json", "array<struct<last_name:string,first_name:string,initials:string>>"), F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>"))
    return raw.withColumn("authors", people).withColumn("year", F.coalesce(F.col("year").try_cast("int"), F.lit(0))).drop("authors_json")


