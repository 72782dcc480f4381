"""A key-value log as a table (db, key, value, seq, op): replay, scans, databases, and a store that appends to it."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError

SCHEMA = "db string, key string, value string, seq long, op string"
DEFAULT = "default"


def replay(log: DataFrame) -> DataFrame:
    """The last write of each key (of each database, where the log names them) by seq; deleted keys are gone."""
    by = [c for c in ("db", "key") if c in log.columns]
    last = log.groupBy(*by).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op <> 'DELETE'").select(*by, "last.value")


def prefix_scan(table: DataFrame, prefix: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Keys with the prefix in order, internal keys (`__`) hidden; a page of them if limit is given."""
    out = scan_fast(table, prefix).orderBy("key")
    return out.offset(offset).limit(limit) if limit is not None else out.offset(offset) if offset else out


def scan_fast(table: DataFrame, prefix: str) -> DataFrame:
    """prefix_scan without an order."""
    return table.where(F.startswith("key", F.lit(prefix)) & ~F.startswith("key", F.lit("__")))


def database_counts(table: DataFrame) -> DataFrame:
    """Keys of each database."""
    return table.where(~F.startswith("key", F.lit("__"))).groupBy("db").agg(F.count(F.lit(1)).alias("n"))


class Store:
    """Databases of keys in a folder of Parquet files: every change is appended, the state is the log's replay.

    One writer at a time: a change takes the next number after the log's greatest. A database is there
    from its creation on, told by an internal key; `default` always is.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def log(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(SCHEMA).parquet(self.folder) if there else self.spark.createDataFrame([], SCHEMA)

    def append(self, rows: DataFrame) -> None:
        """rows (db, key, value, op), numbered after what is there; of rows with one key the last in `seq`, if given, wins."""
        start = self.log().agg(F.max("seq")).first()[0] or 0
        own = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        rows.select("db", "key", "value", (own + start + 1).cast("long").alias("seq"), "op").write.mode("append").parquet(self.folder)

    def change(self, rows: Iterable[tuple[str, str, str | None, str]]) -> None:
        rows = [(*r, k) for k, r in enumerate(rows)]
        for db in {r[0] for r in rows}:
            if db not in self.databases():
                raise ArgumentError("UnknownDatabase", db)
        self.append(self.spark.createDataFrame(rows, "db string, key string, value string, op string, seq long"))

    def put(self, key: str, value: str, db: str = DEFAULT) -> None:
        self.change([(db, key, value, "PUT")])

    def bulk_put(self, pairs: DataFrame | Iterable[tuple[str, str]], db: str = DEFAULT) -> None:
        """Many pairs (key, value) at once; a table of them is written by the executors."""
        if isinstance(pairs, DataFrame):
            self.append(pairs.select(F.lit(db).alias("db"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit("PUT").alias("op")))
        else:
            self.change([(db, k, v, "PUT") for k, v in pairs])

    def delete(self, key: str, db: str = DEFAULT) -> None:
        self.change([(db, key, None, "DELETE")])

    def state(self, db: str = DEFAULT) -> DataFrame:
        """(key, value) of a database."""
        return replay(self.log().where(F.col("db") == db)).select("key", "value")

    def get(self, key: str, db: str = DEFAULT) -> str | None:
        found = replay(self.log().where((F.col("db") == db) & (F.col("key") == key))).first()
        return found["value"] if found else None

    def scan(self, prefix: str = "", db: str = DEFAULT, offset: int = 0, limit: int | None = None) -> DataFrame:
        return prefix_scan(self.state(db), prefix, offset, limit)

    def create_database(self, db: str) -> None:
        if db in self.databases():
            raise ArgumentError("DatabaseExists", db)
        self.append(self.spark.createDataFrame([(db, "__database", "1", "PUT")], "db string, key string, value string, op string"))

    def drop_database(self, db: str) -> None:
        if db == DEFAULT or db not in self.databases():
            raise ArgumentError("UndroppableDatabase" if db == DEFAULT else "UnknownDatabase", db)
        rows = replay(self.log().where(F.col("db") == db)).select("db", "key", F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op"))
        self.append(rows)

    def databases(self) -> dict[str, int]:
        """Keys of each database; there are few databases, and their counts come to the driver."""
        there = replay(self.log().where("key = '__database'")).select("db").union(self.spark.createDataFrame([(DEFAULT,)], "db string"))
        counts = there.distinct().join(database_counts(replay(self.log())), "db", "left")
        return {r["db"]: r["n"] or 0 for r in counts.collect()}

    def snapshot(self, folder: str, db: str = DEFAULT) -> None:
        """Write a database's keys and values."""
        self.state(db).write.mode("overwrite").parquet(folder)

    def restore(self, folder: str, db: str = DEFAULT) -> None:
        """Replace a database's keys by those of a snapshot."""
        new = self.spark.read.parquet(folder)
        gone = self.state(db).where(~F.startswith("key", F.lit("__"))).join(new, "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"), F.lit("DELETE").alias("op"))
        rows = new.select("key", "value", F.lit("PUT").alias("op")).union(gone)
        self.append(rows.select(F.lit(db).alias("db"), "key", "value", "op"))

    def command(self, line: str, db: str = DEFAULT) -> tuple[str, str]:
        """A console line (put, get, delete, scan, use, create, drop, databases): (answer, database in use after it)."""
        word, _, rest = line.strip().partition(" ")
        rest = rest.strip()
        if word == "put":
            key, _, value = rest.partition(" ")
            self.put(key, value, db)
            return "ok", db
        if word == "get":
            return json.dumps(self.get(rest, db)), db
        if word == "delete":
            self.delete(rest, db)
            return "ok", db
        if word == "scan":
            return json.dumps([[r["key"], r["value"]] for r in self.scan(rest, db, limit=100).collect()]), db
        if word in ("create", "drop"):
            (self.create_database if word == "create" else self.drop_database)(rest)
            return "ok", DEFAULT if rest == db and word == "drop" else db
        if word == "use":
            if rest not in self.databases():
                raise ArgumentError("UnknownDatabase", rest)
            return "ok", rest
        if word == "databases":
            return json.dumps(self.databases(), sort_keys=True), db
        raise ArgumentError("UnknownCommand", word)
