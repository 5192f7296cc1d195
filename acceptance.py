"""The 1 GiB sort, join and aggregate of wide rows: generates the four tables, times them here and in DuckDB.

    python acceptance.py [rows] [folder]     4096 rows a table, of 64 KiB each, are 1 GiB
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.engine import Engine

TABLES = ("sort_input", "join_left", "join_right", "aggregate_input")
QUERIES = {
    "sort": "SELECT id, sort_key, payload FROM sort_input ORDER BY sort_key, id LIMIT 16",
    "join": "SELECT l.id AS id, l.payload AS left_payload, r.payload AS right_payload FROM join_left l JOIN join_right r ON l.id = r.id ORDER BY id",
    "aggregate": "SELECT group_key, payload, COUNT(*) AS row_count, SUM(amount) AS amount_sum FROM aggregate_input GROUP BY group_key, payload ORDER BY group_key",
}


def make(spark: SparkSession, index: int, rows: int) -> DataFrame:
    """Row i of table number index: the payload repeats with i mod 64, ids of join_right start 16 before the end."""
    i = F.col("id")
    payload = F.repeat(F.sha2(F.concat(F.lit(f"{index}:"), (i % 64).cast("string")), 256), 1024)
    key = i + (rows - 16 if TABLES[index] == "join_right" else 0)
    return spark.range(0, rows, numPartitions=8).select(key.alias("id"), ((F.lit(rows) - i) * 17 + index).alias("sort_key"), (i % 64).alias("group_key"), (i % 997).alias("amount"), payload.alias("payload"))


def measure(spark: SparkSession, rows: int, folder: str) -> dict:
    """Seconds of the first and second run here and of one in DuckDB, for each query; the tables are made if they are not there."""
    plain = {"compression": "none", "parquet.enable.dictionary": "false"}
    for k, name in enumerate(TABLES):
        if not Path(folder, f"{name}.parquet", "_SUCCESS").exists():
            make(spark, k, rows).write.mode("overwrite").options(**plain).parquet(f"{folder}/{name}.parquet")
    engine = Engine(spark).register_folder(folder, list(TABLES))
    out = {}
    for name, sql in QUERIES.items():
        took = []
        for _ in range(2):
            began = time.perf_counter()
            got = engine.sql(sql).collect()
            took.append(time.perf_counter() - began)
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        began = time.perf_counter()
        want = con.execute(sql).fetchall()
        duck = time.perf_counter() - began
        out[name] = {"first": round(took[0], 3), "second": round(took[1], 3), "duckdb": round(duck, 3), "rows": len(got), "equal": [tuple(r) for r in got] == want}
    return out


def main(rows: int = 4096, folder: str = "") -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as own:
        print(json.dumps(measure(spark, rows, folder or own)))


if __name__ == "__main__":
    main(*[int(a) if i == 0 else a for i, a in enumerate(sys.argv[1:])])
