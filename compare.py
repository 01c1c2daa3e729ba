"""Time the relational queries and their SQL side by side: python compare.py [rounds]. Prints a Markdown table of medians.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores, of DuckDB as well; each query runs once before it is timed.
"""

import os
import sys
import tempfile
import time
from statistics import median

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")  # the recursive SQL of q08 takes minutes on more
cpus = os.environ.get("BENCH_CPUS", "4")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def timed(run) -> float:
    began = time.time()
    run()
    return time.time() - began


def main(rounds: int) -> None:
    from pyspark.sql import SparkSession

    from lectern.plans import catalogue, flows  # noqa: F401

    with tempfile.TemporaryDirectory(prefix="lectern-compare-") as shared:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", cpus).config("spark.checkpoint.dir", shared)
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        duck = duckdb.connect(config={"threads": int(cpus)})
        for name in TABLES.split():
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        print("| query | Spark s | DuckDB s |\n|---|---|---|")
        for name, query in catalogue.QUERIES.items():
            if name not in catalogue.SQL:
                continue
            ours = lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
            theirs = lambda: duck.execute(catalogue.SQL[name]).fetchall()  # noqa: B023, E731
            pair = []
            for run in (ours, theirs):
                run()
                pair.append(median(timed(run) for _ in range(rounds)))
            print(f"| {name} | {pair[0]:.2f} | {pair[1]:.2f} |", flush=True)
        spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 5)
