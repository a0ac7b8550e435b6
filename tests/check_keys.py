"""Compare registered queries with DuckDB: python tests/check_keys.py <folder> [key ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


def main() -> None:
    folder, keys = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as entry

    plans, oracles = entry.queries(), entry.oracle_sql()
    connection = connect(folder)
    bad = 0
    for key in keys or list(plans):
        start = time.time()
        try:
            frame = plans[key](spark, folder)
            if key in oracles:
                problems = compare(frame, connection, oracles[key])
            else:
                rows = frame.count()
                problems = [] if rows else ["EMPTY"]
        except Exception as error:  # noqa: BLE001
            problems = [f"ERROR {type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{key:32s} {time.time() - start:6.1f}s {'sql ' if key in oracles else 'rows'} {problems or 'ok'}", flush=True)
    print("with problems:", bad)


if __name__ == "__main__":
    main()
