"""python tests/run_oracles.py SF_DIR [NAME...]: compares queries with their oracles and prints the times."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from cinderloom.session import get_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark, con = get_session(cpus=8), connect(sf_dir)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            why = compare(spark, con, sf_dir, fn, sql[name]) if name in sql else f"rows {fn(spark, sf_dir).count()}, no oracle"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__} {str(e)[:1500]}"
        bad += bool(why) and "no oracle" not in why
        print(f"{name}: {why or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
