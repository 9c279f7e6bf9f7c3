"""Runs registered queries against their SQL: python tests/check.py [folder] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import connect, duck_rows, spark_rows  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from askwell.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracle, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            columns, rows = spark_rows(fn(spark, sf_dir))
            took, verdict = time.time() - start, "rows only"
            if name in oracle:
                want_columns, want = duck_rows(con, oracle[name])
                if columns != want_columns:
                    verdict = f"COLUMNS {columns} / {want_columns}"
                elif rows != want:
                    off = [(a, b) for a, b in zip(rows, want) if a != b][:2]
                    verdict = f"DIFFER {len(rows)} / {len(want)} {str(off)[:1500]}"
                else:
                    verdict = "equal"
        except Exception as exc:
            took, rows, verdict = time.time() - start, [], f"FAILED {type(exc).__name__}: {str(exc)[:1200]}"
        if verdict not in ("equal", "rows only"):
            bad.append(name)
        print(f"{name:26s} {len(rows):7d} rows {took:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
