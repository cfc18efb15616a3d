"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare the values.

python tools/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barlake.plans.catalog import REGISTRY  # noqa: E402
from barlake.session import local_session  # noqa: E402


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cell = lambda v: None if v is None or v != v else v
    return sorted((tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session()
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    bad = 0
    for name in names:
        query = REGISTRY[name]
        start = time.time()
        try:
            ours = query.build(spark, folder).toPandas()
            took = time.time() - start
            if query.check is None:
                print(f"rows  {name}: {len(ours)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            theirs = db.execute(query.check).df()
            a, b = rows_of(ours), rows_of(theirs)
            same = sorted(ours.columns) == sorted(theirs.columns) and a == b
            types = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns if c in theirs and ours[c].dtype != theirs[c].dtype}
            types = {c: t for c, t in types.items() if not ("object" in t and "str" in t)}
            print(f"{'same ' if same else 'DIFF '} {name}: {len(a)} rows, {took:.1f}s and {time.time() - start:.1f}s {types or ''}", flush=True)
            if not same or not a:
                bad += 1
                print("   columns", sorted(ours.columns), sorted(theirs.columns), len(a), len(b))
                shown = 0
                for x, y in zip(a, b):
                    if x != y and shown < 3:
                        print("   ours  ", x)
                        print("   theirs", y)
                        shown += 1
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
