"""Run registered queries and compare each with its SQL in DuckDB.

usage: python tools/check_queries.py [folder] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def kind(series: pd.Series) -> str:
    if pd.api.types.is_bool_dtype(series):
        return "bool"
    if pd.api.types.is_integer_dtype(series):
        return "int"
    return "float" if pd.api.types.is_float_dtype(series) else "text"


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            missing = v is None or (not isinstance(v, (list, dict)) and pd.isna(v))
            cells.append("" if missing else repr(float(v)) if isinstance(v, (int, float, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [
        (c, kind(got[c]), kind(want[c])) for c in got.columns
        if kind(got[c]) != kind(want[c]) and not (got[c].isna().any() or want[c].isna().any())
    ]
    if kinds:
        return f"types {kinds}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> int:
    from featureforge.catalog import load
    from featureforge.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    registry, spark, con = load(), local_session("check"), connect(folder)
    failed = 0
    for name, run in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            taken = time.time() - start
            if name in registry.ORACLES:
                verdict = compare(got, con.execute(registry.ORACLES[name]).df()) or "equal"
            else:
                verdict = "rows only" if len(got) else "no rows"
        except Exception as error:  # report and go on with the next query
            got, taken, verdict = None, time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        ok = verdict in ("equal", "rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {taken:6.2f}s {0 if got is None else len(got):7d} rows  {verdict[:900]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
