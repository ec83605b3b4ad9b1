"""Compare registered queries with their SQL on the given tables: python tests/oracle_check.py [pattern] [sf] [-v]."""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(table):
    """Column names and sorted rows of an Arrow table, cells as plain hashable Python values."""
    import math

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v
        if isinstance(v, dict):
            return tuple((k, cell(x)) for k, x in sorted(v.items()))
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    cols = sorted(table.column_names)
    data = [[cell(v) for v in table.column(c).to_pylist()] for c in cols]
    return cols, sorted(zip(*data), key=lambda r: tuple((x is None, str(x)) for x in r)) if cols else []


def compare(got, want) -> list[str]:
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    if gc != wc:
        return [f"columns {gc} != {wc}"]
    out = []
    for c in gc:
        a, b = str(got.schema.field(c).type), str(want.schema.field(c).type)
        norm = lambda t: t.split("[")[0].split("<")[0].replace("large_", "")
        if norm(a) != norm(b):
            out.append(f"type {c}: {a} != {b}")
    if len(g) != len(w):
        out.append(f"rows {len(g)} != {len(w)}")
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(g)} rows differ, columns {gc}")
        out += [f"   spark {a}\n      sql   {b}" for a, b in bad[:3]]
    return out


def main() -> int:
    from tests.conftest import make_session

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    pattern = re.compile(args[0] if args else ".")
    sf_dir = f"/root/testdata/sf{args[1] if len(args) > 1 else '0.01'}"
    import __spark_entry__ as entry

    spark, con = make_session(), duck(sf_dir)
    oracles, failed, n = entry.oracle_sql(), [], 0
    for name, fn in entry.queries().items():
        if not pattern.search(name):
            continue
        n += 1
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toArrow()
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name}: {got.num_rows} rows {t1 - t0:.1f}s  (no SQL)", flush=True)
            if "-v" in sys.argv:
                print(got.slice(0, 5).to_pandas().to_string())
            continue
        try:
            want = con.execute(oracles[name]).to_arrow_table()
            problems = compare(got, want)
        except Exception as e:  # noqa: BLE001
            problems = [f"SQL: {str(e)[:1200]}"]
        nulls = "" if not len(got) else " null:" + ",".join(c for c in got.column_names if got.column(c).null_count == len(got))
        print(f"{'FAIL' if problems else 'ok  '} {name}: {got.num_rows} rows spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
              f"{nulls if nulls != ' null:' else ''}", flush=True)
        if problems:
            failed.append(name)
            print("   " + "\n   ".join(problems), flush=True)
        elif "-v" in sys.argv:
            print(got.slice(0, 5).to_pandas().to_string())
    print(f"{n - len(failed)} of {n} fine; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    raise SystemExit(main())
