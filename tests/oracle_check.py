"""Run queries against their DuckDB SQL and report differences.

    python tests/oracle_check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def compare(df, con, sql: str) -> list[str]:
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"] + [str(x) for x in (got[:2], want[:2])]
    bad = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    if bad:
        return [f"{len(bad)} of {len(got)} rows differ; columns {cols}"] + [
            f"  got  {g}\n  want {w}" for g, w in bad[:3]]
    return []


def main(argv):
    from loanwatch.session import configure
    from loanwatch.plans import load_queries
    from pyspark.sql import SparkSession
    sf, want = (argv[0] if argv else "0.001"), argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = configure(SparkSession.builder.master("local[8]")
                      .config("spark.ui.enabled", "false")
                      .config("spark.sql.shuffle.partitions", "8")
                      .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in load_queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                rows = df.collect()
                print(f"rows {name:40s} {time.time()-t:6.1f}s n={len(rows)}", flush=True)
                continue
            problems = compare(df, con, q.sql)
            n = con.execute(f"select count(*) from ({q.sql})").fetchall()[0][0]
            if n == 0:
                problems = problems or ["no rows"]
        except Exception as e:  # report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:40s} {time.time()-t:6.1f}s n={n}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
