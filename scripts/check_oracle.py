"""Run registered queries against their DuckDB oracle.

usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""
import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from almagest.plans import harness, registry  # noqa: E402
from almagest.session import local_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = harness.duck(sf)
    qs, sql = registry.queries(), registry.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        if name not in sql:
            n = qs[name](spark, sf).count()
            print(json.dumps({"q": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            continue
        try:
            r = harness.compare(spark, con, qs[name], sql[name], sf)
        except Exception as e:  # report and continue
            r = {"ok": False, "error": str(e)[:800]}
        r["q"], r["sec"] = name, round(time.time() - t0, 2)
        bad += not r["ok"]
        print(json.dumps(r, default=str))
    print("FAILED", bad)


if __name__ == "__main__":
    main()
