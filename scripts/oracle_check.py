"""Run registered queries against their oracle SQL (local check).

usage: python scripts/oracle_check.py [sf_dir] [name-prefix ...]
"""
import importlib
import json
import os
import sys
import time

sys.path.insert(0, ".")
from loanbook.session import get_spark  # noqa: E402
from loanbook.testing import compare  # noqa: E402
from loanbook.plans import catalog  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    for m in catalog.MODULES:
        try:
            importlib.import_module(f"loanbook.plans.{m}")
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise
    spark = get_spark("local[8]", shuffle_partitions=8)
    bad = 0
    for name, fn in sorted(catalog.QUERIES.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in catalog.ORACLE:
                r = compare(df, catalog.ORACLE[name], sf,
                            None if os.environ.get("EXACT") else 6)
            else:
                r = {"ok": None, "rows_spark": df.count()}
        except Exception as e:  # report and continue
            r = {"ok": False, "error": repr(e)[:600]}
        r["sec"] = round(time.time() - t, 2)
        if r.get("ok") is False:
            bad += 1
        print(name, json.dumps(r, default=str)[:1500], flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
