"""``python tests/check_catalog.py [sf_dir] [key ...]``: run registered queries against their SQL."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from affinis.session import local_session  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402


def main(argv: list[str]) -> int:
    path = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    keys = argv[1:] or list(queries)
    spark, con = local_session(8), duck(path)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, path)
            if key in oracles:
                problems = compare(df, con, oracles[key])
                rows = ""
            else:
                problems, rows = [], f"{df.count()} rows, no SQL"
        except Exception as e:
            problems, rows = [f"{type(e).__name__}: {str(e)[:600]}"], ""
            if "-v" in argv:
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {key} {time.time() - start:.1f}s {rows} {' ; '.join(problems)[:900]}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if a != "-v"]))
