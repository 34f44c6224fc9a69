"""Runs queries of the subpackage next to their SQL: ``run_query.py sf0.01 names...``."""

import os
import sys
import time

sys.path[:0] = [os.path.join(os.path.dirname(__file__), *up) for up in (("..", ".."), ("..",))]

from check_queries import compare, connect

from calibrel.session import build_session

if __name__ == "__main__":
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark, con = build_session(8), connect(sf_dir)
    for name in sys.argv[2:]:
        start = time.time()
        print(name, *compare(spark, con, name, sf_dir), f"{time.time() - start:.1f}s", flush=True)
