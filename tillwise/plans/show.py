"""Print the formatted physical plan of registered queries.

    python -m tillwise.plans.show [sf_dir] [query ...]

Useful to check pushdown (``PushedFilters``/``ReadSchema``), exchanges and
join strategies.  Operators that checkpoint or iterate run those steps while
the plan is being built.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> None:
    from tillwise import build_session, registry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or [n for n in registry.QUERIES if not n.startswith("stream_")]
    spark = build_session("local[8]", app_name="tillwise-plans", shuffle_partitions=8)
    for name in names:
        print(f"===== {name}")
        registry.run(spark, sf_dir, name).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
