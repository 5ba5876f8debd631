"""Run analyses and write their results.

    python -m chainlens.cli --data-dir DIR --out OUT [--format csv|parquet|json] [name ...]
    python -m chainlens.cli --sf-dir /root/testdata/sf0.1 --out OUT [name ...]

``--data-dir`` reads the domain files (see ``chainlens.plans.domain``);
``--sf-dir`` runs the registered test-table queries.  Each result is written
as ``OUT/<name>`` by a distributed sink — nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

if __package__ in (None, ""):  # run as a script (spark-submit chainlens/cli.py): import the package
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chainlens.sources import sinks  # noqa: E402


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="chainlens")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--data-dir")
    src.add_argument("--sf-dir")
    ap.add_argument("--out")
    ap.add_argument("--show", metavar="ROWS", help="print the first ROWS rows of each result, or with `all` every row")
    ap.add_argument("--format", choices=["csv", "parquet", "json"], default="csv")
    ap.add_argument("--json-arrays", action="store_true",
                    help="documents are one JSON array per file (each read by one task), not JSON Lines")
    ap.add_argument("--json-lines", action="store_true", help="documents are JSON Lines (the default)")
    ap.add_argument("--publish", metavar="RUN_ID", help="verify each result and switch to it under this run id")
    ap.add_argument("--master", default=None)
    ap.add_argument("--dashboard", action="store_true",
                    help="write the six dashboard datasets from one pass over each source")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    if not (a.out or a.show):
        ap.error("--out or --show is needed")

    from chainlens.session import get_session

    spark = get_session(a.master, app="chainlens-cli")
    if a.data_dir:
        from chainlens.plans import domain

        d = domain.load(spark, a.data_dir, json_lines=not a.json_arrays)
        run = {k: (lambda f=f: f(d)) for k, f in domain.DOMAIN_QUERIES.items()}
        bundle_inputs = lambda: (d.orders, d.inspections, d.events)
    else:
        from chainlens.plans.catalog import QUERIES, _t
        from chainlens.operators import events
        from chainlens.sources import testdata as td

        run = {k: (lambda f=f: f(spark, a.sf_dir)) for k, f in QUERIES.items()}

        def bundle_inputs():
            t = _t(spark, a.sf_dir)
            return (td.order_totals(t, "Delivered", dims=("customer",)), td.inspection_totals(t, dims=("product",)),
                    events.flatten_events(td.machine_events(t, "cycle_complete")))
    if a.dashboard:
        from chainlens.operators.dashboard import dashboard_bundle

        built = dashboard_bundle(*bundle_inputs())
        run = {k: (lambda v=v: v) for k, v in built.items()}
    writer = {"csv": sinks.write_csv, "parquet": sinks.write_parquet, "json": sinks.write_json}[a.format]
    if a.publish:
        from chainlens.sources.published import publish

        writer = lambda df, path: publish(df, path, a.publish, a.format)
    for name in (a.names or list(run)):
        t0 = time.perf_counter()
        result = run[name]()
        if a.show:
            print(f"== {name}")
            sinks.preview(result, None if a.show == "all" else int(a.show))
        if a.out:
            writer(result, f"{a.out.rstrip('/')}/{name}")
        print(f"{name}\t{time.perf_counter() - t0:.2f}s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
