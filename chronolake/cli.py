"""Command line: audit, readiness, acceptance, queries."""

from __future__ import annotations

import argparse
import json
import sys


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronolake")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, words in (("query", ("name", "folder")), ("acceptance", ("folder",)), ("readiness", ("config",)), ("run-champion", ("folder",))):
        p = sub.add_parser(name)
        for w in words:
            p.add_argument(w)
    a = parser.parse_args(args)
    if a.command == "acceptance":
        from .plans.serving import acceptance

        report = acceptance(a.folder)
        print(json.dumps(report.checks, indent=1))
        return int(not report.ready)
    from .session import session

    spark = session()
    if a.command == "query":
        from . import catalogue

        catalogue.queries()[a.name](spark, a.folder).show(50, truncate=False)
        return 0
    if a.command == "run-champion":
        from .plans.runs import run_synthetic

        out = run_synthetic(spark, a.folder)
        print(json.dumps({k: out[k] for k in ("champions", "seconds")}, indent=1))
        return 0
    from pyspark.sql import functions as F

    from .functions.scalars import utc_time
    from .operators.quality import audit
    from .plans.serving import readiness
    from .sources.readers import load_rows, mapped

    with open(a.config) as f:
        config = json.load(f)
    rows = mapped(load_rows(spark, config["path"], config.get("format")), config["columns"], config.get("constants"))
    times = {c: utc_time(F.col(c)) for c in ("event_time", "known_at") if dict(rows.dtypes).get(c) == "string"}
    obs = rows.withColumns(times).withColumns({"value": F.col("value").try_cast("double"), "revision_sequence": F.col("revision_sequence").try_cast("int")})
    report = readiness(audit(obs, F.lit(config["issue_time"]).cast("timestamp"), config.get("horizons", [1, 24])), config, config.get("expected", []))
    print(json.dumps(report.checks, indent=1))
    return int(not report.ready)


if __name__ == "__main__":
    sys.exit(main())
