"""python -m concord audit|baseline|sample|evaluate|validate|extract"""

from __future__ import annotations

import argparse
import json
import sys

from .operators import scoring, validate
from .plans import runs
from .sources import sinks, tables


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="concord")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("audit", "baseline", "sample"):
        sub.add_parser(name).add_argument("--root", required=True)
    p = sub.add_parser("evaluate")
    p.add_argument("--truth", required=True)
    p.add_argument("--predictions", required=True)
    p = sub.add_parser("validate")
    p.add_argument("-m", "--matching", required=True)
    p.add_argument("-c", "--candidate")
    p.add_argument("-t", "--test-dir", required=True)
    p.add_argument("--check-ids", action="store_true")
    p = sub.add_parser("extract")
    p.add_argument("--archive", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--prefix", default="")
    p.add_argument("--manifest")
    a = parser.parse_args(argv)
    if a.command == "extract":
        manifest = tables.extract(a.archive, a.target, a.prefix)
        if a.manifest:
            sinks.write_json({"archive": a.archive, "members": manifest}, a.manifest)
        print(json.dumps(manifest, indent=2))
        return 0
    spark = tables.session()
    if a.command == "evaluate":
        result = scoring.evaluate(tables.read_results(spark, a.truth), tables.read_results(spark, a.predictions))
    elif a.command == "validate":
        found = tables.rows(validate.validate(spark, a.matching, a.candidate, a.test_dir, a.check_ids))
        for f in found:
            print(f"{f['severity'].upper()}: {f['file']}: {f['rule']}: {f['offenders']} {', '.join(f['examples'])}")
        counts = validate.summary(spark, a.matching)
        if counts:
            print(", ".join(f"{n} {k.replace('_', '-')}" for k, n in counts.items()))
        failed = any(f["severity"] != "warning" for f in found)
        print("FAIL" if failed else "PASS")
        return int(failed)
    else:
        result = {"audit": runs.audit, "baseline": runs.baseline, "sample": runs.positive_sample}[a.command](spark, a.root)
    print(json.dumps(result, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
