"""``python -m tracewell``: scan transcripts, and report on what is stored and installed."""

from __future__ import annotations

import argparse

from .operators.rank import Scope, folder_exists, resolve_scope
from .plans import reports, scan, shapes
from .plans.packs import read_pack
from .plans.rescan import rescan
from .plans.session import build_session
from .sources import stores
from .sources.transcripts import FORMATS, read_events


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracewell")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, told: str, *places: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=told)
        for place in places:
            v.add_argument(place)
        v.add_argument("--json", action="store_true")
        return v

    def of_sessions(v: argparse.ArgumentParser) -> None:
        v.add_argument("--format", choices=sorted(FORMATS), default="claude")
        v.add_argument("--pack", default="default", help=f"{', '.join(scan.PACKS)}, a file or a folder")
        v.add_argument("--min-messages", type=int, default=4)
        v.add_argument("--no-dedupe", action="store_true")

    s = verb("scan", "rank sessions", "path")
    of_sessions(s)
    s.add_argument("--rank-by", choices=["raw", "rate"], default="raw")
    s.add_argument("--limit", type=int)
    s.add_argument("--cache", help="a folder for what has been scored, so that only changed files are scored again")
    s.add_argument("--project", help="only sessions of this working directory")
    f = verb("feedback", "what installed skills have changed", "skills", "path")
    of_sessions(f)
    p = verb("proposals", "list what was proposed", "store")
    p.add_argument("--skills", help="the folder of installed skills")
    verb("show", "a proposal by the beginning of its id", "store", "id")
    c = verb("consolidate", "group proposals that are alike", "store")
    c.add_argument("--least", type=float, default=reports.CLUSTER_THRESHOLD)
    k = verb("prune", "delete all but the newest proposals", "store")
    k.add_argument("--keep", type=int, required=True)
    return parser


def _print(rows, columns: dict[str, int], as_json: bool, shape=None) -> None:
    """A text table, or a line of JSON for each row: in its verb's shape, where it has one."""
    if as_json:
        for line in (rows.toJSON() if shape is None else shape(rows).toDF("json")).toLocalIterator():
            print(line if shape is None else line.json)
    else:
        print(reports.listed(rows, columns))


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = build_session()
    if a.verb in ("scan", "feedback"):
        pack = scan.PACKS[a.pack] if a.pack in scan.PACKS else read_pack(a.pack)
    if a.verb == "scan":
        scope = resolve_scope(a.path, a.project, exists=folder_exists(spark)) if a.project else Scope()
        options = scan.Options(pack, scope, a.min_messages, a.rank_by, not a.no_dedupe, a.limit)
        if a.cache:  # all is scored or known, so a limit cuts the ranking
            rows = scan.select_sessions(rescan(spark, scope.base or a.path, a.cache, a.format, pack)[0], options, a.limit)
        else:
            rows = scan.scan(read_events(spark, scope.base or a.path, a.format), options)
        if a.json:
            for row in shapes.sessions(rows).toLocalIterator():
                print(row.json)
        else:
            print(scan.render(rows, scope=scope))
    elif a.verb == "feedback":
        rows = reports.feedback(spark, a.skills, a.path, a.format, scan.Options(pack, min_messages=a.min_messages, dedupe=not a.no_dedupe))
        _print(rows, {"skill": 30, "sessions": 8, "used": 8, "usage_rate": 10, "friction_with": 13, "friction_without": 16, "verdict": 12}, a.json, shapes.feedback)
    elif a.verb == "proposals":
        _print(reports.proposals(spark, a.store, a.skills, whole=a.json), {"id": 25, "name": 30, "kind": 5, "outcome": 10, "composite": 9, "sources": 7, "installed": 9}, a.json, shapes.proposals)
    elif a.verb == "show":
        print(reports.show(spark, a.store, a.id, as_json=a.json))
    elif a.verb == "consolidate":
        _print(reports.consolidation(spark, a.store, a.least), {"cluster": 25, "size": 5, "outcome": 10, "merged_from": 50}, a.json)
    elif a.verb == "prune":
        print(f"{stores.prune_proposals(spark, a.store, a.keep).count()} kept")


if __name__ == "__main__":
    main()
