"""python -m lodestrata [--folder F] COMMAND ...: one JSON object to the output, exit code 0 where the call's status is a good one."""

from __future__ import annotations

import argparse
import json
import sys

#: Commands: the call, its positional arguments, its options with their types, and the statuses that exit with 0.
COMMANDS = {
    "catalog create": ("catalog.create", (), {}, ("created", "current")),
    "catalog status": ("catalog.status", (), {}, ("current", "missing", "stale")),
    "catalog wipe": ("catalog.wipe_cache", (), {}, ("ok",)),
    "health": ("health", (), {}, ("ok",)),
    "sources scan": ("inventory.scan", ("path",), {"max_files": int, "max_bytes": int, "max_depth": int}, ("ok",)),
    "docs parse": ("inventory.parse", ("path",), {"limit": int, "max_file_size": int}, ("ok", "partial")),
    "index build": ("index.build", (), {"kind": str, "force": bool}, ("ok",)),
    "search text": ("search.text", ("query",), {"limit": int, "budget": str}, ("ok", "partial")),
    "search semantic": ("search.semantic", ("query",), {"limit": int}, ("ok", "partial")),
    "search hybrid": ("search.hybrid", ("query",), {"limit": int, "candidate_limit": int, "rrf_k": int}, ("ok", "partial")),
    "entity add": ("entities.add", ("name",), {"kind": str, "status": str}, ("ok",)),
    "entity list": ("entities.list", (), {"kind": str, "status": str, "limit": int}, ("ok",)),
    "entity show": ("entities.show", ("entity_id",), {}, ("ok",)),
    "entity alias": ("entities.alias", ("entity_id", "text"), {"kind": str}, ("ok",)),
    "entity link": ("entities.link", ("entity_id", "ref"), {"role": str, "status": str}, ("ok",)),
    "entity review": ("entities.review", ("target_id", "decision"), {}, ("ok",)),
    "entity find": ("entities.find", ("entity_id", "query"), {"limit": int, "propose": bool, "role": str}, ("ok", "partial")),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata")
    top.add_argument("--folder", default="lodestrata-data", help="where the tables are; driver and executors share it")
    groups = top.add_subparsers(dest="group", required=True)
    made: dict[str, argparse._SubParsersAction] = {}
    for name, (call, positional, options, good) in COMMANDS.items():
        group, _, action = name.partition(" ")
        if action and group not in made:
            made[group] = groups.add_parser(group).add_subparsers(dest="action", required=True)
        p = made[group].add_parser(action) if action else groups.add_parser(group)
        for x in positional:
            p.add_argument(x)
        for x, kind in options.items():
            flag = f"--{x.replace('_', '-')}"
            p.add_argument(flag, action="store_true", default=None) if kind is bool else p.add_argument(flag, type=kind)
        p.set_defaults(call=call, good=good, names=(*positional, *options))
    return top


def main(args: list[str] | None = None, engine=None) -> int:
    a = parser().parse_args(args)
    if engine is None:
        from lodestrata.api import Engine
        from lodestrata.session import session

        engine = Engine(session(master="local[*]"), a.folder)
    target = engine
    for part in a.call.split("."):
        target = getattr(target, part)
    try:
        out = target(**{n: getattr(a, n) for n in a.names if getattr(a, n) is not None})
    except TypeError as e:  # an argument that the call needs is missing
        out = {"status": "failed", "error_kind": "invalid_arguments", "message": str(e)}
    print(json.dumps(out, default=str))
    return 0 if out["status"] in a.good else 1


if __name__ == "__main__":
    sys.exit(main())
