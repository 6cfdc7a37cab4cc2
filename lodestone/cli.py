"""Command line: ingest, update, ask, sources, rebuild; a bare question asks with the web."""

from __future__ import annotations

import argparse
import sys

from .plans import engine, index
from .session import build_session

ROOT = "knowledge_base"
COMMANDS = ("ingest", "update", "ask", "sources", "rebuild")


def main(argv: list[str] | None = None, spark=None, get=engine.fetch) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv:
        print(f"usage: lodestone QUESTION | {' | '.join(COMMANDS)} ...")
        return 1
    bare = argv[0] not in COMMANDS and argv[0] not in ("-h", "--help")
    if bare:
        argv = ["ask", *argv]
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        sub = commands.add_parser(name)
        if name == "ask":
            sub.add_argument("question")
            sub.add_argument("--limit", type=int, default=5)
            sub.add_argument("--no-web", dest="web", action="store_false")
            sub.add_argument("--web", dest="web", action="store_true", default=bare)
        if name in ("ingest", "update", "rebuild"):
            sub.add_argument("raw_dir", nargs="?", default=f"{ROOT}/raw")
            sub.add_argument("--processed", default=f"{ROOT}/processed")
        sub.add_argument("--index", "--db", dest="index", default=f"{ROOT}/index")
    args = parser.parse_args(argv)
    spark = spark or build_session()
    listed = lambda rows: [r.asDict() for r in rows(spark, args.index).toLocalIterator()]  # noqa: E731  # printed for a person, part by part
    if args.command in ("ingest", "update"):
        result = (index.build if args.command == "ingest" else index.update)(spark, args.raw_dir, args.index, args.processed) | {"duplicate_files": listed(index.duplicate_rows)}
    elif args.command == "rebuild":
        result = index.rebuild(spark, args.raw_dir, args.index, args.processed, ROOT) | {"duplicate_files": listed(index.duplicate_rows)}
    elif args.command == "sources":
        result = index.sources(spark, args.index)
        if result["indexed"]:
            result |= {"sources": listed(index.source_rows), "duplicate_files": listed(index.duplicate_rows)}
    else:
        result = engine.ask(spark, args.index, args.question, args.limit, args.web, get)
    print(index.dump(result))
    return 0


if __name__ == "__main__":
    sys.exit(main())
