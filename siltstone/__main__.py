"""python -m siltstone build --pages TABLE --path FOLDER | chat --chunks TABLE [--question TEXT] [--session NAME]"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("siltstone", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="pages to chunks with their lexical index")
    build.add_argument("--pages", required=True, help="Parquet table with doc_id, page_num, content")
    build.add_argument("--path", required=True)
    chat = commands.add_parser("chat", help="answer a question, or all lines of the input")
    chat.add_argument("--chunks", required=True, help="Parquet table of chunks with row_id")
    chat.add_argument("--question")
    chat.add_argument("--session", default="default")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from siltstone.runtime import session

    spark = session("siltstone")
    if args.command == "build":
        from siltstone.sources import writers

        print(writers.build(spark.read.parquet(args.pages), args.path).count(), "chunks")
        return 0
    from siltstone.control.agent import Agent
    from siltstone.control.toolbox import Toolbox

    agent = Agent(Toolbox(spark.read.parquet(args.chunks)).handlers())
    for question in [args.question] if args.question else (line.strip() for line in sys.stdin):
        if question:
            print(agent.chat(question, args.session))
    return 0


if __name__ == "__main__":
    sys.exit(main())
