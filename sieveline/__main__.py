"""python -m sieveline index FOLDER INDEX | search PATTERN (--folder F | --index I): the
engine from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions.regexes import InvalidRegex
from .operators import present, search
from .request import SearchRequest
from .sources import corpus, index


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="sieveline")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("index")
    build.add_argument("folder")
    build.add_argument("index")
    build.add_argument("--vacuum", action="store_true", help="delete older generations")
    ask = commands.add_parser("search")
    ask.add_argument("pattern")
    ask.add_argument("--folder")
    ask.add_argument("--index")
    for name in ("path", "glob"):
        ask.add_argument(f"--{name}")
    for name in ("ignore-case", "literal", "multiline", "hidden", "no-ignore", "json", "grouped"):
        ask.add_argument(f"--{name}", action="store_true")
    ask.add_argument("--context", type=int, default=0)
    ask.add_argument("--limit", type=int, default=100, help="0 or less: all lines")
    return top.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("sieveline").getOrCreate()
    if args.command == "index":
        built = index.write(corpus.folder_files(spark, args.folder), args.index)
        gone = index.vacuum(spark, args.index) if args.vacuum else []
        print(json.dumps({"generation": built.generation, "files": built.files.count(), "removed": gone}))
        return 0
    request = SearchRequest(
        args.pattern, args.path, args.glob, args.ignore_case, args.literal, args.multiline, args.hidden, args.no_ignore, args.context, limit=args.limit if args.limit > 0 else None
    )
    own = index.open_index(spark, args.index) if args.index else None
    if own is None and not args.folder:
        print("one of --folder and --index is needed", file=sys.stderr)
        return 2
    try:
        result = search.search(request, own, None if own else corpus.folder_files(spark, args.folder))
    except InvalidRegex as why:
        print(f"invalid pattern: {why}", file=sys.stderr)
        return 2
    if args.json:
        for row in present.as_json(result.matches).toLocalIterator():
            print(row.json)
    else:
        print(present.to_grouped_text(result) if args.grouped else present.to_text(result))
    return 0 if result.totals.first().total_matches else 1


if __name__ == "__main__":
    sys.exit(main())
