"""Command line: python -m sparkgrove --path FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from sparkgrove.config import Settings
from sparkgrove.engine import Engine
from sparkgrove.evaluator import Evaluator, questions
from sparkgrove.operators.grounding import OverlapJudge
from sparkgrove.session import get_session
from sparkgrove.sources.web import load_sources


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkgrove", description="A document collection: add, ingest, ask.")
    top.add_argument("--path", default="sparkgrove-data", help="folder of the corpus, the cache and the indexes")
    top.add_argument("--env", default=".env", help="file of SPARKGROVE_<FIELD>=value lines")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("add", help="read files, folders and addresses into the corpus")
    one.add_argument("sources", nargs="+")
    one.add_argument("--replace", action="store_true", help="overwrite documents of the same id")
    commands.add_parser("ingest", help="cut, embed and index the corpus")
    commands.add_parser("remove", help="take documents out of the corpus").add_argument("ids", nargs="+")
    one = commands.add_parser("clear", help="delete the corpus, the indexes, or both")
    one.add_argument("--corpus", action="store_true")
    one.add_argument("--index", action="store_true")
    commands.add_parser("list", help="the documents of the corpus")
    commands.add_parser("status", help="what there is, and whether the index agrees with the corpus")
    for name, what in (("ask", "answer questions"), ("inspect", "what search returns for questions"), ("compare", "exact and hashed neighbours")):
        commands.add_parser(name, help=what).add_argument("questions", nargs="+")
    one = commands.add_parser("eval", help="run a file of labelled questions")
    one.add_argument("file")
    one.add_argument("--fresh", action="store_true", help="forget kept answers")
    one.add_argument("--faithfulness", action="store_true", help="judge the answers too")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = get_session()
    engine = Engine(spark, args.path, Settings.from_env(dotenv=args.env))
    show = lambda df: df.show(1000, truncate=False, vertical=True)
    asked = spark.createDataFrame(list(enumerate(getattr(args, "questions", []))), "query_id bigint, question string")
    match args.command:
        case "add":
            found, failed = load_sources(spark, args.sources)
            show(engine.corpus.add(found, args.replace).select("doc_id", "title", "kind"))
            show(failed)
        case "ingest":
            print(engine.ingest())
        case "remove":
            print(engine.corpus.remove(*args.ids))
        case "clear":
            print(engine.clear(args.corpus, args.index))
        case "list":
            show(engine.corpus.list())
        case "status":
            show(engine.status())
            if engine.exists():
                show(engine.sync())
        case "ask":
            show(engine.ask(asked))
        case "inspect":
            show(engine.inspect(asked))
        case "compare":
            rows, seconds = engine.compare(asked)
            show(rows)
            print(seconds)
        case "eval":
            detail, summary = Evaluator(engine, judge=OverlapJudge() if args.faithfulness else None).run(questions(spark, args.file), args.fresh)
            for frame in (detail, summary):
                show(frame)


if __name__ == "__main__":
    main()
