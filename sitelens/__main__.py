"""Command line: catalogue queries over a folder of tables, raw files, and a corpus from its files to searches.

    python -m sitelens list
    python -m sitelens run QUERY... --data DIR [--out DIR]
    python -m sitelens inventory ROOT
    python -m sitelens build ROOT --register FILE.jsonl --corpus DIR
    python -m sitelens index --corpus DIR --index DIR
    python -m sitelens search TEXT... --corpus DIR --index DIR [--top N]

``build`` reads PDF and DOCX files that a register names (document_id, source_path, source_class, retrieval_eligible, duplicate_of) and
ends with 1 where a document failed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens import catalog
from sitelens.plans import corpus_build, corpus_index
from sitelens.session import get_session
from sitelens.sources import files, versions


REGISTER = "document_id string, source_path string, source_class string, retrieval_eligible boolean, duplicate_of string"


def _printed(rows: DataFrame) -> int:
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join(str(v) for v in row))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sitelens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("names", nargs="+")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    commands.add_parser("inventory").add_argument("root")
    build = commands.add_parser("build")
    build.add_argument("root")
    build.add_argument("--register", required=True)
    build.add_argument("--corpus", required=True)
    index = commands.add_parser("index")
    search = commands.add_parser("search")
    search.add_argument("texts", nargs="+")
    search.add_argument("--top", type=int, default=10)
    for command in (index, search):
        command.add_argument("--corpus", required=True)
        command.add_argument("--index", required=True)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(catalog.queries()))
        return 0
    spark = get_session()
    if args.command == "inventory":
        return _printed(files.inventory(spark, args.root))
    if args.command == "build":
        documents = files.read_jsonl(spark, args.register, REGISTER)
        corpus_build.build_corpus(spark, args.root, documents, args.corpus)
        report = versions.read(spark, args.corpus, "report")
        _printed(report.orderBy("extraction_status"))
        return int(not report.where(F.col("extraction_status") == corpus_build.FAILED).isEmpty())
    if args.command == "index":
        print(corpus_index.index_corpus(spark, args.corpus, args.index))
        return 0
    if args.command == "search":
        return _printed(corpus_index.search_index(spark, args.corpus, args.index, args.texts, args.top))
    for name in args.names:
        df = catalog.queries()[name](spark, args.data)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        else:
            df.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
