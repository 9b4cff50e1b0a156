"""The jobs for spark-submit.

    python -m fixhound.jobs fix-report --tables DIR --out PATH
    python -m fixhound.jobs index --index DIR --files DIR
    python -m fixhound.jobs search --sheet DIR --files DIR --repos DIR --commits DIR --details DIR
"""

from __future__ import annotations

import argparse

from fixhound.operators.patterns import captured_patterns
from fixhound.plans import fix_report as report
from fixhound.plans.matching import Inputs
from fixhound.schemas import (
    FILE_COMMITS,
    FILES,
    FIX_TABLES,
    HEADS,
    PATTERN_REPLIES,
    REPOS,
    SCANNER_ANSWERS,
    SEEDS,
    SIMILAR_ANSWERS,
)
from fixhound.session import get_session
from fixhound.sources.pair_index import PairIndex
from fixhound.sources.snapshots import SheetStore
from fixhound.sources.tables import read_sheet, read_tables, register_views, write_report
from fixhound.streaming.incremental import run_batch


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="fixhound")
    parser.add_argument("--checkpoint", help="folder that driver and executors share")
    jobs = parser.add_subparsers(dest="job", required=True)
    fix = jobs.add_parser("fix-report", help="join the five tables and write the report")
    fix.add_argument("--tables", required=True, help="folder with the five tables")
    fix.add_argument("--out", required=True)
    fix.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    fix.add_argument("--sql", help="run this query text instead of the built-in report")
    find = jobs.add_parser("search", help="match the pending rows of a stored sheet")
    find.add_argument("--sheet", required=True, help="folder of the stored sheet")
    find.add_argument("--seeds", help="first sheet, if none is stored yet (parquet)")
    for table in ("files", "repos", "commits", "details"):
        find.add_argument(f"--{table}", required=True)
    find.add_argument("--index", help="folder of the stored index of the files")
    find.add_argument("--replies", help="captured pattern lists (row_index, reply)")
    find.add_argument("--scanner-answers", help="captured answers (repo_name, answer)")
    find.add_argument("--similar-answers", help="captured answers (file_id, answer)")
    find.add_argument("--heads", help="branch heads of failed lookups (file_id, head_sha)")
    find.add_argument("--quarantine", help="folder for rows with an error")
    find.add_argument("--saves", type=int, default=1, help="parts after which the sheet is saved")
    grow = jobs.add_parser("index", help="add files as a version to a stored index")
    grow.add_argument("--index", required=True)
    grow.add_argument("--files", required=True)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    spark = get_session()
    if args.checkpoint:
        spark.sparkContext.setCheckpointDir(args.checkpoint)
    if args.job == "fix-report":
        tables = read_tables(spark, args.tables, FIX_TABLES)
        if args.sql:
            register_views(tables)
            rows = report.run_sql_file(spark, args.sql)
        else:
            rows = report.fix_report(tables)
        write_report(rows, args.out, args.format)
        return
    if args.job == "index":
        version = PairIndex(spark, args.index).append(spark.read.schema(FILES).parquet(args.files))
        print(f"version {version}")
        return
    store = SheetStore(spark, args.sheet)
    if args.seeds and store.version() == 0:
        store.save(read_sheet(spark, args.seeds, SEEDS))
    read = lambda path, schema: spark.read.schema(schema).parquet(path) if path else None
    replies = read(args.replies, PATTERN_REPLIES)
    inputs = Inputs(
        store.read(),
        read(args.files, FILES),
        read(args.repos, REPOS),
        read(args.commits, FILE_COMMITS),
        index=PairIndex(spark, args.index) if args.index else None,
        given_patterns=captured_patterns(replies) if replies else None,
        scanner_answers=read(args.scanner_answers, SCANNER_ANSWERS),
        similar_answers=read(args.similar_answers, SIMILAR_ANSWERS),
        heads=read(args.heads, HEADS),
    )
    run_batch(spark, args.sheet, args.details, inputs, args.quarantine, args.saves).show()


if __name__ == "__main__":
    main()
