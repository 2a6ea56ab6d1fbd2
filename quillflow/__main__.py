"""The command line: imports files by a configuration.

    python -m quillflow import --input FILES --output FOLDER [--config FILE] [--format properties|json|xml]
    python -m quillflow check --config FILE

import writes a text and a metadata file for each document and prints a line of status for each; it ends with 1 if any
document has an error. check only reads the configuration. A configuration that can't be read ends either with 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.config import ConfigError, load_pipeline, load_xml
from .plans.flow import Pipeline
from .sources.parsers import ParserFactory


def configured(path: str | None) -> Pipeline:
    """The pipeline of a JSON or XML file; without one, documents are only parsed."""
    if path is None:
        return Pipeline(parsers=ParserFactory())
    source = Path(path).read_text(encoding="utf-8")
    return load_xml(source) if source.lstrip().startswith("<") else load_pipeline(json.loads(source))


def main(arguments: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="quillflow", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("import", help="import files")
    run.add_argument("-i", "--input", nargs="+", required=True, help="files, folders or patterns")
    run.add_argument("-o", "--output", required=True, help="folder for the results")
    run.add_argument("-t", "--content-type", help="the files' type, else it is detected")
    run.add_argument("-e", "--encoding", help="the files' character set, else it is detected")
    run.add_argument("-f", "--format", choices=("properties", "json", "xml"), default="properties", help="of metadata files")
    check = commands.add_parser("check", help="check a configuration")
    for command in (run, check):
        command.add_argument("-c", "--config", required=command is check, help="configuration in JSON or XML")
    args = top.parse_args(arguments)
    try:
        pipeline = configured(args.config)
    except (ConfigError, OSError, ValueError, SyntaxError) as e:
        print(f"{args.config}: {e}", file=sys.stderr)
        return 2
    if args.command == "check":
        print(f"{args.config}: {len(pipeline.pre)} steps before parsing, {len(pipeline.post)} after it")
        return 0

    from pyspark.sql import SparkSession, functions as F

    from .sources import files, sinks
    from .stored import written

    spark = SparkSession.builder.appName("quillflow").getOrCreate()
    docs = files.files(spark, args.input)
    if args.content_type:
        docs = docs.withColumn("content_type", F.lit(args.content_type))
    if args.encoding:
        docs = docs.withColumn("content_encoding", F.lit(args.encoding))
    out = written(pipeline.run(docs), "imported")
    sinks.write_files(out, args.output, args.format)
    for row in sinks.status_lines(out).orderBy("reference").toLocalIterator():
        print(row.status, row.reference, row.detail or "", sep="\t")
    return int(not out.filter(F.col("error").isNotNull()).isEmpty())


if __name__ == "__main__":
    sys.exit(main())
