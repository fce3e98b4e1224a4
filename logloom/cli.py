"""``python -m logloom.cli convert|schema|topics FILE ...``"""

from __future__ import annotations

import argparse
import sys

from logloom.errors import LogError
from logloom.sinks.convert import POLICIES, ConvertOptions, convert, schema_of


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="write the messages of a topic")
    c.add_argument("input")
    c.add_argument("-t", "--topic", required=True)
    c.add_argument("-f", "--format", choices=list(POLICIES), default="jsonl")
    c.add_argument("-o", "--output")
    c.add_argument("--list-policy")
    c.add_argument("--list-flatten-size", type=int)
    c.add_argument("--array-policy")
    c.add_argument("--map-policy")
    c.add_argument("--fields", default="")
    c.add_argument("--metadata-prefix", default="@")
    c.add_argument("--time-ns", action="store_true")
    c.add_argument("--jsonl-explicit-null", action="store_true")
    c.add_argument("-p", "--parallel", action="store_true")
    s = sub.add_parser("schema", help="print the schema of a topic")
    s.add_argument("input")
    s.add_argument("-t", "--topic", required=True)
    s.add_argument("-o", "--output")
    t = sub.add_parser("topics", help="list the topics")
    t.add_argument("input")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        if a.command == "schema":
            text = schema_of(a.input, a.topic)
            if a.output:
                with open(a.output, "w") as f:
                    f.write(text + "\n")
            else:
                print(text)
        elif a.command == "topics":
            from logloom.sources.reader import LogReader

            for x in LogReader.default().topics(a.input, with_status=True):
                print(x.topic, x.message_count, x.schema_name, x.schema_encoding, x.message_encoding, x.channel_count, x.decodable, x.decode_error or "", sep="\t")
        else:
            o = ConvertOptions(a.format, tuple(x for x in a.fields.split(",") if x), a.list_policy, a.list_flatten_size, a.array_policy, a.map_policy, a.metadata_prefix, a.time_ns, a.jsonl_explicit_null, a.parallel)
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("logloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            spark.conf.set("spark.sql.caseSensitive", "true")  # the session is this command's own
            convert(spark, a.input, a.topic, a.output, o)
    except (LogError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
