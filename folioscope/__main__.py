"""Commands over an index folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from folioscope.engine import Engine
from folioscope.sources.config import clamp, load_golden, load_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    p.add_argument("--index", required=True, help="folder of the index, shared by the cluster")
    p.add_argument("--config", help="settings in TOML")
    p.add_argument("--profile")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "prune"):
        c.add_parser(name).add_argument("vault")
    for name in ("search", "ask"):
        s = c.add_parser(name)
        s.add_argument("question")
        s.add_argument("--top-k")
        s.add_argument("--category")
        s.add_argument("--format", action="append", default=[])
        s.add_argument("--tag", action="append", default=[])
    c.add_parser("eval").add_argument("golden")
    for name in ("show", "dismiss", "resolve"):
        c.add_parser(name, help="a contradiction").add_argument("id", type=int)
    d = c.add_parser("distil", help="a note from all notes with a tag or in a category")
    d.add_argument("--tag")
    d.add_argument("--category")
    m = c.add_parser("migrate", help="embed with another model")
    m.add_argument("model")
    m.add_argument("--batch", type=int)
    m.add_argument("--abort", action="store_true")
    c.add_parser("mirror", help="read claims and judge pairs").add_argument("--full", action="store_true")
    c.add_parser("listed", help="contradictions").add_argument("--status", default="open")
    c.add_parser("backup").add_argument("stamp")
    c.add_parser("serve").add_argument("--port", type=int, default=8765)
    c.add_parser("tools", help="a tool server on standard input and output")
    c.add_parser("check-decay")
    c.add_parser("preflight")
    for name in ("connect", "dedupe", "graph", "stale", "tags", "categories", "status", "sensitive", "maintain"):
        c.add_parser(name)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    text = open(a.config, encoding="utf-8").read() if a.config else ""
    e = Engine(spark, a.index, load_settings(text, a.profile))
    if a.command in ("scan", "prune"):
        getattr(e, a.command)(a.vault).show(100, truncate=False)
    elif a.command in ("search", "ask"):
        q = spark.createDataFrame([(1, a.question)], "query_id long, question string")
        getattr(e, a.command)(q, clamp(a.top_k), category=a.category, formats=a.format, tags=a.tag).show(50, truncate=120)
    elif a.command == "eval":
        e.evaluate(load_golden(spark, open(a.golden, encoding="utf-8").read())).show(100, truncate=80)
    elif a.command == "maintain":
        print(e.maintain())
    elif a.command == "mirror":
        print(e.mirror(full=a.full))
    elif a.command == "listed":
        e.listed(a.status).show(100, truncate=80)
    elif a.command == "show":
        e.show(a.id).show(truncate=False, vertical=True)
    elif a.command in ("dismiss", "resolve"):
        e.settle(spark.createDataFrame([(a.id,)], "id long"), {"dismiss": "dismissed", "resolve": "resolved"}[a.command])
    elif a.command == "distil":
        for row in e.distil(a.tag, a.category).collect():
            print(row.markdown)
    elif a.command == "migrate":
        print(e.abort_migration(a.model) if a.abort else e.migrate(a.model, e.provider, a.batch))
    elif a.command == "backup":
        print(e.backup(a.stamp))
    elif a.command == "check-decay":
        e.check_decay().show(100, truncate=120)
    elif a.command == "serve":
        from folioscope.serve import Service, server

        server(Service(e), port=a.port).serve_forever()
    elif a.command == "tools":
        from folioscope.serve import Service, ToolServer

        ToolServer(Service(e)).lines(sys.stdin, sys.stdout)
    else:
        out = {"dedupe": e.duplicates}.get(a.command, getattr(e, a.command, None))()
        for t in out if isinstance(out, tuple) else (out,):
            t.show(100, truncate=120)


if __name__ == "__main__":
    main()
