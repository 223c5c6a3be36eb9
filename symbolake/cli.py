"""Command line: `python -m symbolake.cli COMMAND`."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from symbolake import config, render, rpc
from symbolake.providers import provider_of
from symbolake.session import Session

STEPS = ("embed", "enrich", "flows", "guide")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symbolake", description="Code graphs on Spark")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, steps: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--index-dir")
        for flags, options in args:
            p.add_argument(*flags, **options)
        for s in STEPS if steps else ():
            p.add_argument(f"--{s}", action="store_true")
            p.add_argument(f"--no-{s}", action="store_true", dest=f"no_{s}")
        return p

    a = lambda *flags, **options: (flags, options)
    command("index", a("root"), a("--incremental", action="store_true"), a("--since"), steps=True)
    command("link", a("roots", nargs="+"), steps=True)
    command("explore", a("focus"))
    command("search", a("query", nargs="+"), a("--repo"), a("--limit", type=int, default=12), a("--format"))
    command("changed", a("root"), a("--since"))
    command("flow", a("focus"), a("--depth", type=int, default=4))
    command("thread", a("focus"), a("--depth", type=int, default=4))
    command("ripple", a("focus"), a("--depth", type=int, default=4))
    command("zoom", a("focus"))
    command("pack", a("focus"), a("--budget", type=int, default=1500))
    command("suggest", a("--about"), a("--limit", type=int, default=40))
    command("serve")
    command("find", a("query"), a("--repo"), a("--limit", type=int, default=30))
    command("repos")
    command("stats")
    command("guide", a("--repo"), a("-o", "--output"))
    command("config", a("--path", default="~/.config/symbolake/config.toml"), a("--force", action="store_true"))
    return top


def _show(tool: str, result: dict, how: str) -> str:
    return json.dumps(result, indent=2, default=str) if how == "json" or not hasattr(render, tool) else getattr(render, tool)(result)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config":
        print(config.init(args.path, args.force))
        return 0
    conf = config.Config.load(args.config)
    how = conf.get("format", getattr(args, "format", None))
    spark = spark or SparkSession.builder.appName("symbolake").getOrCreate()
    s = Session(spark, conf.graph_dir(args.index_dir), provider=provider_of(conf.get("llm_model"), conf.get("llm_base_url"), os.environ.get("SYMBOLAKE_LLM_KEY")))
    try:
        if args.command in ("index", "link"):
            steps = {x: config.step(getattr(args, x), getattr(args, f"no_{x}"), conf.get(x)) for x in STEPS}
            steps = config.gate_model_steps(steps, s.provider) | {x: None if (n := conf.get(x)) in (None, "") else int(n) for x in ("max_enrich", "max_flows")}
            done = s.link(args.roots, **steps) if args.command == "link" else s.index_incremental(args.root, args.since, **steps) if args.incremental else s.index(args.root, **steps)
            print(json.dumps(done))
        elif args.command == "serve":
            rpc.serve(s, sys.stdin, sys.stdout)
        elif args.command == "explore":
            for tool, result in s.explore(args.focus).items():
                print(_show(tool, result, how))
        elif args.command == "guide":
            text = _show("guide", s.guide(args.repo), how)
            Path(args.output).write_text(text) if args.output else print(text)
        else:
            call = {
                "search": lambda: s.search(" ".join(args.query), args.limit, args.repo), "changed": lambda: s.changed(args.root, args.since), "flow": lambda: s.flow(args.focus, args.depth),
                "thread": lambda: s.thread(args.focus, args.depth), "ripple": lambda: s.ripple(args.focus, args.depth), "zoom": lambda: s.zoom(args.focus), "pack": lambda: s.context_pack(args.focus, args.budget),
                "suggest": lambda: s.suggest(args.about, args.limit), "find": lambda: s.find(args.query, args.limit, args.repo), "repos": s.repos, "stats": s.stats,
            }
            print(_show({"pack": "context_pack"}.get(args.command, args.command), call[args.command](), how))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
