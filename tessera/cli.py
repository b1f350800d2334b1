"""Command line: init, index, search, map, callers, callees, impact, stats, doctor, watch, serve, reset."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.config import DEFAULTS, Config
from tessera.engine import Engine
from tessera.serve import search_text, serve

SETTINGS = ".tessera/settings.json"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--root", default=".")
    p.add_argument("--store")
    p.add_argument("--config", action="append", default=[], help="settings; later files win, and the project's own comes first")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "index", "stats", "doctor", "serve", "reset"):
        sub.add_parser(name)
    w = sub.add_parser("watch")
    w.add_argument("--rounds", type=int, default=1 << 30)
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("limit", nargs="?", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--max-tokens", type=int, default=0)
    s.add_argument("--package", default="")
    s.add_argument("--metadata-only", action="store_true")
    for flag in ("lang", "path", "name", "node-kind"):
        s.add_argument(f"--{flag}", action="append", default=[])
    m = sub.add_parser("map")
    m.add_argument("--tokens", type=int)
    m.add_argument("--all", action="store_true", help="files that are no code too")
    m.add_argument("--no-summary", action="store_true")
    m.add_argument("--no-marks", action="store_true")
    for name in ("callers", "callees", "impact"):
        g = sub.add_parser(name)
        g.add_argument("symbol")
        g.add_argument("--limit", type=int, default=50)
        if name == "impact":
            g.add_argument("--depth", type=int, default=2)
    return p


def init(root: str, store: str | None) -> str:
    """Write the project's settings, unless there are some; gives the file's path."""
    at = Path(root) / SETTINGS
    if not at.exists():
        at.parent.mkdir(parents=True, exist_ok=True)
        said = {"store": store or str(Path(root).resolve() / ".tessera" / "index"), "embedding_model": DEFAULTS.embedding_model, "embedding_width": DEFAULTS.embedding_width}
        at.write_text(json.dumps(said, indent=2) + "\n")
    return str(at)


def settings(root: str, store: str | None, files: list[str]) -> Config:
    """The project's settings, then those of the files, then what the command line says."""
    own = Path(root) / SETTINGS
    out = Config()
    for f in [str(own)] * own.exists() + files:
        out = out.merge(Config.load(f))
    return out.merge(Config(root=root, store=store))


def main(args: list[str] | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(args)
    say = lambda *x, end="\n": print(*x, end=end, file=out)
    if a.command == "init":
        say(init(a.root, a.store))
        return 0
    engine = Engine(SparkSession.builder.appName("tessera").getOrCreate(), settings(a.root, a.store, a.config))
    if a.command == "search":
        rows, cut = engine.search(
            a.text, limit=a.limit, offset=a.offset, max_tokens=a.max_tokens, package=a.package, metadata_only=a.metadata_only,
            languages=tuple(a.lang), paths=tuple(a.path), names=tuple(a.name), node_kinds=tuple(a.node_kind),
        )
        say(search_text(rows, cut, a.metadata_only), end="")
    elif a.command == "map":
        say(engine.map(a.tokens, not a.all, not a.no_summary, not a.no_marks) or "No symbols indexed yet.\n", end="")
    elif a.command in ("callers", "callees"):
        say(getattr(engine, a.command)(a.symbol, limit=a.limit).text, end="")
    elif a.command == "impact":
        say(engine.impact(a.symbol, a.depth, a.limit).text, end="")
    elif a.command == "doctor":
        checks = engine.doctor()
        for what, ok, found in checks:
            say(f"{'ok  ' if ok else 'FAIL'} {what}: {found}")
        return 0 if all(ok for _, ok, _ in checks) else 1
    elif a.command == "watch":
        engine.poll(a.rounds)
    elif a.command == "serve":
        serve(engine)
    elif a.command == "index":
        say(json.dumps(engine.index(progress=lambda stage, n: print(f"{stage}: {n} files", file=sys.stderr))))
    else:
        say(json.dumps(getattr(engine, a.command)() or {}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
