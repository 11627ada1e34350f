"""The command line: index, find, dupes, stats, stale, hook, mcp."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import __version__, render, server
from shelfmark.operators import delta, dupes, search, semantic, stale, stats
from shelfmark.plans import documents
from shelfmark.session import local_session
from shelfmark.sources import git, repo
from shelfmark.streaming import watch


def build_parser() -> argparse.ArgumentParser:
    """All commands and their options."""
    top = argparse.ArgumentParser(prog="shelfmark", description="An inventory of the functions of a source tree.")
    top.add_argument("-V", "--version", action="version", version=f"shelfmark {__version__}")
    sub = top.add_subparsers(dest="command", metavar="<command>")

    def command(name: str, run: Callable, text: str, json: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.set_defaults(run=run)
        if json:
            p.add_argument("--json", action="store_true", help="a JSON document instead of text")
        return p

    command("hello", cmd_hello, "say that it works", json=False)
    p = command("index", cmd_index, "build the index of a tree", json=False)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-w", "--watch", action="store_true")
    p.add_argument("--interval", type=float, default=watch.INTERVAL)
    p.add_argument("--debounce", type=float, default=watch.DEBOUNCE)
    p = command("find", cmd_find, "search by name, purpose or signature shape")
    p.add_argument("query", nargs="?", default="")
    p.add_argument("path", nargs="?", default=None)
    p.add_argument("-n", "--limit", type=int, default=search.LIMIT)
    p.add_argument("-s", "--sig")
    p.add_argument("-i", "--intent", action="store_true")
    p.add_argument("--semantic", action="store_true")
    p.add_argument("--explain", action="store_true")
    p = command("mcp", cmd_mcp, "serve coding agents on standard input and output", json=False)
    p.add_argument("path", nargs="?", default=".")
    p = command("dupes", cmd_dupes, "clusters of near-duplicates")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-t", "--threshold", type=float, default=dupes.THRESHOLD)
    p.add_argument("-n", "--limit", type=int)
    p = command("stats", cmd_stats, "totals and leaderboards")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-t", "--top", type=int, default=stats.TOP)
    p = command("stale", cmd_stale, "functions mentioned nowhere else")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--lang")
    hook = command("hook", lambda a: print(hook.format_help()) or 0, "the git hook", json=False)
    actions = hook.add_subparsers(dest="action", metavar="<action>")
    p = actions.add_parser("install", help="write the hook")
    p.set_defaults(run=cmd_hook_install)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--pre-push", dest="kind", action="store_const", const="pre-push", default="pre-commit")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--force", action="store_true")
    p = actions.add_parser("check", help="compare what is staged with the index")
    p.set_defaults(run=cmd_hook_check)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-t", "--threshold", type=float, default=delta.THRESHOLD)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--json", action="store_true")
    return top


def _usage(text: str) -> int:
    print(f"shelfmark: {text}", file=sys.stderr)
    return 2


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or local_session(os.environ.get("SHELFMARK_CORES", "*"))


def _document(df: DataFrame) -> None:
    print(df.first()["value"])


def cmd_hello(_: argparse.Namespace) -> int:
    """Print that the installation works."""
    print(f"shelfmark {__version__} works.")
    return 0


def cmd_index(a: argparse.Namespace) -> int:
    """Build, and with --watch keep, the index."""
    if not os.path.isdir(a.path):
        return _usage(f"{a.path} is not a directory")
    if a.interval <= 0 or a.debounce < 0:
        return _usage("--interval must be above 0 and --debounce not below")
    spark = _spark()
    path = repo.save_index(repo.build_index(spark, a.path), a.path)
    print(f"{repo.load_index(spark, a.path).count()} functions indexed in {path}")
    if a.watch:
        print(watch.watch(spark, a.path, a.interval, a.debounce, log=lambda s: print(s, file=sys.stderr)).summary(), file=sys.stderr)
    return 0


def cmd_find(a: argparse.Namespace) -> int:
    """Search; exit code 1 if nothing is found."""
    query, path = a.query, a.path
    if path is None:
        alone = bool(a.sig) and query and os.path.isdir(query)
        query, path = ("", query) if alone else (query, ".")
    if not query.strip() and not a.sig or a.semantic and not query.strip():
        return _usage("give a query" + ("" if a.semantic else " or --sig"))
    if not os.path.isdir(path):
        return _usage(f"{path} is not a directory")
    spark = _spark()
    records = repo.load_or_build(spark, path)
    backend = None
    if a.semantic:
        backend, why = semantic.load_backend()
        if backend is None:
            print(f"{why}; searching by text instead", file=sys.stderr)
    if backend:
        stored = os.path.join(path, repo.INDEX_DIR, "vectors")
        cache = semantic.load_cache(spark, stored, backend.name)
        from shelfmark.session import written

        vectors = written(semantic.embed_records(records, backend, cache), "vectors")
        if cache is None or any(not df.isEmpty() for df in semantic.split_cache(records, cache)[1:]):
            semantic.save_cache(vectors, stored, backend.name)
        hits = semantic.search(records, query, backend, vectors, a.limit)
    else:
        hits = search.find(records, query, a.limit, a.sig, a.intent)
    rows = hits.collect()
    if a.json:
        held = spark.createDataFrame(rows, hits.schema)
        _document(documents.find_document(held, query, a.sig, a.intent, backend is not None))
    else:
        print(render.results(query, rows, a.explain, render.use_color()))
    return 0 if rows else 1


def cmd_mcp(a: argparse.Namespace) -> int:
    """Serve until the input ends."""
    return server.serve(_spark(), a.path) if os.path.isdir(a.path) else _usage(f"{a.path} is not a directory")


def cmd_dupes(a: argparse.Namespace) -> int:
    """Clusters; exit code 1 if there are none."""
    if not 0 <= a.threshold <= 100:
        return _usage("--threshold must be from 0 to 100")
    spark = _spark()
    found = dupes.find_clusters(repo.load_or_build(spark, a.path), a.threshold, a.limit)
    rows = found.collect()
    if a.json:
        _document(documents.clusters_document(spark.createDataFrame(rows, found.schema), a.threshold))
    else:
        print(render.clusters(rows, render.use_color()))
    return 0 if rows else 1


def cmd_stats(a: argparse.Namespace) -> int:
    """Leaderboards; exit code 1 for an empty index."""
    if a.top < 0:
        return _usage("--top must not be below 0")
    records = repo.load_or_build(_spark(), a.path)
    total = stats.totals(records).first()
    if a.json:
        _document(documents.stats_document(records, a.top))
    else:
        boards = [[tuple(r) for r in df.collect()] for df in (stats.languages(records), stats.top_names(records, a.top), stats.biggest_files(records, a.top))]
        print(render.stats(total, *boards, color=render.use_color()))
    return 0 if total["total_functions"] else 1


def cmd_stale(a: argparse.Namespace) -> int:
    """Candidates of the stored index against the tree as it is now; exit code 1 if there are none."""
    spark = _spark()
    records = repo.load_or_build(spark, a.path)
    texts = repo.sources(spark, a.path).select(F.col("path").alias("file"), "content")
    ignore = tuple(a.ignore)
    rows = stale.find_stale(records, texts, ignore, a.lang).collect()
    if a.json:
        _document(documents.stale_document(records, texts, ignore, a.lang))
    else:
        print(render.stale(rows, *stale.counters(records, ignore, a.lang).first(), color=render.use_color()))
    return 0 if rows else 1


def cmd_hook_install(a: argparse.Namespace) -> int:
    """Write the hook."""
    try:
        print(git.install_hook(a.path, a.kind, a.strict, a.force))
    except (FileNotFoundError, FileExistsError) as e:
        return _usage(str(e))
    return 0


def cmd_hook_check(a: argparse.Namespace) -> int:
    """What is staged against the index; exit code 1 only with --strict and matches."""
    if not 0 <= a.threshold <= 100:
        return _usage("--threshold must be from 0 to 100")
    try:
        root = git.repo_root(a.path)
    except FileNotFoundError as e:
        return _usage(str(e))
    spark = _spark()
    try:
        existing = repo.load_index(spark, root)
    except FileNotFoundError:
        empty = spark.createDataFrame([], repo.RECORD)
        if a.json:
            _document(documents.matches_document(empty.select(F.struct("*").alias("staged"), F.struct("*").alias("existing"), F.lit(0.0).alias("score")), a.threshold, a.strict))
        else:
            print("There is no index yet; run shelfmark index.")
        return 0
    found = delta.best_matches(git.staged_records(spark, root), existing, a.threshold)
    rows = found.collect()
    if a.json:
        _document(documents.matches_document(spark.createDataFrame(rows, found.schema), a.threshold, a.strict))
    elif rows:
        print(render.matches(rows, render.use_color()))
    return 1 if rows and a.strict else 0


def main(argv: list[str] | None = None) -> int:
    """Run a command; its exit code."""
    parser = build_parser()
    a = parser.parse_args(argv)
    if not a.command:
        parser.print_help()
        return 0
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
