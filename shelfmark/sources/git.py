"""Staged changes of a git repository, and the hook that checks them."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession

from shelfmark.schema import SOURCE
from shelfmark.sources import repo

HOOKS = ("pre-commit", "pre-push")
MARK = "# shelfmark: staged-duplicate check"


def _git(args: list[str], cwd: str) -> bytes | None:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return done.stdout


def git_lines(args: list[str], cwd: str) -> list[str]:
    """Lines of a git command's output that aren't empty; none if it fails."""
    return [x for x in (_git(args, cwd) or b"").decode("utf-8", "replace").splitlines() if x.strip()]


def repo_root(start: str = ".") -> str:
    """The top of the working tree around a path; FileNotFoundError outside of one."""
    top = git_lines(["rev-parse", "--show-toplevel"], start)
    if not top:
        raise FileNotFoundError(f"{start} is not in a git working tree")
    return top[0]


def hooks_dir(root: str) -> str:
    """Where git looks for hooks, core.hooksPath included."""
    own = git_lines(["config", "--get", "core.hooksPath"], root)
    return os.path.join(root, own[0]) if own else os.path.join(root, ".git", "hooks")


def staged_paths(root: str) -> list[str]:
    """Added, copied, modified and renamed paths of the index that have a parser."""
    return [p for p in git_lines(["diff", "--cached", "--name-only", "--diff-filter=ACMR"], root) if repo.parser_for(p)]


def staged_sources(spark: SparkSession, root: str) -> DataFrame:
    """Staged texts, not those of the working tree: path, content."""
    rows = [(p, blob.decode("utf-8", "replace")) for p in staged_paths(root) if (blob := _git(["show", f":{p}"], root)) is not None]
    return spark.createDataFrame(rows, SOURCE)


def staged_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of the staged texts."""
    return repo.parse_sources(staged_sources(spark, root))


def install_hook(start: str = ".", hook: str = "pre-commit", strict: bool = False, force: bool = False) -> str:
    """Write the hook, executable; a hook of someone else's is kept unless forced."""
    if hook not in HOOKS:
        raise ValueError(f"no such hook: {hook}")
    folder = hooks_dir(repo_root(start))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, hook)
    if os.path.exists(path) and not force:
        with open(path, encoding="utf-8", errors="replace") as f:
            if MARK not in f.read():
                raise FileExistsError(f"{path} is not ours; force to overwrite it")
    command = "hook check --strict" if strict else "hook check"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'#!/bin/sh\n{MARK}\ncommand -v shelfmark >/dev/null 2>&1 && exec shelfmark {command}\nexec "{sys.executable}" -m shelfmark.cli {command}\n')
    os.chmod(path, 0o755)
    return path
