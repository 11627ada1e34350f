"""The command line, the git hook, documents and texts, over a small tree."""

import io
import json
import os
import subprocess

import pytest

from shelfmark import cli, render, server
from shelfmark.operators import semantic
from shelfmark.sources import git, repo
from shelfmark.streaming import watch

FILES = {
    "a.py": "def parse_date(text: str) -> str:\n    '''Parse a date.'''\n    return text\n\n\ndef helper():\n    return parse_date('x')\n",
    "lib/b.py": "def parse_dates(text: str) -> str:\n    '''Parse a date.'''\n    return text\n",
    "lib/c.js": "function helper(a) { return a }\nhelper(1)\n",
}


def put(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(body)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    put(root, FILES)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=x", "-c", "user.email=x@example.com", "commit", "-qm", "x"]):
        subprocess.run(["git", *args], cwd=root, check=True)
    return root


def run(capsys, *args):
    code = cli.main(list(args))
    out = capsys.readouterr()
    return code, out.out, out.err


def test_commands(spark, tree, capsys):
    assert run(capsys, "hello")[0] == 0
    code, out, _ = run(capsys, "index", tree)
    assert code == 0 and out.startswith("4 functions")
    code, out, _ = run(capsys, "find", "parse date", tree, "--json", "-n", "2")
    found = json.loads(out)
    assert code == 0 and [r["name"] for r in found["results"]] == ["parse_date", "parse_dates"] and found["count"] == 2 and found["results"][0]["breakdown"]["sig"] is None
    assert run(capsys, "find", "zzzzqqq", tree)[0] == 1 and run(capsys, "find", " ", tree)[0] == 2 and run(capsys, "find", "x", tree + "/none")[0] == 2
    code, out, _ = run(capsys, "find", tree, "-s", "(str) -> str", "--explain")
    assert code == 0 and "parse_date" in out.splitlines()[1] and "sig 100" in out
    code, out, _ = run(capsys, "dupes", tree, "--json")
    assert code == 0 and sorted([m["name"] for m in c["members"]] for c in json.loads(out)["clusters"]) == [["helper", "helper"], ["parse_date", "parse_dates"]]
    assert run(capsys, "dupes", tree, "-t", "101")[0] == 2
    code, out, _ = run(capsys, "stats", tree, "--json")
    assert code == 0 and json.loads(out)["top_names"] == [{"name": "helper", "count": 2}] and run(capsys, "stats", tree, "-t", "-1")[0] == 2
    code, out, _ = run(capsys, "stale", tree, "--json", "--ignore", "zz*")
    stale = json.loads(out)
    assert code == 0 and [c["function"]["name"] for c in stale["candidates"]] == ["parse_dates"] and stale["scanned"] == 4 and "zz*" in stale["ignore"]
    assert run(capsys, "stale", tree, "--lang", "javascript")[0] == 1
    assert "parse_dates" in run(capsys, "stale", tree)[1] and "helper" in run(capsys, "stats", tree)[1] and "parse_dates" in run(capsys, "dupes", tree)[1]


def test_hook(spark, tree, capsys):
    assert run(capsys, "hook", "check", tree)[1].startswith("There is no index")
    repo.save_index(repo.build_index(spark, tree), tree)
    put(tree, {"d.py": "def parse_date(text: str) -> str:\n    '''Parse a date.'''\n    return 1\n", "e.py": "def unlike(q, r): pass\n"})
    subprocess.run(["git", "add", "d.py"], cwd=tree, check=True)
    put(tree, {"d.py": "not staged ("})
    assert git.staged_paths(tree) == ["d.py"]
    code, out, _ = run(capsys, "hook", "check", tree, "--json")
    match = json.loads(out)["matches"][0]
    assert code == 0 and (match["staged"]["file"], match["existing"]["file"], match["score"]) == ("d.py", "a.py", 100.0)
    code, out, _ = run(capsys, "hook", "check", tree, "--strict")
    assert code == 1 and "100 % like parse_date" in out
    code, out, _ = run(capsys, "hook", "install", tree)
    path = out.strip()
    assert code == 0 and os.access(path, os.X_OK) and path.endswith("hooks/pre-commit") and run(capsys, "hook", "install", tree)[0] == 0
    with open(path, "w") as f:
        f.write("#!/bin/sh\n")
    assert run(capsys, "hook", "install", tree)[0] == 2 and run(capsys, "hook", "install", tree, "--force", "--strict")[0] == 0
    assert run(capsys, "hook", "check", os.path.dirname(tree))[0] == 2
    subprocess.run(["git", "config", "core.hooksPath", "own"], cwd=tree, check=True)
    assert run(capsys, "hook", "install", tree, "--pre-push")[1].strip().endswith("own/pre-push")


def test_old_versions_of_an_index_go(spark, tree):
    for _ in range(4):
        repo.save_index(repo.build_index(spark, tree), tree)
    assert sorted(x for x in os.listdir(repo.index_path(tree)) if x[0] == "v") == ["v3", "v4"]
    assert repo.load_index(spark, tree).count() == 4
    back = repo.import_json(spark, _saved(repo.export_json(repo.load_index(spark, tree)), tree))
    assert sorted(map(tuple, back.drop("seq").collect())) == sorted(map(tuple, repo.load_index(spark, tree).drop("seq").collect()))


def _saved(df, root):
    path = os.path.join(root, "index.json")
    with open(path, "w") as f:
        f.write(df.first()["value"])
    return path


def test_watching_a_tree(spark, tree):
    steps = iter([lambda: put(tree, {"n.py": "def fresh(): pass\n"}), lambda: os.remove(os.path.join(tree, "lib/c.js")), lambda: None, lambda: None, lambda: None])
    turns, clock = [], iter(range(100, 1000, 10))
    found = watch.watch(spark, tree, sleep=lambda s: (turns.append(s), next(steps, lambda: None)()), stop=lambda: len(turns) > 4, now=lambda: next(clock))
    assert (found.added, found.dropped, found.net_records) == (1, 1, 0) and found.summary().endswith("in 10 s")
    assert {r["name"] for r in repo.load_index(spark, tree).collect()} == {"parse_date", "helper", "parse_dates", "fresh"}


def test_server_answers(spark, tree):
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "find_function", "arguments": {"query": "parse date", "limit": "1"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "find_function", "arguments": {"query": "x", "limit": "many"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "find_function", "arguments": {"query": "x", "limit": 0}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "find_function", "arguments": {}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "none"}},
        {"jsonrpc": "2.0", "id": 8, "method": "none"},
        {"id": 9},
    ]
    out = io.BytesIO()
    assert server.serve(spark, tree, io.BytesIO(b"".join(json.dumps(x).encode() + b"\n" for x in lines) + b"\n{\n[]\n"), out) == 0
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines()) if r["id"] is not None}
    assert [t["name"] for t in got[2]["result"]["tools"]] == ["find_function", "index_stats"]
    assert json.loads(got[3]["result"]["content"][1]["text"])["results"][0]["name"] == "parse_date"
    assert all(got[k]["result"]["isError"] for k in (4, 5, 6)) and got[7]["error"]["code"] == -32602 and got[8]["error"]["code"] == -32601 and got[9]["error"]["code"] == -32600


def test_texts():
    row = {"name": "f", "qualname": "", "file": "m.py", "line": 3, "signature": "", "docstring": "Does.", "score": 91.4, "breakdown": {"name": 91.4, "doc": None, "sig": 50.0}}
    assert render.place(row) == "f | m.py:3 | ()"
    assert render.results("q", [row], True).splitlines() == ["1 like 'q':", "  f | m.py:3 | ()", "      Does.", "      score 91 (name 91, sig 50)"]
    assert "\033[1m" in render.results("q", [row], color=True) and render.results(" ", []) == "Nothing like that shape is indexed."
    assert render.clusters([]) == "No near-duplicates." and "2 functions, 80 % alike" in render.clusters([{"size": 2, "score": 80.0, "members": [row, row]}])
    assert render.stats({"total_functions": 0, "total_files": 0}, [], [], []) == "The index has no functions."
    assert render.stats({"total_functions": 5, "total_files": 1}, [("python", 5)], [("f", 3)], [("m.py", 5)]).endswith("f is defined 3 times.")
    assert render.stale([], 4, 1) == "All of 4 functions are mentioned somewhere (1 ignored)." and not render.use_color(io.StringIO())


class Lengths:
    name = "lengths"

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_an_unchanged_cache_is_left_alone(spark, tree, capsys, monkeypatch):
    monkeypatch.setattr(semantic, "load_backend", lambda: (Lengths(), None))
    saved = []
    save = semantic.save_cache
    monkeypatch.setattr(semantic, "save_cache", lambda *a: (saved.append(1), save(*a)))
    for _ in range(2):
        assert run(capsys, "find", "date", tree, "--semantic", "--json")[0] == 0
    assert len(saved) == 1
    put(tree, {"new.py": "def more(): pass\n"})
    repo.save_index(repo.build_index(spark, tree), tree)
    assert run(capsys, "find", "date", tree, "--semantic")[0] == 0 and len(saved) == 2
