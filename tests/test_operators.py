"""Operators over small inventories, against plain Python."""

import json
import os
import random
import re
import time

from pyspark.sql import functions as F

from shelfmark import server
from shelfmark.functions import shapes, text
from shelfmark.operators import delta, dupes, search, semantic, stale, stats
from shelfmark.operators.ordinal import with_ordinal
from shelfmark.plans import queries
from shelfmark.schema import RECORD
from shelfmark.session import drop_tables, tables_noted, written
from shelfmark.sources import python_functions, repo, script_functions
from shelfmark.streaming import watch

ROWS = [
    ("parse_iso_date", "m.py", 1, "(s: str)", "Parse an ISO 8601 date string."),
    ("parse_date_iso", "m.py", 10, "(text: str)", "Parse an ISO 8601 date string into a date object."),
    ("parse_iso", "n.py", 20, "(value: str)", "Parse an ISO date string."),
    ("add", "n.py", 30, "(a: int, b: int) -> int", "Add two integers."),
    ("slugify", "o.py", 40, "(text: str) -> str", "Make a URL-safe slug."),
    ("helper", "o.py", 50, "()", ""),
]


def records(spark, rows=ROWS):
    return spark.createDataFrame([(n, f, l, s, d, "python", n, 0) for n, f, l, s, d in rows], RECORD)


def pair_py(a, b):
    parts = [(text.token_set_ratio(a[0].replace("_", " "), b[0].replace("_", " ")), 0.5)]
    if a[4] and b[4]:
        parts.append((text.token_set_ratio(a[4], b[4]), 0.3))
    sig = shapes.shape_score_py(shapes.parse_signature(a[3]), shapes.parse_signature(b[3]))
    if sig > 0:
        parts.append((sig, 0.2))
    return round(min(100.0, sum(s * w for s, w in parts) / sum(w for _, w in parts)), 2)


def test_pair_edges_against_all_pairs(spark):
    got = {(r["i"], r["j"]): r["score"] for r in dupes.pair_edges(with_ordinal(records(spark)), 50.0).collect()}
    want = {(i, j): s for i, a in enumerate(ROWS) for j, b in enumerate(ROWS) if i < j and (s := pair_py(a, b)) >= 50.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.011 for k in want)


def test_no_pair_of_names_that_can_reach_the_floor_is_lost(spark):
    r = random.Random(7)
    words = ["get", "set", "user", "name", "a", "parse", "parser", "x1", "value_of", "é", "longerword", ""]
    names = sorted({"_".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(60)} | {"".join(r.choice("abcde") for _ in range(r.randrange(1, 12))) for _ in range(40)})
    df = spark.createDataFrame([(n,) for n in names], "a string")
    for floor in (0.0, 20.0, 49.99, 80.0, 100.0):
        got = {(x["a"], x["b"]) for x in dupes.name_candidates(df, df.withColumnRenamed("a", "b"), floor).collect()}
        want = {(a, b) for a in names for b in names if text.token_set_ratio(a.replace("_", " "), b.replace("_", " ")) >= floor}
        assert want <= got and (floor < 40 or len(got) < 0.6 * len(names) ** 2)


def test_mentions_of_names_with_dollars(spark):
    names = ["$", "$$", "a$", "$a", "a$b", "ab", "$el", "x$1$", "é$"]
    body = "a$b $a a$ ab$ $el.x $$ a $ x$1$ é$b a$b$a\nab ab (a$)\n$el$el\n\n a$ b a$$b"
    got = {(r["line"], r["token"]): r["n"] for r in stale.reference_counts(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([("f", body)], "file string, content string")).collect()}
    want = {(k, n): c for k, line in enumerate(body.split("\n"), 1) for n in names if (c := len(re.findall(rf"\b{re.escape(n)}\b", line)))}
    assert got == want and len(want) > 8


def test_sources_of_one_split_are_parsed_on_all_cores(spark):
    held = spark.createDataFrame([(f"f{k}.py", f"def f{k}(): pass\n") for k in range(500)], "path string, content string").coalesce(1)
    found = repo.parse_sources(held).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["name"] for r in found) == sorted(f"f{k}" for k in range(500)) and len({r["task"] for r in found}) >= 8


def test_lines_are_cut_in_linear_time(spark):
    bodies = ["", "\n", "a", "a\n", "a\r\n", "\r\n\r\n", "a\n\nb\u2028", "a\x1cb\n\n", "\n\r", "a\x85\r"]
    got = {}
    for r in stale.lines(spark.createDataFrame(list(enumerate(bodies)), "file int, content string")).collect():
        got.setdefault(r["file"], []).append((r["line"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(b.splitlines(), 1)) for k, b in enumerate(bodies) if b}
    start = time.time()
    assert stale.lines(spark.range(1).select(F.lit("f").alias("file"), F.repeat(F.lit("a line of some words\n"), 60_000).alias("content"))).count() == 60_000
    whole = stale.lines(spark.range(1).select(F.lit("f").alias("file"), F.repeat(F.lit("a line of some words\n"), 60_000).alias("content")))
    assert whole.agg(F.sum(F.length("text"))).first()[0] == 60_000 * 20 and time.time() - start < 30


def test_names_beyond_the_broadcast_are_counted_alike(spark, monkeypatch):
    names = spark.createDataFrame([("a",), ("b$",), ("cd",)], "name string")
    sources = spark.createDataFrame([("f", "a cd\ncd b$x a a\n"), ("g", "no")], "file string, content string")
    few = sorted(stale.reference_counts(names, sources).collect())
    monkeypatch.setattr(stale, "HELD", 0)
    assert few == sorted(stale.reference_counts(names, sources).collect()) and len(few) == 5
    assert [r["n"] for r in few] == [1, 1, 2, 1, 1]


def test_scripts_are_scanned_in_linear_time_and_never_fail():
    body = "class A {\n static async load<T>(url: string, n = 3): Promise<T> {\n return get(url) }\n}\nexport const add = (a, b) => a + b;\nlet one = x => x;\nfunction* gen(a /* c */) { if (a) { call(a) } }\nconst s = 'function no() {}';\n"
    assert [(r[0], r[2], r[3]) for r in script_functions.parse(body, "a.ts")] == [("load", 2, "(url: string, n = 3): Promise<T>"), ("add", 5, "(a, b)"), ("one", 6, "(x)"), ("gen", 7, "(a /* c */)")]
    for text_ in ("f(a);\n" * 30_000, "a<b(" * 30_000, "x(): [" * 30_000, "(" * 100_000, "`" * 9, "function f(", "\0"):
        start = time.time()
        assert script_functions.parse(text_, "a.js") == [] and time.time() - start < 20
    assert python_functions.parse("x = " + "+".join("1" * 30_000) + "\ndef f(): pass\n", "a.py") == []
    assert python_functions.parse("x = " + "(" * 5000, "a.py") == []


def test_clusters(spark):
    found = dupes.find_clusters(records(spark)).collect()
    assert [sorted(m["name"] for m in c["members"]) for c in found] == [["parse_date_iso", "parse_iso", "parse_iso_date"]]
    assert dupes.find_clusters(records(spark), limit=-1).collect() == []
    assert dupes.find_clusters(records(spark, [])).collect() == []


def test_chains_stay_apart():
    assert dupes.greedy_linkage([(92.0, 0, 1), (80.0, 1, 2)]) == [([0, 1], 92.0)]


def test_linkage_of_profiles_equals_that_of_records():
    for seed in range(150):
        r = random.Random(seed)
        place = list(range(r.randrange(2, 30)))
        profile = [r.randrange(6) for _ in place]
        score = {(p, q): r.choice((75.5, 80.25, 90.0)) for p in range(6) for q in range(6) if r.random() < 0.7}
        edges = [(score[profile[i], profile[j]], i, j) for i in place for j in place[i + 1 :] if (profile[i], profile[j]) in score]
        own = {}
        for i in place:
            own.setdefault(profile[i], []).append(i)
        score = {k: s for k, s in score.items() if k[0] in own and k[1] in own}
        want, got = dupes.greedy_linkage(edges), dupes.profile_linkage(own, score)
        assert [m for m, _ in got] == [m for m, _ in want] and all(abs(a[1] - b[1]) < 0.011 for a, b in zip(got, want, strict=True))


def written_out(rows):
    """All pairs of records that follow from the rows of ``class_edges``."""
    home = {r["i"]: r["j"] for r in rows if r["score"] is None}
    score = {(r["i"], r["j"]): r["score"] for r in rows if r["score"] is not None}
    return {(i, j): score[home[i], home[j]] for i in home for j in home if i < j and (home[i], home[j]) in score}


def test_copies_are_not_written_out_as_pairs(spark):
    rows = [("load", "m.py", k, "(a: int)" if k % 3 else "(a: str, *more) -> int", "Load it.") for k in range(200)]
    got = dupes.class_edges(with_ordinal(records(spark, rows))).collect()
    want = {(i, j): s for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and (s := pair_py(a, b)) >= 75.0}
    pairs = written_out(got)
    assert len(got) <= 204 and pairs.keys() == want.keys() and len(want) > 10_000 and all(abs(pairs[k] - want[k]) < 0.011 for k in want)


def test_duplicate_queries_have_every_record(spark):
    held = with_ordinal(queries.inventory(spark, "/root/testdata/sf0.001")).collect()
    key = {r["ord"]: (r["name"], r["docstring"], r["signature"]) for r in held}
    edges = written_out(queries.pair_edges(spark, "/root/testdata/sf0.001").collect())
    assert edges == {(r["i"], r["j"]): r["score"] for r in dupes.pair_edges(with_ordinal(queries.inventory(spark, "/root/testdata/sf0.001"))).collect()}
    same = {(i, j) for i in key for j in key if i < j and key[i] == key[j]}
    assert same and same <= edges.keys()
    want = {(held[i]["file"], held[i]["line"]): (m[0], s, len(m)) for m, s in dupes.greedy_linkage([(s, i, j) for (i, j), s in edges.items()]) for i in m}
    got = {(r["file"], r["line"]): (r["cluster"], r["score"], r["size"]) for r in queries.dupe_clusters(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(g[0] == w[0] and abs(g[1] - w[1]) < 0.011 and g[2] == w[2] for g, w in zip(got.values(), map(want.get, got), strict=True))


def test_linkage_of_classes_equals_that_of_records():
    for seed in range(400):
        r = random.Random(seed)
        kinds = r.randrange(2, 9)
        profile = [r.randrange(kinds) for _ in range(r.randrange(2, 40))]
        own = {}
        for i, p in enumerate(profile):
            own.setdefault(p, []).append(i)
        first = {p: m[0] for p, m in own.items()}
        score = {(p, q): r.choice((75.5, 90.0, 100.0)) for p in range(kinds) for q in range(p) if r.random() < 0.6}
        score |= {(q, p): s for (p, q), s in score.items()} | {(p, p): 100.0 for p in range(kinds)}
        want = dupes.greedy_linkage([(score[profile[i], profile[j]], i, j) for i in range(len(profile)) for j in range(i + 1, len(profile)) if (profile[i], profile[j]) in score])
        links = {(first[p], first[q]): s for (p, q), s in score.items() if p in own and q in own and first[p] < first[q]}
        found = dupes.class_linkage({m[0]: len(m) for m in own.values()}, {m[0]: m[1] for m in own.values() if len(m) > 1}, links)
        got = {tuple(sorted(i for c in m for i in own[profile[c]])): s for m, s in found}
        assert got.keys() == {tuple(m) for m, _ in want} and all(abs(got[tuple(m)] - s) < 0.011 for m, s in want)


def test_clusters_of_many_copies_are_linked_by_class(spark, monkeypatch):
    rows = [(f"load_{'ab'[k % 2]}_file", "m.py", k, "(a: int) -> int", "Load it.") for k in range(300)]
    rows += [("save", "s.py", k, "(a: int)" if k % 3 else "(a: str, *more) -> int", "Save it.") for k in range(30)]
    asked = []
    monkeypatch.setattr(dupes, "written", lambda df, name, keep=dupes.written: asked.append((name, out := keep(df, name))) or out)
    found = dupes.assign_clusters(with_ordinal(records(spark, rows))).collect()
    clusters = {}
    for r in found:
        clusters.setdefault(r["cluster"], []).append(r["node"])
    edges = [(s, i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and (s := pair_py(a, b)) >= 75.0]
    assert sorted(sorted(m) for m in clusters.values()) == sorted(m for m, _ in dupes.greedy_linkage(edges))
    by_class = next(df for name, df in asked if name == "class-clusters")
    assert sorted(r["node"] for r in by_class.collect()) == [0, 1]


def test_search_against_brute_force(spark):
    query = "parse iso date"
    want = sorted(((-min(100.0, max(text.token_set_ratio(query, r[0].replace("_", " ")), 0.9 * text.partial_ratio(query, r[4]) if r[4] else 0.0)), r[1], r[2]) for r in ROWS))
    got = [(-r["score"], r["file"], r["line"]) for r in search.find(records(spark), query, min_score=0.0).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want] and all(abs(g[0] - w[0]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert search.find(records(spark), "  ").collect() == []
    assert search.find(records(spark), query, limit=-2).collect() == []
    assert search.find(records(spark), "", sig="(int, int) -> int").first()["name"] == "add"


def test_best_matches_against_brute_force(spark):
    want = {}
    for a in ROWS:
        best = max(((pair_py(a, b), -k) for k, b in enumerate(ROWS) if b[1] != a[1]), default=(0, 0))
        if best[0] >= 60:
            want[a[0]] = ROWS[-best[1]][0]
    got = {r["staged"]["name"]: r["existing"]["name"] for r in delta.best_matches(records(spark), records(spark), 60.0).collect()}
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def many_copies(spark):
    rows = [(("load_file", "file_load", "save_it")[k % 3], f"{'abc'[k // 7 % 3]}.py", k, "(a: int) -> int", f"Load {k % 2}.") for k in range(90)]
    return rows, records(spark, rows)


def test_best_matches_of_copies_are_found_by_profile(spark):
    rows, df = many_copies(spark)
    want = {}
    for a in rows:
        best = max((pair_py(a, b), [-ord(b[1][0]), -b[2]]) for b in rows if b[1] != a[1])
        if best[0] >= 75:
            want[a[2]] = -best[1][1]
    found = delta.best_matches(df, df)
    assert {r["staged"]["line"]: r["existing"]["line"] for r in found.collect()} == want and len(want) == 90
    assert not any("Window [" in x and "staged" in x and "existing" in x for x in plan_of(found).split("\n"))


def test_a_batch_of_searches_ranks_first_records_alone(spark):
    rows, df = many_copies(spark)
    asked = ["load file", "save", "1"]
    score = lambda q, r: min(100.0, max(text.token_set_ratio(q, r[0].replace("_", " ")), 0.9 * text.partial_ratio(q, r[4])))
    want = {(q, k): r[2] for q in asked for k, r in enumerate(sorted((r for r in rows if score(q, r) >= 40), key=lambda r: (-round(score(q, r), 9), r[1], r[2]))[:4], 1)}
    made = []
    keep = search.written
    search.written = lambda x, name: made.append(keep(x, name)) or made[-1]
    try:
        found = search.find_many(df, spark.createDataFrame([(q,) for q in asked], "query string"), limit=4)
    finally:
        search.written = keep
    assert {(r["query"], r["rank"]): r["line"] for r in found.collect()} == want
    assert made[0].count() <= 4 * 18


def test_stats_and_stale(spark):
    assert stats.totals(records(spark, [])).first()["is_empty"]
    assert stats.top_names(records(spark), -1).collect() == []
    sources = spark.createDataFrame([("o.py", "\n" * 39 + "def slugify(text): pass\n" + "\n" * 9 + "def helper(): pass\nslugify(helper)\n")], "file string, content string")
    assert [r["name"] for r in stale.find_stale(records(spark), sources, ("parse*",)).collect()] == ["add"]


class Letters:
    name = "letters"

    def embed(self, texts):
        return [[float(t.lower().count(c)) for c in "abcdefgh"] for t in texts]


def test_semantic_cache(spark):
    one = records(spark)
    first = written(semantic.embed_records(one, Letters()), "vectors")
    hits, misses, stale_ = semantic.split_cache(records(spark, ROWS[1:] + [("new", "p.py", 1, "()", "")]), first)
    assert (hits.count(), misses.count(), stale_.count()) == (5, 1, 1)
    assert semantic.search(one, "slug", Letters(), first, limit=2).count() == 2
    assert semantic.search(one, " ", Letters()).collect() == []


def test_tree_index_watch_and_server(spark, tmp_path):
    root = str(tmp_path)
    for name, body in {"a.py": "def f(x: int) -> int:\n    'Doubles.'\n    return x\n", "b.js": "function g(a) { return a }\n", "build/c.py": "def no(): pass\n", ".gitignore": "d.py\n", "d.py": "def no(): pass\n"}.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    repo.save_index(repo.build_index(spark, root), root)
    assert [r["name"] for r in repo.load_index(spark, root).orderBy("file").collect()] == ["f", "g"]
    answer = server.Server(spark, root).answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "index_stats"}}))
    assert json.loads(answer["result"]["content"][1]["text"])["count"] == 2
    assert server.Server(spark, root).answer("{")["error"]["code"] == -32700
    q = watch.watch_stream(spark, root, os.path.join(root, "state"), debounce=0.01)
    q.awaitTermination(120)
    os.remove(os.path.join(root, "b.js"))
    with open(os.path.join(root, "a.py"), "a") as f:
        f.write("def h(): pass\n")
    q = watch.watch_stream(spark, root, os.path.join(root, "state"), debounce=0.01)
    q.awaitTermination(120)
    assert sorted(r["name"] for r in repo.load_index(spark, root).collect()) == ["f", "h"]


def test_noted_tables_are_dropped_once_unread(spark):
    noted = []
    with tables_noted(noted):
        a, b = (written(spark.range(3).withColumn("x", F.lit(k)), f"t{k}") for k in range(2))
    drop_tables(noted, a)
    assert len(noted) == 1 and a.count() == 3
