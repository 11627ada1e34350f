"""Similarity, shapes, globs and parsers."""

import itertools
import random

from pyspark.sql import functions as F

from shelfmark.functions import globs, shapes, text
from shelfmark.sources import python_functions, script_functions


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_lcs_against_the_table():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(2))
        assert text.lcs_length(a, b) == slow_lcs(a, b)


def test_expressions_equal_the_udfs(spark):
    words = ["", "parse date", "date parse iso", "slug", "make a slug", "aa bb", "bb cc"]
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(words, words)], "a string, b string")
    pairs = [(text.ratio_column, text.ratio), (text.token_set_column, text.token_set_ratio), (text.partial_column, text.partial_ratio)]
    for r in df.select("a", "b", *[c(F.col("a"), F.col("b")).alias(f"c{k}") for k, (c, _) in enumerate(pairs)]).collect():
        for k, (_, f) in enumerate(pairs):
            assert abs(r[f"c{k}"] - f(r["a"], r["b"])) < 1e-9, (k, r)


def test_shapes():
    assert shapes.parse_signature("(self, a: int, *args, b: t.Optional[str] = None) -> List[int]") == (["int", "*", "optional"], "list", True)
    assert shapes.parse_signature("(str, int) -> bool", query=True) == (["str", "int"], "bool", True)
    same = shapes.parse_signature("(a: int) -> bool")
    assert shapes.shape_score_py(shapes.parse_signature("(int) -> bool", True), same) == 100.0
    assert shapes.shape_score_py(shapes.parse_signature("()"), same) == 0.0
    assert shapes.looks_like_signature("x -> y") and not shapes.looks_like_signature("parse date")


def test_shape_score_column_equals_python(spark):
    sigs = ["()", "(a: int) -> bool", "(a, b: str)", "(*args) -> str", "(x: int, y: str, z) -> None", "(a: bool, *rest)"]
    df = spark.createDataFrame([(a, b) for a in sigs for b in sigs], "a string, b string")
    for r in df.select("a", "b", shapes.shape_score(shapes.shape_udf("a"), shapes.shape_udf("b")).alias("s")).collect():
        assert r["s"] == shapes.shape_score_py(shapes.parse_signature(r["a"]), shapes.parse_signature(r["b"]))


def test_ignore_rules():
    rules = globs.IgnoreRules("*.gen.py\n!keep.gen.py\nout/\n/top.py\n# note\n")
    assert rules.ignored("a/x.gen.py") and not rules.ignored("a/keep.gen.py")
    assert rules.ignored("a/out/b.py") and rules.ignored("top.py") and not rules.ignored("a/top.py")


def test_python_records():
    got = python_functions.parse('class A:\n    async def f(self, x: int = 1, *, y=2) -> str:\n        """\n        Does it.\n        """\n        def g(a, /): pass\n', "m.py")
    assert [(r[0], r[2], r[3], r[4], r[6]) for r in got] == [("f", 2, "(self, x: int = 1, *, y=2) -> str", "Does it.", "A.f"), ("g", 6, "(a, /)", "", "A.f.g")]
    assert python_functions.parse("def (", "m.py") == []


def test_script_records():
    source = "// function no() {}\nexport function one<T>(a: T, b = 'x)'): string { return a }\nconst two = async (x) => x;\nclass K {\n  static three(q) { if (q) { } }\n}\n"
    assert [(r[0], r[2]) for r in script_functions.parse(source, "m.ts")] == [("one", 2), ("two", 3), ("three", 5)]
