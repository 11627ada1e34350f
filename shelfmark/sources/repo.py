"""Source trees: listing, reading, parsing, and the stored index."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfmark import __version__
from shelfmark.functions.globs import IgnoreRules
from shelfmark.schema import FIELDS, RECORD, SCHEMA_VERSION, records
from shelfmark.session import spread
from shelfmark.sources import python_functions, script_functions

INDEX_DIR = ".shelfmark"
SKIPPED = frozenset(f".git .hg .svn .venv venv env node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .eggs build dist {INDEX_DIR}".split())


class Parser(Protocol):
    """What turns a source text into record rows (name, file, line, signature, docstring, lang, qualname, seq)."""

    def __call__(self, source: str, path: str) -> list[python_functions.Row]:
        """The rows of one file."""
        ...


#: Adding a language is one entry for each of its extensions.
PARSERS: dict[str, Parser] = {".py": python_functions.parse, **dict.fromkeys((".js", ".jsx", ".ts", ".tsx"), script_functions.parse)}


def parser_for(path: str) -> Parser | None:
    """The parser of a path's extension, whatever its case."""
    return PARSERS.get(os.path.splitext(path)[1].lower())


def extension(path: Column) -> Column:
    """The extension of a path in lower case, with its dot; '' if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def has_parser(path: Column) -> Column:
    """Whether some parser takes a path."""
    return extension(path).isin(list(PARSERS))


def rules_of(root: str) -> IgnoreRules:
    """The rules of the root's ignore file; nested ones aren't read."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            return IgnoreRules(f.read())
    except OSError:
        return IgnoreRules()


def walk(root: str, wanted: Callable[[str], bool] | None = None) -> Iterator[str]:
    """Paths below a root, in order, that aren't skipped or ignored and have a parser; skipped directories aren't entered."""
    wanted, rules = wanted or (lambda p: parser_for(p) is not None), rules_of(root)
    for here, dirs, files in os.walk(root):
        base = os.path.relpath(here, root).replace(os.sep, "/")
        prefix = "" if base == "." else f"{base}/"
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED and not rules.matches(prefix + d, True))
        for name in sorted(files):
            if wanted(prefix + name) and not rules.matches(prefix + name):
                yield prefix + name


def is_indexable(root: str, path: str, wanted: Callable[[str], bool] | None = None) -> bool:
    """Whether the walk would give this path."""
    path = path.replace(os.sep, "/")
    wanted = wanted or (lambda p: parser_for(p) is not None)
    return wanted(path) and not SKIPPED & set(path.split("/")[:-1]) and not rules_of(root).ignored(path)


def indexable(path: Column, rules: str = "") -> Column:
    """The same rules as an expression, for tables of paths; only with ignore rules is there Python in it."""
    inner = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    known = has_parser(path) & ~F.arrays_overlap(inner, F.lit(sorted(SKIPPED)))
    if not rules.strip():
        return known

    @F.pandas_udf("boolean")
    def free(paths):
        held = IgnoreRules(rules)
        return paths.map(lambda p: not held.ignored(p))

    return known & free(path)


class _Chunk(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.content = options["path"], options.get("content", "true") == "true"
        self.chunk = int(options.get("chunk", 256))

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root))
        return [_Chunk(paths[k : k + self.chunk]) for k in range(0, len(paths), self.chunk)] or [_Chunk([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                full = os.path.join(self.root, path)
                seen = os.stat(full)
                text = None
                if self.content:
                    with open(full, encoding="utf-8", errors="replace") as f:
                        text = f.read()
            except OSError:
                continue
            yield path, text, seen.st_mtime_ns, seen.st_size


class SourceTree(DataSource):
    """``format("source_tree")``: path, content, mtime_ns, size of a tree's sources. With content=false files aren't read."""

    @classmethod
    def name(cls) -> str:
        """The short name."""
        return "source_tree"

    def schema(self) -> str:
        """Columns of the source."""
        return "path string, content string, mtime_ns bigint, size bigint"

    def reader(self, schema) -> DataSourceReader:
        """A reader over chunks of the listing."""
        return _TreeReader(self.options)


def sources(spark: SparkSession, root: str) -> DataFrame:
    """The sources of a tree: path, content."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(root).select("path", "content")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """When and how large the files of a tree are: path, mtime_ns, size."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("content", "false").load(root).select("path", "mtime_ns", "size")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a distributed folder as (path, content), line ends as '\\n'."""
    held = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return held.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))


def parse_sources(held: DataFrame) -> DataFrame:
    """The records of sources (path, content), parsed on all cores; files without a parser, or unreadable, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in RECORD]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = parser_for(path or "")
                if parser and text is not None:
                    rows += parser(re.sub("\r\n?", "\n", text), path)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("line", "seq") else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return spread(held.where(has_parser(F.col("path"))).select("path", "content"), "path").mapInArrow(run, RECORD)


def build_index(spark: SparkSession, root: str) -> DataFrame:
    """The inventory of a tree, in natural order."""
    return parse_sources(sources(spark, root)).orderBy("file", "line", "seq")


def index_path(root: str) -> str:
    """Where a tree's index is stored."""
    return os.path.join(root, INDEX_DIR, "index")


def save_index(index: DataFrame, root: str) -> str:
    """Write an index as Parquet in a new version folder, then point to it: readers never see half of one.

    The version before stays for those that read it; older ones are removed.
    """
    base = index_path(root)
    old = _pointer(root)
    version = (old["version"] if old else 0) + 1
    index.select(*FIELDS, "seq").write.mode("overwrite").parquet(os.path.join(base, f"v{version}"))
    with open(os.path.join(base, "current.tmp"), "w", encoding="utf-8") as f:
        json.dump({"schema_version": SCHEMA_VERSION, "tool_version": __version__, "version": version}, f)
    os.replace(os.path.join(base, "current.tmp"), os.path.join(base, "current.json"))
    for name in os.listdir(base):
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < version - 1:
            shutil.rmtree(os.path.join(base, name), ignore_errors=True)
    return base


def _pointer(root: str) -> dict | None:
    try:
        with open(os.path.join(index_path(root), "current.json"), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def load_index(spark: SparkSession, root: str) -> DataFrame:
    """The stored index; FileNotFoundError if there is none."""
    at = _pointer(root)
    if at is None:
        raise FileNotFoundError(f"no index below {root}; build one first")
    return records(spark.read.parquet(os.path.join(index_path(root), f"v{at['version']}")))


def index_metadata(root: str) -> dict:
    """The versions an index was written with."""
    return _pointer(root) or {"schema_version": SCHEMA_VERSION, "tool_version": __version__, "version": 0}


def load_or_build(spark: SparkSession, root: str) -> DataFrame:
    """The stored index, built and stored first if there is none."""
    try:
        return load_index(spark, root)
    except FileNotFoundError:
        save_index(build_index(spark, root), root)
        return load_index(spark, root)


def export_json(index: DataFrame) -> DataFrame:
    """An index as one JSON document: value. The array is built in one row, as the format asks."""
    ordered = F.array_sort(F.collect_list(F.struct("file", "line", "seq", *[c for c in FIELDS if c not in ("file", "line")])))
    rows = F.transform(ordered, lambda r: F.struct(*[r[c].alias(c) for c in FIELDS]))
    doc = index.agg(F.count("*").alias("count"), rows.alias("functions"))
    return doc.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(__version__).alias("tool_version"), "count", "functions"), {"ignoreNullFields": "false"}).alias("value"))


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON index documents; unknown keys are dropped."""
    fields = ", ".join(f"{c}: {'int' if c == 'line' else 'string'}" for c in FIELDS)
    held = spark.read.schema(f"functions array<struct<{fields}>>").json(path, multiLine=True)
    return records(held.select(F.posexplode("functions").alias("seq", "r")).select("seq", "r.*"))
