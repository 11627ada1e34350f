"""Near-duplicate functions: weighted pair scores, edges, complete-linkage clusters."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from functools import reduce
from heapq import merge
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import shapes, text
from shelfmark.operators.ordinal import with_ordinal
from shelfmark.session import written

THRESHOLD = 75.0
NAME, DOC, SIG = 0.5, 0.3, 0.2
#: What a score depends on.
KEY = ["name", "docstring", "signature"]


def pair_score(name: Column, doc: Column, sig: Column) -> Column:
    """The weighted mean of the signals that apply, 2 decimals.

    ``doc`` is null unless both have summaries; ``sig`` counts only above 0.
    """
    has_sig = F.coalesce(sig > 0, F.lit(False))
    total = name * NAME + F.coalesce(doc * DOC, F.lit(0.0)) + F.when(has_sig, sig * SIG).otherwise(0.0)
    weight = F.lit(NAME) + F.when(doc.isNotNull(), DOC).otherwise(0.0) + F.when(has_sig, SIG).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), total / weight), 2)


def name_floor(threshold: float) -> float:
    """The least name score with which any pair can reach the threshold, whatever its other signals.

    A pair's weighted mean is highest with full marks for the others: three signals allow the lowest
    name score, 2t - 100. Scores are rounded, so the threshold is eased by half a unit.
    """
    t = threshold - 0.005
    return max(0.0, 2 * t - 100)


def _joined(words: Column) -> Column:
    """The length of words joined by spaces."""
    return F.length(F.array_join(words, " "))


def common_characters(a: Column, b: Column) -> Column:
    """How many characters two strings have in common, in any order: the most that a common subsequence can have."""

    def count(text_: Column, c: Column) -> Column:
        return F.length(text_) - F.length(F.replace(text_, c, F.lit("")))

    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def name_bound(x: Column, y: Column) -> Column:
    """The most that the token-set ratio of two sets of words can be, by the characters that their rests have in common."""
    shared = _joined(F.array_intersect(x, y))
    l_rest, r_rest = F.array_join(F.array_except(x, y), " "), F.array_join(F.array_except(y, x), " ")
    left, right = F.length(l_rest), F.length(r_rest)
    gap = F.when(shared > 0, 1).otherwise(0)
    la, lb = shared + gap + left, shared + gap + right
    first = 100.0 - F.lit(100.0) * (left + right - 2 * common_characters(l_rest, r_rest)) / (la + lb)
    second, third = 100.0 - F.lit(100.0) * (gap + left) / (shared + la), 100.0 - F.lit(100.0) * (gap + right) / (shared + lb)
    full = F.least(left, right) == 0
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((shared > 0) & full, 100.0).when(shared == 0, first).otherwise(F.greatest(first, second, third))


def name_candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs of names (a of ``left``, b of ``right``) whose token-set ratio can reach ``floor``, and no pair lost that does.

    Names meet by a common word, or else by their length: without one, a ratio of f needs lengths within
    f / (200 - f) of each other, so it is within a class of lengths or the next. Pairs that the bound rules out go
    before anything is scored.
    """

    def cut(df: DataFrame, name: str) -> DataFrame:
        # where Python's split cuts
        words = F.array_distinct(F.filter(F.split(text.spaced(F.col(name)), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
        return df.select(name, words.alias(f"{name}_words")).withColumn(f"{name}_size", _joined(F.col(f"{name}_words")))

    a, b = cut(left, "a"), cut(right, "b")
    by_word = a.withColumn("key", F.explode("a_words")).join(b.withColumn("key", F.explode("b_words")), "key").drop("key")
    share = floor / (200 - floor)
    if share > 0:
        step = F.lit(float(-math.log(share)) or 1.0)
        place = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / step)
        near = F.explode(F.array(place("b_size") - 1, place("b_size"), place("b_size") + 1))
        by_size = a.withColumn("key", place("a_size")).join(b.withColumn("key", near), "key").drop("key")
        by_size = by_size.where((F.col("a_size") >= share * F.col("b_size") - 1e-9) & (F.col("b_size") >= share * F.col("a_size") - 1e-9))
    else:  # any two names can
        by_size = a.withColumn("key", F.lit(0)).join(b.withColumn("key", F.lit(0)), "key").drop("key")
    able = by_size.where(~F.arrays_overlap("a_words", "b_words")).unionByName(by_word.distinct())
    return able.where(name_bound(F.col("a_words"), F.col("b_words")) >= floor - 1e-9).select("a", "b")


def scored_profiles(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.0) -> DataFrame:
    """Pairs of profiles, of ``left`` with columns prefixed ``a`` and of ``right`` with ``b``, that reach the threshold, with their score.

    Names, summaries and shapes are each scored once for each distinct pair of values; names come first, and those
    that can't bring a pair to the threshold aren't scored. What remains is joined to the profiles.
    """
    floor = name_floor(threshold)
    able = name_candidates(left.select(F.col(f"{a}name").alias("a")).distinct(), right.select(F.col(f"{b}name").alias("b")).distinct(), floor)
    names = able.repartition("a", "b").withColumn("_n", text.token_set_udf(text.spaced(F.col("a")), text.spaced(F.col("b")))).where(F.col("_n") >= floor)
    names = written(names.select(F.col("a").alias(f"{a}name"), F.col("b").alias(f"{b}name"), "_n"), "names")
    met = left.join(names, f"{a}name").join(right, f"{b}name")
    docs = met.select(f"{a}docstring", f"{b}docstring").where((F.col(f"{a}docstring") != "") & (F.col(f"{b}docstring") != "")).distinct()
    docs = docs.withColumn("_d", text.token_set_udf(f"{a}docstring", f"{b}docstring"))
    sigs = met.select(f"{a}signature", f"{b}signature").distinct()
    sigs = sigs.withColumn("_s", shapes.shape_score(shapes.shape_udf(f"{a}signature"), shapes.shape_udf(f"{b}signature")))
    whole = met.join(docs, [f"{a}docstring", f"{b}docstring"], "left").join(sigs, [f"{a}signature", f"{b}signature"])
    scored = whole.withColumn("score", pair_score(F.col("_n"), F.col("_d"), F.col("_s")))
    return scored.where(F.col("score") >= threshold).drop("_n", "_d", "_s")


def linked_classes(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records in classes of equal ones, each known by its least record, and what links the classes.

    Classes: class, last, count and the columns of ``KEY``; members: ord, class; links: i, j, score (of a record of
    class i before one of class j). The score depends on the order of a pair only through its signatures, so classes
    are paired both ways.
    """
    held = records.select("ord", *KEY)
    classes = written(held.groupBy(*KEY).agg(F.min("ord").alias("class"), F.max("ord").alias("last"), F.count("*").alias("count")), "classes")
    members = held.alias("h").join(classes.alias("c"), reduce(and_, [F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}")) for k in KEY])).select("ord", "class")
    a, b = (classes.select(*[F.col(k).alias(f"{p}{k}") for k in [*KEY, "class"]]) for p in ("a_", "b_"))
    links = scored_profiles(a, b, "a_", "b_", threshold).select(F.col("a_class").alias("i"), F.col("b_class").alias("j"), "score")
    return classes, members, written(links, "links")


def class_edges(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs of records that score at least the threshold, by class: i, j, score.

    A row without a score says that record i is of class j; one with a score, that each record of class i is linked
    with every one of class j that comes after it, and there is such a pair. All pairs follow from these rows, of
    which there is one for each record and one for each link between classes.
    """
    classes, members, links = linked_classes(records, threshold)
    real = links.join(classes.select(F.col("class").alias("j"), "last"), "j").where("i < last")
    return members.select(F.col("ord").alias("i"), F.col("class").alias("j"), F.lit(None).cast("double").alias("score")).unionByName(real.select("i", "j", "score"))


def pair_edges(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``class_edges`` written out, for small inventories: pairs of records (by ``ord``, i before j), score."""
    _, members, links = linked_classes(records, threshold)
    left, right = (members.select(F.col("ord").alias(n), F.col("class").alias(f"{n}_class")) for n in "ij")
    pairs = links.select(F.col("i").alias("i_class"), F.col("j").alias("j_class"), "score")
    return left.join(pairs, "i_class").join(right, "j_class").where("i < j").select("i", "j", "score")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (i, j): node, component, the least node of it.

    Each round takes the least label around, then the label of that label; it is written to the
    shared folder, and the rounds end when no label moves.
    """
    both = written(edges.select(F.col("i").alias("node"), F.col("j").alias("other")).unionByName(edges.select(F.col("j").alias("node"), F.col("i").alias("other"))).distinct(), "both-ways")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "components")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        low = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("low"))
        step = low.join(labels.select(F.col("node").alias("low"), F.col("component").alias("far")), "low")
        new = written(step.select("node", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("component")).alias("moved")), "components")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def greedy_linkage(edges: list[tuple[float, int, int]]) -> list[tuple[list[int], float]]:
    """Complete-linkage clusters of one component's edges: (members, mean score of their pairs).

    Best edges first; a node joins a cluster only if it has an edge to every member; two clusters are
    never merged.
    """
    score = {(i, j): s for s, i, j in edges}
    home: dict[int, int] = {}
    members: list[list[int]] = []

    def linked(node: int, cluster: int) -> bool:
        return all((min(node, m), max(node, m)) in score for m in members[cluster])

    for _, i, j in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if i not in home and j not in home:
            home[i] = home[j] = len(members)
            members.append([i, j])
        elif (i in home) != (j in home):
            inside, outside = (i, j) if i in home else (j, i)
            if linked(outside, home[inside]):
                home[outside] = home[inside]
                members[home[inside]].append(outside)
    out = []
    for m in members:
        own = sorted(m)
        values = [score[p, q] for k, p in enumerate(own) for q in own[k + 1 :]]
        out.append((own, round(sum(values) / len(values), 2)))
    return out


def profile_linkage(own: dict[int, list[int]], score: dict[tuple[int, int], float]) -> list[tuple[list[int], float]]:
    """The clusters of ``greedy_linkage`` from profiles, without a list of the edges of their records.

    ``own``: the records of each profile, in order; ``score``: of a record of the first profile before one of
    the second, where it links them. What a cluster requires of a record follows from its profiles and from
    the first and last record of each.
    """
    profile = {r: p for p, rs in own.items() for r in rs}
    levels: dict[float, dict[int, list[int]]] = {}
    for (p, q), s in score.items():
        levels.setdefault(s, {}).setdefault(p, []).append(q)
    free = {p: set(rs) for p, rs in own.items()}
    home: dict[int, int] = {}
    members: list[dict[int, list[int]]] = []

    def fits(node: int, cluster: int) -> bool:
        q = profile[node]
        return all((rs[0] > node or (p, q) in score) and (rs[-1] < node or (q, p) in score) for p, rs in members[cluster].items())

    def put(node: int, cluster: int) -> None:
        home[node] = cluster
        insort(members[cluster].setdefault(profile[node], []), node)
        free[profile[node]].discard(node)

    for s in sorted(levels, reverse=True):
        for i in sorted(r for p in levels[s] for r in own[p]):
            seconds = levels[s][profile[i]]
            after = i
            if i not in home:
                refused = set()
                for j in merge(*(own[q][bisect_right(own[q], i) :] for q in seconds)):
                    if j not in home:
                        members.append({})
                        put(i, len(members) - 1)
                        put(j, home[i])
                    elif home[j] not in refused:
                        if fits(i, home[j]):
                            put(i, home[j])
                        else:
                            refused.add(home[j])
                    if i in home:
                        after = j
                        break
            if i in home:
                for j in sorted(r for q in seconds for r in free[q] if r > after):
                    if fits(j, home[i]):
                        put(j, home[i])
    out = []
    for m in members:
        cents = 0
        for p, ps in m.items():
            for q, qs in m.items():
                count = sum(len(qs) - bisect_right(qs, r) for r in ps)
                cents += count * round(100 * score[p, q]) if count else 0
        nodes = sorted(r for rs in m.values() for r in rs)
        out.append((nodes, round(cents / (50 * len(nodes) * (len(nodes) - 1)), 2)))
    return out


def class_linkage(size: dict[int, int], second: dict[int, int], score: dict[tuple[int, int], float]) -> list[tuple[list[int], float]]:
    """The clusters of ``profile_linkage`` by class, where links go both ways alike and copies link with 100.

    ``size``: the records of each class; ``second``: the next record after the first, of those with more than one;
    ``score``: by classes, the lesser first. All copies of a class then join a cluster right after its first
    record, as they have the same links, and of the edges of two classes only the first can change anything.
    """
    edges = [(-s, i, j, j) for (i, j), s in score.items()] + [(-100.0, i, j, i) for i, j in second.items()]
    home: dict[int, int] = {}
    members: list[list[int]] = []
    for _, i, _, j in sorted(edges):
        if i not in home and j not in home:
            home[i] = home[j] = len(members)
            members.append([i, j] if i != j else [i])
        elif (i in home) != (j in home):
            inside, outside = (i, j) if i in home else (j, i)
            if all((min(outside, m), max(outside, m)) in score for m in members[home[inside]]):
                home[outside] = home[inside]
                members[home[inside]].append(outside)
    out = []
    for m in members:
        own, n = sorted(m), sum(size[c] for c in m)
        cents = sum(10_000 * (size[c] * (size[c] - 1) // 2) for c in own)
        cents += sum(size[p] * size[q] * round(100 * score[p, q]) for k, p in enumerate(own) for q in own[k + 1 :])
        out.append((own, round(cents / (50 * n * (n - 1)), 2)))
    return out


def assign_clusters(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Clusters of numbered records: cluster (its least member), node, score.

    Each connected component of classes is linked by itself: edges of different ones never meet in the linkage.
    Where links go both ways alike and copies link with 100, classes are linked and their records follow; the
    records of any other component are linked one by one.
    """
    classes, members, links = linked_classes(records, threshold)
    labels = components(links.select("i", "j"))
    back = links.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("score").alias("back"))
    uneven = links.join(back, ["i", "j"], "left").where("NOT score <=> back").select(F.col("i").alias("node"))
    copied = links.where("i = j AND score = 100").select(F.col("i").alias("class"))
    loose = classes.where("count > 1").join(copied, "class", "left_anti").select(F.col("class").alias("node"))
    odd = labels.join(uneven.unionByName(loose), "node", "left_semi").select("component").distinct()
    labels = written(labels.join(odd.withColumn("odd", F.lit(True)), "component", "left").select("node", "component", F.coalesce("odd", F.lit(False)).alias("odd")), "components")
    pairs = links.join(labels.select(F.col("node").alias("i"), F.col("component").alias("part"), F.col("odd").alias("apart")), "i")
    owned = members.withColumnRenamed("class", "node").join(labels, "node")
    after = owned.where("NOT odd AND ord > node").groupBy("node").agg(F.min("ord").alias("second"))
    sized = labels.where("NOT odd").join(classes.select(F.col("class").alias("node"), "count"), "node").join(after, "node", "left")

    def by_class(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(left["node"].tolist(), left["count"].tolist(), strict=True))
        second = {n: int(s) for n, s in zip(left["node"].tolist(), left["second"].tolist(), strict=True) if size[n] > 1}
        found = class_linkage(size, second, dict(zip(zip(right["i"].tolist(), right["j"].tolist(), strict=True), right["score"].tolist(), strict=True)))
        return pd.DataFrame([(m[0], n, s) for m, s in found for n in m], columns=["cluster", "node", "score"])

    def by_record(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = {int(p): sorted(x.tolist()) for p, x in left.groupby("node")["ord"]}
        found = profile_linkage(own, dict(zip(zip(right["i"].tolist(), right["j"].tolist(), strict=True), right["score"].tolist(), strict=True)))
        return pd.DataFrame([(m[0], n, s) for m, s in found for n in m], columns=["cluster", "node", "score"])

    kind = "cluster bigint, node bigint, score double"
    even = sized.groupBy("component").cogroup(pairs.where("NOT apart AND i < j").groupBy("part")).applyInPandas(by_class, kind)
    alone = owned.where("odd").groupBy("component").cogroup(pairs.where("apart").groupBy("part")).applyInPandas(by_record, kind)
    return members.join(written(even, "class-clusters").withColumnRenamed("node", "class"), "class").select("cluster", F.col("ord").alias("node"), "score").unionByName(alone)


def placed(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each numbered record of a cluster: its columns, cluster, score and size."""
    found = written(assign_clusters(records, threshold), "clusters")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
    return found.join(sizes, "cluster").withColumnRenamed("node", "ord").join(records, "ord")


def find_clusters(records: DataFrame, threshold: float = THRESHOLD, limit: int | None = None) -> DataFrame:
    """Clusters, largest and tightest first: members (array of records in natural order), score, size."""
    numbered = records if "ord" in records.columns else with_ordinal(records)
    fields = [c for c in numbered.columns if c not in ("ord", "seq")]
    placed = assign_clusters(numbered, threshold).join(numbered.withColumnRenamed("ord", "node"), "node")
    member = F.struct("node", *fields)
    grouped = placed.groupBy("cluster").agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("score").alias("score"))
    clean = F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    out = grouped.select(clean.alias("members"), "score", F.size("m").alias("size"))
    ordered = out.orderBy(F.desc("size"), F.desc("score"), F.col("members")[0]["file"], F.col("members")[0]["line"])
    return ordered if limit is None else ordered.limit(max(0, limit))
