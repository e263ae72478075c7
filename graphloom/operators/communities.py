"""Communities: detection, assembly, reports, ranking."""

from __future__ import annotations

import inspect
import random
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import clustering_weight
from graphloom.operators.components import connected_components
from graphloom.operators.moves import joined
from graphloom.operators.sweeps import swept
from graphloom.sources.shared import stored

SCOPE = ["realm", "space"]
SWEEPS = 20
#: Edges that one task sweeps in memory.
ONE_TASK = 1 << 18
REPORT = "struct<title:string,summary:string,rating:double,findings:array<struct<summary:string,explanation:string>>>"
WEIGHTS = (1.0, 0.25, 0.15)


def cluster_edges(relations: DataFrame, entities: DataFrame, damping: float = 0.3) -> DataFrame:
    """(realm, space, src, dst, weight) between entities that are there, negated relations damped; parallel relations add up, loops go."""
    live = entities.select(*SCOPE, F.col("id").alias("src"))
    rows = relations.select(*SCOPE, F.col("from_id").alias("src"), F.col("to_id").alias("dst"), clustering_weight(F.col("weight"), F.col("negated"), damping).alias("weight")).where("src <> dst")
    rows = rows.join(live, [*SCOPE, "src"], "left_semi").join(live.withColumnRenamed("src", "dst"), [*SCOPE, "dst"], "left_semi")
    return rows.groupBy(*SCOPE, "src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(nodes: list[str], edges: list[tuple[str, str, float]], sweeps: int = SWEEPS) -> dict[str, str]:
    """Labels by propagation in sorted order of the nodes: each takes the label of most weight around it, the least of equals, at once; until a sweep changes nothing."""
    around: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        if a != b and a in around and b in around:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    label = {n: n for n in nodes}
    for _ in range(sweeps):
        moved = False
        for n in sorted(around):
            votes: dict[str, float] = {}
            for m, w in around[n].items():
                votes[label[m]] = votes.get(label[m], 0.0) + w
            if votes:
                best = min(votes, key=lambda x: (-votes[x], x))
                moved |= best != label[n]
                label[n] = best
        if not moved:
            break
    return label


def modularity(nodes: list[str], edges: list[tuple[str, str, float]], label: dict[str, str], resolution: float = 1.0) -> float:
    """Weight inside communities less what degrees would give by chance, as a share of all weight."""
    total, inner, degree = 0.0, 0.0, dict.fromkeys(label.values(), 0.0)
    for a, b, w in edges:
        if a != b and a in label and b in label:
            total += w
            degree[label[a]] += w
            degree[label[b]] += w
            inner += w if label[a] == label[b] else 0.0
    return (inner - resolution * sum(d * d for d in degree.values()) / (4 * total)) / total if total else 0.0


def _moved(around: list[dict[int, float]], loops: list[float], resolution: float, order: list[int]) -> list[int]:
    """Nodes move, one by one, to the neighbouring community that gains most, until none does; a node whose neighbour moved is asked again."""
    label = list(range(len(around)))
    degree = [sum(x.values()) + 2 * l for x, l in zip(around, loops, strict=True)]
    held, twice = degree[:], sum(degree) or 1.0
    todo, waiting = deque(order), set(order)
    while todo:
        n = todo.popleft()
        waiting.discard(n)
        weight: dict[int, float] = {label[n]: 0.0}
        for m, w in around[n].items():
            weight[label[m]] = weight.get(label[m], 0.0) + w
        held[label[n]] -= degree[n]
        gain = lambda c: weight[c] - resolution * degree[n] * held[c] / twice  # noqa: E731, B023
        best = max(weight, key=lambda c: (gain(c), c == label[n], -c))
        if best != label[n] and gain(best) <= gain(label[n]) + 1e-12:
            best = label[n]
        held[best] += degree[n]
        if best != label[n]:
            label[n] = best
            for m in around[n]:
                if label[m] != best and m not in waiting:
                    waiting.add(m)
                    todo.append(m)
    return label


def _connected(around: list[dict[int, float]], label: list[int]) -> list[int]:
    """Communities split into their connected parts."""
    out = [-1] * len(label)
    for n in range(len(label)):
        if out[n] < 0:
            out[n], todo = n, [n]
            while todo:
                for m in around[todo.pop()]:
                    if out[m] < 0 and label[m] == label[n]:
                        out[m] = n
                        todo.append(m)
    return out


def joined_up(around: list[dict[int, float]], loops: list[float], resolution: float, seed: int) -> list[int]:
    """The number of each node's community: moves, splits and joins until nothing moves."""
    of, rnd = list(range(len(around))), random.Random(seed)
    while True:
        order = list(range(len(around)))
        rnd.shuffle(order)
        label = _connected(around, _moved(around, loops, resolution, order))
        kept = sorted(set(label))
        if len(kept) == len(around):
            break
        new = {c: k for k, c in enumerate(kept)}
        joined: list[dict[int, float]] = [{} for _ in kept]
        more = [0.0] * len(kept)
        for n, x in enumerate(around):
            a = new[label[n]]
            more[a] += loops[n]
            for m, w in x.items():
                b = new[label[m]]
                if a == b:
                    more[a] += w / 2
                else:
                    joined[a][b] = joined[a].get(b, 0.0) + w
        of, around, loops = [new[label[c]] for c in of], joined, more
    return of


def leiden(nodes: list[str], edges: list[tuple[str, str, float]], resolution: float = 1.0, seed: int = 7) -> dict[str, str]:
    """Communities of great modularity (Traag et al. 2019, with connectivity as the refinement): nodes move, communities that are not connected are split, and
    communities become nodes, until nothing moves. A label is the least node of its community. The order of visits comes from ``seed``."""
    names = sorted(set(nodes))
    number = {n: k for k, n in enumerate(names)}
    around: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in edges:
        if a != b and a in number and b in number:
            x, y = number[a], number[b]
            around[x][y] = around[x].get(y, 0.0) + w
            around[y][x] = around[y].get(x, 0.0) + w
    of = joined_up(around, [0.0] * len(names), resolution, seed)
    least: dict[int, str] = {}
    for n, c in zip(names, of, strict=True):
        least.setdefault(c, n)
    return {n: least[c] for n, c in zip(names, of, strict=True)}


def leiden_communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 7, most: int = ONE_TASK) -> DataFrame:
    """As ``label_propagation``, by ``leiden`` in each connected component; more than ``most`` edges in steps over blocks (``moves.joined``), by the same rule of gain in another order of visits."""
    large = lambda e, n: joined(e, n, resolution, seed, most=most)
    return label_propagation(nodes, edges, kernel=lambda n, e: leiden(n, e, resolution, seed), most=most, large=large)


def label_propagation(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS, kernel: Callable[[list, list], dict] | None = None, most: int = ONE_TASK, large: Callable[[DataFrame, int], DataFrame | None] | None = None) -> DataFrame:
    """(realm, space, node, community) of nodes (realm, space, id) over edges (realm, space, src, dst, weight); ids compare as strings.

    Up to ``most`` edges are swept in one task a space; more of them in steps over blocks (``sweeps.swept``), with the same labels. Where that takes too many steps, and for ``kernel``, another detector of
    (nodes, edges) in the place of ``propagate`` that has no form for ``large`` graphs, connected components, which are found by iterated joins, are swept apart, one task each: labels never leave a component. Nodes without edges
    never reach Python. Communities are numbered from 0 in order of their label.
    """
    edges = stored(edges.where("src <> dst").select(*SCOPE, "src", "dst", "weight"))
    n_edges = edges.count()
    by, inside, labels = list(SCOPE), edges, None
    if kernel is None and large is None:
        large = lambda e, n: swept(e, n, sweeps)
    if large is not None and n_edges > most:
        labels = large(edges, n_edges)
    if labels is None and (kernel is not None or n_edges > most):
        key = lambda c: F.xxhash64(*SCOPE, c)
        parts = connected_components(edges.select(key("src").alias("a"), key("dst").alias("b")))
        by, inside = ["component", *SCOPE], edges.withColumn("node", key("src")).join(parts, "node")
    kernel = kernel or (lambda n, e: propagate(n, e, sweeps))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].astype(str), pdf["dst"].astype(str)
        label = kernel(sorted({*src, *dst}), sorted(zip(src, dst, pdf["weight"].tolist(), strict=True)))
        return pd.DataFrame({"realm": pdf["realm"].iloc[0], "space": pdf["space"].iloc[0], "node": [int(n) for n in label], "label": list(label.values())})

    if labels is None:
        labels = inside.groupBy(*by).applyInPandas(sweep, "realm string, space string, node bigint, label string")
    all_ = nodes.select(*SCOPE, F.col("id").alias("node")).join(labels, [*SCOPE, "node"], "left").withColumn("label", F.coalesce("label", F.col("node").cast("string")))
    numbers = all_.select(*SCOPE, "label").distinct().withColumn("community", (F.row_number().over(Window.partitionBy(*SCOPE).orderBy("label")) - 1).cast("bigint"))
    return all_.join(numbers, [*SCOPE, "label"]).select(*SCOPE, "node", "community")


def accepts_resolution(detector: Callable) -> bool:
    """Whether a detector has a parameter "resolution", or takes any."""
    known = inspect.signature(detector).parameters.values()
    return any(p.name == "resolution" or p.kind is p.VAR_KEYWORD for p in known)


def detect(nodes: DataFrame, edges: DataFrame, detector: Callable[..., DataFrame] | None = None, resolution: float | None = None) -> DataFrame:
    """Communities by a detector of one's own (nodes, edges) -> (realm, space, node, community), which gets ``resolution`` if it has such a parameter; else by label propagation."""
    more = {"resolution": resolution} if detector and resolution is not None and accepts_resolution(detector) else {}
    return (detector or label_propagation)(nodes, edges, **more)


def community_count(communities: DataFrame) -> DataFrame:
    """(realm, space, n) of each space that has communities."""
    return communities.groupBy(*SCOPE).agg(F.count("*").alias("n"))


def parse_report(reply: Column) -> Column:
    """A reporter's JSON reply, fenced or not, as a struct (title, summary, rating, findings); null where it is none or has no title."""
    from graphloom.functions.text import parse_json

    report = parse_json(reply, REPORT)
    rated = F.struct(report["title"].alias("title"), F.coalesce(report["summary"], F.lit("")).alias("summary"), F.least(F.greatest(F.coalesce(report["rating"], F.lit(5.0)), F.lit(0.0)), F.lit(10.0)).alias("rating"), report["findings"].alias("findings"))
    return F.when(F.coalesce(F.trim(report["title"]), F.lit("")) != "", rated)


def replaced(old: DataFrame, new: DataFrame, built: DataFrame) -> DataFrame:
    """``old`` with the spaces of ``built`` (realm, space) replaced by their rows of ``new``: a rebuild of one space leaves the others."""
    return old.join(built.select(*SCOPE).distinct(), SCOPE, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def grouped(assignment: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(realm, space, community, members, size) of communities of at least ``least`` members, the ``most`` largest of each space; equal sizes by number."""
    out = assignment.groupBy(*SCOPE, "community").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size")).where(F.col("size") >= least)
    if most is not None:
        w = Window.partitionBy(*SCOPE).orderBy(F.desc("size"), "community")
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    return out


def inner_relations(relations: DataFrame, assignment: DataFrame) -> DataFrame:
    """Relations whose ends are in one community, with it."""
    a = assignment.select(*SCOPE, F.col("node").alias("from_id"), "community")
    b = assignment.select(*SCOPE, F.col("node").alias("to_id"), F.col("community").alias("other"))
    return relations.join(a, [*SCOPE, "from_id"]).join(b, [*SCOPE, "to_id"]).where("community = other").drop("other")


def rank_communities(hits: DataFrame, k: int, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Hits (query_id, community_id, rating, size, distance) by a blend of similarity, importance and size, each on its own scale; the first k."""
    by = Window.partitionBy("query_id")
    largest = F.log1p(F.max("size").over(by).cast("double"))
    share = F.log1p(F.col("size").cast("double")) / F.when(largest > 0, largest).otherwise(1.0)
    rating = F.least(F.greatest(F.coalesce("rating", F.lit(0.0)), F.lit(0.0)), F.lit(10.0)) / 10
    scored = hits.withColumn("score", F.round(weights[0] * (1 - F.col("distance")) + weights[1] * rating + weights[2] * share, 6))
    w = by.orderBy(F.desc("score"), "distance", "community_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unique_titles(reports: DataFrame) -> DataFrame:
    """Reports (realm, space, pos, title, names) with ``title`` unique: a repeat is followed by the first member the title does not name, else by its number."""
    base = F.trim(F.coalesce(F.nullif("title", F.lit("")), F.lit("Community")))
    n = F.row_number().over(Window.partitionBy(*SCOPE, "base").orderBy("pos"))
    other = F.try_element_at(F.filter("names", lambda x: (F.coalesce(x, F.lit("")) != "") & ~F.contains(F.lower("base"), F.lower(x))), F.lit(1))
    rows = reports.withColumn("base", base).withColumn("n", n).withColumn("other", other)
    title = F.when(F.col("n") == 1, F.col("base")).when(F.col("other").isNotNull(), F.concat("base", F.lit(" ("), "other", F.lit(")"))).otherwise(F.concat("base", F.lit(" #"), F.col("n").cast("string")))
    return rows.withColumn("title", title).drop("base", "n", "other")


def report_input(members: DataFrame, relations: DataFrame, most_entities: int = 60, most_relations: int = 80) -> DataFrame:
    """(realm, space, community, text): what a reporter reads of each community. members: (community, name, line), relations: (community, line, weight, id)."""
    e = members.withColumn("r", F.row_number().over(Window.partitionBy(*SCOPE, "community").orderBy("name", "line"))).where(F.col("r") <= most_entities)
    r = relations.withColumn("r", F.row_number().over(Window.partitionBy(*SCOPE, "community").orderBy(F.desc("weight"), "id"))).where(F.col("r") <= most_relations)
    lines = e.select(*SCOPE, "community", F.lit(0).alias("part"), "r", "line").unionByName(r.select(*SCOPE, "community", F.lit(1).alias("part"), "r", "line"))
    return lines.groupBy(*SCOPE, "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "r", "line"))), lambda x: x["line"]), "\n").alias("text"))


def build(
    entities: DataFrame, relations: DataFrame, reporter: Callable[[Column], Column], *, detector=None, least: int = 2, most: int | None = None, built_at: Column | None = None, level: int = 0, resolution: float | None = None, exclude_dormant: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Communities of the entities that are not dormant, with their reports, level and time of building, and their members. ``reporter`` maps a text column to a struct (title, summary, rating, findings), null where it failed: such communities are left out."""
    from graphloom.functions.text import entity_line, relation_line

    if exclude_dormant and "dormant_since" in entities.columns:
        entities = entities.where("dormant_since is null")
    found = detect(entities, cluster_edges(relations, entities), detector, resolution)
    groups = grouped(found, least, most)
    member = groups.select(*SCOPE, "community", "size", F.explode("members").alias("id"))
    named = member.join(entities.select(*SCOPE, "id", "name", "type", "description"), [*SCOPE, "id"])
    names = entities.select(*SCOPE, "id", "name")
    inner = inner_relations(relations, member.withColumnRenamed("id", "node").select(*SCOPE, "node", "community"))
    inner = inner.join(names.select(*SCOPE, F.col("id").alias("from_id"), F.col("name").alias("src")), [*SCOPE, "from_id"]).join(names.select(*SCOPE, F.col("id").alias("to_id"), F.col("name").alias("tgt")), [*SCOPE, "to_id"])
    lines = report_input(
        named.withColumn("line", entity_line(F.col("name"), F.col("type"), F.col("description"))),
        inner.withColumn("line", relation_line(F.col("src"), F.col("relation_type"), F.col("tgt"), F.col("description"), F.col("negated"), F.col("weight"))),
    )
    told = lines.withColumn("report", reporter(F.col("text"))).where("report is not null").join(groups, [*SCOPE, "community"])
    listed = named.groupBy(*SCOPE, "community").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]).alias("names"))
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("size"), "community")
    rows = told.join(listed, [*SCOPE, "community"]).select(*SCOPE, F.col("community").alias("community_id"), F.row_number().over(w).alias("pos"), "report.*", "names", "size")
    done = unique_titles(rows).drop("names").withColumns({"level": F.lit(level), "built_at": F.current_timestamp() if built_at is None else built_at})
    return done, member.select(*SCOPE, F.col("community").alias("community_id"), F.col("id").alias("entity_id"))


def stale(communities: DataFrame, *tables: DataFrame) -> DataFrame:
    """One row (built, written, stale): whether anything was written after the oldest report."""
    written = None
    for t in tables:
        at = t.select(F.greatest("created_at", "updated_at").alias("at"))
        written = at if written is None else written.unionByName(at)
    return communities.agg(F.min("built_at").alias("built")).crossJoin(F.broadcast(written.agg(F.max("at").alias("written")))).withColumn("stale", F.coalesce(F.col("written") > F.col("built"), F.lit(False)))
