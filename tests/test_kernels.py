"""Kernels and list algebra against plain versions of their definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.chunking import pack_paragraphs
from graphloom.functions import vectors
from graphloom.functions.vectors import hash_vector
from graphloom.operators import communities, fuse, knn, lexical, metrics, sweeps
from graphloom.operators.communities import propagate
from graphloom.plans import registry


def triples(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "query_id bigint, pos bigint, src_id string, relation_type string, tgt_id string")


def order(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("pos").collect()]


def test_dedupe_ignores_case_and_keeps_the_first(spark):
    df = triples(spark, [("A", "r", "B"), ("a", "R", "b"), ("A", "s", "B")])
    assert order(fuse.dedupe(df), "relation_type") == [("r",), ("s",)]


def test_agreement_of_channels_wins(spark):
    a = triples(spark, [("x", "r", str(i)) for i in range(4)])
    b = triples(spark, [("x", "r", "9"), ("x", "r", "3")])
    from pyspark.sql import functions as F

    got = order(fuse.reciprocal_rank(a.withColumn("channel", F.lit(0)).unionByName(b.withColumn("channel", F.lit(1)))), "tgt_id")
    scores = {}
    for ch, l in ((0, "0123"), (1, "93")):
        for k, x in enumerate(l, 1):
            s, first = scores.get(x, (0, (ch, k)))
            scores[x] = (s + 1 / (60 + k), first)
    assert [g[0] for g in got] == [x for x, _ in sorted(scores.items(), key=lambda kv: (-round(kv[1][0], 12), kv[1][1]))]
    assert got[0] == ("3",)


@pytest.mark.parametrize("quota", [-1, 0, 0.25, 0.3, 0.5, 0.7, 1, 2])
@pytest.mark.parametrize("sizes", [(0, 3), (3, 0), (5, 2), (2, 7)])
def test_quota_is_the_loop(spark, quota, sizes):
    a, b = [f"t{i}" for i in range(sizes[0])], [f"s{i}" for i in range(sizes[1])]
    q, out, i, j = min(1, max(0, quota)), [], 0, 0
    while i < len(a) or j < len(b):
        if j < len(b) and (i == len(a) or (len(out) + 1) * q > j):
            out.append(b[j])
            j += 1
        else:
            out.append(a[i])
            i += 1
    got = fuse.quota_interleave(triples(spark, [("x", "r", t) for t in a]), triples(spark, [("x", "r", t) for t in b]), quota)
    assert [x for (x,) in order(got, "tgt_id")] == out


def test_budget_stops_at_the_first_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 400), (1, 3, "c")], "query_id int, pos int, line string")
    assert [r["pos"] for r in fuse.token_budget(df, 50).collect()] == [1]


def test_fewer_hops_come_before_the_latest(spark):
    df = spark.createDataFrame([(1, 1, 2, "2024", 9), (1, 2, None, "2020", 1), (1, 3, 1, "2021", 1)], "query_id int, pos int, hops int, asserted_at string, weight int")
    assert [r["hops"] for r in fuse.hop_recency(df).orderBy("pos").collect()] == [1, None, 2]


def test_unreached_stay_at_the_end(spark):
    df = triples(spark, [("a", "r", "b"), ("c", "r", "d")]).selectExpr("*", "if(pos = 1, 7, 1) src_key", "if(pos = 1, 8, 2) tgt_key")
    near = spark.createDataFrame([(1, 2, 0)], "query_id bigint, node int, dist int")
    assert order(fuse.nearest_first(df, near), "src_id") == [("c",), ("a",)]
    assert order(fuse.nearest_first(df, near.where("false")), "src_id") == [("a",), ("c",)]


def plain_mmr(words, ends, trade):
    def red(i, j):
        u = words[i] | words[j]
        s = len(words[i] & words[j]) / len(u) if u else 0.0
        return max(s, fuse.SAME_ENDS) if ends[i][0] and ends[i] == ends[j] else s

    left, out = list(range(len(words))), []
    while left:
        best = max(left, key=lambda i: (trade * (1 - i / len(words)) - (1 - trade) * max((red(i, j) for j in out), default=0.0), -i))
        left.remove(best)
        out.append(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcde"), max_size=4), st.sampled_from(["x", "y", ""])), max_size=9), st.sampled_from([0.0, 0.3, 0.7]))
def test_mmr_is_its_definition(items, trade):
    words, ends = [set(w) for w, _ in items], [(e, e) for _, e in items]
    assert fuse.mmr_order(words, ends, trade) == plain_mmr(words, ends, trade)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abcdef"), max_size=4), st.sampled_from([("", ""), ("x", "y"), ("x", "z"), ("", "y")])), max_size=9), st.floats(0, 0.99))
def test_mmr_with_and_without_a_matrix(items, trade):
    words, ends = [w for w, _ in items], [e for _, e in items]
    want = plain_mmr(words, ends, trade)
    assert fuse.mmr_order(words, ends, trade, dense=0) == want and fuse.mmr_order(words, ends, trade, dense=99) == want


def test_long_lists_are_reordered_in_time():
    import random
    import time

    rnd = random.Random(3)
    words = [set(rnd.choices([f"w{i}" for i in range(60)], k=8)) for _ in range(400)]
    ends = [(f"s{i % 3}", f"t{i % 7}") for i in range(400)]
    start = time.perf_counter()
    got = fuse.mmr_order(words, ends, 0.7)
    took, start = time.perf_counter() - start, time.perf_counter()
    for i, a in enumerate(words):
        for b in words[i:]:
            len(a & b) / len(a | b)
    assert took < time.perf_counter() - start, "less than sets of all pairs take"
    assert sorted(got) == list(range(400))


def test_near_pairs_are_spread_by_their_work(spark, monkeypatch):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(60)], "id bigint, embedding array<double>").coalesce(1)
    asked = df.withColumnRenamed("id", "query_id")
    found = lambda: sorted(map(tuple, knn.nearest(asked, df, 4).collect()))
    want = found()
    assert knn.spread(df, 240).rdd.getNumPartitions() == 1
    monkeypatch.setattr(knn, "WORK", 2000)
    assert knn.spread(df, 240).rdd.getNumPartitions() == 8
    assert found() == want


def test_nearest_relations_hold_the_first_of_each_query(spark):
    from graphloom.operators import traverse

    rnd = random.Random(4)
    rel = spark.createDataFrame([(i, rnd.randrange(8), rnd.randrange(8), rnd.randrange(3)) for i in range(120)], "id bigint, from_id bigint, to_id bigint, weight int")
    seeds = spark.createDataFrame([(q, rnd.randrange(8)) for q in range(5) for _ in range(2)], "query_id bigint, seed bigint")
    order = [F.desc("weight"), F.col("id")]
    got = traverse.nearest_relations(seeds, rel, 2, 6, *order)
    whole = traverse.closest(traverse.neighbourhood(seeds, rel, 2, None))
    assert got.count() < whole.count()

    def first(df):
        rows = sorted((r["query_id"], r["hops"], -r["weight"], r["id"]) for r in df.collect())
        return [r for k, r in enumerate(rows) if k < 6 or rows[k - 6][0] != r[0]]

    assert first(got) == first(whole)


def test_lists_over_several_batches_are_reordered_whole(spark):
    rnd = random.Random(6)
    rows = [(q, p, f"s{rnd.randrange(3)}", f"r{rnd.randrange(4)}{rnd.randrange(4)}", f"t{rnd.randrange(5)}") for q in (None, 1, 2, 3) for p in range(1, 12 + 9 * (q or 0))]
    df = spark.createDataFrame(rows, "query_id bigint, pos bigint, src_id string, relation_type string, tgt_id string").withColumn("description", F.lit(""))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = fuse.diversify(df, 0.6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    terms = {(r["src_id"], r["relation_type"], r["tgt_id"]): set(r["w"]) for r in df.select("*", fuse.triple_terms().alias("w")).collect()}
    for q in (None, 1, 2, 3):
        mine = [r[2:] for r in rows if r[0] == q]
        order_ = plain_mmr([terms[x] for x in mine], [(x[0], x[2]) for x in mine], 0.6)
        assert [tuple(r)[2:5] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["pos"])] == [mine[i] for i in order_]


def test_mmr_sends_a_restatement_back(spark):
    df = triples(spark, [("a", "likes", "b"), ("a", "likes", "b "), ("c", "owns", "d")]).selectExpr("*", "'' description")
    assert order(fuse.diversify(df, 0.5), "src_id") == [("a",), ("c",), ("a",)]
    assert order(fuse.diversify(df, 1.0), "src_id") == [("a",), ("a",), ("c",)]


def test_two_triangles_are_two_communities(spark):
    from graphloom.operators.communities import label_propagation

    e = [(a, b, 1.0) for t in ((1, 2, 3), (11, 12, 13)) for a in t for b in t if a < b] + [(5, 5, 1.0)]
    edges = spark.createDataFrame([("r", "s", *x) for x in e], "realm string, space string, src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([("r", "s", n) for n in (1, 2, 3, 5, 11, 12, 13)], "realm string, space string, id bigint")
    got = {r["node"]: r["community"] for r in label_propagation(nodes, edges).collect()}
    assert len({got[1], got[2], got[3]}) == 1 == len({got[11], got[12], got[13]})
    assert len(set(got.values())) == 3


def test_propagation_by_component_is_propagation_of_all():
    r = random.Random(3)
    for _ in range(50):
        nodes = [str(i) for i in range(14)]
        edges = [(r.choice(nodes), r.choice(nodes), float(r.randint(1, 3))) for _ in range(12)]
        whole = propagate(nodes, edges)
        near = {n: n for n in nodes}
        for _ in nodes:
            for a, b, _w in edges:
                near[a] = near[b] = min(near[a], near[b])
        parts = {}
        for n in nodes:
            parts.setdefault(near[n], []).append(n)
        for part in parts.values():
            own = propagate(part, [e for e in edges if e[0] in part])
            assert all(own[n] == whole[n] for n in part)


def test_chunks_overlap_from_a_sentence():
    line = "The first part goes on for a good while here. Then comes another."
    assert pack_paragraphs("short\n== Heading that is quite long enough, really ==\n" + line) == [line]
    a, b = pack_paragraphs(f"{line}\n{line}", chunk=100, overlap=30)
    assert a == line and b == "Then comes another.\n" + line
    assert pack_paragraphs(None) == [] == pack_paragraphs("")
    long = "x" * 5000
    assert pack_paragraphs(f"{long}\n{line}", overlap=0) == [long, line]


def test_hash_vectors_are_unit_and_deterministic():
    v = hash_vector("Alpha beta", 8)
    assert abs((v * v).sum() - 1) < 1e-12 and (v == hash_vector("alpha  BETA", 8)).all()
    assert not hash_vector("  ", 8).any() and not hash_vector(None, 8).any()


def test_label_propagation_of_the_whole_graph(spark, sf):
    """The query against one sweep over all nodes and relations, without components."""
    from graphloom.operators.communities import cluster_edges, propagate
    from graphloom.plans import registry
    from graphloom.plans import testgraph as g

    nodes = g.nodes(spark, sf)
    edges = [(str(r["src"]), str(r["dst"]), r["weight"]) for r in cluster_edges(g.relations(spark, sf), nodes).collect()]
    ids = [str(r["id"]) for r in nodes.collect()]
    label = propagate(ids, edges)
    number = {x: k for k, x in enumerate(sorted(set(label.values())))}
    got = {str(r["node"]): r["community"] for r in registry.queries()["label_propagation"](spark, sf).collect()}
    assert got == {n: number[label[n]] for n in ids} and len(got) == nodes.count()


def test_sweep_in_steps_is_the_loop(spark):
    rnd = random.Random(5)
    edges = [("r", "s", rnd.randrange(60) * 7, rnd.randrange(60) * 7, rnd.choice([1.0, 0.3, 0.1, 2.0])) for _ in range(150)]
    edges += [("r", "s", 900, 901, 1.0), ("r", "s", 901, 900, 0.3), ("r", "t", 7, 8, 1.0)]
    df = spark.createDataFrame(edges, "realm string, space string, src bigint, dst bigint, weight double")
    want = {}
    for space in "st":
        rows = sorted((str(a), str(b), w) for _, s, a, b, w in edges if s == space)
        want |= {(space, int(n)): label for n, label in communities.propagate(sorted({x for e in rows if e[0] != e[1] for x in e[:2]}), rows).items()}
    loopless = df.where("src <> dst")
    got = sweeps.swept(loopless, loopless.count(), communities.SWEEPS, entries=64)
    assert {(r["space"], r["node"]): r["label"] for r in got.collect()} == want
    nodes = df.selectExpr("realm", "space", "src as id").union(df.selectExpr("realm", "space", "dst as id")).distinct()
    rows = lambda most: sorted(map(tuple, communities.label_propagation(nodes, df, most=most).collect()))
    assert rows(0) == rows(1000)


def test_a_long_chain_takes_too_many_steps(spark):
    df = spark.createDataFrame([("r", "s", 1000 + i, 1001 + i, 1.0) for i in range(80)], "realm string, space string, src bigint, dst bigint, weight double")
    assert sweeps.swept(df, 80, 3) is None
    nodes = spark.range(1000, 1081).selectExpr("'r' as realm", "'s' as space", "id")
    rows = lambda most: sorted(map(tuple, communities.label_propagation(nodes, df, most=most).collect()))
    assert rows(0) == rows(1000)


def test_blocks_of_queries_find_what_broadcast_ones_find(spark):
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, [1e-30] * 4)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    found = lambda **m: sorted(map(tuple, knn.nearest(asked, df, 4, **m).collect()))
    unit = lambda v: (lambda n: [x / n for x in v] if n else v)(sum(x * x for x in v) ** 0.5)
    want = []
    for q, v in rows[::3]:
        d = sorted((round(1 - sum(a * b for a, b in zip(unit(v), unit(x), strict=True)), 6) + 0.0, i) for i, x in rows)
        want += [(q, i, e, r + 1) for r, (e, i) in enumerate(d[:4])]
    assert found() == sorted(want) == found(broadcast_bytes=0)


def test_an_embedder_remembers_and_forgets(monkeypatch):
    monkeypatch.setattr(vectors, "KNOWN", 3)
    e = vectors.TermHashEmbedder(8)
    for batch in (["a b", "", "b c"], ["c d e f", None, "A"], ["a"]):
        assert (e.embed(batch) == [hash_vector(t, 8) for t in batch]).all()
    assert len(e.known) <= 4


@pytest.mark.parametrize("k", [1, 3, 40])
def test_scanned_terms_score_as_joined_ones(spark, k):
    rnd = random.Random(k)
    words = ["ring", "rings", "bolt", "bolted", "plates", "supplying", "the", "of", "Ä1-b", "long_word"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = spark.createDataFrame([(i, text(rnd.randrange(6)) if i % 9 else None) for i in range(200)], "id bigint, text string")
    asked = spark.createDataFrame([(q, text(3)) for q in range(7)] + [(9, "nothing of it"), (10, None)], "query_id bigint, text string")
    rows = lambda **m: sorted(map(tuple, lexical.search(asked, items, k, **m).collect()))
    assert rows() == rows(most_terms=0)


def test_counts_of_mentions_are_the_joins(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PAIRS", 50)
    rnd = random.Random(8)
    ids = [5, 7, 2**33, -4, *range(20, 60)]
    pairs = {(s, rnd.choice(ids) + 1000 * (s == "t"), rnd.randrange(12)) for s in "st" for _ in range(150)}
    mentions = spark.createDataFrame([("r", *p) for p in pairs], "realm string, space string, from_id bigint, to_id bigint")
    chunks = mentions.select("realm", "space", mentions.from_id.alias("id")).distinct()
    seeds = spark.createDataFrame([(q, rnd.randrange(14)) for q in range(9) for _ in range(5)], "query_id bigint, id bigint")
    rows = lambda few: sorted(tuple(r[c] for c in ("query_id", "realm", "space", "id", "hits", "rank")) for r in metrics.chunks_mentioning(seeds, mentions, chunks, 4, few=few).collect())
    assert rows(True) == rows(False)


def test_partitions_follow_the_input(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "SHARE", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    registry.queries()["type_histogram"](spark, sf)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == -(-registry.table_bytes(spark, sf) // 1000)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.undo()
    registry.queries()["type_histogram"](spark, sf)


def test_a_predicate_is_normalised_once(spark):
    from graphloom.functions.text import canonical_predicate, normal_predicate

    df = spark.createDataFrame([("Was Born-in",), (None,), ("",), ("  is__view",), ("viewed by",), ("sign-up",)], "p string")
    once = df.select(canonical_predicate(F.col("p"), {"sign_up": "joined"}, ["joined", "viewed"]).alias("out"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r[0] for r in once.collect()] == ["born_in", "", "", "viewed", "viewed", "joined"]
    assert [r[0] for r in df.select(normal_predicate(F.col("p"))).collect()] == ["born_in", "", "", "view", "viewed_by", "sign_up"]
