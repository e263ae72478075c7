"""Life of a graph: resolution, folding, supersession, walks, deletion, ingest, retrieval."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import is_phrase, is_referring, normal_predicate
from graphloom.operators import communities, errors, extract, lifecycle, relations, resolve, schema, scope, traverse
from graphloom.plans.retrieve import Ask, Graph, answers, contexts, retrieve
from graphloom.sources.files import Store, read_texts, read_transcripts, render_sessions, write_csv
from graphloom.sources.providers import Failover, Replay, Retryable, completed
from graphloom.streaming.ingest import event_windows, merge_batches, superseding_stream

M = "realm string, space string, pos bigint, id bigint, name string, type string, description string, aliases array<string>"
A = "realm string, space string, from_id bigint, relation_type string, to_id bigint, pos bigint, t string"


def mentions(spark, *rows):
    return spark.createDataFrame([("r", "s", i, i, *x) for i, x in enumerate(rows)], M)


def test_aliases_take_the_fuller_name(spark):
    df = mentions(spark, ("Ada", "Concept", "x", []), ("Ada Lovelace", "Person", "longer text", ["Ada"]), ("ADA", None, None, []))
    for way in (resolve.resolve_ordered, resolve.resolve_components):
        (one,) = way(df).collect()
        assert one["name"] == "Ada Lovelace" and one["type"] == "Person" and one["description"] == "longer text" and "Ada" in one["aliases"]


def test_spaces_do_not_mix(spark):
    df = mentions(spark, ("Ada", "P", "x", [])).unionByName(mentions(spark, ("Ada", "P", "x", [])).withColumn("space", F.lit("t")))
    assert resolve.resolve_ordered(df).count() == 2 == resolve.resolve_components(df).count()


def assertions(spark, *kinds):
    return spark.createDataFrame([("r", "s", 1, k, 2, i, f"2024-01-0{i + 1}") for i, k in enumerate(kinds)], A)


def test_supersession_opens_again(spark):
    got = {r["relation_type"]: r["superseded_by"] for r in relations.supersede(assertions(spark, "friend", "enemy", "friend"), [["friend", "enemy"]]).collect()}
    assert got == {"friend": None, "enemy": "friend"}
    strict = {r["relation_type"]: r["superseded_by"] for r in relations.supersede_strict(assertions(spark, "friend", "enemy", "friend"), [["friend", "enemy"]]).collect()}
    assert strict == {"friend": "enemy", "enemy": "friend"}


def test_first_close_stays(spark):
    got = {r["relation_type"]: (r["superseded_by"], r["t_expired"]) for r in relations.supersede(assertions(spark, "a", "b", "c"), [["a", "b", "c"]]).collect()}
    assert got == {"a": ("b", "2024-01-02"), "b": ("c", "2024-01-03"), "c": (None, None)}


def test_deletion_cascades(spark):
    rel = spark.createDataFrame([], schema.RELATIONS)
    row = {f.name: None for f in rel.schema} | {"realm": "r", "space": "s", "id": 1, "from_id": 1, "to_id": 2, "sources": [1, 2], "weight": 2}
    rel = spark.createDataFrame([row, row | {"id": 2, "sources": [1], "weight": 1}], rel.schema)
    ent = spark.createDataFrame([{f.name: None for f in spark.createDataFrame([], schema.ENTITIES).schema} | {"realm": "r", "space": "s", "id": i, "name": str(i)} for i in (1, 2)], schema.ENTITIES)
    men = spark.createDataFrame([("r", "s", 1, 1), ("r", "s", 2, 2)], schema.MENTIONS)
    chunks = spark.createDataFrame([("r", "s", 1, "d1"), ("r", "s", 2, "d2")], "realm string, space string, id bigint, doc_key string")
    out = lifecycle.delete_document("d1", chunks, men, rel, ent, F.lit("2025-01-01").cast("timestamp_ntz"))
    left = {r["id"]: (r["weight"], r["dormant_since"] is None) for r in out["relations"].collect()}
    assert left == {1: (1, True), 2: (1, False)}
    assert {r["id"]: r["dormant_since"] is None for r in out["entities"].collect()} == {1: False, 2: True}
    assert out["documents"].count() == 1 == out["doc_mentions"].count()
    woken = lifecycle.refresh_dormancy(out["entities"], men, F.current_timestamp().cast("timestamp_ntz"))
    assert woken.where("dormant_since is not null").count() == 0


def chain(spark):
    return spark.createDataFrame([("r", "s", 10 + i, i, i + 1, "next") for i in range(1, 5)], "realm string, space string, id bigint, from_id bigint, to_id bigint, relation_type string")


def test_more_hops_reach_further(spark):
    seeds = spark.createDataFrame([(7, 1)], "query_id bigint, seed bigint")
    at = lambda h: {r["id"]: r["hops"] for r in traverse.neighbourhood(seeds, chain(spark), h).collect()}
    assert at(1) == {11: 1} and at(3) == {11: 1, 12: 2, 13: 3}
    assert {r["id"] for r in traverse.neighbourhood(seeds, chain(spark), 3, most=2).collect()} == {11, 12}


def test_validation_drops_what_says_nothing(spark):
    one = {"entities": [{"name": "he", "type": "x"}, {"name": " Bolt ", "aliases": ["bolt", "B"]}], "triples": [{"subject": "A", "predicate": "Was Born-in", "object": "B", "valid_from": "1820"}, {"subject": "A", "predicate": "x", "object": "a"}, {"subject": "it", "predicate": "x", "object": "B"}, {"subject": "A", "predicate": "y", "object": "B", "confidence": 0.1}]}
    df = spark.createDataFrame([(1, "```json\n" + json.dumps(one) + "\n```"), (2, "no json")], "id int, reply string").select("id", extract.parse_extraction(F.col("reply")).alias("extraction"))
    (e,) = extract.entity_rows(df).collect()
    assert (e["name"], e["type"], e["aliases"]) == ("Bolt", "Concept", ["B"])
    (t,) = extract.triple_rows(df, extract.Rules(least_confidence=0.5)).collect()
    assert (t["predicate"], t["valid_from"], t["confidence"]) == ("born_in", "1820", 1.0)
    with pytest.raises(errors.ExtractionError):
        extract.require_progress(0, 3)
    extract.require_progress(1, 3)


def test_names(spark):
    df = spark.createDataFrame([("my brother",), ("my very old brother",), ("Tom and Jerry",), ("$ 3 million",), ("Tom",), ("",), (None,)], "n string")
    got = [(r[0], r[1]) for r in df.select(is_referring(F.col("n")), is_phrase(F.col("n"))).collect()]
    assert got == [(True, False), (False, False), (False, True), (False, True), (False, False), (True, False), (True, False)]
    assert spark.range(1).select(normal_predicate(F.lit(" Is--Married to "))).first()[0] == "married_to"


def test_scope(spark):
    df = chain(spark)
    assert scope.in_scope(df, "r", scope.ALL).count() == 4 and scope.in_scope(df, "r", "x").count() == 0
    with pytest.raises(ValueError):
        scope.space_for(scope.ALL, None, "d")
    with pytest.raises(errors.SchemaError):
        schema.check_width(spark.createDataFrame([([1.0],)], "embedding array<float>"), 2)


def test_providers(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        raise Retryable("busy")

    f = Failover([("a", flaky), ("b", Replay({"p": "yes"}))], tries=2, sleep=lambda s: None)
    assert f.complete("p") == "yes" and len(calls) == 2 and f.served == {"b": 1}
    assert "".join(f.stream("p", 2)) == "yes"
    with pytest.raises(errors.ProviderError):
        f.complete("q")
    df = spark.createDataFrame([("p",), ("q",)], "prompt string").select(completed(lambda: Failover([("b", Replay({"p": "yes"}))]), F.col("prompt")).alias("c")).select("c.*")
    assert [(r["reply"], r["error"] is None) for r in df.collect()] == [("yes", True), (None, False)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/02_b.txt").write_text("two\nlines")
    (tmp_path / "in/a.txt").write_text("one")
    got = {r["name"]: (r["position"], r["text"]) for r in read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"02_b.txt": (2, "two\nlines"), "a.txt": (None, "one")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/tech-ABC-2021-q3.json").write_text(json.dumps({"company_name": "Abc", "raw_content": "raw"}))
    (r,) = read_transcripts(spark, str(tmp_path / "t")).collect()
    assert (r["sector"], r["code"], r["year"], r["quarter"], r["text"]) == ("tech", "ABC", 2021, "q3", "raw")
    assert write_csv(spark.range(3), str(tmp_path / "csv"), 3) == 3
    turns = spark.createDataFrame([(1, 2, "user", "b", "2024"), (1, 1, "sys", "a", "2024")], "c int, turn int, role string, text string, d string")
    assert render_sessions(turns, ["c"], "d").first()["text"] == "[Conversation on 2024]\nsys: a\nuser: b"


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("007", "1", 5)], "realm string, space string, id bigint")
    assert s.write("t", df) == 0 and s.write("t", s.read("t").unionByName(df.withColumn("realm", F.lit("b")))) == 1
    assert {tuple(r) for r in s.read("t").select("realm", "space", "id").collect()} == {("007", "1", 5), ("b", "1", 5)}
    s.drop_realm("b")
    assert s.read("t").count() == 1
    with pytest.raises(errors.SchemaError):
        s.read("none")


FOLD = "realm string, space string, from_id bigint, relation_type string, to_id bigint, pos bigint, t string, source bigint, description string, negated boolean, confidence double, valid_from string, valid_to string"


def test_stream_is_the_batch(spark, tmp_path):
    rows = [("r", "s", 1, k, 2, i, f"t{i}", i, "d", False, 1.0, None, None) for i, k in enumerate(["friend", "enemy", "friend", "likes", "enemy"])]
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "store"))
    groups = [["friend", "enemy"]]
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, FOLD).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(FOLD).parquet(str(src))
        merge_batches(stream, store, str(tmp_path / "cp"), groups).awaitTermination()
    got = store.read("relations")
    whole = spark.createDataFrame(rows, FOLD)
    want = relations.fold(whole).join(relations.supersede(whole, groups).select(*relations.EDGE, "superseded_by", "t_expired"), relations.EDGE)
    cols = ["relation_type", "weight", "superseded_by", "t_expired", "sources"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_supersession_as_state(spark, tmp_path):
    src = tmp_path / "src"
    assertions(spark, "friend", "enemy", "friend").coalesce(1).write.parquet(str(src))
    q = superseding_stream(spark.readStream.schema(A).parquet(str(src)), [["friend", "enemy"]]).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["relation_type"], r["superseded_by"], r["t_expired"]) for r in spark.table("closed").orderBy("t_expired").collect()]
    assert got == [("friend", "enemy", "2024-01-02"), ("enemy", "friend", "2024-01-03")]


def test_windows_drop_late_rows(spark, tmp_path):
    ddl = "ts timestamp, relation_type string"
    for i, hours in enumerate(([0, 5], [1, 9])):
        spark.createDataFrame([(h, "a") for h in hours], "h int, relation_type string").selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) as ts", "relation_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
        q = event_windows(spark.readStream.schema(ddl).parquet(str(tmp_path / "src"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["start"].hour for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 5]


class Letters:
    width = 3

    def embed(self, texts):
        import numpy as np

        return np.array([[t.lower().count(c) + 0.1 for c in "abc"] for t in texts]).reshape(-1, 3)


def small_graph(spark):
    none = "cast(null as timestamp_ntz) dormant_since"
    ent = spark.sql(f"select 'r' realm, 's' space, id, name, 'T' type, name description, {none}, e embedding from values (1L, 'aaaa', array(1f, 0f, 0f)), (2L, 'bbbb', array(0f, 1f, 0f)), (3L, 'cccc', array(0f, 0f, 1f)) as t(id, name, e)")
    rel = spark.sql("select 'r' realm, 's' space, id, f from_id, t to_id, k relation_type, d description, 1 weight, n negated, 1.0D confidence, cast(null as string) valid_from, cast(null as string) valid_to, cast(null as string) t_created, cast(null as string) t_expired, cast(null as bigint) superseded_by, e embedding from values (10L, 1L, 2L, 'likes', 'rare 737-9 part', false, array(1f, 1f, 0f)), (11L, 2L, 3L, 'owns', 'x', true, array(0f, 1f, 1f)) as t(id, f, t, k, d, n, e)")
    chunks = spark.sql("select 'r' realm, 's' space, id, x text, 'doc' doc_key, e embedding from values (100L, 'about a', array(1f, 0f, 0f)), (101L, 'about c', array(0f, 0f, 1f)) as t(id, x, e)")
    men = spark.sql("select 'r' realm, 's' space, f from_id, t to_id from values (101L, 1L) as t(f, t)")
    com = spark.sql("select 'r' realm, 's' space, 1L id, 'T1' title, 'S' summary, 5.0D rating, 3 size, array(1f, 0f, 0f) embedding")
    return Graph(ent, rel, chunks, men, com, Letters())


@pytest.mark.parametrize("mode,counts", [("naive", (0, 0, 1, 0)), ("local", (1, 2, 2, 0)), ("mix", (1, 2, 2, 0)), ("global", (0, 2, 0, 1)), ("hybrid", (1, 2, 2, 1)), ("bypass", (0, 0, 0, 0))])
def test_modes(spark, mode, counts):
    q = spark.createDataFrame([(1, "aaaa 737-9?")], "query_id bigint, text string")
    ask = Ask(mode=mode, k=1, hops=2)
    f = retrieve(q, small_graph(spark), ask)
    assert (f.entities.count(), f.triples.count(), f.chunks.count(), f.communities.count()) == counts
    (row,) = contexts(q, f, ask).collect()
    if mode == "mix":
        assert "--[NOT owns (weight=1)]-->" in row["relations"] and row["passages"].startswith("Chunk [1] (doc): about a")
        assert answers(q, f, lambda p: F.length(p), ask).first()["answer"] > 0
    if mode == "bypass":
        assert row["prompt"] == "aaaa 737-9?"


def test_unknown_mode():
    with pytest.raises(ValueError):
        Ask(mode="other")


def test_star_is_the_whole_graph(spark, sf):
    """Customers and orders are in the graph that questions are put to, and relations have vectors, so that the quota has a second list."""
    from dataclasses import replace

    from graphloom.plans import fusion_queries as q
    from graphloom.plans import testgraph as g
    from graphloom.plans.retrieve import Ask, retrieve

    star = q.star(spark, sf)
    assert sorted(r[0] for r in star.entities.select("id").collect()) == sorted(r[0] for r in g.nodes(spark, sf).select("id").collect())
    assert sorted(r[0] for r in star.relations.select("id").collect()) == sorted(r[0] for r in g.relations(spark, sf).select("id").collect())
    assert star.relations.where("embedding is null or size(embedding) <> 32").count() == 0
    asked = spark.createDataFrame([(1, "who ordered the small ring in canada?")], "query_id bigint, text string")
    ask = Ask(mode="local", merge="quota")
    edges = lambda graph, a: [r[0] for r in retrieve(asked, graph, a).triples.orderBy("pos").select("edge_id").collect()]
    with_vectors = edges(star, ask)
    assert set(with_vectors) - set(edges(replace(star, relations=star.relations.drop("embedding")), ask))


def test_documents_are_indexed_in_batches(spark):
    """Two batches: a document that stays, one that changes, one that is new; replies are made from the text, "A > verb > B" on each line."""
    from graphloom.operators import indexing

    def extractor(text, names):
        parts = F.transform(F.split(text, "\n"), lambda line: F.split(line, " > "))
        entities = F.flatten(F.transform(parts, lambda p: F.transform(F.array(p[0], p[2]), lambda n: F.struct(n.alias("name"), F.lit("Person").alias("type"), F.concat(F.lit("known: "), F.size(names).cast("string")).alias("description"), F.array().cast("array<string>").alias("aliases")))))
        triples = F.transform(parts, lambda p: F.struct(p[0].alias("subject"), p[1].alias("predicate"), p[2].alias("object")))
        return F.to_json(F.struct(entities.alias("entities"), triples.alias("triples")))

    docs = lambda *rows: spark.createDataFrame([("r", "s", *x) for x in rows], "realm string, space string, doc_key string, pos bigint, text string")
    lines = lambda text: [text] if text else []
    run = lambda d, s, t: indexing.index_documents(d, s, extractor, t, chunker=lines)
    groups = [["friend_of", "enemy_of"]]
    one, plan = run(docs(("a", 1, "Ada > friend_of > Bob"), ("b", 2, "Bob > knows > Cyd\nCyd > knows > Ada"), ("n", 3, None)), indexing.empty(spark), "2024-01-01")
    assert {(r["doc_key"], r["action"]) for r in plan.collect()} == {("a", "new"), ("b", "new")}
    ids = {r["name"]: r["id"] for r in one.entities.collect()}
    assert set(ids) == {"Ada", "Bob", "Cyd"} and one.mentions.count() == 5
    two, plan = run(docs(("a", 4, "Ada > friend_of > Bob"), ("b", 5, "Bob > knows > Dan"), ("c", 6, "ADA > enemy_of > bob")), one, "2024-02-01")
    assert {(r["doc_key"], r["action"]) for r in plan.collect()} == {("a", "unchanged"), ("b", "replaced"), ("c", "new")}
    after = {r["name"]: r for r in two.entities.collect()}
    assert {n: after[n]["id"] for n in ids} == ids and after["Cyd"]["dormant_since"] == "2024-02-01" and after["Ada"]["dormant_since"] is None
    assert after["Dan"]["description"] == "known: 3", "names of the first batch go to the second"
    names = {r["id"]: n for n, r in after.items()}
    got = {(names[r["from_id"]], r["relation_type"], names[r["to_id"]]): (r["superseded_by"], r["weight"]) for r in two.relations(groups).collect()}
    assert got == {("Ada", "friend_of", "Bob"): ("enemy_of", 1), ("Ada", "enemy_of", "Bob"): (None, 1), ("Bob", "knows", "Dan"): (None, 1)}
    again, plan = run(docs(("a", 7, "Ada > friend_of > Bob")), two, "2024-03-01")
    assert [r["action"] for r in plan.collect()] == ["unchanged"] and again.assertions.count() == two.assertions.count()


def test_statements_meet_names_only_where_ids_do_not_follow(spark, tmp_path):
    """Aliases, a name that grew and a name in another case lead to one id; the plan sends no statement to another task for it, and a name is trimmed once."""
    from graphloom.functions.text import is_phrase, is_referring
    from graphloom.operators import indexing
    from graphloom.operators.resolve import keys_of, linked

    schema = "realm string, space string, id bigint, name string, aliases array<string>"
    own = lambda n: spark.range(1).select(indexing._id(F.lit("r"), F.lit("s"), F.lit(n))).first()[0]
    entities = spark.createDataFrame([("r", "s", own("bob"), "Bob", []), ("r", "s", own("ada"), "Ada Lovelace", ["Ada", "Countess"]), ("r", "s", 7, "Cyd", ["bob"])], schema)
    triples = spark.createDataFrame([("r", "s", a, b) for a, b in [("ADA", "Bob"), ("ada lovelace", "cyd"), ("Countess", "bob")]], "realm string, space string, subject string, object string")
    odd = keys_of(entities).where(F.col("entity_id") != indexing._id("realm", "space", "key"))
    assert {r["key"] for r in odd.collect()} == {"ada lovelace", "countess", "cyd"}, "bob and ada have the ids of their names"
    triples.write.parquet(str(tmp_path / "t"))
    odd.write.parquet(str(tmp_path / "odd"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    said = indexing._identified(indexing._identified(read("t"), F.broadcast(read("odd")), "subject", "from_id"), F.broadcast(read("odd")), "object", "to_id")
    rows = lambda df: sorted((r["subject"], r["from_id"], r["to_id"]) for r in df.collect())
    assert rows(said) == rows(linked(triples, entities)) and len(rows(said)) == 3
    assert "Exchange hashpartitioning" not in said._jdf.queryExecution().executedPlan().toString()
    plan = read("t").where(~is_referring(F.col("subject")) & ~is_phrase(F.col("subject")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coalesce(subject") <= 2, "once for each of the two; before, once for every rule"


def test_leiden_finds_what_modularity_prefers(spark):
    tri = lambda a, b, c: [(a, b, 1.0), (b, c, 1.0), (a, c, 1.0)]
    edges = tri("a1", "a2", "a3") + tri("b1", "b2", "b3") + [("a1", "b1", 0.1), ("a1", "a1", 5.0), ("a1", "ghost", 1.0)]
    nodes = ["a1", "a2", "a3", "b1", "b2", "b3", "alone"]
    got = communities.leiden(nodes, edges)
    assert got == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1", "alone": "alone"}
    assert len(set(communities.leiden(nodes, edges, resolution=20.0).values())) == 7
    r = random.Random(3)
    many = [f"n{i}" for i in range(60)]
    links = [(a, b, 1.0) for a in many for b in many if a < b and r.random() < (0.5 if int(a[1:]) // 15 == int(b[1:]) // 15 else 0.03)]
    found, planted = communities.leiden(many, links), {n: str(int(n[1:]) // 15) for n in many}
    assert communities.modularity(many, links, found) >= communities.modularity(many, links, planted) - 1e-9
    assert communities.modularity(many, links, found) >= communities.modularity(many, links, communities.propagate(many, links)) - 1e-9
    assert communities.leiden(many, links) == found
    assert communities.accepts_resolution(communities.leiden_communities) and not communities.accepts_resolution(lambda n, e: n)


def test_leiden_in_steps_over_blocks(spark):
    import random
    from collections import defaultdict

    rnd, rows = random.Random(5), []
    for space, size in (("s", 240), ("t", 120)):  # planted groups of fifteen; t has two components
        for _ in range(size * 12):
            a = rnd.randrange(size)
            b = a // 15 * 15 + rnd.randrange(15) if rnd.random() < 0.8 else rnd.randrange(size) % (60 if space == "t" else size) + (a // 60 * 60 if space == "t" else 0)
            if a != b:
                rows.append(("r", space, a, b, rnd.choice([1.0, 0.3, 2.0])))
    edges = spark.createDataFrame(rows, "realm string, space string, src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([("r", s, n) for s, size in (("s", 240), ("t", 120), ("u", 2)) for n in range(size)], "realm string, space string, id bigint")
    found = lambda df, most: {(r["space"], r["node"]): r["community"] for r in communities.leiden_communities(nodes, df, most=most).collect()}
    got = found(edges, 40)
    assert len(got) == 362 and got == found(edges.repartition(7), 40), "one row for each node, whatever the partitions"
    assert got["u", 0] != got["u", 1]
    for space, size in (("s", 240), ("t", 120)):
        links = [(str(a), str(b), w) for _, s, a, b, w in rows if s == space]
        label, planted = {str(n): str(got[space, n]) for n in range(size)}, {str(n): str(n // 15) for n in range(size)}
        assert communities.modularity([], links, label) >= communities.modularity([], links, planted) - 0.01
        around = defaultdict(set)
        for a, b, _ in links:
            if label[a] == label[b]:
                around[a].add(b)
                around[b].add(a)
        for c in set(label.values()):
            todo = [next(n for n in label if label[n] == c)]
            seen = set(todo)
            while todo:
                new = around[todo.pop()] - seen
                seen |= new
                todo += new
            assert seen == {n for n in label if label[n] == c}, "communities are connected"
        if space == "t":
            assert not {label[str(n)] for n in range(60)} & {label[str(n)] for n in range(60, 120)}


def test_community_build_is_a_job(spark):
    e = spark.createDataFrame([("r", "s", i, f"N{i}", "T", "", None if i < 6 else "2024") for i in range(7)], "realm string, space string, id bigint, name string, type string, description string, dormant_since string")
    rel = spark.createDataFrame([("r", "s", k, a, b, "knows", "", 1, False) for k, (a, b) in enumerate([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (5, 6)])], "realm string, space string, id bigint, from_id bigint, to_id bigint, relation_type string, description string, weight int, negated boolean")
    fence = "`" * 3
    reporter = lambda text: communities.parse_report(F.concat(F.lit(fence + 'json\n{"title": "Of '), F.substring_index(text, " ", 2), F.lit('", "summary": "s", "rating": 99}\n' + fence)))
    rows, members = communities.build(e, rel, reporter, built_at=F.lit("2024-05-01 00:00:00").cast("timestamp"), level=1)
    got = rows.collect()
    assert sorted(r["size"] for r in got) == [3, 3] and {r["rating"] for r in got} == {10.0} and {r["level"] for r in got} == {1} and all(r["built_at"] for r in got)
    assert 6 not in {r["entity_id"] for r in members.collect()}, "dormant entities are in no community"
    other = rows.withColumn("space", F.lit("t"))
    both = communities.replaced(rows.unionByName(other), rows.limit(1), rows)
    assert {(r["space"], r["n"]) for r in communities.community_count(both).collect()} == {("s", 1), ("t", 2)}
    assert [r[0] for r in spark.createDataFrame([("no json",), ('{"summary": "x"}',)], "x string").select(communities.parse_report(F.col("x"))).collect()] == [None, None]


def test_frames_headers_and_keywords(spark, tmp_path):
    from graphloom.functions import text
    from graphloom.sources.files import graphml_keywords

    df = spark.createDataFrame([("x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(text.without_license_frame(F.col("t"))).collect()] == ["body", "plain", ""]
    assert spark.range(1).select(text.quarter_header(F.lit("Acme"), F.lit(2023), F.lit("q2"))).first()[0] == "[Acme, quarter 2 of 2023]"
    p = tmp_path / "g.graphml"
    p.write_text('<graphml><graph><edge source="a" target="b"><data key="d9">Trade, war</data><data key="d1">x</data></edge><edge source="b" target="c"><data key="d9">trade</data></edge></graph></graphml>')
    assert {(r["keyword"], r["n"]) for r in graphml_keywords(spark, str(p), "d9").collect()} == {("trade", 2), ("war", 1)}
