import datetime as dt
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import terms
from tidegraph.functions import text as T
from tidegraph.operators import access, algorithms, catalog, consistency, etl, language, lineage, retrieval, spatial, temporal, traverse, vectors, workflow
from tidegraph.operators.consistency import Link, Property, Schema
from tidegraph.plans import ir
from tidegraph.plans.compile import compile_query
from tidegraph.plans.graph import PropertyGraph
from tidegraph.plans.ir import Filter, Query
from tidegraph.sources import documents, interchange, stores
from tidegraph.streaming import micro_batch


@pytest.fixture(scope="module")
def graph(spark):
    person = spark.createDataFrame([("p1", "Ann", 30, "x"), ("p2", "Bo", None, "x"), ("p3", "Cy", 50, "y")], "id string, name string, age int, project string")
    ship = spark.createDataFrame([("s1", "Sea", "x"), ("s2", "Sky", "y")], "id string, name string, project string")
    on = spark.createDataFrame([("p1", "s1", "x"), ("p2", "s1", "x"), ("p3", "s2", "y")], "src string, dst string, project string")
    knows = spark.createDataFrame([("p1", "p2", "x"), ("p2", "p3", "x"), ("p3", "p3", "y")], "src string, dst string, project string")
    return PropertyGraph({"Person": person, "Ship": ship}, {"ON": on, "KNOWS": knows})


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hops_and_optional(graph):
    q = Query("Person").hop("ON", "Ship").select("n.name", "h1.name").build()
    assert rows(compile_query(graph, q), "n_name", "h1_name") == [("Ann", "Sea"), ("Bo", "Sea"), ("Cy", "Sky")]
    q = Query("Person").hop("ON", "Ship", optional=True, filters=(Filter("name", "=", "Sky"),)).group_by("n.name").agg("count", "h1.id", "k").build()
    assert rows(compile_query(graph, q), "n_name", "k") == [("Ann", 0), ("Bo", 0), ("Cy", 1)]
    q = Query("Person").hop("KNOWS", "Person", "both").count().build()
    assert compile_query(graph, q).first()["count"] == 5


def test_null_order_and_pages(graph):
    q = Query("Person").select("name").order_by("age").build()
    assert [r["n_name"] for r in compile_query(graph, q).collect()] == ["Ann", "Cy", "Bo"]
    q = Query("Person").select("name").order_by("age", True).skip(1).limit(1).build()
    assert [r["n_name"] for r in compile_query(graph, q).collect()] == ["Cy"]


def test_project_scope(graph):
    q = Query("Person").for_project("x").hop("ON", "Ship").count().build()
    assert compile_query(graph, q).first()["count"] == 2


def test_query_problems():
    with pytest.raises(ValueError, match="unknown operator"):
        Query("A").where("x", "like", 1).build()
    with pytest.raises(ValueError):
        Query("A").limit(-1).build()
    assert ir.operator("gte") is ir.Op.GE
    with pytest.raises(ValueError):
        ir.decode_cursor("!!")
    assert ir.decode_cursor(ir.encode_cursor({"a": 1})) == {"a": 1}


def test_three_valued_filters(graph):
    names = lambda op, v=None: [r["n_name"] for r in compile_query(graph, Query("Person").where("age", op, v).select("name").build()).collect()]
    assert names("<>", 30) == ["Cy"] and names("not_in", [30]) == ["Cy"]
    assert names("is_null") == ["Bo"] and names("same", None) == ["Bo"]


def edges(spark, pairs):
    return spark.createDataFrame([(f"e{i}", "T", a, b) for i, (a, b) in enumerate(pairs)], "edge_id string, type string, src string, dst string")


def test_traversals(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x")])
    v = spark.createDataFrame([(i,) for i in "abcdxz"], "id string")
    start = v.where("id = 'a'")
    assert rows(traverse.reach(e, start), "id", "depth") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(traverse.reach(e, start, "both", 1), "id") == [("b",), ("c",)]
    assert rows(traverse.orphans(v, e), "id") == [("z",)]
    assert dict(rows(traverse.degrees(v, e), "id", "degree"))["x"] == 2
    assert rows(traverse.paths(e, start, 1, 4), "id", "length") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    nodes, near = traverse.ego(e, start)
    assert rows(nodes, "id") == [("a",), ("b",), ("c",)] and near.count() == 2
    assert traverse.subgraph(e, start, 1).count() == 3
    good, bad = traverse.attach_edges(spark.createDataFrame([("a", "b"), ("a", "q"), (None, "b")], "src string, dst string"), v)
    assert good.count() == 1 and rows(bad, "missing") == [("source",), ("target",)]


def test_pagerank_against_loop(spark):
    rng = random.Random(1)
    pairs = [(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(40)]
    got = {r["id"]: r["score"] for r in algorithms.pagerank(edges(spark, pairs), 7).collect()}
    ids = {x for p in pairs for x in p}
    score = dict.fromkeys(ids, 1.0)
    for _ in range(7):
        out = {i: sum(1 for a, _ in pairs if a == i) for i in ids}
        score = {i: 0.15 + 0.85 * sum(score[a] / out[a] for a, b in pairs if b == i) for i in ids}
    assert all(math.isclose(got[i], score[i], rel_tol=1e-9) for i in ids)


def test_components_on_a_long_chain(spark):
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)] + [("z", "z"), ("q", "p")]
    got = dict(rows(algorithms.connected_components(edges(spark, pairs)), "id", "component"))
    assert set(got.values()) == {"c000", "z", "p"} and got["c090"] == "c000" and got["q"] == "p"


def test_paths_and_weights(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 5.0), ("a", "c", 2.0), ("c", "d", 1.0), ("a", "d", 9.0)], "src string, dst string, weight double")
    assert algorithms.shortest_path(e, "a", "d").first()["node_ids"] == ["a", "d"]
    best = algorithms.dijkstra(e, "a", "d").first()
    assert best["node_ids"] == ["a", "c", "d"] and best["total_cost"] == 3.0
    assert algorithms.shortest_path(e, "d", "a").count() == 0
    with pytest.raises(ValueError):
        algorithms.dijkstra(e.withColumn("weight", -F.col("weight")), "a", "d")


def test_betweenness_and_communities(spark):
    star = edges(spark, [(a, "hub") for a in "abc"] + [("hub", a) for a in "abc"])
    got = dict(rows(algorithms.betweenness(star), "id", "score"))
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0, "hub": 6.0}
    with pytest.raises(ValueError):
        algorithms.betweenness(star, max_edges=3)
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0")]
    for found in (algorithms.louvain(edges(spark, cliques)), algorithms.label_propagation(edges(spark, cliques))):
        groups = dict(rows(found, "id", "community"))
        assert len(groups) == 10 and len({groups[f"x{i}"] for i in range(1, 5)}) == 1
    named = dict(rows(algorithms.louvain(edges(spark, cliques)), "id", "community"))
    assert set(named.values()) == {"x0", "y0"}


def test_similarity_against_all_pairs(spark):
    rng = random.Random(3)
    sets = {f"n{i}": {f"d{rng.randrange(6)}" for _ in range(rng.randint(1, 4))} | ({"hub"} if i % 3 else set()) for i in range(40)}
    e = edges(spark, [(a, b) for a, s in sets.items() for b in s])
    got = rows(algorithms.node_similarity(e, 0.5, 5), "node1", "node2", "similarity")
    want = []
    for a in sets:
        sims = sorted((-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), b) for b in sets if b != a)
        want += [(a, b, -s) for s, b in [x for x in sims if -x[0] >= 0.5][:5]]
    assert [(a, b, round(s, 9)) for a, b, s in got] == sorted((a, b, round(s, 9)) for a, b, s in want)


def test_time_and_space(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 1, 5), None)], "id int, valid_from timestamp, valid_to timestamp")
    assert rows(df.where(temporal.at_time(dt.datetime(2024, 1, 5))), "id") == [(1,), (2,)]
    assert rows(df.where(temporal.current(dt.datetime(2024, 2, 1))), "id") == [(2,)]
    with pytest.raises(ValueError):
        temporal.between(None, dt.datetime(2024, 1, 1))
    p = spark.createDataFrame([(i, random.Random(i).uniform(-89, 89), random.Random(-i).uniform(-180, 180)) for i in range(1, 200)], "id int, lat double, lon double")
    got = rows(spatial.distance_join(p, p, 900_000), "a", "b")
    brute = p.select(F.col("id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("oa")).join(p.select(F.col("id").alias("b"), "lat", "lon"), F.lit(True))
    assert got == rows(brute.where(spatial.haversine(F.col("la"), F.col("oa"), F.col("lat"), F.col("lon")) < 900_000), "a", "b")


def test_access(spark):
    users = spark.createDataFrame([("u", "ACTIVE"), ("v", "OFF")], "user_id string, status string")
    classes = spark.createDataFrame([("c", 3)], "class_id string, level int")
    granted = access.grants(spark.createDataFrame([("u", "r"), ("v", "r")], "user_id string, role_id string"), spark.createDataFrame([("r", "c")], "role_id string, class_id string"), classes)
    asked = spark.createDataFrame([("u", "c"), ("u", "d"), ("v", "c"), ("w", "c")], "user_id string, class_id string")
    got = rows(access.decide(asked, users, classes, granted), "user_id", "class_id", "reason")
    assert got == [("u", "c", "granted"), ("u", "d", "class not found"), ("v", "c", "user not active"), ("w", "c", "user not found")]
    data = spark.createDataFrame([(1, None), (2, 3), (3, 4)], "id int, level int")
    assert rows(data.where(access.visible("level", 3)), "id") == [(1,), (2,)]
    assert data.where(access.visible("level", None)).count() == 0 and data.where(access.visible("level", 5)).count() == 3


def test_names(spark):
    df = spark.createDataFrame([("Samsung Co., Ltd.",), ("Hyundai Corp.",), ("삼성전자 주식회사",), ("현대상선(주)",), ("㈜한진해운",)], "n string")
    assert [r[0] for r in df.select(T.entity_name(F.col("n"))).collect()] == ["samsung", "hyundai", "삼성전자", "현대상선", "㈜한진해운"]
    assert T.jaro("", "") == 1.0 and T.jaro("abc", "") == 0.0
    assert math.isclose(T.jaro("martha", "marhta"), 0.944444, abs_tol=1e-6) and math.isclose(T.jaro_winkler("martha", "marhta"), 0.961111, abs_tol=1e-6)


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("1", "vessel collision"), ("2", None), ("3", ""), ("4", "vessel collision vessel collision maritime safety")], "id string, text string")
    q = spark.createDataFrame([(1, "vessel collision maritime"), (2, "nothing")], "query_id int, text string")
    got = rows(retrieval.bm25(docs, q), "query_id", "rank", "id")
    assert got == [(1, 1, "4"), (1, 2, "1")]
    assert retrieval.bm25(docs.limit(0), q).count() == 0


def test_vectors(spark):
    rng = random.Random(0)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(99, None), (98, [1.0])], "id int, embedding array<double>")
    got = vectors.search_many(v, v.where("id < 3"), 4)
    for i in range(3):
        q = v.where(F.col("id") == i).first()["embedding"]
        want = [r["id"] for r in vectors.search(v.where("size(embedding) = 8"), q, 4).collect()]
        assert [x[1] for x in rows(got.where(F.col("query_id") == i), "rank", "id")] == want
    zero = spark.createDataFrame([([0.0], [1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in zero.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0]


def test_etl(spark):
    df = spark.createDataFrame([("1", " a ", "x"), ("2", None, "7"), ("3", " ", None)], "id string, name string, n string")
    p = etl.Pipeline("p", (etl.required("name", "gone"), etl.typed(n="int")), (etl.id_normal("id", "k"),))
    bad = {r["id"]: r[etl.ERRORS] for r in p.plan(df)[1].collect()}
    assert bad["1"] == ["missing field: gone", "wrong type: n is no int"] and bad["3"] == ["blank field: name", "missing field: gone"]
    ok = etl.Pipeline("q", (etl.required("name"),), (etl.text_normal("name"), etl.id_normal("id", "k")))
    kept: list = []
    lost: list = []
    assert ok.run(df, lambda x: kept.extend(x.collect()), lambda x: lost.extend(x.collect())) == {"loaded": 1, "failed": 2}
    assert kept[0]["id"] == "k-1" and kept[0]["name"] == "a" and len(lost) == 2
    t = spark.createDataFrame([("2024-02-30",), ("2024년 3월 5일 14시",), ("on 2024/03/05 late",), ("2024-03-05T01:02:03Z",)], "t string")
    got = [r[0] for r in etl.time_normal("t")(t).collect()]
    assert got == ["2024-02-30", "2024-03-05T14:00:00", "2024-03-05T00:00:00", "2024-03-05T01:02:03"]


def test_upsert_merges_properties(spark):
    old = spark.createDataFrame([("a", {"x": "1", "y": "2"})], "k string, properties map<string,string>")
    new = spark.createDataFrame([("a", 1, {"x": "9"}), ("a", 2, {"y": None}), ("b", 1, {"z": "3"}), (None, 1, {"z": "4"})], "k string, o int, properties map<string,string>")
    assert {r["k"]: r["properties"] for r in etl.upsert(old, new, "k", "o").collect()} == {"a": {"x": "9"}, "b": {"z": "3"}}


def test_lineage(spark):
    e = spark.createDataFrame([("derivation", "a", "b", 1), ("derivation", "b", "c", 2), ("creation", "a", None, 0)], "event_type string, src string, dst string, at int")
    kept = lineage.record(e, F.lit("standard"))
    assert rows(kept, "event_type", "dst") == [("creation", "a")]
    all_ = lineage.record(e, F.lit("full"))
    start = spark.createDataFrame([("b",)], "id string")
    assert rows(lineage.ancestors(all_, start), "id") == [("a",)] and rows(lineage.descendants(all_, start), "id") == [("c",)]
    assert lineage.subgraph(all_, start).where("src <> dst").count() == 2
    assert [r["event_type"] for r in lineage.timeline(all_, spark.createDataFrame([("a",)], "id string")).collect()] == ["creation", "derivation"]


def test_schema_checks():
    s = Schema({"Vessel": {"name": Property()}, "Tanker": {"name": Property()}, "Port": {}}, {"AT": Link("Vessel", "Port")}, {"Tanker": "Vessel"})
    assert s.descendants("Vessel") == ["Tanker"] and s.resolve("vessel") == "Vessel"
    assert s.problems(("Crew",)) == ["label Crew is missing", "label Port has no properties"]
    q = Query("vessel").hop("at", "port").limit(3).build()
    assert language.check_query(q, s).score < 0.2
    assert language.check_query(language.correct_query(q, s), s).errors == ()
    assert "doesn't lead" in language.check_query(Query("Port").hop("AT", "Vessel").build(), s).errors[0]
    assert consistency.schema_alignment(s, ["Vessel", "Buoy"]) == (["Port", "Tanker"], ["Buoy"])
    assert ":Tanker a owl:Class ; rdfs:subClassOf :Vessel ." in interchange.turtle(s)


def test_report_survives_a_broken_check(spark):
    report = consistency.run(spark, {"a": lambda: ("PASSED", "INFO", ""), "b": lambda: 1 / 0})
    assert rows(report, "name", "status") == [("a", "PASSED"), ("b", "FAILED")] and not consistency.passed(report)


def test_read_only():
    assert language.read_only("SELECT 'drop table x' AS a")
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a"):
        with pytest.raises(ValueError):
            language.read_only(bad)


def test_questions():
    t = language.Terms({"ship": "Ship", "port": "Port"}, {"docked at": ("AT", "Port", "outgoing")}, {"tonnage": "gt"}, {"tanker": ("kind", "Tanker")})
    p = language.parse_question("How many tanker ships with tonnage of at least 5,000?", t)
    assert p.query.intent is ir.Intent.COUNT and p.query.filters == (Filter("kind", "=", "Tanker"), Filter("gt", ">=", 5000.0)) and not p.unread
    p = language.parse_question("Top 3 ships by tonnage docked at a port", t)
    assert p.query.limit == 3 and p.query.sorts[0].field == "gt" and p.query.hops[0].type == "AT"
    assert language.parse_question("hello", t).query is None


def test_tags(spark):
    texts = spark.createDataFrame([("1", "Busan Port Authority at busan port"), ("2", None), ("3", "")], "id string, text string")
    d = spark.createDataFrame([("Busan Port", "port"), ("Busan Port Authority", "org"), ("", "x")], "term string, kind string")
    assert rows(language.tag(texts, d), "kind", "start") == [("org", 0), ("port", 24)]
    assert language.tag(texts, d, longest=False).count() == 3


def test_workflow(spark):
    one = spark.createDataFrame([(1, "a\n\nb", None)], "id int, body string, x string")
    assert rows(workflow.split_text(one, "body", "\n"), "text", "index") == [("a", 0), ("b", 2)]
    assert workflow.template(one, "{{id}}-{{x}}-{{gone}}", "out").first()["out"] == "1-None-None"
    with pytest.raises(workflow.WorkflowError, match="circle"):
        workflow.order_of({"a": ["b"], "b": ["a"]})
    states = workflow.Workflow().add("a", lambda: one).add("b", lambda df: df.nope(), "a").add("c", lambda df: df, "b").run()[1]
    assert states["a"] == "completed" and states["b"].startswith("failed") and states["c"] == "skipped"
    assert rows(workflow.static_input(spark, "json", '[{"a": 1}, {"a": 2}]'), "a") == [(1,), (2,)]
    assert rows(workflow.static_input(spark, "list", "x\n\n y "), "index", "text") == [(0, "x"), (2, "y")]


def test_documents(spark, tmp_path):
    page = "<html><head><title>T &amp; U</title><meta name='citation_title' content='Paper'><style>p{}</style></head><body><p>One</p><script>x</script>Two<br>&lt;3 <a href='/x'>l</a></body></html>"
    df = spark.createDataFrame([(page, "# Head\n\n**bold** [a](b) ![i](j)\n```py\ncode\n```\n> q\n---\nend")], "h string, m string")
    r = df.select(documents.html_text(F.col("h")).alias("t"), documents.html_title(F.col("h")).alias("ti"), documents.html_links(F.col("h")).alias("l"), documents.paper(F.col("h")).alias("p"), documents.markdown_text(F.col("m")).alias("m"), documents.markdown_title(F.col("m")).alias("mt")).first()
    assert "One\n" in r["t"] and "<3 l" in r["t"] and "x" not in r["t"].split("Two")[0].split("One")[1] and r["ti"] == "T &amp; U" and r["l"] == ["/x"]
    assert r["p"]["title"] == "Paper" and r["mt"] == "Head" and r["m"].startswith("Head\n\nbold a i") and "code" not in r["m"] and "q" in r["m"]
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Hi &amp; you</w:t></w:p><w:p><w:t xml:space='preserve'>there</w:t></w:p>")
    (tmp_path / "b.docx").write_bytes(b"junk")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.office_files(spark, f"file://{tmp_path}/*.docx").collect()}
    assert got == {"a.docx": "Hi & you\nthere", "b.docx": None}
    (tmp_path / "c.csv").write_text('a,b\n1,"x, y"\n')
    c = documents.csv_document(spark, f"file://{tmp_path}/c.csv").first()
    assert c["text"] == "a\tb\n1\tx, y" and c["rows"] == 2 and c["columns"] == 2


def test_exchange(spark, tmp_path):
    nodes = spark.createDataFrame([("1", ["A", "B"], {"n": "x<&\"y"}), ("2", ["C"], {})], "id string, labels array<string>, properties map<string,string>")
    e = spark.createDataFrame([("e", "T", "1", "2", {})], "id string, type string, sourceId string, targetId string, properties map<string,string>")
    import xml.etree.ElementTree as ET

    head, body, tail = interchange.graphml(nodes, e)
    assert len(ET.fromstring(head + "".join(r[0] for r in body.collect()) + tail)[-1]) == 3
    import json

    first = json.loads(interchange.jsonld_nodes(nodes.where("id = '1'")).first()["value"])
    assert first == {"@id": "urn:kg:node:1", "@type": ["A", "B"], "n": 'x<&"y'}
    interchange.write_csv(interchange.csv_nodes(nodes, ["n"]), f"file://{tmp_path}/n")
    back = {r["id"]: (r["labels"], r["properties"]) for r in interchange.read_csv_nodes(spark, f"file://{tmp_path}/n").collect()}
    assert back == {"1": (["A", "B"], {"n": 'x<&"y'}), "2": (["C"], {})}
    s = Schema({"A": {"n": Property("int")}}, {}, {})
    (tmp_path / "o.ttl").write_text(interchange.turtle(s))
    assert ("a", "owl:Class") in rows(interchange.read_turtle(spark, f"file://{tmp_path}/o.ttl"), "predicate", "object")


def test_stores(spark, tmp_path):
    r = spark.createDataFrame([("1", "{}"), ("2", "{}")], "id string, payload string")
    stores.put_raw(r, f"file://{tmp_path}/raw", "s", F.lit("2024-01-02"))
    assert rows(stores.raw(spark, f"file://{tmp_path}/raw", "s"), "key") == [("s/2024-01-02/1.json",), ("s/2024-01-02/2.json",)]
    assert stores.delete_raw(spark, f"file://{tmp_path}/raw", "s")
    log = spark.createDataFrame([("r", 1, "started"), ("r", 2, "done")], "run_id string, at int, status string")
    assert rows(stores.current_runs(log), "run_id", "status") == [("r", "done")]
    bad = etl.Pipeline("p", (etl.required("payload"),)).plan(r.withColumn("payload", F.lit(None).cast("string")))[1]
    stores.append_letters(etl.dead_letters(bad, F.current_timestamp(), "s"), f"file://{tmp_path}/dlq")
    with open(tmp_path / "dlq" / "part-x.json", "w") as f:
        f.write("{broken\n")
    assert etl.retryable(stores.letters(spark, f"file://{tmp_path}/dlq")).count() == 2


def test_stream_sends_failing_batches_away(spark, tmp_path):
    src = spark.createDataFrame([(i,) for i in range(10)], "n int")
    src.repartition(2).write.parquet(f"file://{tmp_path}/in")
    stream = micro_batch.subscribe(spark, f"file://{tmp_path}/in", src.schema, 1)
    done, dead = [], []

    def handle(df, n):
        if n == 0:
            raise RuntimeError("no")
        done.append(df.count())

    micro_batch.process(stream, handle, lambda df, e, n: dead.append((e, df.count())), f"file://{tmp_path}/cp").awaitTermination()
    assert len(dead) == 1 and dead[0][0] == "no" and sum(done) + dead[0][1] == 10
    with pytest.raises(ValueError):
        micro_batch.trigger_of("other")


def test_catalog(spark):
    e = spark.createDataFrame([("a", "Port Calls", dt.date(2024, 1, 1)), ("b", None, None)], "id string, name string, at date")
    assert rows(catalog.search(e, "port", ["name"], "id"), "id") == [("a",)]
    q = {r["id"]: r for r in catalog.quality(e, "id", ["name"], "at", F.lit(True), dt.date(2024, 1, 20)).collect()}
    assert q["a"]["overall"] == 1.0 and q["b"]["freshness"] == 0.0


def test_entry_queries_have_no_stray_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("# Head #\n\nSome **bold *nested* text** and `a*b`", "Head\n\nSome bold nested text and a*b"),
        ("![alt [x](u)](i.png) [![img](a)](b)", "alt x img"),
        ("> quote\n> > deeper\n\n---\nend", "quote\ndeeper\n\n\nend".replace("\n\n\n", "\n\n")),
        ("a\n```py\n# no heading\n```\nb", "a\nb"),
        ("snake_case_word _em_ __str__ 2*3*4", "snake_case_word em str 234"),
        ("Title\n===\n\n\n\nlast \\*esc\\*", "Title\n\nlast *esc*"),
        ("***x*** **a*b** a ** b", "x a*b a ** b"),
        ("[no link] [text](u (x)) `` a`b ``", "[no link] text  a`b "),
        ("~~~\nnever closed", ""),
        ("", ""),
    ],
)
def test_plain_markdown(text, plain):
    assert documents.plain_markdown(text) == plain.strip()


def test_turtle_of_others():
    text = """@prefix : <urn:x#> . # a comment
PREFIX owl: <http://o#>
:A a owl:Class ; :label "Ä \\"q\\""@en-GB , '''two
lines''' ; :n 5 , -1.5e3 , true ; .
<http://a.b/c> :p [ a :X ; :q "v"^^owl:t ] ; :l ( 1 :two ) .
[] :p :x.y .
"""
    got = interchange.turtle_triples(text)
    assert (":A", ":label", '"Ä \\"q\\""@en-GB') in got and (":A", ":label", "'''two\nlines'''") in got and (":A", ":n", "-1.5e3") in got
    assert ("_:b1", ":q", '"v"^^owl:t') in got and ("<http://a.b/c>", ":p", "_:b1") in got and ("_:b3", "rdf:rest", "rdf:nil") in got and ("_:b4", ":p", ":x.y") in got
    assert interchange.turtle_triples(text, True)[0] == ("<urn:x#A>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://o#Class>")
    for bad in (":a :b", "a b c .", ":a :b <x y> ."):
        with pytest.raises(ValueError):
            interchange.turtle_triples(bad + " |")


def test_point_ids(spark):
    import uuid

    names = ["a", "문서", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.point_id(F.col("n")).alias("i")).collect()
    assert [r.i for r in got] == [None if n is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_questions_with_units():
    t = language.maritime_terms({"위치한": ("LOCATED_AT", "Port", "outgoing")})
    q = language.parse_question("부두 근처 컨테이너선 5000톤 이상", t).query
    assert [(f.field, f.op, f.value) for f in q.filters] == [("tonnage", ">=", 5000.0)]
    q = language.parse_question("선박 길이 3 km 미만 12.5노트", t).query
    assert [(f.field, f.op, f.value) for f in q.filters] == [("distance", "<", 3000.0), ("speed", "=", 12.5)]
    assert terms.label_of("자율운항선박들") == "AutonomousVessel" and terms.label_of("없음") is None and terms.label_of("") is None
    assert terms.entity_of("부산항") == ("Port", "unlocode", "KRPUS") and terms.entity_of("남해")[0] == "SeaArea" and terms.value_of("severity", "심각") == "HIGH"


def test_as_of_join_over_buckets(spark):
    rng = random.Random(8)
    day = lambda n: None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(400)])) for i in range(200)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(400)]), i) for i in range(40)]
    l = spark.createDataFrame([(i, k, day(t)) for i, k, t in left], "i int, k string, t timestamp")  # noqa: E741
    r = spark.createDataFrame([(k, day(t), v) for k, t, v in right], "k string, s timestamp, v int")
    got = dict(rows(temporal.as_of_join(l, r, "k", "t", "s", ["v"]), "i", "v"))
    for i, k, t in left:
        fit = [(s, v) for key, s, v in right if key == k and k is not None and None not in (s, t) and s <= t]
        assert (got[i] is None) == (not fit) and (not fit or got[i] in {v for s, v in fit if s == max(fit)[0]})


def test_components_of_a_hub(spark):
    pairs = [("hub", f"s{i:03}") for i in range(300)] + [(f"s{i:03}", f"t{i:03}") for i in range(50)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    random.Random(2).shuffle(pairs)
    got = dict(rows(algorithms.connected_components(edges(spark, pairs).repartition(4), hot_rows=20), "id", "component"))
    assert {v: sum(x == v for x in got.values()) for v in set(got.values())} == {"c000": 71, "hub": 351}


def test_searches_in_blocks(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(300)], "id int, embedding array<double>").repartition(3)
    q = v.where("id < 50")
    want = rows(vectors.search_many(v, q, 5), "query_id", "rank", "id")
    assert rows(vectors.search_many(v, q, 5, block=7), "query_id", "rank", "id") == want and len(want) == 250
