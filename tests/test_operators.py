import hashlib

import pytest
from pyspark.sql import functions as F

from strandlake.common import first_by_hash, spread_join
from strandlake.operators import catalog, chunking, evaluate, retrieval, versions
from strandlake.plans import registry
from strandlake.sources import readers
from strandlake.streaming import rate


def sets(df):
    return sorted(map(tuple, df.collect()))


def test_spread_join_equals_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("row"))
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert sets(spread_join(rows, groups, "key", "n", "row", hot=50, salts=4).select("key", "row", "n")) == sets(rows.join(groups, "key").select("key", "row", "n"))


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "x" * 800), (2, "y" * 801), (3, ""), (4, None), (5, "z" * 2300)], "doc_id int, body string")
    assert {(r.doc_id, r.n) for r in chunking.fixed_windows(df).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 1), (2, 2), (5, 4)}


def test_hierarchy_children_lie_in_parents(spark):
    df = spark.createDataFrame([("d", "para one. " * 300 + "\n\n" + "para two. " * 200), ("e", None), ("f", " ")], "doc_id string, body string")
    rows = chunking.hierarchy(df).collect()
    assert {r.doc_id for r in rows} == {"d"} and all(r.raw_body in r.parent_body and r.token_count <= 180 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_rrf_channels_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, vector_rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, bm25_rank int")
    got = {r.doc_id: (r.fusion_score, r.vector_rank, r.bm25_rank) for r in retrieval.reciprocal_rank_fusion(a, b, 1.0, 1.0).collect()}
    assert got == {10: (round(1 / 61, 6), 1, None), 11: (round(1 / 62 + 1 / 61, 6), 2, 1), 12: (round(1 / 62, 6), None, 2)}


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, ""), (4, None), (5, "red red")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "red"), (8, ""), (9, "zebra"), (10, None)], "query_id bigint, question string")
    got = retrieval.bm25(docs, asked, 2).orderBy("bm25_rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(7, 2), (7, 5)]
    assert retrieval.bm25(docs.limit(0), asked).count() == 0


def test_title_channel_ranks_all_documents(spark):
    docs = spark.createDataFrame([(1, "red fox", "red"), (2, "red fox den", "nothing"), (3, None, "red fox"), (4, "fox fox", "blue")], "doc_id bigint, title string, text string")
    asked = spark.createDataFrame([(7, "Red fox"), (8, "zebra")], "query_id bigint, question string")
    assert sets(retrieval.title_top_k(docs, asked, 3).select("query_id", "doc_id", "shared", "vector_rank")) == [(7, 1, 2, 1), (7, 2, 2, 2), (7, 4, 1, 3)]


def test_channels_bring_their_own_documents(spark, tmp_path):
    rows = [(50, "red fox", "unrelated words"), (51, "red fox den", "nothing"), (52, "other", "red fox"), (53, "fox", "")]
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.channel: r.results for r in registry.channel_counts(spark, str(tmp_path)).collect()}
    assert got == {"vector": 3, "bm25": 1}


def test_both_halves_are_subqueries(spark, tmp_path):
    rows = [(50, "red fox blue whale", ""), (51, "a", "red fox"), (52, "b", "blue whale"), (100, "zebra", "")]
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sets(registry.subquery_merge(spark, str(tmp_path)).select("query_id", "doc_id", "hits")) == [(50, 51, 2), (50, 52, 2)]


def test_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 0), (5, None, 0)], "vec_id bigint, embedding array<float>, label int")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in retrieval.vector_top_k(vectors, asked, 3).orderBy("vector_rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert retrieval.vector_top_k(vectors, asked.limit(0), 3).count() == 0
    by_column = vectors.filter("embedding is not null").crossJoin(F.broadcast(asked.withColumnRenamed("embedding", "q"))).select(F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6)).collect()
    assert sorted(r[0] for r in by_column) == [0.0, 0.0, 1.0, 1.0]


def test_boosts_and_plans(spark):
    rows = spark.createDataFrame([(1, "latest Kafka internship and SQL", "uses kafka and sql", "internship", 20240101.0, 0.5), (1, "latest Kafka internship and SQL", None, "profile", None, 0.5)], "query_id int, question string, searchable string, section_type string, updated_number double, score double")
    got = retrieval.freshness_boost(retrieval.section_boost(retrieval.keyword_boost(rows), "rank_score"), "intent_score").orderBy("section_type").collect()
    assert [(r.rank_score, r.intent_score, r.freshness_score) for r in got] == [(0.62, 0.74, 0.74), (0.5, 0.47, 0.47)]  # one date alone makes nothing fresher
    dated = spark.createDataFrame([(1, "newest", d, 0.5) for d in (20240101.0, 20240102.0, None, 20240101.0)], "query_id int, question string, updated_number double, score double")
    assert sorted(r.freshness_score for r in retrieval.freshness_boost(dated, "score").collect()) == [0.5, 0.5, 0.5, 0.58]
    plans = retrieval.plan_questions(spark.createDataFrame([(1, "compare Spark jobs and Flink jobs"), (2, "my passport"), (3, None)], "query_id int, question string")).orderBy("query_id").collect()
    assert plans[0].complex and len(plans[0].subqueries) == 3 and plans[1].refused and not plans[2].refused


def test_boosts_take_every_chunk_of_the_space(spark):
    chunks = spark.sql("""select * from values ('c1', 's', 'education', 'kafka course', timestamp'2024-01-01'), ('c2', 's', 'education', 'kafka kafka', timestamp'2024-03-01'),
        ('c3', 's', null, 'about kafka streams', timestamp'2024-02-01'), ('c4', 't', 'education', 'kafka', timestamp'2025-01-01'), ('c5', 's', 'award', 'other', timestamp'2026-01-01') as t(chunk_id, space_id, section_type, raw_body, updated_at)""")
    got = {r.chunk_id: r for r in registry._boosted_chunks(spark.createDataFrame([(1, "latest kafka course", "s")], "query_id int, question string, space_id string"), chunks).collect()}
    assert set(got) == {"c1", "c2", "c3"} and got["c1"].matched_section_intent and not got["c3"].matched_section_intent
    assert round(got["c2"].freshness_score - got["c2"].intent_score, 6) == 0.08 and got["c1"].freshness_score == got["c1"].intent_score


def test_diversify_and_balance(spark):
    rows = spark.createDataFrame([(1, "a", "g1", "s1", 0.9, "secondary"), (1, "b", "g1", "s1", 0.5, "primary"), (1, "c", "g2", "s2", 0.1, "primary"), (1, "d", "g3", "s1", 0.8, "primary")], "query_id int, chunk_id string, grp string, space_id string, score double, pr string")
    assert {r.chunk_id for r in retrieval.diversify(rows, "grp", "score", priority="pr").collect()} == {"b", "c", "d"}
    assert [r.chunk_id for r in retrieval.balance_spaces(rows, 3, "score").orderBy("place").collect()] == ["a", "c", "d"]


def test_metrics_golden(spark):
    rankings = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "n", 1)], "query_id int, doc_id string, place int")
    relevant = spark.createDataFrame([(1, "a", 3), (1, "b", 1)], "query_id int, doc_id string, relevance int")
    got = {r.query_id: (r.hit, r.recall, r.reciprocal_rank, r.ndcg) for r in evaluate.case_metrics(rankings, relevant, 2).collect()}
    import math

    assert got[1] == (1, 0.5, 0.5, round((3 / math.log2(3)) / (3 + 1 / math.log2(3)), 6)) and got[2] == (0, 1.0, 0.0, 1.0)


def test_catalog_snapshots(spark):
    old = spark.createDataFrame([("a", "t", "active", "1"), ("b", "u", "active", "1")], "doc_id string, title string, status string, updated_at string")
    new = spark.createDataFrame([("b", "v", "x", "2"), ("b", "w", "y", "3"), ("c", "z", "discovered", "1")], old.schema)
    assert sets(catalog.upsert(old, new)) == [("a", "t", "active", "1"), ("b", "w", "active", "3"), ("c", "z", "discovered", "1")]
    assert sets(catalog.upsert(old, new.limit(0))) == sets(old)
    assert catalog.fingerprint(old, "doc_id").first() == catalog.fingerprint(old.orderBy(F.col("doc_id").desc()), "doc_id").first()
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_id string, c int")
    assert sets(catalog.replace_chunks(chunks, spark.createDataFrame([("a", 9)], chunks.schema))) == [("a", 9), ("b", 3)]


def test_version_groups_equal_brute_force(spark):
    bodies = {"a": "alpha beta gamma delta epsilon zeta eta theta", "b": "alpha beta gamma delta epsilon zeta eta theta!", "c": "quite another text about something else", "d": "alpha beta gamma delta epsilon zeta eta theta", "e": None, "f": ""}
    df = spark.createDataFrame(list(bodies.items()), "doc_id string, body string")
    assert {(r.doc_id, r.members) for r in versions.version_members(df).collect()} == {("a", 3), ("b", 3), ("d", 3)}
    features = {r.doc_id: set(r.features) for r in versions.body_features(df).collect()}
    expected = {(x, y) for x in features for y in features if x < y and len(features[x] & features[y]) / len(features[x] | features[y]) >= 0.3}
    assert {(r.a, r.b) for r in versions.similar_pairs(versions.body_features(df), 0.3).collect()} == expected


def test_version_groups_need_like_titles(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("a", "Guide to tables", body), ("b", "Guide to tables v2", body + "!"), ("c", "Payroll notes", body + "?"), ("d", "", body + "."), ("e", "Guides to tables", body + ";"), ("f", "Another", "one text"), ("g", None, "one text")]
    got = versions.version_members(spark.createDataFrame(rows, "doc_id string, title string, body string")).collect()
    assert {(r.doc_id, r.members) for r in got} == {("a", 3), ("b", 3), ("e", 3), ("f", 2), ("g", 2)}
    expected = {"version_" + hashlib.sha256(m.encode()).hexdigest()[:16] for m in ("a|b|e", "f|g")}
    assert {r.version_group_id for r in got} == expected


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "a int, b int")
    roots = {r.doc_id: r.root for r in versions.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(31)) and roots[101] == 100 and roots[100] == 100


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a int, b int")
    with pytest.raises(RuntimeError):
        versions.components(edges, most_rounds=1)


def test_rate_and_stream(spark, tmp_path):
    rows = spark.sql("select 1 as u, timestamp'2024-01-01 00:00:10' as ts union all select 1, timestamp'2024-01-01 00:00:50' union all select 2, timestamp'2024-01-01 00:00:50'")
    assert {(r.u, r.requests, r.allowed) for r in rate.rate_buckets(rows, "u", "ts", most=1).collect()} == {(1, 2, False), (2, 1, True)}
    source = tmp_path / "in"
    spark.sql("select 1 as doc_id, 'a' as text, timestamp'2024-01-01 00:00:00' as loaded_at union all select 2, 'a', timestamp'2024-01-01 00:01:00'").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id int, text string, loaded_at timestamp").parquet(str(source))
    rate.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "t", "body": "b"}]')
    assert readers.read_json_array(spark, str(tmp_path / "a.json")).first().title == "t"
    (tmp_path / "b.json").write_text('{"title": "t"}')
    with pytest.raises(ValueError):
        readers.read_json_array(spark, str(tmp_path / "b.json"))
    (tmp_path / "c d.csv").write_text("project,hours\nX,3\nY,\n")
    got = {(r.title, r.body) for r in readers.read_csv_records(spark, str(tmp_path / "c d.csv")).collect()}
    assert got == {("c d row 1", "project: X | hours: 3"), ("c d row 2", "project: Y | hours: ")}
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "long.md").write_text("word " * 40)
    (folder / "short.txt").write_text("hi")
    (folder / "scan.png").write_bytes(b"x")
    (folder / "bad.docx").write_bytes(b"x")
    assert {r.path.rsplit("/", 1)[1]: r.parse_status.split(":")[0] for r in readers.scan_folder(spark, str(folder)).collect()} == {"long.md": "ready", "short.txt": "short", "scan.png": "needs_ocr", "bad.docx": "parse_error"}


def test_first_by_hash_is_bounded_and_repeatable(spark):
    df = spark.range(20_000)
    once = {r.id for r in first_by_hash(df, "id", 500).collect()}
    assert 450 <= len(once) <= 500 and once == {r.id for r in first_by_hash(df.repartition(7), "id", 500).collect()}
    assert first_by_hash(df.limit(3), "id", 500).count() == 3 and first_by_hash(df.limit(0), "id", 5).count() == 0


def test_resume_units(spark):
    text = "Nora H.\n\nEDUCATION\n\nNorth University 2019 - 2023\n\nCourses: statistics\n\nProjects\n\nLoom | 2022\n\n- built it\n\nShop\n\nTech stack: Kafka\n\nProfile\n\nFirst.\n\nSecond.\n\nSkills\n\nProgramming and development\n\nJava\n\nAlso: Go"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, body string")
    got = [(r.section_type, r.entity_title, r.retrieval_priority) for r in chunking.resume_units(df).orderBy("chunk_index").collect()]
    assert got == [("profile", "基本信息", "primary"), ("education", "North University 2019 - 2023", "primary"), ("project", "Loom | 2022", "primary"), ("project", "Shop", "primary"), ("summary", "Profile 1", "primary"), ("summary", "Profile 2", "secondary"), ("skill", "Programming and development", "primary"), ("skill", "Additional skill variants", "secondary")]
    long = spark.createDataFrame([("d", "Projects\n\nLoom | 2022\n\n" + "word " * 900)], "doc_id string, body string")
    labels = {r.label for r in chunking.resume_units(df).collect()}
    assert "Education" in labels and "EDUCATION" not in labels  # canonical, whatever the text writes
    rows = chunking.resume_units(long, 300).collect()
    assert len(rows) > 2 and all(r.raw_body.startswith("Loom | 2022") for r in rows) and len({r.semantic_group_id for r in rows}) == 1


def test_packed_chunks(spark):
    df = spark.createDataFrame([(1, "One two. Three four! 五六。七八。" + "x " * 50), (2, None), (3, "  "), (4, "aa bb\n\ncc dd\n\nee ff gg")], "doc_id int, body string")
    rows = chunking.packed_chunks(df, 6, 0).orderBy("doc_id", "chunk_index").collect()
    assert {r.doc_id for r in rows} == {1, 4} and rows[0].chunk_body == "One two.\n\nThree four!"
    assert [r.chunk_body for r in rows if r.doc_id == 4] == ["aa bb\n\ncc dd", "ee ff gg"]
    over = [r.chunk_body for r in chunking.packed_chunks(df.filter("doc_id = 4"), 6, 5).orderBy("chunk_index").collect()]
    assert over == ["aa bb\n\ncc dd", "dd\n\nee ff gg"]  # a quarter of six tokens at most


def test_contexts_by_parent_and_group(spark):
    schema = "query_id int, chunk_id string, doc_id string, space_id string, parent_chunk_id string, semantic_group_id string, section_type string, score double, question string"
    row = lambda c, p, g, score, doc="d", q=1, kind="document", ask="what is it": (q, c, doc, "s", p, g, kind, score, ask)
    pool = [row("a", "p1", "g1", 0.9), row("b", "p1", "g2", 0.8), row("c", "p2", "g2", 0.7), row("d", "p3", "g1", 0.6), row("e", None, None, 0.5), row("f", None, None, 0.4), row("g", "p1", "g1", 0.3, "other")]
    pool += [row(f"x{k}", None, None, 1 - k / 100, q=2, ask="list all projects", kind=("project", "award")[k % 2]) for k in range(30)]
    pool += [row(f"y{k}", None, None, 1 - k / 100, q=3, ask="best projects", kind="project") for k in range(30)]
    got = retrieval.select_contexts(spark.createDataFrame(pool, schema)).orderBy("query_id", "place").collect()
    chosen = {q: [r.chunk_id for r in got if r.query_id == q] for q in (1, 2, 3)}
    assert chosen[1] == ["a", "c", "e", "f", "g"]  # missing parents and groups are nobody's, keys count within a document
    assert chosen[2] == [f"x{k}" for k in range(0, 24, 2)] and chosen[3] == [f"y{k}" for k in range(5)]


def test_records_and_uploads(spark, tmp_path):
    import io
    import zipfile

    paragraphs = [("Heading1", "Loom guide"), ("", "First & last."), ("", "")]
    xml = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t.replace("&", "&amp;")}</w:t></w:r></w:p>' for s, t in paragraphs)
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    for name, content in {
        "a.json": b'\xef\xbb\xbf[{"title": "one", "body": "x"}, {"title": "two", "metadata": {"visibility": "public"}}]', "b.json": b'{"title": "only"}', "c.json": b"{", "d.csv": b"title,body,n\nT,B,1\n,,2\n",
        "e.md": b"# Head\r\ntext\x00", "f.docx": word.getvalue(), "g.docx": b"PK no", "h.exe": b"x", "i.txt": b" \n", "j.pdf": b"%PDF-1.7", "k.pdf": b"no", "l.csv": b"a,b\n1, 2 \n\n3,\n",
    }.items():
        (tmp_path / name).write_bytes(content)
    records = {(r.source, r.row_no, r.title, r.body, r.visibility, r.error) for r in readers.read_records(spark, str(tmp_path)).collect()}
    assert {r for r in records if r[0] < "e"} == {
        ("a.json", 1, "one", "x", None, None), ("a.json", 2, "two", None, "public", None), ("b.json", 1, "only", None, None, None), ("c.json", None, None, None, None, "invalid_file"),
        ("d.csv", 1, "T", "B", None, None), ("d.csv", 2, "d row 2", "title:  | body:  | n: 2", None, None),
    }
    assert ("h.exe", None, None, None, None, "unsupported_file") in records and ("f.docx", 1, "f", "Loom guide\n\nFirst & last.", None, None) in records
    uploads = {r.file_name: (r.title, r.body, r.error) for r in readers.read_uploads(spark, str(tmp_path)).collect()}
    assert uploads["e.md"] == ("Head", "# Head\ntext", None) and uploads["f.docx"] == ("Loom guide", "# Loom guide\n\nFirst & last.", None)
    assert uploads["l.csv"][1] == "a: 1\nb: 2\n\na: 3\nb:"
    assert {k: v[2] for k, v in uploads.items() if v[2]} == {"a.json": "unsupported_file", "b.json": "unsupported_file", "c.json": "unsupported_file", "g.docx": "invalid_file", "h.exe": "unsupported_file", "i.txt": "empty_file", "j.pdf": "needs_ocr", "k.pdf": "invalid_file"}


def test_benchmark_cases(spark, tmp_path):
    import json

    case = {"case_id": "a", "language": "en", "scope": "all", "should_answer": True, "expected_doc_ids": ["d"], "relevance": {"d": 3}, "question": "q"}
    write = lambda *cases: (tmp_path / "b.json").write_text(json.dumps(list(cases))) and str(tmp_path / "b.json")
    assert readers.read_benchmark(spark, write(case, case | {"case_id": "b", "should_answer": False, "expected_doc_ids": []})).count() == 2
    for fault in ({"language": "fr"}, {"scope": "x"}, {"expected_doc_ids": []}, {"case_id": "z"}):
        with pytest.raises(ValueError):
            readers.read_benchmark(spark, write(case | {"case_id": "z"}, case | fault))


def test_sizes_are_tested_on_the_listing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MOST_TEXT_BYTES", 100)
    (tmp_path / "big.md").write_text("word " * 40)
    (tmp_path / "fits.md").write_text("word " * 17)
    assert {(r.path.rsplit("/", 1)[1], r.parse_status, bool(r.body)) for r in readers.scan_folder(spark, str(tmp_path)).collect()} == {("big.md", "too_large", False), ("fits.md", "ready", True)}


def test_scanned_texts_are_whole(spark, tmp_path):
    (tmp_path / "long.md").write_text("word " * 4000)
    row = readers.scan_folder(spark, str(tmp_path)).first()
    assert (len(row.body), row.parse_status) == (20_000, "ready")
    row = readers.scan_folder(spark, str(tmp_path), most_chars=12_000).first()
    assert (len(row.body), row.parse_status) == (12_000, "truncated")


def test_bm25_by_joins_equals_bm25_in_tasks(spark, small, monkeypatch):
    documents, asked = registry._documents(spark, small), registry._questions(spark, small)
    spaces = documents.withColumn("space_id", F.coalesce("space_id", F.lit("none")))
    within = asked.withColumn("space_id", F.explode(F.array(*(F.lit(r[0]) for r in spaces.select("space_id").distinct().collect()))))
    run = lambda: (sets(retrieval.bm25(documents, asked, 5).select("query_id", "doc_id", "bm25_score")), sets(retrieval.bm25(spaces, within, 3, within="space_id").select("query_id", "space_id", "doc_id", "bm25_score", "bm25_rank")))
    in_tasks = run()
    monkeypatch.setattr(retrieval, "MOST_ASKED", 1)
    assert run() == in_tasks and all(in_tasks)
    monkeypatch.undo()
    monkeypatch.setattr(retrieval, "MOST_CELLS", 7)  # many small blocks
    assert run() == in_tasks


def test_vector_blocks_and_ties(spark, monkeypatch):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-1, 2, 4)], int(k % 3), "s" if k % 2 else "t") for k in range(60)] + [(100, None, 0, "s"), (101, [1.0], 0, "s")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, space_id string").repartition(5)
    asked = spark.createDataFrame([(k, [float(x) for x in rng.integers(-1, 2, 4)], "s") for k in range(9)], "query_id bigint, embedding array<float>, space_id string")
    whole = {r[0]: r for r in rows[:60]}

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 6) if size else 0.0

    def expected(k, key, allowed=lambda r: True):
        out = []
        for q in asked.collect():
            scored = sorted(((-cosine(q.embedding, r[1]), r[0]) for r in whole.values() if allowed(r)))
            for _, group in itertools.groupby(sorted(scored, key=lambda s: key(whole[s[1]])), key=lambda s: key(whole[s[1]])):
                out += [(q.query_id, v, -s) for s, v in sorted(group)[:k]]
        return sorted(out)

    for blocks, cells in ((64_000_000, 4_000_000), (40, 20)):
        monkeypatch.setattr(retrieval, "MOST_BYTES", blocks)
        monkeypatch.setattr(retrieval, "MOST_CELLS", cells)
        plain = lambda **kw: sets(retrieval.vector_top_k(vectors, asked, 4, **kw).select("query_id", "vec_id", "score"))
        assert plain() == expected(4, lambda r: 0)
        assert plain(group="label") == expected(4, lambda r: r[2])
        assert plain(within="space_id") == expected(4, lambda r: 0, lambda r: r[3] == "s")


def test_select_results(spark):
    schema = "query_id int, chunk_id string, visibility string, space_id string, score double, intent_score double, raw_body string, parent_body string, retrieval_priority string, semantic_group_id string"
    rows = [
        (1, "a", "public", "x", 0.9, 0.5, "child", "parent", "primary", "g1"), (1, "b", None, "x", 0.8, 0.7, "child", "", "primary", "g1"), (1, "c", "private", "x", 0.99, 0.99, "p", None, None, None), (1, "d", "public", "y", 0.7, None, "d", None, None, ""),
        (1, "e", "public", "z", 0.95, 0.9, "e", None, None, None), (1, "f", "public", "x", 0.6, 0.95, "f", None, "secondary", "g2"), (1, "h", "public", None, 0.3, 0.3, "h", None, None, None), (2, "a", "private", "x", 0.1, 0.1, "a", None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    chosen = lambda **kw: [r.chunk_id for r in retrieval.select_results(df, **kw).orderBy("query_id", "place").collect()]
    assert chosen(k=9) == ["e", "b", "d", "h", "f"]  # one row a group, secondary rows last, private ones never
    assert chosen(k=9, spaces=("x",)) == ["b", "f"] and chosen(k=9, spaces=("y", "x")) == ["d", "b", "f"] and chosen(k=1, spaces=("y", "x")) == ["d"]
    assert chosen(k=9, threshold=0.7) == ["e", "b", "d"] and chosen(k=9, scope="all") == ["c", "e", "b", "d", "h", "f", "a"] and chosen(k=9, spaces=("portfolio",)) == ["h"]
    bodies = {r.chunk_id: (r.body, r.matched_body, r.parent_expanded) for r in retrieval.select_results(df.filter("chunk_id in ('a', 'd')"), 5).collect()}
    assert bodies == {"a": ("parent", "child", True), "d": ("d", "d", False)}
    assert retrieval.select_results(df.limit(0), 3).count() == 0


def test_modes_of_retrieval(spark):
    chunks = spark.createDataFrame(
        [(f"c{k}", f"d{k}", "s", f"p{k}", None, "document", "primary", "public", f"{word} notes about {word} number {k}", f"{word} page", 20240101.0 + k) for k, word in enumerate(("kafka", "spark", "flink", "redis", "docker") * 6)],
        "chunk_id string, doc_id string, space_id string, parent_chunk_id string, semantic_group_id string, section_type string, retrieval_priority string, visibility string, raw_body string, title string, updated_number double",
    )
    asked = spark.createDataFrame([(1, "kafka notes", "s"), (2, "compare redis and docker", "s"), (3, "zzz", "s"), (4, "kafka", "none")], "query_id int, question string, space_id string")
    for search in (retrieval.baseline_search, retrieval.fulltext_search, retrieval.hybrid_search):
        got = search(chunks, asked, 3).collect()
        assert {r.title for r in got if r.query_id == 1} == {"kafka page"} and not [r for r in got if r.query_id == 4]
        assert all(r.title in ("redis page", "docker page") for r in got if r.query_id == 2)
    found = {r.query_id: r for r in retrieval.adaptive_search(chunks, asked, 3).collect()}
    assert found[2].path == "hybrid-rerank" and "complex-query" in found[2].reasons
    without = retrieval.adaptive_search(chunks, asked, 3, scorer=None).filter("query_id = 2").collect()
    assert {(r.path, r.fallback) for r in without} == {("vector", "no reranker")}
    clear = spark.createDataFrame([(1, 0.9), (1, 0.5), (2, 0.9), (2, 0.89), (3, 0.3)], "query_id int, score double")
    plans = retrieval.plan_questions(spark.createDataFrame([(k, "a question") for k in range(1, 5)], "query_id int, question string"))
    reasons = {r.query_id: r.reasons for r in retrieval.adaptive_decision(clear, plans).collect()}
    assert reasons == {1: "", 2: "low-confidence", 3: "low-confidence", 4: "low-confidence"}
    assert {r.reasons for r in retrieval.adaptive_decision(clear, plans, forced=True).filter("query_id = 1").collect()} == {"user-requested"}
    preview = retrieval.preview_search(chunks, spark.createDataFrame([(9, "kafka", "d0")], "query_id int, question string, doc_id string"), 3).collect()
    assert [r.chunk_id for r in preview] == ["c0"]
    plans = {r.query_id: r.subqueries for r in retrieval.plan_questions(spark.createDataFrame([(1, " compare Spark jobs, and Flink jobs? "), (2, "sandy shore summary"), (3, "对比白石引擎和夜航助手手册")], "query_id int, question string")).collect()}
    assert plans == {1: ["compare Spark jobs, and Flink jobs?", "compare Spark jobs", "Flink jobs"], 2: ["sandy shore summary"], 3: ["对比白石引擎和夜航助手手册", "对比白石引擎", "夜航助手手册"]}


def test_benchmark_and_section_metrics(spark):
    cases = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "query_id int, answerable boolean")
    rankings = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (3, "x", 1)], "query_id int, doc_id string, place int")
    relevant = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "query_id int, doc_id string, relevance int")
    row = evaluate.benchmark(cases, rankings, relevant, 3).first()
    assert (row.cases, row.answerable, row.hit, row.recall, row.reciprocal_rank, row.no_answer_accuracy) == (4, 2, 0.5, 0.5, 0.25, 0.5)
    assert evaluate.benchmark(cases.limit(0), rankings, relevant, 3).first().no_answer_accuracy == 1.0
    results = spark.createDataFrame([(1, 1, "skill", "S", "b"), (1, 2, "project", "Loom", "b"), (2, 1, "project", "x", "uses loom"), (3, 1, "award", "x", "y")], "query_id int, place int, section_type string, entity_title string, body string")
    questions = spark.createDataFrame([(1, "project", "loom"), (2, "project", "Loom"), (3, "skill", None)], "query_id int, expected_section_type string, expected_entity string")
    row = evaluate.section_metrics(results, questions).first()
    assert (row.questions, row.hit_at_1, row.hit_at_3, row.mrr) == (3, round(1 / 3, 6), round(2 / 3, 6), 0.5)


def test_publication_snapshots(spark, tmp_path):
    from strandlake.operators import publish

    drafts = spark.createDataFrame([("u1", "o", " T ", "", "", "en", "Body one", 0, "", "https://a.example"), ("u2", "o", "U", "s", "c", "zh", "Body two", 3, "x", "ftp://b")], "draft_id string, owner_id string, title string, summary string, category string, language string, body string, version int, space_id string, url string")
    chunks = chunking.preview_chunks(drafts.select(F.col("draft_id").alias("doc_id"), "title", "body"), F.lit("parent_child")).withColumn("draft_id", F.col("doc_id"))
    documents, rows = publish.publication(drafts, chunks, "2026-01-01")
    first = documents.orderBy("title").first()
    assert (first.title, first.category, first.space_id, first.publication_version, first.source_url) == ("T", "portfolio", "portfolio", 1, "https://a.example")
    assert first.doc_id == "owner_" + hashlib.sha256(b"o:u1").hexdigest()[:24] and {r.chunk_id.rsplit("_", 1)[0] for r in rows.collect()} == {first.doc_id + "_v1", documents.orderBy("title").collect()[1].doc_id + "_v3"}
    now, held = publish.commit(documents, rows, documents.withColumn("publication_version", F.lit(2)), rows.withColumn("chunk_id", F.concat("chunk_id", F.lit("+"))))
    assert sorted(r.publication_version for r in now.collect()) == [2, 3] and sorted(r.chunk_id.endswith("+") for r in held.collect()) == [False, True]
    public = spark.createDataFrame([("a", "A", "one", "public", "x"), ("b", "B", "two", "public", "y")], "doc_id string, title string, body string, visibility string, content_hash string")
    public, _ = catalog.normalize_documents(public.drop("content_hash", "visibility"), "public")
    made, known = publish.add_public(public, spark.createDataFrame([("c", "C", "two"), ("e", "E", "three"), ("d", "D", "three"), ("f", "F", "")], "doc_id string, title string, body string"))
    assert {r.doc_id for r in made.collect()} == {"a", "b", "d"} and {r.doc_id for r in known.collect()} == {"c"}
    left, archive = publish.archive(public, public.limit(0), spark.createDataFrame([("a",), ("z",)], "doc_id string"), "2026")
    assert {r.doc_id for r in left.collect()} == {"b"} and [(r.doc_id, r.archived_at) for r in archive.collect()] == [("a", "2026")]
    seeds = spark.createDataFrame([("s1", "S", "text", None), ("s2", "", "text", None), ("s3", "Ã©", "other", "private"), ("s3", "V", "third", None)], "doc_id string, title string, body string, visibility string")
    rows, faults = publish.seed(seeds)
    assert {tuple(r) for r in faults.collect()} == {("s1", "duplicate_hash"), ("s2", "duplicate_hash"), ("s2", "empty_text"), ("s3", "mojibake"), ("s3", "not_public"), ("s3", "duplicate_id")}
    state = spark.createDataFrame([("s1", "old", "repo_seed", "2020", "2020"), ("gone", "g", "repo_seed", "2020", "2020"), ("mine", "m", "owner_upload", "2020", "2020")], "doc_id string, title string, source_origin string, created_at string, updated_at string")
    synced = publish.sync_seed(state, rows.filter("doc_id = 's1'"), "2026")
    assert {tuple(r) for r in synced.select("doc_id", "title", "created_at", "updated_at").collect()} == {("s1", "S", "2020", "2026"), ("mine", "m", "2020", "2020")}
    index = spark.createDataFrame([("c1", "s", "T", "red fox fox"), ("c2", "t", None, "数据湖")], "chunk_id string, space_id string, title string, raw_body string")
    publish.rebuild_index(index, str(tmp_path / "index"))
    publish.rebuild_index(index.filter("chunk_id = 'c1'"), str(tmp_path / "index"))
    terms = spark.read.parquet(str(tmp_path / "index" / "terms")).collect()
    assert [(r.chunk_id, r.length, sorted((h.term, h.tf) for h in r.hits)) for r in terms] == [("c1", 4, [("fox", 2), ("red", 1), ("t", 1)])]
    assert len(spark.read.parquet(str(tmp_path / "index" / "chunks")).first().embedding) == 64


def test_catalog_changes(spark):
    rows = spark.createDataFrame([("a", "Body", "h", "en", "active", "1"), ("b", "Other", "h", "en", "active", "1")], "doc_id string, body string, content_hash string, language string, status string, updated_at string")
    made = {r.doc_id: r for r in catalog.replace_bodies(rows, spark.createDataFrame([("a", "new &amp; text"), ("b", " "), ("z", "x")], "doc_id string, body string")).collect()}
    assert (made["a"].body, made["a"].content_hash, made["b"].body, made["b"].content_hash) == ("new & text", hashlib.sha256(b"new & text").hexdigest(), "Other", "h") and len(made) == 2
    changed = catalog.update_rows(rows, spark.createDataFrame([("a", "excluded"), ("z", "x"), ("b", None)], "doc_id string, status string"), "2")
    assert sets(changed.select("doc_id", "status", "updated_at")) == [("a", "excluded", "2"), ("b", "active", "2")]
    assert sets(catalog.matching(rows, {"language": "zh", "status": "active"}).select("doc_id")) == [("a",), ("b",)]  # language isn't filtered
    wide = rows.withColumn("title", F.lit("T_1")).withColumn("summary", F.lit("")).withColumn("source_path", F.lit(None).cast("string")).withColumn("relative_path", F.lit("É"))
    assert [catalog.matching(wide, {}, w).count() for w in ("t_1", "t%1", "é", " OTHER ", "  ")] == [2, 2, 0, 1, 2]
    raw = spark.createDataFrame([("s", "x/docs/a.md", "T", "text", "ready"), ("s", "x/b.docx", None, "more", "needs_ocr"), ("s", "c", "", "", "ready")], "source string, relative_path string, title string, body string, parse_status string")
    made = {r.file_name: r for r in catalog.catalog_rows(raw, "now").collect()}
    assert set(made) == {"a.md", "b.docx"} and made["a.md"].doc_id == "local_" + hashlib.sha256(b"s|x\\docs\\a.md").hexdigest()[:24]
    assert (made["a.md"].project, made["a.md"].chunk_strategy, made["a.md"].status, made["b.docx"].status, made["b.docx"].chunk_size, made["b.docx"].title) == ("x", "markdown", "discovered", "needs_ocr", 320, "Untitled document")
    accepted, rejected = catalog.normalize_documents(spark.createDataFrame([("a", "x", "secret"), ("b", "x", None), ("c", None, None)], "doc_id string, body string, visibility string").withColumn("title", F.lit(None).cast("string")).withColumn("metadata", F.create_map(F.lit("visibility"), F.lit("public"))))
    assert sets(accepted.select("doc_id", "visibility")) == [("b", "public")] and sets(rejected.select("doc_id")) == [("a",), ("c",)]


def test_recent_turns(spark):
    from strandlake.plans import prompt

    history = spark.sql("select id as message_id, 's' as session_id, 'user' as msg_role, concat('m', id) as content, timestamp_seconds(id * 60) as sent_at from range(20) union all select 3, 's', 'user', 'm3', timestamp_seconds(180) union all select 100, 'other', 'user', 'x', timestamp_seconds(0)")
    turns = prompt.recent_turns(spark.createDataFrame([(15, "q", "s"), (0, "q", "s")], "query_id bigint, question string, space_id string"), history, 12)
    assert sorted((r.query_id, r.from_end, r.content) for r in turns.collect()) == [(15, k, f"m{15 - k}") for k in range(1, 13)]


def test_best_rows_wait_in_bounded_numbers(monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "MOST_WAITING", 20)
    values = np.round(np.random.default_rng(3).integers(0, 9, (400, 3)) / 4, 6)
    best, most = retrieval.Best(4, 3, 0.0), 0
    for low in range(0, 400, 7):
        best.offer(values[low : low + 7], np.arange(low, min(low + 7, 400)))
        most = max(most, best.count)
    assert most <= 20 + 12 + 7 * 3  # not every pair of a document and a question
    got = sorted(zip(*(c.tolist() for c in best.settle()), strict=True))
    expected = [(q, v, d) for q in range(3) for v, d in sorted(((values[d, q], d) for d in range(400)), key=lambda x: (-x[0], x[1]))[:4]]
    assert got == sorted(expected)


def test_equal_questions_are_searched_once_and_all_answered(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "blue"), (5, "red red")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "red"), (8, "Red zebra"), (9, "red red"), (10, "blue")], "query_id bigint, question string")
    got = {}
    for r in retrieval.bm25(docs, asked, 2).collect():
        got.setdefault(r.query_id, {})[r.bm25_rank] = (r.doc_id, r.bm25_score)
    assert got[7] == got[8] and got[7][1][0] == 2 and got[7][2][0] == 5
    assert got[9][1][1] > got[7][1][1] and got[10][1][0] == 3 and sorted(got) == [7, 8, 9, 10]


def test_searches_within_documents_never_collect_questions(spark, monkeypatch):
    chunks = spark.createDataFrame([("a1", "a", "red fox"), ("a2", "a", "blue"), ("b1", "b", "red"), ("c1", None, "red")], "chunk_id string, space_id string, raw_body string").withColumn("title", F.lit(None).cast("string"))
    asked = spark.createDataFrame([("a", "red fox", "a"), ("b", "Red", "b"), ("d", "red", "d")], "query_id string, question string, space_id string")
    plain = [sets(retrieval.vector_pool(chunks, asked, 3, retrieval.HashingEmbedder())), sets(retrieval.sparse_pool(chunks, asked, 3).select("query_id", "chunk_id", "bm25_score", "bm25_rank"))]
    monkeypatch.setattr(retrieval, "_asked_block", None)  # both would take questions to the driver
    monkeypatch.setattr(retrieval, "_cosine_scorer", None)
    joined = [sets(retrieval.vector_pool(chunks, asked, 3, retrieval.HashingEmbedder(), joined=True).select("query_id", "space_id", "chunk_id", "score", "vector_rank")), sets(retrieval.sparse_pool(chunks, asked, 3, joined=True).select("query_id", "chunk_id", "bm25_score", "bm25_rank"))]
    assert joined == plain and len(plain[0]) == 3 and len(plain[1]) == 2


def test_vectors_are_made_once_a_chunk(spark):
    made = spark.sparkContext.accumulator(0)

    class Counting:
        dimensions = 2

        def column(self, text, kind="document"):
            @F.udf("array<double>")
            def one(value):
                if kind == "document":
                    made.add(1)
                return [1.0, float(len(value))]

            return one(text)

    chunks = spark.createDataFrame([(f"c{n}", "s", "t", "x" * n) for n in range(6)], "chunk_id string, space_id string, title string, raw_body string")
    asked = spark.createDataFrame([(1, "xx", "s")], "query_id int, question string, space_id string")
    assert retrieval.vector_pool(chunks, asked, 2, Counting()).count() == 2
    assert made.value == 6


def test_equal_vectors_are_searched_once_and_all_answered(spark, monkeypatch):
    seen, scorer = [], retrieval._cosine_scorer
    monkeypatch.setattr(retrieval, "_cosine_scorer", lambda shared, *rest: (seen.append(sum(len(m) for _, m in shared.value.values())), scorer(shared, *rest))[1])
    vectors = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [0.6, 0.8]), (3, "t", [0.0, 1.0])], "vec_id int, space_id string, embedding array<double>")
    asked = spark.createDataFrame([(7, "s", [1.0, 0.0]), (8, "s", [1.0, 0.0]), (9, "t", [1.0, 0.0])], "query_id int, space_id string, embedding array<double>")
    got = sets(retrieval.vector_top_k(vectors, asked, 2, within="space_id").select("query_id", "space_id", "vec_id", "score", "vector_rank"))
    assert got == [(7, "s", 1, 1.0, 1), (7, "s", 2, 0.6, 2), (8, "s", 1, 1.0, 1), (8, "s", 2, 0.6, 2), (9, "t", 3, 0.0, 1)]
    assert seen == [2]


def _notes(spark):
    chunks = spark.createDataFrame(
        [(f"c{k:02d}", f"d{k}", "s", "document", "primary", "public", f"{word} notes number {k}", f"{word} page", 20240101.0 + k) for k, word in enumerate(("kafka", "spark", "flink") * 10)],
        "chunk_id string, doc_id string, space_id string, section_type string, retrieval_priority string, visibility string, raw_body string, title string, updated_number double",
    )
    return chunks, spark.createDataFrame([(1, "kafka notes", "s"), (2, "compare spark and flink", "s"), (3, "kafka notes", "s")], "query_id int, question string, space_id string")


def test_texts_come_after_the_cut_of_candidates(spark, monkeypatch):
    whole, described = [], retrieval.described
    monkeypatch.setattr(retrieval, "described", lambda ranked, chunks, asked: (whole.append(("fusion_score" in ranked.columns, "raw_body" in chunks.columns)), described(ranked, chunks, asked))[1])
    got = retrieval.hybrid_search(*_notes(spark), 3, scorer=retrieval.shared_terms, most_reranked=4).select("query_id", "chunk_id", "reranker_score").collect()
    assert [w for w in whole if w[0]] == [(True, False), (True, True)]
    assert len(got) == 9 and all(r.reranker_score == 1.0 for r in got if r.query_id != 2) and all(r.reranker_score == 0.25 for r in got if r.query_id == 2)


def test_single_precision_only_rules_out(monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "MOST_WAITING", 30)
    rng = np.random.default_rng(5)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.normal(size=(300, 16)), rng.normal(size=(5, 16))))
    a[100:200] = a[:100] + rng.normal(size=(100, 16)) * 1e-7  # scores that single precision can't tell apart
    true, best = np.round(a @ b.T, 6), retrieval.Best(4, 5, -np.inf)
    for low in range(0, 300, 11):
        some = a[low : low + 11]
        best.offer(some.astype(np.float32) @ b.T.astype(np.float32), np.arange(low, low + len(some)), retrieval._dots(some, b, 3), 5e-6)
    got = sorted(zip(*(c.tolist() for c in best.settle()), strict=True))
    assert got == sorted((q, v, d) for q in range(5) for v, d in sorted(((true[d, q], d) for d in range(300)), key=lambda x: (-x[0], x[1]))[:4])


def test_both_paths_of_the_adaptive_mode_share_one_vector_pool(spark, monkeypatch):
    made, pool = [], retrieval.vector_pool
    monkeypatch.setattr(retrieval, "vector_pool", lambda *args, **kw: (made.append(1), pool(*args, **kw))[1])
    chunks, asked = _notes(spark)
    got = retrieval.adaptive_search(chunks, asked, 3).filter("path = 'hybrid-rerank'").select("query_id", "chunk_id", "place")
    assert made == [1]
    assert set(sets(got)) <= set(sets(retrieval.hybrid_search(chunks, asked, 3, scorer=retrieval.shared_terms).select("query_id", "chunk_id", "place")))
    assert got.filter("query_id = 2").count() == 3


def test_chunks_of_a_search_are_written_once(spark, small):
    from strandlake.plans import search

    assert all("/table-" in f for f in search._searched(spark, small).inputFiles())
    assert all("/table-" in f for f in search._asked(spark, small).inputFiles())


def test_contained_questions_equal_brute_force(spark):
    texts = [("a", "s", "The Quick brown fox jumps"), ("b", "s", "quick brown"), ("c", "t", "the quick brown fox"), ("d", "s", None), ("e", "s", "纸鸢导航使用Docker"), ("f", None, "quick")]
    asked = [(1, "quick brown fox", "s"), (2, "QUICK", "s"), (3, "quick", "s"), (4, "导航", "s"), (5, "x", "s"), (6, "own fox", "t"), (7, "brown fox jumps high", "s"), (8, "quick brown", "s"), (9, "quick", "u"), (10, "quick brown ", "s")]
    got = sets(retrieval.contained(spark.createDataFrame(texts, "chunk_id string, space_id string, text string"), spark.createDataFrame(asked, "query_id int, question string, space_id string"), width=5).select("query_id", "chunk_id"))
    assert got == sorted((q, c) for q, question, space in asked for c, own, text in texts if own == space and text is not None and question.lower() in text.lower())


def test_turns_of_a_long_session_are_found_by_number(spark):
    import re

    from strandlake.plans import prompt

    rows = [(m, "s", "user", f"m{m}", (m // 3) * 1000) for m in range(90)] + [(200, None, "user", "x", 5), (201, "s", "user", "untimed", None), (202, "u", "user", "alone", 5)]
    history = spark.createDataFrame(rows, "message_id bigint, session_id string, msg_role string, content string, t bigint").withColumn("sent_at", F.timestamp_seconds("t")).drop("t")
    asked = spark.createDataFrame([(3,), (50,), (89,), (200,), (202,)], "query_id bigint")
    turns = prompt.recent_turns(asked, history, 5)
    assert sorted((r.query_id, r.from_end, r.content) for r in turns.collect()) == sorted((q, k, f"m{q - k}") for q in (3, 50, 89) for k in range(1, 6) if q >= k)
    plan = turns._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "session_id" in line]
    assert joins and all(re.search(r"\[session_id#\d+L?, (cast\()?at#", line) for line in joins)  # a session never meets itself


def test_boosts_take_what_is_prepared_of_a_question(spark):
    rows = spark.createDataFrame([(q, c, question, "Kafka and the course of Redis", section, 0.5, 20240101.0 + c) for q, question in enumerate(("latest Kafka course", "which projects use Redis and the Kafka", "获奖", None)) for c, section in enumerate(("education", "project", "award", "summary", None))], "query_id int, chunk_id int, question string, searchable string, section_type string, score double, updated_number double")
    questions = retrieval.prepared(rows.select("query_id", "question").distinct())
    boosted = lambda df: sets(retrieval.freshness_boost(retrieval.section_boost(retrieval.keyword_boost(df), "rank_score"), "intent_score").select("query_id", "chunk_id", "rank_score", "matched_section_intent", "freshness_score"))
    assert boosted(rows.drop("question").join(questions, "query_id")) == boosted(rows)


def test_equal_askings_are_ranked_once_with_their_documents_columns(spark):
    documents = spark.createDataFrame([(f"c{n}", "st"[n % 2], f"kafka {'redis ' * (n % 3)}x{n}", None if n == 3 else f"s{n}", 1.5 * n) for n in range(12)], "doc_id string, space string, text string, section string, dated double")
    asked = spark.createDataFrame([(1, "kafka redis", "s"), (2, "redis kafka", "s"), (3, "kafka", "t"), (4, "kafka redis", "t"), (5, "none", "s"), (6, None, "s")], "query_id int, question string, space string")
    who, ranked = retrieval.bm25_askings(documents, asked, 4, "text", "space", ("section", "dated"))
    assert ranked.select("asking").distinct().count() == 3
    got = who.join(ranked, "asking").select("query_id", "doc_id", "section", "dated", "bm25_score")
    joined = retrieval.bm25_askings(documents, asked, 4, "text", "space", ("section", "dated"), joined=True)
    again = joined[0].join(joined[1], "asking").select(*got.columns)
    assert sets(got) == sets(retrieval.bm25(documents, asked, 4, "text", "space").join(documents, "doc_id").select(*got.columns)) == sets(again)


def test_messages_of_one_content_get_the_same_boosted_chunks(spark):
    chunks = spark.sql("select concat('c', id) as chunk_id, 's' as space_id, if(id % 2 = 0, 'education', null) as section_type, concat('kafka ', repeat('course ', cast(id % 4 as int))) as raw_body, timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as updated_at from range(40)")
    asked = spark.createDataFrame([(n, ("latest kafka course", "course kafka", "kafka")[n % 3], "s") for n in range(9)], "query_id int, question string, space_id string")
    rows = registry._boosted_chunks(asked, chunks, 5)
    hits = retrieval.normalize_by_max(retrieval.bm25(chunks.withColumnRenamed("chunk_id", "doc_id"), asked, 5, "raw_body", "space_id"), "bm25_score", "base").drop("space_id")
    own = chunks.select(F.col("chunk_id").alias("doc_id"), "section_type", F.date_format("updated_at", "yyyyMMdd").cast("double").alias("updated_number"))
    whole = retrieval.freshness_boost(retrieval.section_boost(hits.join(own, "doc_id").join(asked, "query_id"), "base"), "intent_score")
    columns = ("query_id", "intent_score", "freshness_score")
    assert sets(rows.select("chunk_id", *columns)) == sets(whole.select(F.col("doc_id").alias("chunk_id"), *columns)) and rows.count() == 45
    assert "fresh_place" in rows.columns  # settled once an asking, beside the chunk's own columns


def test_parts_hold_whole_places_where_they_can(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_PART", 40)
    rows = spark.range(400).selectExpr("id as key", "case when id < 200 then 'big' when id < 380 then concat('m', id % 6) else concat('s', id % 10) end as place")
    sizes = [tuple(r) for r in rows.groupBy("place").count().orderBy("place").collect()]
    parts = [[r for r in p] for p in retrieval.in_order(rows, sizes, "place", "key").rdd.glom().collect()]
    assert sorted(r.key for p in parts for r in p) == list(range(400)) and all(p == sorted(p, key=lambda r: (r.place, r.key)) for p in parts)
    over = {place: sum(any(r.place == place for r in p) for p in parts) for place, _ in sizes}
    assert over["big"] >= 5 and all(n == 1 for place, n in over.items() if place != "big")
    ranged = [r for p in retrieval.in_order(rows.select("key"), [(None, 400)], "key").rdd.glom().collect() for r in p]
    assert len(ranged) == 400


def test_blocks_of_questions_are_cut_and_packed_in_tasks(spark, monkeypatch):
    words = ("kafka", "redis", "course", "award", "项目", "go", "rust", "spark")
    documents = spark.createDataFrame([(f"c{n}", "st"[n % 2], " ".join(words[i] for i in range(8) if (n * 37 + 11) >> i & 1)) for n in range(60)], "doc_id string, space string, text string")
    questions = [(n, " ".join(words[i] for i in range(8) if n >> i & 1), "stu"[n % 3]) for n in range(256)]
    asked = spark.createDataFrame([*questions, (300, None, "s"), (7, "kafka", "t"), (7, "redis redis", "t")], "query_id int, question string, space string")
    find = lambda: sets(retrieval.bm25(documents, asked, 3, "text", "space").select("query_id", "space", "doc_id", "bm25_score", "bm25_rank"))
    joined = sets(retrieval.bm25(documents, asked, 3, "text", "space", joined=True).select("query_id", "space", "doc_id", "bm25_score", "bm25_rank"))
    whole, seen, frame = find(), [], type(asked)
    to_arrow, create = frame.toArrow, type(spark).createDataFrame
    monkeypatch.setattr(frame, "toArrow", lambda df: (seen.append((made := to_arrow(df)).num_rows), made)[1])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *rest, **more: (seen.append(1000), create(self, *rest, **more))[1])
    monkeypatch.setattr(retrieval, "MOST_ASKED", 200)  # several blocks
    assert find() == whole == joined and len(whole) > 300
    assert len(seen) > 5 and max(seen) <= 30  # terms, spaces and packed blocks, and neither questions nor askings
