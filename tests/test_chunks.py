"""Chunk trees, contracts, previews and profiles: made-up cases with known parents, children and groups."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandlake.functions import preview, profiles, resume
from strandlake.functions.split import token_length
from strandlake.operators import chunking

RESUME = """Personal Information

Mara Lindqvist

Aim: data engineer

EDUCATION

Northfield University | Statistics | 2019 - 2021

Courses: sampling, regression.

Projects

Loom catalogue | 2022

Tech stack: Kafka, Spark

Built the ingest.

Shelf search | 2023

Tech stack: Lucene

Profile

Careful with numbers.

Also writes well.

Skills

Tools and collaboration

Git, reviews"""


def tree(spark, body, profile, title="A guide"):
    df = spark.createDataFrame([("d", title, body), ("n", None, None), ("b", "", "  ")], "doc_id string, title string, body string")
    rows = chunking.chunk_tree(df, profile.column()).orderBy("parent_index", "child_index").collect()
    return [r for r in rows if r.child_index is None], [r for r in rows if r.child_index is not None]


def test_resume_contract(spark):
    parents, children = tree(spark, RESUME, profiles.RESUME)
    assert [(p.section_type, p.entity_title, p.retrieval_priority) for p in parents] == [
        ("profile", "Personal Information", "primary"), ("education", "Northfield University | Statistics | 2019 - 2021", "primary"), ("project", "Loom catalogue | 2022", "primary"),
        ("project", "Shelf search | 2023", "primary"), ("summary", "Profile 1", "primary"), ("summary", "Profile 2", "secondary"), ("skill", "Tools and collaboration", "primary"), ("skill", "Additional skill variants", "secondary"),
    ]
    assert parents[1].section_path == "Education > Northfield University | Statistics | 2019 - 2021"
    assert len(children) == len(parents) and all(c.raw_body == c.parent_body for c in children)
    made = {(r.parent_index, r.child_index): r.semantic_group_index for r in chunking.contract(chunking.chunk_tree(spark.createDataFrame([("d", "T", RESUME)], "doc_id string, title string, body string"), profiles.RESUME.column())).collect()}
    assert [made[k, -1] for k in range(8)] == [0, 1, 2, 3, 4, 4, 5, 6] == [made[k, 0] for k in range(8)]  # both summaries are one group
    group = "group_" + hashlib.sha256("d\neducation\nnorthfielduniversity|statistics|2019-2021".encode()).hexdigest()[:20]
    assert parents[1].semantic_group_id == group


def test_general_profile_has_one_child_each(spark):
    body = "# Loom\n\nFirst part.\n\n## Shelf\n\nSecond part."
    parents, children = tree(spark, body, profiles.GENERAL)
    assert len(parents) == len(children) == 1 and children[0].raw_body == parents[0].raw_body == body
    assert children[0].retrieval_text == parents[0].retrieval_text == f"[Document: A guide | Section: Loom]\n{body}"
    assert children[0].chunk_id == "child_" + hashlib.sha256(f"{parents[0].chunk_id}\n{body}".encode()).hexdigest()[:20]
    assert parents[0].chunk_id == "parent_" + hashlib.sha256(f"d\n0\n{body}".encode()).hexdigest()[:20]


def test_parents_and_children(spark):
    body = "\n\n".join(f"Paragraph {k} " + "word " * 100 for k in range(20))
    parents, children = tree(spark, body, profiles.PARENT_CHILD)
    assert len(parents) == 4 and all(p.token_count <= 700 for p in parents) and all(c.token_count <= 181 for c in children)
    assert {c.semantic_group_id for c in children} == {p.semantic_group_id for p in parents} and len({c.chunk_id for c in children}) == len(children)
    # children are titled by their parent's entity, which here is the document
    assert children[0].retrieval_text.startswith("[Document: A guide | Entity: A guide]\n")
    # children split at a full stop only where a blank follows: Chinese sentences stay together
    chinese = "。".join("字" * 100 for _ in range(3))
    assert [c.token_count for c in tree(spark, chinese, profiles.PARENT_CHILD)[1]][0] == 180


def test_long_entities_repeat_their_title():
    unit = resume.Unit("project", "Projects", "Loom | 2022", "Loom | 2022", paragraphs=["Loom | 2022", "word " * 100, "word " * 100, "word " * 600])
    bodies = list(resume.bodies_of(unit, 320))
    assert all(b.startswith("Loom | 2022\n\n") and token_length(b) <= 320 for b in bodies) and sum(b.count("word") for b in bodies) == 800
    assert list(resume.bodies_of(resume.Unit("project", "P", "x " * 400, "g", paragraphs=["x " * 400]), 320))  # a long title alone isn't lost


def test_profiles_by_kind_and_size(spark):
    long, short = "word " * 2001, "word"
    cases = [
        ("csv", "my resume", long, None, None, "general", 0), ("json", "cv", short, None, None, "general", 0), ("json", "cv", long, None, None, "general", 80), ("docx", "Résumé 2024", short, None, None, "resume_semantic", 0),
        ("png", "resume", short, None, None, "general", 80), ("md", "notes", long, None, None, "parent_child", 20), ("py", "notes", long, None, None, "general", 80), ("pdf", "x", short, None, "Resume_Root ", "resume_semantic", 0),
        (None, "x", short, "a/my_cv.docx", None, "resume_semantic", 0), (None, "x", short, "a/mycv.docx", None, "general", 80), (None, "x", short, "a/my-cv.docx", None, "resume_semantic", 0), (".MD", "x", None, None, None, "general", 80), (None, None, long, "a/b.txt", None, "parent_child", 20),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, file_type string, title string, body string, file_name string, source string, mode string, overlap int")
    made = profiles.recommended(F.col("file_type"), F.col("title"), F.col("body"), F.col("file_name"), F.col("source"))
    for row in df.select("*", made.alias("p")).collect():
        assert (row.p.chunk_mode, row.p.overlap_tokens) == (row["mode"], row.overlap), row
    legacy = [("docx", "x", 320), ("txt", "README first", 800), ("txt", "x", 700), ("pdf", "x", 800), ("py", "x", 900), ("json", "x", 800), (None, None, 800), ("md", "简历", 320)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(legacy)], "k int, file_type string, title string, size int")
    assert all(r.size == r.c["size"] for r in df.select("size", profiles.recommended_chunking(F.col("file_type"), F.col("title"), F.lit("b")).alias("c")).collect())


def test_stored_and_legacy_profiles(spark):
    rows = [("markdown", 800, 80, "characters", 200, 20), ("recursive", 1000, 100, "tokens", 1000, 100), ("fixed", 800, 80, "tokens", None, None), ("paragraph", 100, 0, "tokens", None, None), ("paragraph", 400, 101, "tokens", None, None), ("Recursive ", 1001, 1, "characters", 251, 1)]
    df = spark.createDataFrame(rows, "strategy string, size int, overlap int, unit string, most int, over int")
    made = profiles.from_legacy(F.lit("x"), F.lit("txt"), F.col("strategy"), F.col("size"), F.col("overlap"), F.col("unit"))
    for r in df.select("*", made.alias("p")).collect():
        assert (r.p and (r.p.max_tokens, r.p.overlap_tokens)) == (r.most and (r.most, r.over)), r
    texts = ['{"chunk_mode": "general", "max_tokens": 400, "overlap_tokens": 40}', '{"chunk_mode": "parent_child", "max_tokens": 180, "overlap_tokens": 20}', '{"chunk_mode": "parent_child", "max_tokens": 100}', '{"max_tokens": 100}', "no json", None, '{"chunk_mode": "other"}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.p and r.p.max_tokens for r in df.select("k", profiles.stored(F.col("t")).alias("p")).orderBy("k").collect()]
    assert got == [400, 180, None, None, None, None, None]
    for profile in (profiles.GENERAL, profiles.PARENT_CHILD, profiles.RESUME):
        assert spark.range(1).select(profiles.canonical_digest(profile.column())).first()[0] == profile.digest()


def test_chunk_records_take_the_first_of_equal_bodies(spark):
    columns = "doc_id string, title string, body string, space_id string, visibility string, file_type string, file_name string, source string, source_path string, relative_path string, project string, modified_at string, chunk_strategy string, chunk_size int, chunk_overlap int, chunk_unit string, processing_profile_json string"
    base = ("s", None, "txt", "a.txt", "x", "", "", None, None)
    rows = [("b", "B", "same &amp; text", *base, "fixed", 1, 0, "tokens", None), ("a", "A", "same & text", *base, "recursive", 400, 40, "tokens", None), ("c", "C", None, *base, None, None, None, None, None), ("d", "D", "word " * 900, *base, "recursive", 400, 0, "tokens", '{"max_tokens": 300, "overlap_tokens": 0}')]
    made = chunking.chunk_records(spark.createDataFrame(rows, columns), F.col("title")).collect()
    assert {r.doc_id for r in made} == {"a", "d"} and all(r.visibility == "private" and r.chunk_unit == "tokens" for r in made)
    assert max(r.token_count for r in made if r.doc_id == "d") <= 301  # the stored profile comes before the stored settings
    assert {r.raw_body for r in made if r.doc_id == "a"} == {"same & text"} and len({r.processing_profile_hash for r in made}) == 2


def test_preview_of_a_resume(spark):
    df = spark.createDataFrame([("d", "My CV", RESUME), ("n", None, None), ("e", "x", "")], "doc_id string, title string, body string")
    mode = chunking.public_profile(F.lit(None).cast("string"), F.col("title"), F.col("body"))
    made = chunking.preview_chunks(df, mode).orderBy("parent_index", "child_index").collect()
    assert [(r.section_type, r.entity_title) for r in made] == [
        ("profile", "Personal Information"), ("education", "Northfield University | Statistics | 2019 - 2021"), ("project", "Loom catalogue | 2022"), ("project", "Shelf search | 2023"),
        ("summary", "Careful with numbers."), ("summary", "Also writes well."), ("skill", "Tools and collaboration"),
    ]
    assert made[1].retrieval_text.startswith("[Document: My CV | Section: EDUCATION > Northfield")
    assert {r.doc_id for r in made} == {"d"} and len({r.chunk_id for r in made}) == len(made)


@pytest.mark.parametrize("text", ["", "a b", "one. two! three? " * 40, "字" * 500, "a/b " * 30, "x" * 900])
def test_packing_keeps_everything(text):
    for most in (5, 40):
        pieces = preview.pack([text], most)
        assert "".join("".join(pieces).split()) == "".join(text.split())
    assert preview.tokens(preview.tail(text, 4)) <= 4 and text.strip().endswith(preview.tail(text, 4))


def test_published_sections_by_other_rules():
    text = "**教育经历**\n\n北学院\n\n东大学 | 2020\n\n## Awards\n\nA prize\n\nplain\n\nBest award"
    assert [(s.kind, s.entity, s.body) for s in preview.resume_sections(text)] == [("education", "北学院", "北学院"), ("education", "东大学 | 2020", "东大学 | 2020"), ("award", "A prize", "A prize\n\nplain"), ("award", "Best award", "Best award")]
    general = list(preview.preview("a\n\nb\n\nc", "T", "standard", 700, 2, 0))
    assert [(s.path, p, c) for s, p, c in general] == [("", "a\n\nb", ["a\n\nb"]), ("", "c", ["c"])]
    assert json.dumps([c for _, _, c in preview.preview("a b\n\nc d", "T", "parent_child", 10, 2, 0)]) == '[["a b", "c d"]]'
