from pyspark.sql import functions as F

from strandlake.functions import keys, split
from strandlake.functions import text as T


def value(spark, column_of, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.select("k", column_of(F.col("t")).alias("v")).orderBy("k").select("v").collect()]


def test_whitespace(spark):
    assert value(spark, T.normalize_whitespace, "a\r\nb \n c\n\n\n\nd\t\te ", None, "", "a  b", " x ") == ["a\nb\nc\n\nd e", None, "", "a  b", "x"]


def test_clean_text(spark):
    clean = lambda c: T.clean_text(c, urls=True, emails=True)
    got = value(spark, clean, "a &amp; <b>b</b><script>x()</script>c", "见https://a.example/p?q=1, 好", "mail x.y+z@mail5.example.com now", "see www.site.org/a). End", None)
    assert got == ["a & b c", "见, 好", "mail now", "see ). End", None]


def test_tokens(spark):
    assert value(spark, T.count_tokens, "café C++ 数据, x_1", None, "") == [7, 0, 0]
    assert value(spark, T.search_tokens, "Hi 数据湖 v2", None) == [["hi", "v2", "数", "据", "湖", "数据", "据湖"], []]


def test_counted_tokens_equal_listed_ones(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text")
    assert rows.filter(T.count_search_tokens(F.col("text")) != F.size(T.search_tokens(F.col("text")))).count() == 0


def test_small_functions(spark):
    assert value(spark, T.detect_language, "这是中文", "no", None) == ["zh", "en", None]
    assert value(spark, lambda c: T.date_number(c), "2024-3-5", "May 2023", "x", None) == [20240305.0, 20230101.0, None, None]
    assert value(spark, T.slugify, "My  Space!", "中文", "") == ["my-space", "space", "space"]
    assert value(spark, T.valid_http_url, "https://a.example/x", "ftp://a.example", "x", None) == [True, False, False, False]
    keys_ = value(spark, T.version_title_key, "Guide v2.1 FINAL", "guide_copy", "Guide version 3 (updated, EN)", "指南 中文 master", "Etüde no. 4", None)
    assert keys_ == ["guide", "guide_copy", "guide", "指南", "etüde no", None]  # an underscore is part of a word
    assert value(spark, T.file_stem, "a/b/guide.v2.md", ".profile", "c:\\x\\y.txt", "plain") == ["guide.v2", ".profile", "y", "plain"]
    assert value(spark, T.is_mojibake, "Ã©tÃ©", "été", None) == [True, False, False]
    assert value(spark, T.public_pii_kinds, "住址：某路 1", "call 0412 345 678", None) == [["address"], ["phone"], []]


def test_keys(spark):
    df = spark.createDataFrame([("a", None)], "t string, n string")
    row = df.select(keys.document_id(F.col("n"), F.col("t")).alias("d"), keys.catalog_id(F.col("t"), F.lit("A/B")).alias("c")).first()
    assert row.d.startswith("doc_") and len(row.d) == 24 and row.c.startswith("local_") and len(row.c) == 30


def test_split_keeps_everything():
    text = "# A\nword " + " ".join(f"w{k}" for k in range(300)) + "\n\n中文。" * 50
    for literals in (None, split.BUDGET_LITERALS, split.CHILD_LITERALS):
        pieces = split.split_recursive(text, 40, 0, literals=literals)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        assert all(split.token_length(p) <= 41 for p in pieces)
    assert split.split_recursive("", 10) == [] and split.split_recursive("   ", 10) == []


def test_split_overlap_and_modes():
    pieces = split.split_recursive("a b c d e f g h", 4, 2, literals=split.CHILD_LITERALS)
    assert pieces[0] == "a b c d" and pieces[1].startswith("c d")
    assert split.split_paragraphs("a b\n\nc d\n\ne f g h i", 5) == ["a b\n\nc d", "e f g h i"]
    assert [p[:3] for p in split.split_markdown("intro\n# A\nx\n## B\ny", 50)] == ["int", "# A", "## "]


def test_pattern_separator_cuts_before_last_letter():
    assert split.split_recursive("hello world foo", 2, 0, measure=lambda t: len(t.split()))[0].startswith("hell")


def test_html_and_sizes(spark):
    page = "<html><head><title>x</title></head><body><h2>Head</h2><p>a &amp; b<br>c</p><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>z</script></body></html>"
    assert T.structured_text("<table><tr><th> A  b</th><td></td><td>c&#33;</td></tr></table>x&nbsp;y&copy;&#x41;&amp;lt; &#99999999; a < b") == "A b | c!\n\nx y&copy;A&lt; &#99999999; a < b"
    assert T.structured_text("<H2>a <b>b</b>\n c</H2>one<br/>two") == "## a b c\none\ntwo"
    assert value(spark, T.html_to_text, page, None, "plain") == ["## Head\n\na & b\nc\n\n- one\n\n- two\n\n1 | 2", None, "plain"]
    # a Han character after letters belongs to their word; signs count, underscores don't
    assert value(spark, T.estimated_tokens, "two words 数据 カタカナ", None, "abc数据", "数据abc", "a_b, c!", "한국어") == [6, 0, 1, 3, 5, 2]
    assert value(spark, T.is_resume, "my CV 2024", "简历草稿", "curve", None, "Résumé", "ＣＶ final", "cv2024", "curriculum_-vitae", "resumes") == [True, True, False, False, True, True, False, True, False]


def test_public_cleaning(spark):
    clean = lambda c: T.clean_public(c, urls=True, emails=True)
    assert value(spark, clean, "see https://a.example/x?y=1, then http://b.example/x。", "mail ü.b@c.example now", "a\r\nb\t\tc <b>", None, "https://") == ["see , then 。", "mail now", "a\nb c <b>", None, "https://"]
    assert value(spark, T.clean_flat, "<p>a&amp;b</p>\n c", None) == ["a&b c", None]


def test_pii_spans(spark):
    text = "住址：某路 1 号\nmail a.b@c.example, id 11010119900307123X, call 0412 345 678 or 13912345678"
    found = [(text[a:b], kind) for a, b, kind in T.spans_of(text)]
    assert found == [("住址：某路 1 号", "address"), ("a.b@c.example", "email"), ("11010119900307123X", "national_id"), ("0412 345 678", "phone"), ("13912345678", "phone")]
    assert T.spans_of(None) == T.spans_of("") == [] and T.spans_of("home address: x@y.example") == [(14, 25, "email")]  # mail comes first
    local = value(spark, T.local_pii, "A@b.example and +86 13912345678", None, "113912345678")
    assert [[tuple(f) for f in row] for row in local] == [[("email", "A@b.example"), ("phone", "+86 13912345678")], [], []]
