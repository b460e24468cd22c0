import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import html, ignore, models, paths, sniff, text, urls
from sheaf.operators.snapshot import snapshot_diff


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_extension_and_language(spark):
    names = [".bashrc", "a.b/c", "x.tar.gz", "A.GO", "README.md", "page.HTM", "n", "a/.x/b.mjs"]
    assert values(spark, [(n,) for n in names], "p string", paths.file_ext(F.col("p"))) == [
        ".bashrc", "", ".gz", ".GO", ".md", ".HTM", "", ".mjs"
    ]
    langs = values(spark, [(n,) for n in names], "p string", paths.language_id(F.col("p")))
    assert langs == [None, None, None, "go", None, "html", None, "javascript"]


def test_ancestors_and_parent(spark):
    rows = [("a",), ("a/b",), ("a/b/c.py",)]
    assert values(spark, rows, "p string", paths.ancestors(F.col("p"))) == [[], ["a"], ["a", "a/b"]]
    assert values(spark, rows, "p string", paths.parent_dir(F.col("p"))) == [".", "a", "a/b"]


def test_walk_order(spark):
    names = ["a.b", "a/b", "a", "a-b", "a/b/c"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").orderBy(paths.walk_key(F.col("p")))
    assert [r.p for r in rows.collect()] == ["a", "a/b", "a/b/c", "a-b", "a.b"]


def test_formatting(spark):
    rows = [("x\n", ".py"), ("", ""), ("é\r\nb", ".c")]
    assert values(spark, rows, "t string, e string", text.line_numbers(F.col("t"))) == [
        "   1 | x\n   2 | ", "   1 | ", "   1 | é\r\n   2 | b"
    ]
    assert values(spark, rows, "t string, e string", text.code_fence(F.col("t"), F.col("e"))) == [
        "```py\nx\n\n```", "```\n\n```", "```c\né\r\nb\n```"
    ]
    shown = text.format_file(F.col("t"), F.col("e"), number=True, outline=F.when(F.col("e") == ".c", "short"))
    assert values(spark, rows, "t string, e string", shown)[2] == "short"


@settings(max_examples=20, deadline=None)
@given(lines=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\n\x00"), max_size=8), min_size=1, max_size=12))
def test_line_numbers_property(spark, lines):
    got = values(spark, [("\n".join(lines),)], "t string", text.line_numbers(F.col("t")))[0]
    assert got == "\n".join(f"{i:4d} | {line}" for i, line in enumerate(lines, 1))


def test_trim_is_unicode(spark):
    assert values(spark, [(" \x0b  a b \x85　\n",)], "t string", text.trim_space(F.col("t"))) == ["a b"]


def test_thousands(spark):
    assert values(spark, [(0,), (-1234567,), (999,), (1000,)], "n bigint", text.thousands(F.col("n"))) == [
        "0", "-1,234,567", "999", "1,000"
    ]


def test_affix(spark):
    assert values(spark, [("p",)], "t string", text.prompt_affix(F.col("t"), "a", ["b", "c"])) == ["a\np\nb c"]
    assert values(spark, [("p",)], "t string", text.prompt_affix(F.col("t"))) == ["p"]


def test_pdf_text(spark):
    page = "  Title \r\n% note\n/Type\n1 0 obj\nan object lesson\n\tlast\x0cline "
    rows = [(page,), ("x endobj",), ("%PDF-1.4",), ("",)]
    assert values(spark, rows, "t string", text.pdf_clean_text(F.col("t"))) == ["Title\n\nlastline", "", "", ""]
    assert values(spark, rows[:1], "t string", text.pdf_clean_text(F.col("t"), strict=False)) == [
        "Title\n\n1 0 obj\n\nan object lesson\n\nlastline"
    ]


SNIFFED = [
    (b"", True),
    ("päth".encode(), True),
    (b"a" * 511 + b"\x00", False),
    (b"a" * 512 + b"\x00", True),
    (b"BMW is a car", False),
    (b"GIF89a", False),
    (b"%!PS-Adobe-3.0", False),
    (b"%PDF-1.7\x00", True),
    (b"\x89PNG\r\n\x1a\n", False),
    (b"\x1b[0m colour", True),
    (b"\n <HTML>\x00", True),
    (b"<htmlx\x00", False),
    (b"<?xml\x00", True),
    (b"\xff\xfea\x00b\x00", True),
    (b"\xff\xd8\xff\xe0", False),
    (b"PK\x03\x04", False),
    (b"RIFF....WEBPVP8 ", False),
    (b"ID3 tag", False),
    (b"wOF2", False),
    (b"\xc3\x28 odd bytes", True),
    (b"a\x0bb", False),
]


def test_sniff(spark):
    rows = [(bytearray(data),) for data, _ in SNIFFED]
    assert values(spark, rows, "b binary", sniff.text_sniff(F.col("b"))) == [hit for _, hit in SNIFFED]


def test_pdf_detect(spark):
    rows = [(bytearray(b"%PDF-1"), "a"), (bytearray(b"x"), "a.PDF"), (bytearray(b"x"), "a.pdf.txt")]
    assert values(spark, rows, "b binary, p string", text.pdf_detect(F.col("b"), F.col("p"))) == [True, True, False]


BASE = "http://a/b/c/d;p?q"
# The reference resolution examples of RFC 3986, and some of our own.
RESOLVED = [
    ("g:h", None), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"),
    ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"),
    (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"),
    ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"),
    ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"),
    ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("mailto:x@y", None),
    ("https://u@h:80/x y", "https://u@h:80/x%20y"), ("/für,", "http://a/f%C3%BCr,"), ("a%zz", None),
    ("HTTPS://x/", "https://x/"), ("/a%2Fb", "http://a/a%2Fb"), ("x#für", "http://a/b/c/x#f%C3%BCr"), ("a:b", None),
    ("javascript:void(0)", None), ("/a//b", "http://a/a//b"), ("/x+y", "http://a/x+y"),
]


def test_resolve(spark):
    got = values(spark, [(h,) for h, _ in RESOLVED], "h string", urls.resolve_url(F.lit(BASE), F.col("h")))
    assert got == [r for _, r in RESOLVED]


def test_url_predicates(spark):
    rows = [("http://u:p@h.x:80/a//b/../c/",), ("http://h",), ("https://h/",), ("h b",), ("http:///x",), ("http://h/f%C3%BCr",)]
    assert values(spark, rows, "u string", urls.is_url(F.col("u"))) == [True, True, True, False, False, True]
    assert values(spark, rows, "u string", urls.url_label(F.col("u"))) == [
        "h.x:80/a/c", "h", "h", "/h b", "/x", "h/für"
    ]
    assert values(spark, rows[:3], "u string", urls.domain_allow(F.col("u"), [".x:8"])) == [True, False, False]
    assert values(spark, rows, "u string", urls.url_exclude(F.col("u"), ["für", "/"]))[1:] == [True, True, False, False, True]
    assert values(spark, rows[1:3], "u string", urls.single_page(F.col("u"), "http://z/p/")) == [False, False]
    assert values(spark, [("http://q/p?x",)], "u string", urls.single_page(F.col("u"), "http://z/p/")) == [True]


def test_html(spark):
    page = (
        "<!-- <a href='no'> --><title>A &amp; B</title><script>var a='<a href=\"no\">'</script>"
        "<a class=x href=one>1</a><A HREF='t&amp;w'>2</A><a name=z>3</a><abbr href=no><a\nhref = \"&#233;\">4</a>"
        "<svg><title>!</title></svg>"
    )
    assert values(spark, [(page,)], "h string", html.hrefs(F.col("h"))) == [["one", "t&w", "é"]]
    assert values(spark, [(page,)], "h string", html.page_title(F.col("h"))) == ["A & B!"]
    odd = "a &amp; &#x1F600; &eacute; &nope; & &#0; &#xD800; &#9999999; &amp"
    assert values(spark, [(odd,)], "h string", html.unescape(F.col("h"))) == [
        "a & 😀 é &nope; & � � � &amp"
    ]


RULES = ["# note", "", "*.log", "!keep.log", "build/", "/top", "doc/*.txt", "a/**/z", r"\#x", "q?"]
IGNORED = [
    ("x.log", True), ("d/x.log", True), ("keep.log", False), ("build", False), ("build/x", True), ("s/build/x/y", True),
    ("top", True), ("s/top", False), ("top/x", True), ("doc/a.txt", True), ("s/doc/a.txt", False), ("a/z", True),
    ("a/b/c/z", True), ("#x", True), ("note", False), ("qa", False), ("q?", True), ("xlog", False),
]


def test_ignore_rules(spark):
    rows = [(p,) for p, _ in IGNORED]
    assert values(spark, rows, "p string", ignore.ignored_by(F.col("p"), RULES)) == [hit for _, hit in IGNORED]
    made = spark.createDataFrame([("r", ".gitignore", "\n".join(RULES))], "root string, path string, content string")
    table = ignore.ignore_rules(made)
    joined = spark.createDataFrame([("r", p) for p, _ in IGNORED], "root string, p string").join(table, "root")
    got = {r.p: r.hit for r in joined.select("p", ignore.ignored_by_rules(F.col("p"), F.col("rules")).alias("hit")).collect()}
    assert got == dict(IGNORED)


@pytest.mark.parametrize("alias,encoding", [("gpt-4", "cl100k"), ("llama2", "o200k"), ("gpt2", "r50k"), ("?", "o200k")])
def test_aliases(spark, alias, encoding):
    assert values(spark, [(alias,)], "a string", models.encoding_of(F.col("a"))) == [encoding]


def test_model_info(spark):
    rows = [("gpt-4",), ("llama2",), ("cl100k",)]
    got = values(spark, rows, "a string", models.model_info(F.col("a")))
    assert got[0] == models.MODERN_MODELS and got[1].startswith("Legacy") and got[2].startswith("Llama3")


def test_correction_truncates(spark):
    assert values(spark, [(n,) for n in (0, 1, 50, 15945)], "n bigint", models.corrected(F.col("n"))) == [
        int(n * 1.18) for n in (0, 1, 50, 15945)
    ]


def test_references_of_any_length(spark):
    rows = [("&#00000065;&#x00000041;&#x0;&#99999999999999999999;&#xD800;&NotEqualTilde;&nosuchname;",)]
    text = spark.createDataFrame(rows, "t string").select(html.unescape(F.col("t"))).first()[0]
    assert text == "AA\ufffd\ufffd\ufffd\u2242\u0338&nosuchname;"


def test_snapshots_of_null_texts(spark):
    schema = "root string, path string, content string"
    left = spark.createDataFrame([("r", "gone", None), ("r", "same", None), ("r", "lost", "a\nb"), ("r", "odd", "")], schema)
    right = spark.createDataFrame([("r", "new", None), ("r", "same", None), ("r", "lost", None), ("r", "odd", None)], schema)
    got = {r.path: (r.status, r.lines_added, r.lines_removed) for r in snapshot_diff(left, right).collect()}
    assert got == {"gone": ("removed", 0, 0), "new": ("added", 0, 0), "lost": ("modified", 0, 2), "odd": ("modified", 0, 0)}
