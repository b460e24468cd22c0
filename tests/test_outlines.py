"""Outlines of sources of our own: what they must hold and what they must not."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.checks.code_checks import LANG_OF, TEMPLATES
from sheaf.functions import html
from sheaf.functions import outlines as patterns
from sheaf.functions.text import trim_space
from sheaf.operators import outline as outlining

HOLDS = {
    ".go": (
        ["package p7", 'import "fmt"', 'import (\n\t"os"\n\t"strings"\n)', "/* block\n   comment */", "type S7 struct {", "type 7s = []string",
         "func (s *S7) Get(v int, f func(int) int) (string, error) { ... }\n", "func main7() interface{} { ... }\n", "// inside", "//note"],
        ["return", "Println", "func no", "type no"],
    ),
    ".py": (
        ["#note", "import os", "from sys import (\n    argv,\n    path,\n)", "class C7(dict): { ... } # Body removed", "# inside",
         "def get(self, a: int = 3, b={\"x\": (1, 2)}) -> dict: { ... } # Body removed", "async def run7(x,\n        y): { ... } # Body removed"],
        ["def no", "return", "print"],
    ),
    ".js": (
        ["import { a as b, c } from 'm';", "import 'side';", "export class C7 extends Base { ... } // Body removed", "constructor(n) { ... } // Body removed",
         "get(a, { b = 1 }) { ... } // Body removed", "export function f7(x, y = g(1)) { ... } // Body removed", "function* gen7() { ... } // Body removed",
         "const arrow7 = async (a, b) => { ... } // Body removed", "const short7 = (x) => { ... } // Body removed", "export const v7 = 42;",
         "export { v7 as w };", "export default f7;"],
        ["function no", "if (", "for (", "yield", "x * x", "return"],
    ),
    ".sh": (
        ["#!/bin/bash", "function greet7() { ... } # Body removed", "proc7() { ... } # Body removed", 'echo "Hello # not, $name"\n', "# said",
         'cat "$1"', "grep -v 'x;y' > out 2>&1", 'greet7 "$i"', "proc7 /tmp/f7", "exit 0"],
        ["local name", "X=1", "export", "for i", "done", "if ["],
    ),
    ".c": (
        ["#include <stdio.h>", '#include "a7.h"', "/* block */", "struct P7 {\n  int a;\n  struct { int b; } in;\n}", "enum C7 { RED, GREEN }",
         "typedef unsigned long u7;", "typedef struct { int x; } t7;", "static int *run7(int a, char *b[]) { ... } // Body removed", "// inside", "struct P7\n// -----"],
        ["return", "int no", "if ("],
    ),
    ".css": (
        ["/*note*/", "@import url('a;7.css') screen;", ":root {\n  --c: #fff;\n}", ".a7 > b:hover, c {\n  color: red; /* in */\n}",
         "@media (max-width: 9px) {\n  .a7 {\n    top: 0;\n  }\n}", "@keyframes k7 {\n  from { top: 0; }\n  to { top: 1px; }\n}"],
        ["font-face"],
    ),
    ".html": (["<!DOCTYPE html>\n// -----\n<html lang=\"x\">\n// -----\n</html>\n// -----\n<head>\n// -----\n</head>\n// -----\n<header>\n// -----\n<!--note-->"], ["script", "title"]),
    ".rs": (
        ["use std::io::{self, Read};", "pub struct P7 {\n    a: u32,\n}", "pub trait T7 {\n    fn go(&self);\n}", "enum E7 { A, B }",
         "pub fn new7(a: u32) -> Self {", "impl T7 for P7 {"],
        ["impl P7"],
    ),
    ".java": (
        ["package a.b7;", "import java.util.List;", "/** doc */", "public final class C7 extends Base implements X, Y {", "interface I7 extends J {",
         "public enum F7 {", "public static <T> T get(T a, int b) throws E {", "if (b > 1) {"],
        ["return"],
    ),
    ".swift": (
        ["import Foundation", "public struct S7: Codable {", "final class C7 {", "static func make(_ a: Int) -> C7 {", "protocol P7 {", "enum E7: Int {",
         "extension C7: P7 {", "func go() {"],
        ["return"],
    ),
}


def outlined(spark, ext, text, **options):
    rows = spark.createDataFrame([(f"x{ext}", text)], "path string, content string")
    return outlining.outline(rows, **options).first().outline


@pytest.mark.parametrize("ext", HOLDS)
def test_templates(spark, ext):
    text = outlined(spark, ext, TEMPLATES[ext].replace("ID", "7").replace("TEXT", "note"))
    holds, lacks = HOLDS[ext]
    for part in holds:
        assert part in text, (part, text)
    for part in lacks:
        assert part not in text, (part, text)


def test_unknown_language_keeps_its_text(spark):
    assert outlined(spark, ".md", "# x\n") == "# x\n"


@pytest.mark.parametrize("ext", LANG_OF)
def test_nothing_found(spark, ext):
    assert outlined(spark, ext, "").startswith("// No relevant ")


def test_line_ends(spark):
    """Only a line feed ends a line, and a vertical tab is no white space."""
    assert outlined(spark, ".rs", "// a\rb\u2028c\x85d\n").startswith("// a\rb\u2028c\x85d\n// -----")
    assert outlined(spark, ".rs", "use\x0bx;") == "// No relevant Rust elements found after compression.\n"
    assert outlined(spark, ".go", "// a\r\npackage x\r\n") == "// a\n// -----\npackage x\n// -----\n"


def test_options(spark):
    css = outlined(spark, ".css", "@media x {\n a { top: 0; left: 1 }\n}\nb { right: 2 }", css_declarations=True)
    parts = css.split("\n// -----\n")[:-1]
    assert parts == ["@media x {\n a { top: 0; left: 1 }\n}", "a { top: 0; left: 1 }", "b { right: 2 }", "right: 2"]
    named = outlined(spark, ".py", "def go(a):\n  pass\n", emit_names=True)
    assert named == "def go(a): { ... } # Body removed\n// -----\ngo\n// -----\n"


def test_anonymous_default_exports(spark):
    text = outlined(spark, ".js", "export default function (a) {\n  b();\n}\n")
    assert text == "export default function() { ... } // Body removed\n// -----\n"


def test_long_strings_do_not_recurse(spark):
    text = 'x = "' + "a\\n" * 200_000 + '"\ndef f(' + "a, " * 50_000 + "z):\n  pass\n"
    assert outlined(spark, ".py", text).endswith("z): { ... } # Body removed\n// -----\n")
    text = 'const x = `' + "\\`" * 200_000 + "`;\nfunction f() {\n}\n"
    assert outlined(spark, ".js", text) == "function f() { ... } // Body removed\n// -----\n"
    assert outlined(spark, ".sh", 'echo "' + 'a\\"' * 100_000 + '"\n').startswith('echo "a')
    assert outlined(spark, ".java", "int x = " + "y" * 300_000 + ";") == "// No relevant Java elements found after compression.\n"


def test_chunks_carry_their_kind(spark):
    rows = spark.createDataFrame([("a.go", "package a\n// c\nfunc (t T) M() {\n}\nfunc f() {\n}\n")], "path string, content string")
    got = [(r.chunk_no, r.kind) for r in outlining.outline_chunks(rows).orderBy("chunk_no").collect()]
    assert got == [(0, "package"), (1, "comment"), (2, "method"), (3, "function")]
    assert rows.select(F.size(outlining.chunks(F.col("content"), F.lit("none")))).first()[0] in (None, -1)


OPENERS = {
    "html": "<!-- <!DOCTYPE <html <head <body", "rust": "/* use|x struct|x|{ trait|x|{ enum|x|{ fn|x(", "java": "/* import|x class|x enum|x f(",
    "swift": "/* struct|x: func|x(", "go": "/*", "javascript": "/*", "c": "/*", "css": "/*",
}


@pytest.mark.parametrize("lang", OPENERS)
def test_openers_that_are_never_closed(spark, lang):
    """One after the other, twenty thousand of each, none closed: no chunk, and no time."""
    texts = [(opener.replace("|", " ") + " ") * 20_000 for opener in OPENERS[lang].split()]
    rows = spark.createDataFrame([("x", t) for t in texts], "path string, content string").repartition(len(texts))
    start = time.perf_counter()
    assert rows.select(F.explode(outlining.chunks_of(F.col("content"), lang))).count() <= len(texts)
    assert time.perf_counter() - start < 30


def _is(kind):
    return lambda c: c["kind"] == kind


_FORMS = ["public ", "private\n", "static ", "my", "final ", "<T> ", "<", "> ", "a", "b1", "[] ", "(", ")", " throws X ", "{", "}", ";", " ", "é", "/*", "*/", "//", "\n"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(_FORMS), max_size=14).map("".join), min_size=20, max_size=60))
def test_guards_leave_matches_as_they_are(spark, texts):
    """Against the bare patterns."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for lang, kind in (("java", "method"), ("java", "class"), ("rust", "function"), ("swift", "function")):
        pattern = dict(patterns.BY_KIND[lang])[kind]
        bare = F.transform(F.regexp_extract_all("t", F.lit(patterns.java(pattern)), F.lit(0)), lambda m: trim_space(m))
        mine = F.transform(F.filter(outlining.chunks_of(F.col("t"), lang), _is(kind)), lambda c: c["content"])
        assert rows.where(~bare.eqNullSafe(mine)).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["<!--", "-->", "<script ", "</SCRIPT >", "<style>", "</style>", "a", "<a href=x>", "\ue000", "\n", "<title>", "</title>"]), max_size=12).map("".join), min_size=30, max_size=60))
def test_marks_leave_pages_as_they_are(spark, pages):
    rows = spark.createDataFrame([(t,) for t in pages], "t string")
    bare = F.regexp_replace("t", html._HIDDEN, "")
    titles = F.regexp_extract_all(bare, F.lit(html._TITLE), F.lit(1))
    assert rows.where((bare != html.visible(F.col("t"))) | (F.array_join(titles, "") != html.page_title(F.col("t")))).collect() == []


def test_hidden_openers_that_are_never_closed(spark):
    page = "<title>t</title><a href=x>" + "<!-- <script> <style> " * 20_000
    rows = spark.createDataFrame([(page,), (page + "</script>" + "<!--" * 20_000,)], "t string")
    assert [r.n for r in rows.select(F.size(html.hrefs(F.col("t"))).alias("n")).collect()] == [1, 1]


def test_passing_over_words_leaves_matches_as_they_are(spark):
    """Against the bare patterns; methods are looked for from word to word, comments and
    ends of texts without trying every character."""
    rng = random.Random(3)
    forms = [*_FORMS, "class ", "class", "xpublic ", "public", "interface ", "enum ", "pub ", "fn ", "struct ", "trait ", "func ", "protocol ", "a(b)", " {", "f(a) {",
             "<html>", "</html", "<head ", "<body>", "<!--", "-->", "-", "*", "/", ": T ", "static ", "foo[] bar (x)"]
    rows = spark.createDataFrame([("".join(rng.choice(forms) for _ in range(rng.randint(1, 25))),) for _ in range(4000)], "t string")
    for lang, kinds in patterns.BY_KIND.items():
        found = []
        for kind, pattern in kinds:
            body = pattern.replace(r"[\s\S]", "\0").replace(r"\s", patterns.W).replace("\0", r"[\s\S]")
            bare = F.regexp_extract_all("t", F.lit("(?d)" + body), F.lit(0))
            found += [F.transform(bare, lambda m: F.concat(F.lit(f"{kind} "), trim_space(m)))]  # noqa: B023
        mine = F.transform(outlining.chunks_of(F.col("t"), lang), lambda c: F.concat_ws(" ", c["kind"], c["content"]))
        assert rows.where(F.concat(*found) != mine).collect() == []
        assert rows.select(F.sum(F.size(mine))).first()[0] > 100
    assert outlining._whole_words("x").startswith(r"\G") and "++" in patterns.java(patterns.BLOCK_COMMENT)
