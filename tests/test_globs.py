import random
import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions.globs import any_glob_regex, glob_match, glob_match_above, glob_regex, matches_dot
from sheaf.functions.ignore import ignore_rules, ignored_by, rule_regex
from sheaf.operators.filters import gitignore_filter, label_files

CASES = [
    ("**/a.py", "a.py", True),
    ("**/a.py", "x/y/a.py", True),
    ("**/a.py", "x/ba.py", False),
    ("a/**/b", "a/b", True),
    ("a/**/b", "a/x/y/b", True),
    ("a/**/b", "ab", False),
    ("a/**", "a", True),
    ("a/**", "a/b/c", True),
    ("a/**", "ab", False),
    ("**", "x/y", True),
    ("*", "x", True),
    ("*", ".", True),
    ("*", "x/y", False),
    ("*.log*", "a.log.1", True),
    ("a**b", "axxb", True),
    ("a**b", "ax/xb", False),
    ("?.c", "a.c", True),
    ("?.c", "/.c", False),
    ("[a-c].c", "b.c", True),
    ("[!a-c].c", "b.c", False),
    ("[^a-c].c", "d.c", True),
    ("[!a].c", "/.c", False),
    ("*.{py,go}", "x.go", True),
    ("{a/b,c}/*.py", "a/b/x.py", True),
    ("{a,b{c,d}}", "bd", True),
    (r"\*.c", "*.c", True),
    (r"\*.c", "a.c", False),
    ("a.b", "axb", False),
    ("a\nb/*", "a\nb/c", True),
    ("[a", "a", False),
    ("{a", "a", False),
    ("a\\", "a", False),
]


@pytest.mark.parametrize("glob,path,hit", CASES)
def test_cases_in_python(glob, path, hit):
    body = glob_regex(glob)
    assert (body is not None and re.fullmatch(body, path, re.S) is not None) is hit


def test_cases_in_spark(spark):
    rows = spark.createDataFrame([(i, path) for i, (_, path, _) in enumerate(CASES)], "i int, path string")
    columns = [glob_match("path", [glob]).alias(f"c{i}") for i, (glob, _, _) in enumerate(CASES)]
    for row in rows.select("i", *columns).collect():
        assert row[f"c{row.i}"] is CASES[row.i][2], CASES[row.i]


def test_above_and_dot(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a/x",), ("b",)], "path string")
    assert [r[0] for r in rows.select(glob_match_above("path", ["a/b"])).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(glob_match_above("path", ["**"])).collect()] == [True, True, True]
    assert matches_dot(["*"]) and matches_dot(["**"]) and not matches_dot(["**/a"])
    assert any_glob_regex(["[x"]) is None
    assert [r[0] for r in rows.select(glob_match("path", [])).collect()] == [False] * 3


def naive(glob, path):
    """Match by trying everything, segment by segment."""

    def one(pattern, text):
        if not pattern:
            return not text
        if pattern[0] == "*":
            return any(one(pattern[1:], text[i:]) for i in range(len(text) + 1))
        return bool(text) and pattern[0] in ("?", text[0]) and one(pattern[1:], text[1:])

    def many(globs, parts):
        if not globs:
            return not parts
        if globs[0] == "**":
            if len(globs) == 1:
                return True
            return any(many(globs[1:], parts[i:]) for i in range(len(parts) + 1))
        return bool(parts) and one(globs[0], parts[0]) and many(globs[1:], parts[1:])

    return many(glob.split("/"), path.split("/"))


SEGMENT = st.one_of(st.just("**"), st.text("ab*?.", min_size=1, max_size=4).filter(lambda s: "**" not in s))
PATHS = st.lists(st.text("ab.", min_size=1, max_size=3), min_size=1, max_size=4).map("/".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(SEGMENT, min_size=1, max_size=4).map("/".join), PATHS)
def test_against_naive(glob, path):
    assert (re.fullmatch(glob_regex(glob), path, re.S) is not None) == naive(glob, path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(SEGMENT, min_size=1, max_size=3).map("/".join), min_size=1, max_size=6), PATHS)
def test_list_is_any_of_its_globs(globs, path):
    assert (re.fullmatch(any_glob_regex(globs), path, re.S) is not None) == any(naive(g, path) for g in globs)


def test_no_pattern_crashes(spark):
    rng = random.Random(3)
    globs = ["".join(rng.choice("[[]]!^-&\\{},*?az/") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    for glob in globs:
        alone = glob_regex(glob)
        assert alone is None or re.compile(alone)
    paths = spark.createDataFrame([("a",), ("az/z",), ("[-]",), ("&&",), ("^",)], "path string")
    some = globs[:40]
    rows = paths.select(glob_match("path", globs).alias("g"), ignored_by(F.col("path"), some).alias("i")).collect()
    assert len(rows) == 5
    assert all(rule_regex(g) is None or re.compile(rule_regex(g)[0].replace(r"\z", r"\Z")) for g in globs)


def test_malformed_ranges(spark):
    assert glob_regex("[z-a]") is None and rule_regex("[z-a]") is None
    one = spark.createDataFrame([("b",), ("&",), ("-",), ("[",)], "path string")
    hit = lambda g: [r[0] for r in one.select(glob_match("path", [g])).collect()]
    assert hit("[a-c&&]") == [True, True, False, False]
    assert hit("[[-]") == [False] * 4 and hit("[!b]") == [False, True, True, True]
    assert hit("[z-a]") == [False] * 4


RULE_LINES = st.lists(
    st.sampled_from(
        ["a", "!a", "/a", "!/a", "b/", "!b/", "a/b", "!a/b", "*.c", "!*.c", "a/**/c", "!a/**/c", "**/b", "!**/b", "*", "!*", "[ab]c", "!b/*"]
    ),
    max_size=8,
)
TREE = sorted({"/".join(p) for n in (1, 2, 3, 4) for p in product(["a", "b", "x.c"], repeat=n)})


def first_ignored(path, lines):
    """The topmost of a path's directories and itself that the rules ignore."""
    rules = [r for r in map(rule_regex, lines) if r]
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        some = "/".join(parts[:n])
        verdict = False
        for regex, negated in rules:
            if re.search(regex.replace(r"\z", r"\Z"), some):
                verdict = not negated
        if verdict:
            return some
    return None


@settings(max_examples=15, deadline=None)
@given(lines=RULE_LINES)
def test_rules_of_files_and_directories(spark, lines):
    """Ignored by themselves or by a directory above, whatever is negated below it."""
    files = spark.createDataFrame([("r", p) for p in TREE] + [("other", "a/b")], "root string, path string")
    made = spark.createDataFrame([("r", ".gitignore", "\n".join(lines))], "root string, path string, content string")
    want = {p: first_ignored(p, lines) for p in TREE}
    for rules, extra in ((ignore_rules(made), [("other", "a/b")]), (lines, [])):
        rows = files if extra else files.where("root = 'r'")
        left = sorted((r.root, r.path) for r in gitignore_filter(rows, rules).collect())
        assert left == sorted([("r", p) for p in TREE if want[p] is None] + extra)
        labelled = label_files(rows, ["nothing"], rules=rules).where("root = 'r'").collect()
        assert {r.path: r.pruned_at for r in labelled} == {p: top if top != p else None for p, top in want.items()}
        assert {r.path: r.state for r in labelled} == {
            p: "kept" if top is None else "excluded" if top == p else "pruned" for p, top in want.items()
        }


def test_glob_or_rule_on_top(spark):
    files = spark.createDataFrame([("r", "a/b/c/d")], "root string, path string")
    for globs, lines, top in ([["a"], ["b"], "a"], [["a/b"], ["/a"], "a"], [["q"], ["c"], "a/b/c"], [["a/b"], ["q"], "a/b"]):
        assert label_files(files, globs, rules=lines).first().pruned_at == top


def test_many_turns_of_rules(spark):
    """As many runs as lines: each negated one takes back what the ones before ignore."""
    lines = [line for i in range(150) for line in (f"f{i}*", f"!f{i}")]
    files = spark.createDataFrame([("r", f"f{i}{end}") for i in range(0, 150, 7) for end in ("", "x")], "root string, path string")
    made = spark.createDataFrame([("r", ".gitignore", "\n".join(lines))], "root string, path string, content string")
    left = sorted(r.path for r in gitignore_filter(files, ignore_rules(made)).collect())
    kept = [f.path for f in files.collect() if first_ignored(f.path, lines) is None]
    assert left == sorted(kept)
