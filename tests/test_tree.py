import pytest
from pyspark.sql import functions as F

from sheaf.operators import filters, snapshot, stats, tree
from sheaf.operators.assemble import assemble_prompt, pdf_assemble

PATHS = ["b.txt", "a/z.txt", "a/sub/x.py", "a/b.log", "a.b", "node/deep/q.js", "node/w", "z"]
DRAWN = """\
(Files/directories marked with ❌ are excluded or not included here)

proj/
├── a/
│   ├── sub/
│   │   └── x.py
│   ├── b.log ❌
│   └── z.txt
├── a.b
├── b.txt
├── node/ ❌
└── z"""


def manifest(spark, paths, root="/home/proj"):
    return spark.createDataFrame([(root, p, f"text of {p}") for p in paths], "root string, path string, content string")


@pytest.mark.parametrize("part_bytes", [1 << 20, 1])
def test_drawing(spark, part_bytes):
    parts = tree.tree_render(manifest(spark, PATHS), ["**/*.log", "node/**"], part_bytes=part_bytes).collect()
    assert "".join(t for _, t in sorted((r.part, r.tree) for r in parts)) == DRAWN
    assert (len(parts) == 1) == (part_bytes > 1)


def test_top_level_is_lexical_and_deeper_levels_are_not(spark):
    text = tree.tree_render(manifest(spark, ["a", "b/c", "d/a", "d/b/x"])).first().tree
    assert text == "proj/\n├── a\n├── b/\n│   └── c\n└── d/\n    ├── b/\n    │   └── x\n    └── a"


def test_excluded_can_be_hidden(spark):
    text = tree.tree_render(manifest(spark, ["a", "b.log"]), ["*.log"], show_excluded=False).first().tree
    assert text == "proj/\n└── a"


def test_hot_directories(spark, monkeypatch):
    from sheaf.plans import skew

    want = tree.tree_render(manifest(spark, PATHS), ["node/**"]).first().tree
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("left", 1, 4))
    assert tree.tree_render(manifest(spark, PATHS), ["node/**"]).first().tree == want


def test_source_trees(spark):
    rows = manifest(spark, ["x"], "b").unionByName(manifest(spark, ["y"], "a"))
    assert tree.source_trees(rows).first().source_trees == "a:\na/\n└── y\n\nb:\nb/\n└── x"


GLOBS = ["**/*.log", "node/**"]


def test_labels(spark):
    rows = filters.label_files(manifest(spark, PATHS), GLOBS, include=["**/*.{py,txt,js}"])
    assert {r.path: r.state for r in rows.collect()} == {
        "b.txt": "kept", "a/z.txt": "kept", "a/sub/x.py": "kept", "a/b.log": "excluded", "a.b": "excluded",
        "node/deep/q.js": "pruned", "node/w": "pruned", "z": "excluded",
    }
    assert [r.dir for r in stats.pruned_dirs(rows).collect()] == ["node"]
    assert {r.state for r in filters.label_files(manifest(spark, PATHS), ["*"]).collect()} == {"pruned"}
    assert filters.prune_excluded(manifest(spark, PATHS), ["**"]).count() == 0
    ruled = filters.label_files(manifest(spark, PATHS), ["**/*.log"], rules=["a/sub", "node"])
    assert {r.dir for r in stats.pruned_dirs(ruled).collect()} == {"a/sub", "node"}


def test_priority(spark):
    rows = manifest(spark, ["a.py", "b.py"])
    kept = lambda **o: sorted(r.path for r in filters.include_filter(rows, ["*.py"], ["b*"], **o).collect())
    assert kept() == ["a.py"]
    assert kept(include_priority=True) == ["a.py", "b.py"]


def test_prompt_layout(spark):
    rows = spark.createDataFrame(
        [("r", "a.py", "x = 1"), ("r", "d/b.py", ""), ("r", "c.log", "no")], "root string, path string, content string"
    )
    labelled = filters.label_files(rows, ["*.log"])
    changes = spark.createDataFrame(
        [("r", "a.py", "modified", 2, 1)], "root string, path string, status string, lines_added bigint, lines_removed bigint"
    )
    drawn = "(Files/directories marked with ❌ are excluded or not included here)\n\nr/\n├── a.py\n├── c.log ❌\n└── d/\n    └── b.py"
    want = (
        f"\nSource Trees:\n\nr:\n{drawn}\n\n"
        "\nExcluded Content:\n\nFiles:\n\n- r/c.log\n\n\n\n\n\n"
        "\n\n`r/a.py`:\n\nx = 1\n\n\n\n\n\n\n{changes}\n"
    )
    assert assemble_prompt(labelled, ["*.log"]).first().prompt == want.replace("{changes}", "\n\n")
    noted = "\n\nGit Information for r:\n\nGit Diff:\nmodified a.py +2 -1\n\n\n\n\n\n"
    assert assemble_prompt(labelled, ["*.log"], changes=changes).first().prompt == want.replace("{changes}", noted)


def test_excluded_section_by_counts(spark):
    paths = [f"d/f{i}.log" for i in range(21)] + ["x.log", "node/a", "k.py", "Makelog"]
    rows = filters.label_files(manifest(spark, paths, "r"), ["**/*.log", "node/**", "Makelog"])
    section = stats.excluded_section(rows).first().section
    assert section == (
        "\nExcluded Content:\n\nDirectories with excluded files:\n\n- r: 2 files\n\n- r/d: 21 files\n\n\n"
        "\n\nFile extensions excluded:\n\n- .log: 22 files\n\n\n\n"
    )


def test_snapshots(spark):
    schema = "root string, path string, content string"
    left = spark.createDataFrame([("r", "same", "a\n"), ("r", "gone", "a\nb"), ("r", "mod", "a\nb\nb\nc"), ("r", "swap", "a\nb"), ("r", "nl", "a\n")], schema)
    right = spark.createDataFrame([("r", "same", "a\n"), ("r", "new", ""), ("r", "mod", "a\nb\nd\nd"), ("r", "swap", "b\na"), ("r", "nl", "a")], schema)
    got = {r.path: (r.status, r.lines_added, r.lines_removed) for r in snapshot.snapshot_diff(left, right).collect()}
    assert got == {
        "gone": ("removed", 0, 2), "new": ("added", 0, 0), "mod": ("modified", 2, 2), "swap": ("modified", 0, 0), "nl": ("modified", 0, 0),
    }


def test_pdf_documents(spark):
    rows = spark.createDataFrame(
        [("d/a.pdf", 2, "two"), ("d/a.pdf", 1, "one\n/x"), ("d/a.pdf", 3, ""), ("b.pdf", 1, "endobj")], "path string, page_no int, text string"
    )
    got = pdf_assemble(rows).collect()
    assert [(r.path, r.content) for r in got] == [("d/a.pdf", "# PDF Content: a.pdf\n\n## Page 1\n\none\n\n## Page 2\n\ntwo\n\n")]


def test_symlinks_and_pdfs(spark):
    rows = spark.createDataFrame(
        [("a", True, False, bytearray(b"x")), ("b.pdf", False, False, bytearray(b"x")), ("c.pdf", False, True, bytearray(b"x")), ("d", False, False, bytearray(b"\x00"))],
        "path string, is_symlink boolean, explicit boolean, bytes binary",
    )
    assert [r.path for r in filters.symlink_filter(rows).collect()] == ["b.pdf", "c.pdf", "d"]
    assert filters.symlink_filter(rows, follow=True).count() == 4
    assert [r.path for r in filters.pdf_skip(rows).collect()] == ["a", "c.pdf", "d"]
    assert "d" not in [r.path for r in filters.text_files(rows).collect()]
    assert rows.select(F.lit(1)).count() == 4


@pytest.mark.parametrize("most", [1000, 1])
def test_largest_files_with_their_text(spark, monkeypatch, most):
    from sheaf.operators import report

    monkeypatch.setattr(report, "MAX_LITERALS", most)
    rows = manifest(spark, ["a", "bb", "ccc", "dddd"])
    top = report.largest_files(rows, F.col("content"), 2)
    assert [(r.path, r.rank) for r in top.orderBy("rank").collect()] == [("dddd", 1), ("ccc", 2)]
    texts = report.with_text(rows, F.col("content"), top).collect()
    assert sorted(r.text for r in texts) == ["text of ccc", "text of dddd"]


def test_pages_as_files(spark):
    from sheaf.operators.pages import page_files

    rows = spark.createDataFrame([("u", "t", "# m", 200), ("v", "t", "x", 404), ("w", "t", "", 200)], "url string, title string, markdown string, status int")
    assert [tuple(r) for r in page_files(rows).collect()] == [("web", "u", ".md", "# m")]
