import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators.crawl import crawl, visited_dedupe
from sheaf.operators.pages import crawl_select, page_links, web_tree
from sheaf.operators.tree import tree_render
from sheaf.plans.prompts import directory_files, directory_prompt, web_prompt
from sheaf.sources import patterns, sinks, tree
from sheaf.sources.default_globs import default_globs
from sheaf.sources.pages import read_pages
from sheaf.streaming.rows import prepare, run_available


@pytest.fixture
def folder(tmp_path):
    made = {
        ".env": "secret", ".hid/x.py": "hidden", "_priv/y.py": "private", "pkg/__init__.py": "", "pkg/a b.py": "blank in name",
        "pkg/m.py": "import os\n", "node_modules/big/z.js": "z", "data.bin": "\x00\x01", "doc.pdf": "%PDF-1.4",
        ".gitignore": "*.tmpl\npkg/gen/\n", "x.tmpl": "t", "pkg/gen/g.py": "g", "notes.md": "# é\n",
    }
    for name, text in made.items():
        path = tmp_path / "proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    os.symlink(tmp_path / "proj" / "notes.md", tmp_path / "proj" / "link.md")
    os.symlink(tmp_path / "proj" / "pkg", tmp_path / "proj" / "linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "proj" / "dangling")
    return str(tmp_path / "proj"), made


def test_tree_sees_hidden_files(spark, folder):
    root, made = folder
    got = {r.path: bytes(r.bytes).decode() for r in tree.read_tree(spark, [root]).collect()}
    assert got == made
    followed = {r.path for r in tree.read_tree(spark, [root], follow_symlinks=True).collect()}
    assert {"link.md", "linked/m.py"} <= followed


def test_pruned_directories_are_not_entered(spark, folder):
    root, _ = folder
    listed = {r.path for r in tree.list_tree(spark, [root], ["**/node_modules/**"]).collect()}
    assert "node_modules" in listed and "node_modules/big" not in listed


def test_only_what_is_kept_is_read(spark, folder):
    root, _ = folder
    rows = tree.read_tree(spark, [root], keep=lambda df: df.where(F.col("path").endswith(".md")))
    assert [r.path for r in tree.decode_text(rows).collect()] == ["notes.md"]


def test_trees_as_they_are_found(spark, tmp_path):
    """Text of other encodings, links back, and files that are no text."""
    root = tmp_path / "wild"
    (root / "a" / "b").mkdir(parents=True)
    (root / "latin.txt").write_bytes("caf\u00e9 noir\n".encode("latin-1"))
    (root / "a" / "x.txt").write_text("x")
    (root / "a" / "b" / "big.dat").write_bytes(b"\x00" * 600)
    os.symlink(root, root / "a" / "b" / "up")
    os.symlink(root / "a", root / "a" / "b" / "here")
    os.symlink(root / "self", root / "self")
    (root / "c").mkdir()
    os.symlink(root / "a", root / "c" / "over")
    os.symlink(root / "c", root / "a" / "across")
    os.symlink(root / "latin.txt", tmp_path / "link.txt")
    files = {r.path: r for r in directory_files(spark, [str(root)], []).where("state <> 'listed'").collect()}
    assert set(files) == {"latin.txt", "a/x.txt", "a/b/big.dat"}
    assert files["latin.txt"].content == "caf\ufffd noir\n" and files["latin.txt"].state == "kept"
    assert files["a/b/big.dat"].state == "skipped" and files["a/b/big.dat"].content is None
    listed = {r.path for r in tree.list_tree(spark, [str(root)], follow_symlinks=True).collect()}
    assert {"a/b/up", "a/b/here", "c/over/x.txt", "a/across/over"} <= listed
    assert not {"a/b/up/a", "a/b/here/x.txt", "a/across/over/x.txt"} & listed and len(listed) < 25
    with pytest.raises(ValueError, match="link.txt"):
        tree.list_tree(spark, [str(tmp_path / "link.txt")])
    assert [r.content for r in tree.decode_text(tree.read_tree(spark, [str(tmp_path / "link.txt")], follow_symlinks=True)).collect()] == ["caf\ufffd noir\n"]


DRAWN = """\
(Files/directories marked with ❌ are excluded or not included here)

r/
├── a/
│   ├── bare/
│   │   └── inner/
│   ├── gone/ ❌
│   └── x.txt
├── empty/
├── over
├── self
└── to.txt"""


@pytest.mark.parametrize("follow", [False, True])
def test_trees_show_empty_directories_and_links(spark, tmp_path, follow):
    root = tmp_path / "r"
    for name in ("a/bare/inner", "a/gone/below", "empty"):
        (root / name).mkdir(parents=True)
    (root / "a" / "x.txt").write_text("text of x")
    os.symlink(root / "a", root / "over")
    os.symlink(root / "a" / "x.txt", root / "to.txt")
    os.symlink(root, root / "self")
    files = directory_files(spark, [str(root)], ["a/gone"], follow_symlinks=follow)
    shown = tree_render(files, ["a/gone"]).first().tree
    assert shown == DRAWN
    kept = {r.path for r in files.where("state = 'kept'").collect()}
    assert kept == ({"a/x.txt", "to.txt", "over/x.txt"} if follow else {"a/x.txt"})
    prompt = directory_prompt(files, ["a/gone"]).first().prompt
    assert DRAWN in prompt and prompt.count("text of x") == len(kept)


def test_binary_files_are_not_read_to_the_end(monkeypatch):
    import pyarrow as pa

    asked = []
    monkeypatch.setattr(tree, "_read", lambda where, most=None: asked.append((where, most)) or b"\0")
    rows = pa.RecordBatch.from_pydict({"root": ["r", "r"], "path": ["a", "b"], "explicit": [False, False], "wanted": [True, False]})
    heads = next(tree._head_batches([rows]))
    read = next(tree._read_batches([rows]))
    assert heads["head"].to_pylist() == [b"\0"] * 2 and read["bytes"].to_pylist() == [b"\0", None]
    assert asked == [("r/a", tree.HEAD_BYTES), ("r/b", tree.HEAD_BYTES), ("r/a", None)]


def test_tasks_write_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", b"1"), ("a/x", b"2"), ("a/y", b""), ("b/c/z", None)], "path string, data binary").coalesce(1)
    for at in (str(tmp_path / "local"), f"file://{tmp_path}/uri"):
        assert sinks.write_files(rows, at) == 3
        assert sinks.write_files(rows, at) == 3  # as a task that runs again
        got = {r.path: bytes(r.bytes) for r in tree.read_tree(spark, [at]).collect()}
        assert got == {"a/x": b"12", "a/y": b"", "b/c/z": b""}
    assert sinks.write_files(rows.limit(0), str(tmp_path / "none")) == 0


def test_directory_to_prompt(spark, folder):
    root, _ = folder
    globs = [*default_globs(), "**/.git/**"]
    files = directory_files(spark, [root], globs)
    states = {r.path: r.state for r in files.collect()}
    assert states["pkg/m.py"] == "kept" and states["x.tmpl"] == "excluded" and states["data.bin"] == "excluded"
    assert states["pkg/gen/g.py"] == "excluded" and states["node_modules/*"] == "pruned" and "node_modules/big/z.js" not in states
    prompt = directory_prompt(files, globs, number=True).first().prompt
    assert "├── node_modules/ ❌\n" in prompt and "`proj/pkg/m.py`:\n\n```py\n   1 | import os\n   2 | \n```" in prompt
    assert "- .tmpl" not in prompt and "x.tmpl\n" in prompt and "secret" not in prompt
    single = f"{root}/pkg/gen/g.py"
    alone = directory_prompt(directory_files(spark, [single], ["**/*.py"]), ["**/*.py"]).first().prompt
    assert alone == f"\nSource Trees:\n\nFile: {single}\n\n\n\n\n\n`g.py`:\n\n```py\ng\n```\n\n\n\n\n\n\n\n"
    outlined = directory_prompt(files, globs, outline=True).first().prompt
    assert "`proj/pkg/m.py`:\n\nimport os\n// -----\n" in outlined


def test_globs_by_precedence(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    one, two = write("one.glob", "# c\n\n  *.a  \n"), write("two.glob", "*.b\n")
    active = lambda **o: patterns.active_globs(spark, **o)
    assert active(pattern_file=one, user_default=two, user=["u"]) == ["u", "*.a", "**/.git/**"]
    assert active(user_default=two, user_files=[one], defaults=False) == ["*.b", "**/.git/**"]
    assert active(user_files=[one], defaults=False) == ["*.a", "**/.git/**"]
    assert len(active()) == 220 and len(set(default_globs())) == 218
    assert len(active(user_files=[one])) == 221
    table = patterns.exclude_patterns(spark, user=["[x"], defaults=False).orderBy("ord").collect()
    assert [(r.ord, r.glob, r.regex is None) for r in table] == [(0, "[x", True), (1, "**/.git/**", False)]


def test_written_prompts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "x\ny"), ("a", 1, "z"), ("b", 0, "w")], "root string, part bigint, prompt string")
    sinks.write_prompts(rows, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("root", "part", "prompt").collect())) == [
        ("a", 0, "x\ny"), ("a", 1, "z"), ("b", 0, "w")
    ]
    sinks.write_prompts(rows, str(tmp_path / "t"), "text")
    texts = spark.read.text(str(tmp_path / "t"), wholetext=True)
    assert sorted(r.value for r in texts.collect()) == ["w\n", "x\ny\n", "z\n"]


def test_record_keys_are_in_order(spark):
    row = spark.range(1).select(sinks.prompt_json(F.lit('a"b'), F.lit(3), F.lit("p50k"))).first()[0]
    assert row == '{"model_info":"OpenAI code models, text-davinci-002, text-davinci-003 etc...","prompt":"a\\"b","token_count":3}'


PAGES = [
    ("http://s/", "<title>T</title><h1>Home</h1><a href='/a'>a</a><a href='b?x#y'>b</a><a href='http://o/'>o</a>", 200),
    ("http://s/a", "<p>A</p><a href='/c'>c</a><a href='/'>home</a>", 200),
    ("http://s/b?x#y", "<p>B</p><a href='/d'>d</a>", 500),
    ("http://s/c", "<p>C</p>", 200),
    ("http://s/d", "<p>D</p>", 200),
    ("http://o/", "<p>other</p>", 200),
]


def test_crawl(spark):
    pages = read_pages(spark.createDataFrame(PAGES, "url string, html string, status int"), status="status")
    links = page_links(pages)
    seeds = spark.createDataFrame([("http://s/",)], "url string")
    reach = lambda depth, **o: {r.url: r.depth for r in crawl(pages, links, seeds, depth, **o).collect()}
    assert reach(0) == {"http://s/": 0}
    assert reach(1) == {"http://s/": 0, "http://s/a": 1, "http://s/b?x#y": 1, "http://o/": 1}
    assert reach(9, domains=["s"]) == {"http://s/": 0, "http://s/a": 1, "http://s/b?x#y": 1, "http://s/c": 2, "http://s/d": 2}
    assert reach(9, domains=["s"], exclude=["a"]) == {"http://s/": 0, "http://s/b?x#y": 1, "http://s/d": 2}
    assert reach(9, page="http://s/") == reach(9)
    both = reach(1).items()
    found = spark.createDataFrame([*both, ("http://o/", 0)], "url string, depth int")
    assert {r.url: r.depth for r in visited_dedupe(found).collect()}["http://o/"] == 0


def test_web_prompt(spark):
    pages = read_pages(spark.createDataFrame(PAGES, "url string, html string, status int"), status="status")
    whole = web_prompt(pages, "http://s/", 1, ["s"]).first().prompt
    assert whole == (
        "\nSource Trees:\n\nWeb Crawl Structure:\n├── s\n  ├── s/a\n\n\n\n\n"
        "\n\n`http://s/`:\n\n# Home\n\n[a](/a)[b](b?x#y)[o](http://o/)\n\n\n"
        "\n\n`http://s/a`:\n\nA\n\n[c](/c)[home](/)\n\n\n\n\n\n"
    )
    one = web_prompt(pages, "http://s/a", 3).first().prompt
    assert one.startswith("\nSource Trees:\n\nWeb Page: http://s/a\n\n\n\n\n\n`http://s/a`:")


def test_selection_and_listing(spark):
    rows = spark.createDataFrame([("http://s/a/", 0), ("http://s/b", 1)], "url string, depth int")
    assert [r.url for r in crawl_select(rows, "http://x/a").collect()] == ["http://s/a/"]
    assert crawl_select(rows, "http://x/").count() == 2 and crawl_select(rows, "http://x/none").count() == 2
    assert web_tree(rows).first().tree == "Web Crawl Structure:\n├── s/a\n  ├── s/b\n"
    assert "".join(r.tree for r in web_tree(rows, part_bytes=1).orderBy("part").collect()) == web_tree(rows).first().tree
    assert web_tree(rows.limit(0)).first().tree == ""


def test_stream_equals_table(spark, tmp_path):
    from sheaf.checks import base

    rows = base.files(spark, "/root/testdata/sf0.001").select("root", "path", "content")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    step = lambda df: prepare(df, base.GLOBS, number=True, outline=True)
    run_available(stream, step, str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert streamed == sorted(map(tuple, step(rows).collect())) and streamed


def test_crawl_works_links_out_once(spark):
    """However many rounds there are, the links' source is read once."""
    n = 40
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([(f"p{i}",) for i in range(n)], "url string")
    raw = [(f"p{i}", f"p{j}") for i in range(n) for j in (i + 1, 0)]
    links = spark.createDataFrame(raw, "src string, dst string").mapInArrow(counted, "src string, dst string")
    seeds = spark.createDataFrame([("p0",)], "url string")
    got = {r.url: r.depth for r in crawl(pages, links, seeds, 5).collect()}
    assert got == {f"p{i}": i for i in range(6)}
    assert seen.value == len(raw)
