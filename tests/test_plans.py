import random

from pyspark.sql import functions as F

from sheaf.plans.ordered import running_totals, stitch
from sheaf.plans.skew import lookup_join
from sheaf.session import CHECKPOINT_CONF, shared_dir, shared_path


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.before for r in running_totals(df, ["g"], ["k"], {"v": "before"}).collect()}
    want, seen = {}, {}
    for g, k, v in sorted(rows):
        want[g, k] = seen.get(g, 0)
        seen[g] = want[g, k] + v
    assert got == want
    whole = {r.k: r.before for r in running_totals(df, [], ["k"], {"v": "before"}).collect()}
    assert whole[0] == 0 and max(whole.values()) <= sum(v for *_, v in rows)


def test_parts_make_up_the_whole(spark):
    rows = [(g, i, f"{g}{i}é;" * (i % 7)) for g in "ab" for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(4)
    whole = {g: "".join(t for h, _, t in rows if h == g) for g in "ab"}
    for limit in (1 << 30, 1000, 1):
        parts = stitch(df, ["g"], ["i"], "t", "text", limit).collect()
        for g in "ab":
            mine = sorted((r.part, r.text) for r in parts if r.g == g)
            assert "".join(t for _, t in mine) == whole[g]
            assert all(len(t.encode()) < limit + 60 for _, t in mine) or limit == 1 << 30
            assert (len(mine) > 1) == (limit < 1 << 30)


def test_lookup_join_with_hot_keys(spark):
    rows = [(1, i) for i in range(100)] + [(2, 200), (3, 300)]
    left = spark.createDataFrame(rows, "k int, i int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    for hot_rows in (1_000_000, 10):
        got = sorted((r.k, r.i, r.v) for r in lookup_join(left, right, ["k"], ["i"], hot_rows=hot_rows, salts=4).collect())
        assert got == sorted((k, i, {1: "a", 2: "b"}.get(k)) for k, i in rows)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get(CHECKPOINT_CONF)
    assert shared_dir(spark) == named
    assert shared_path(spark, "x").startswith(named)


def test_scans_read_only_what_they_need(spark):
    """Path work does not read texts."""
    from sheaf.checks import base, file_checks
    from sheaf.operators import stats

    df = stats.excluded_by_dir(file_checks.labelled(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert base.GLOBS


def test_rank_limit_is_applied_before_the_shuffle(spark):
    from sheaf.checks import file_checks
    from sheaf.operators import report, stats

    rows = file_checks.labelled(spark, "/root/testdata/sf0.001")
    for df in (stats.excluded_sample(rows), report.largest_files_per_root(rows, F.col("content"))):
        assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_parts_with_equal_keys(spark):
    rows = [("a", 1, "bbbb"), ("a", 1, "aaaa"), ("a", 1, "aaaa"), ("a", 2, "c"), ("b", 1, ""), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "g string, i int, t string")
    whole = set()
    for limit in (1 << 30, 5, 1):
        parts = sorted((r.g, r.part, r.text) for r in stitch(df, ["g"], ["i"], "t", "text", limit).collect())
        whole.add(tuple("".join(t for h, _, t in parts if h == g) for g in "ab"))
    assert len(whole) == 1 and sorted(whole.pop()[0]) == sorted("bbbbaaaaaaaac")
