"""Files of directory trees, hidden ones included, listed and read by executors.

Spark's own file sources skip every name that starts with a dot or an underscore, so
the listing is a loop of its own: each round lists the directories that the round
before found. The driver only ever sees the roots.

Reading looks at the beginning of a file first, and at the rest only of those that are
wanted by it. A link to a directory is followed unless it leads back to a directory on
its own path; a root that is a link to a file is an error unless links are followed.
"""

from __future__ import annotations

import errno
import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.globs import glob_match
from sheaf.functions.paths import file_ext
from sheaf.session import cut

_ENTRY = "root string, path string, is_dir boolean, is_symlink boolean, size bigint, explicit boolean, loop boolean, via string"
_ENTRY_ARROW = pa.schema(
    [
        ("root", pa.string()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("is_symlink", pa.bool_()),
        ("size", pa.int64()),
        ("explicit", pa.bool_()),
        ("loop", pa.bool_()),
        ("via", pa.string()),
    ]
)
# What tells text from binary.
HEAD_BYTES = 512
_ROWS_PER_BATCH = 4096
_BYTES_PER_BATCH = 64 << 20
_BYTES_PER_TASK = 256 << 20


def _single(root: str) -> tuple[str, bool, int] | None:
    """Name, whether a link, and size of a root that is a file."""
    if "://" not in root:
        return (os.path.basename(root), os.path.islink(root), os.stat(root).st_size) if os.path.isfile(root) else None
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    info = store.get_file_info(path)
    return (info.base_name, False, info.size) if info.type == fs.FileType.File else None


def _back(root: str, path: str) -> bool:
    """Whether a linked directory is one of those that its own path has come through."""
    parts = path.split("/")
    through = [os.path.join(root, *parts[:k]) for k in range(len(parts))]
    return os.path.realpath(os.path.join(root, path)) in map(os.path.realpath, through)


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, bool, int, bool]]:
    """Name, whether a directory, a link, the size, and whether it leads back."""
    where = f"{root}/{folder}" if folder else root
    if "://" not in where:
        with os.scandir(where) as found:
            for e in found:
                try:
                    is_dir, is_link, size = e.is_dir(), e.is_symlink(), e.stat().st_size
                except OSError as failed:
                    # A dangling link, one that leads to itself, or gone since.
                    if failed.errno in (errno.ENOENT, errno.ELOOP):
                        continue
                    raise
                yield e.name, is_dir, is_link, size, is_dir and is_link and _back(root, f"{folder}/{e.name}" if folder else e.name)
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(where)
    for info in store.get_file_info(fs.FileSelector(base)):
        yield info.base_name, info.type == fs.FileType.Directory, False, info.size or 0, False


def _list_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for root, folder, via in zip(batch["root"].to_pylist(), batch["path"].to_pylist(), batch["via"].to_pylist()):
            single = _single(root) if not folder else None
            if single:
                rows.append((root, single[0], False, single[1], single[2], True, False, None))
                continue
            for name, is_dir, is_link, size, loop in _entries(root, folder):
                rows.append((root, f"{folder}/{name}" if folder else name, is_dir, is_link, size, False, loop, via))
                if len(rows) == _ROWS_PER_BATCH:
                    yield _batch(rows, _ENTRY_ARROW)
                    rows = []
    if rows:
        yield _batch(rows, _ENTRY_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def list_tree(
    spark: SparkSession, roots: Iterable[str], prune: Iterable[str] = (), follow_symlinks: bool = False
) -> DataFrame:
    """Entries ``(root, path, is_dir, is_symlink, size, explicit, via)`` below the roots.

    ``via`` is the first link that a path leads through, null for most. Directories that
    match ``prune`` are listed but not entered. A root that is a file
    is listed by its name and marked ``explicit``; a link among these is an error unless
    links are followed.
    """
    prune = list(prune)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = [(r.rstrip("/") or "/", "", None) for r in roots]
    frontier = spark.createDataFrame(start, "root string, path string, via string")
    levels, n = [], len(start)
    while True:
        level = cut(frontier.repartition(max(1, min(n, most)), "root", "path").mapInArrow(_list_batches, _ENTRY))
        if not levels and not follow_symlinks:
            links = [r.root for r in level.where("explicit AND is_symlink").select("root").collect()]  # among the roots
            if links:
                raise ValueError(f"links, which are not followed: {sorted(links)}")
        levels.append(level)
        enter = F.col("is_dir") & ~F.col("loop") & ~glob_match("path", prune)
        if not follow_symlinks:
            enter = enter & ~F.col("is_symlink")
        through = F.coalesce("via", F.when(F.col("is_symlink"), F.col("path")))
        frontier = level.where(enter).select("root", "path", through.alias("via"))
        n = frontier.count()
        if n == 0:
            return reduce(DataFrame.unionByName, levels).drop("loop")


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of their files, of those that are not ``wanted`` none."""
    for batch in batches:
        pending, held = [], 0
        wanted = batch["wanted"].to_pylist() if "wanted" in batch.schema.names else [True] * batch.num_rows
        rows = zip(batch["root"].to_pylist(), batch["path"].to_pylist(), batch["explicit"].to_pylist(), wanted)
        for at, (root, path, explicit, want) in enumerate(rows):
            data = _read(root if explicit else f"{root}/{path}") if want else None
            pending.append((at, data))
            held += len(data or b"")
            if held >= _BYTES_PER_BATCH:
                yield _with_bytes(batch, pending)
                pending, held = [], 0
        if pending:
            yield _with_bytes(batch, pending)


def _head_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch["root"].to_pylist(), batch["path"].to_pylist(), batch["explicit"].to_pylist())
        heads = [_read(root if explicit else f"{root}/{path}", HEAD_BYTES) for root, path, explicit in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])


def _read(where: str, most: int | None = None) -> bytes:
    if "://" not in where:
        with open(where, "rb", buffering=0 if most else -1) as file:
            return file.read(-1 if most is None else most)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(where)
    with store.open_input_stream(path) as file:
        return file.read(most)


def _with_bytes(batch: pa.RecordBatch, read: list[tuple[int, bytes]]) -> pa.RecordBatch:
    kept = batch.take(pa.array([at for at, _ in read]))
    data = pa.array([data for _, data in read], pa.binary())
    return pa.RecordBatch.from_arrays([*kept.columns, data], names=[*batch.schema.names, "bytes"])


def read_tree(
    spark: SparkSession,
    roots: Iterable[str],
    prune: Iterable[str] = (),
    follow_symlinks: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Files below the roots: ``(root, path, ext, is_symlink, size, explicit, bytes)``.

    ``keep`` filters the listing, so that only what it lets through is read.
    """
    listed = list_tree(spark, roots, prune, follow_symlinks).where(~F.col("is_dir"))
    if not follow_symlinks:
        listed = listed.where(~F.col("is_symlink"))
    return read_files(keep(listed) if keep else listed)


def read_files(
    listed: DataFrame, wanted: Callable[[Column, Column], Column] | None = None, also: Iterable[str] = ()
) -> DataFrame:
    """Add ``bytes`` to a table ``(root, path, is_symlink, size, explicit)``, of which the
    text columns ``also`` stay too.

    A folder's files are listed by one task; the repartitioning spreads their reading,
    over as many tasks as the files' total size asks for. ``wanted`` tells by the first
    bytes of a file and its path whether it is read further; the others get null bytes.
    """
    total, n = listed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n, max(tasks, -(-total // _BYTES_PER_TASK))))
    also = list(also)
    columns = ["root", "path", "is_symlink", "size", "explicit", *also]
    schema = ", ".join(["root string, path string, is_symlink boolean, size bigint, explicit boolean", *(f"{c} string" for c in also)])
    spread = listed.select(*columns).repartition(tasks, "root", "path")
    if wanted is not None:
        headed = spread.mapInArrow(_head_batches, schema + ", head binary")
        spread = headed.select(*columns, (F.col("explicit") | wanted(F.col("head"), F.col("path"))).alias("wanted"))
        schema += ", wanted boolean"
    return spread.mapInArrow(_read_batches, schema + ", bytes binary").drop("wanted").withColumn("ext", file_ext(F.col("path")))


def text_of(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(data.cast("string"))


def decode_text(files: DataFrame) -> DataFrame:
    """``bytes`` as the text column ``content``."""
    return files.withColumn("content", text_of(F.col("bytes"))).drop("bytes")
