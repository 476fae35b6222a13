"""File trees as a DataFrame ``path, ext, size, content``: batch, stream and writer.

Spark's own file index hides names that begin with ``_`` or ``.`` and cannot prune folders, so a
Python data source lists the tree.  The driver only opens folders until it has ``FOLDERS`` of them;
tasks walk what lies below and read the contents as Arrow batches.  Folders that are skipped are
never entered; files are chosen by name and size before they are opened.  The options ``below``,
``extensions``, ``minsize`` and ``maxsize`` reach the walk.  (They are options because Spark 4.1
keeps the filters that it pushed into a Python reader for all scans of the same DataFrame: with
``pushFilters`` a union of a tree and its filtered self lost rows.)  The tree must be on a path
that the executors see too; urls of other stores are refused.

A stream reads the files whose last change (of content, name or attributes) falls between two
times, so an offset is one number however large the tree is.  A file that changes again comes again.

The writer's tasks write whole files aside and move them to a staged tree when they end; the
driver renames that tree into place.  A task that dies leaves nothing in it, and a job that fails
leaves no tree.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections import deque
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

#: Extensions of source files (fixed values).
SOURCE_EXTENSIONS = (
    "rs", "py", "ts", "js", "go", "java", "rb", "c", "cpp", "h", "hpp", "cs", "swift", "kt", "scala", "zig", "nim", "ex",
    "exs", "erl", "hs", "ml", "clj", "r", "lua", "php", "pl", "d", "cr", "dart", "jl", "v", "odin", "gleam", "rkt", "scm",
    "lisp", "lsp", "f", "fs", "fsi", "fsx", "sh", "bash", "zsh", "sql", "css", "tsx",
)
#: Extensions whose identifiers may hold hyphens (fixed values).
KEBAB_EXTENSIONS = ("css", "lisp", "lsp", "clj", "scm", "rkt")
#: Folders that are never entered; others that begin with a dot are not either (fixed values).
SKIP_DIRS = (".git", "node_modules", "target", "__pycache__", ".venv", "vendor")
#: Extension -> language that syntax mode knows (fixed values).
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}

SCHEMA = "path string, ext string, size bigint, content string"
#: Folders that are dealt to tasks, about; bytes of files in a task's list and in an Arrow batch.
FOLDERS, LIST_BYTES, BATCH_BYTES = 256, 16 << 20, 8 << 20


#: Seconds that a change must lie back before a stream takes it: later ones then have later times.
SETTLED = 1.0


def extension(path: str) -> str:
    """What follows the last dot of the file name; a leading dot does not count."""
    return os.path.splitext(os.path.basename(path))[1][1:]


def local_path(root) -> str:
    """A path on a file system that is mounted everywhere; urls of other stores are refused."""
    root = os.fspath(root).removeprefix("file://")
    if "://" in root or root.startswith(("hdfs:", "s3a:", "gs:")):
        raise ValueError(f"{root}: a source tree must be a folder that the driver and all executors see at one path")
    return root


@dataclass
class Wanted:
    """What a walk looks for: extensions, sizes, beginnings of paths, times of the last change in nanoseconds."""

    extensions: frozenset | None = None
    least: int = 0
    most: int | None = None
    prefixes: list = field(default_factory=list)
    after: int | None = None
    until: int | None = None

    def enters(self, folder: str) -> bool:
        return all(f"{folder}/".startswith(p) or p.startswith(f"{folder}/") for p in self.prefixes)

    def takes(self, path: str, size: int) -> bool:
        if self.extensions is not None and extension(path) not in self.extensions or not all(path.startswith(p) for p in self.prefixes):
            return False
        return self.least <= size and (self.most is None or size <= self.most)

    def at_the_time(self, status) -> bool:
        changed = max(status.st_mtime_ns, status.st_ctime_ns)
        return (self.after is None or changed > self.after) and (self.until is None or changed <= self.until)


def open_folder(folder: str, wanted: Wanted | None = None) -> tuple[list[tuple[str, int]], list[str]]:
    """(path, bytes) of a folder's own source files, and its folders that are entered; links are neither."""
    wanted = wanted or Wanted()
    files, folders = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return files, folders
    for entry in entries:
        try:
            if entry.is_symlink():
                continue
            if entry.is_dir():
                if entry.name not in SKIP_DIRS and not entry.name.startswith(".") and wanted.enters(entry.path):
                    folders.append(entry.path)
            elif extension(entry.name) in SOURCE_EXTENSIONS and entry.is_file():
                status = entry.stat()
                if wanted.takes(entry.path, status.st_size) and wanted.at_the_time(status):
                    files.append((entry.path, status.st_size))
        except OSError:
            continue
    return files, folders


def walk(folders, most=None, wanted: Wanted | None = None):
    """(path, bytes) of the source files below folders; with ``most``, folders stay unopened from that number on: (files, folders)."""
    waiting, found = deque(folders), []
    while waiting and (most is None or len(waiting) < most):
        files, below = open_folder(waiting.popleft(), wanted)
        found += files
        waiting.extend(below)
    return found if most is None else (found, list(waiting))


def list_files(root: str, most=None, wanted: Wanted | None = None):
    """What ``walk`` finds below a folder, or one file whatever its extension."""
    root, wanted = os.fspath(root), wanted or Wanted()
    if os.path.isfile(root):
        status = os.stat(root)
        found = [(root, status.st_size)] if wanted.takes(root, status.st_size) and wanted.at_the_time(status) else []
        return found if most is None else (found, [])
    start = [] if os.path.basename(os.path.abspath(root)) in SKIP_DIRS or not wanted.enters(root.rstrip("/")) else [root]
    return walk(start, most, wanted)


class _Part(InputPartition):
    def __init__(self, files=(), folders=(), wanted=None):
        super().__init__(None)
        self.files, self.folders, self.wanted = files, folders, wanted


class _Tree:
    """What batches and streams share: parts of a tree, and their contents."""

    def __init__(self, options):
        self.root, self.list_bytes = local_path(options["path"]), int(options.get("batchbytes", LIST_BYTES))
        self.folders = int(options.get("folders", FOLDERS))
        most, kinds, below = int(options.get("maxsize", -1)), options.get("extensions"), options.get("below")
        self.wanted = Wanted(
            extensions=frozenset(kinds.split(",")) if kinds is not None else None, least=int(options.get("minsize", 0)), most=most if most >= 0 else None,
            prefixes=[f"{self.root.rstrip('/')}/{below.strip('/')}/"] if below else [],
        )

    def parts(self, wanted):
        """Lists of known files of about equal bytes, and folders that tasks walk; an empty tree is one empty list."""
        files, folders = list_files(self.root, self.folders, wanted)
        out, batch, size = [_Part((), [f], wanted) for f in folders], [], 0
        for path, n in files:
            batch.append((path, n))
            size += n + 4096
            if size >= self.list_bytes:
                out.append(_Part(batch, (), wanted))
                batch, size = [], 0
        return [*out, _Part(batch, (), wanted)] if batch or not out else out

    def read(self, partition):
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["path", "ext", "size", "content"])
        for path, n in [*partition.files, *walk(partition.folders, None, partition.wanted)]:
            try:
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue  # unreadable or not UTF-8: no row
            rows.append((path, extension(path), n, content))
            size += n
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class _Reader(_Tree, DataSourceReader):
    def partitions(self):
        return self.parts(self.wanted)


class _StreamReader(_Tree, DataSourceStreamReader):
    def initialOffset(self):
        return {"changed": -1}

    def latestOffset(self):
        return {"changed": time.time_ns() - int(SETTLED * 1e9)}

    def partitions(self, start, end):
        if end["changed"] <= start["changed"]:
            return []
        found = self.parts(replace(self.wanted, after=start["changed"], until=end["changed"]))
        return [p for p in found if p.files or p.folders]


@dataclass
class _Moved(WriterCommitMessage):
    task: str
    files: int


class _Writer(DataSourceArrowWriter):
    """Tasks write below ``<root>.staged-*``; the driver renames its ``tree`` to ``root``."""

    def __init__(self, options, overwrite):
        self.root, self.overwrite = local_path(options["path"]).rstrip("/"), overwrite
        self.staged = f"{self.root}.staged-{uuid.uuid4().hex}"
        if not overwrite and os.path.exists(self.root):
            raise FileExistsError(f"{self.root} is there; only overwrite replaces it")
        os.makedirs(f"{self.staged}/tree")
        os.makedirs(f"{self.staged}/tasks")

    def write(self, iterator):
        if not os.path.isdir(f"{self.staged}/tasks"):
            raise OSError(f"{self.staged}: not a folder that all executors see")
        task = uuid.uuid4().hex  # an attempt's own folder
        aside = f"{self.staged}/tasks/{task}"
        os.makedirs(aside)
        moves = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path is None or content is None:
                    continue
                place = os.path.normpath(path)
                if os.path.isabs(place) or place.startswith(".."):
                    raise ValueError(f"{path}: not below the tree")
                own = f"{aside}/{len(moves)}"
                with open(own, "wb") as f:
                    f.write(content if isinstance(content, bytes) else content.encode())
                moves.append((own, f"{self.staged}/tree/{place}"))
        # whole files only are moved; another attempt of this task moves the same ones again
        for own, place in moves:
            os.makedirs(os.path.dirname(place), exist_ok=True)
            os.replace(own, place)
        return _Moved(task, len(moves))

    def commit(self, messages):
        unseen = [m.task for m in messages if m is not None and not os.path.isdir(f"{self.staged}/tasks/{m.task}")]
        if unseen:
            self.abort(messages)
            raise OSError(f"{self.root}: the driver does not see what {len(unseen)} tasks wrote; the folder is not shared")
        old = None
        if self.overwrite and os.path.exists(self.root):
            old = f"{self.staged}/old"
            os.rename(self.root, old)
        os.rename(f"{self.staged}/tree", self.root)
        shutil.rmtree(self.staged)

    def abort(self, messages):
        shutil.rmtree(self.staged, ignore_errors=True)


class SourceTree(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("source_tree").load(root)``, ``df.write.format("source_tree").save(root)``"""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(SourceTree)


def _load(reader, root, max_size, min_size, extensions, below):
    options = {"maxsize": max_size, "minsize": min_size, "extensions": None if extensions is None else ",".join(extensions), "below": below}
    return reader.format("source_tree").options(**{k: v for k, v in options.items() if v is not None}).load(local_path(root))


def read_tree(spark, root: str, max_size: int | None = None, min_size: int | None = None, extensions=None, below: str | None = None):
    """The files of a tree (or one file) as ``path, ext, size, content``.

    Files of other sizes or extensions are not opened; of folders outside ``below`` (a path from the root) none is.
    """
    register(spark)
    return _load(spark.read, root, max_size, min_size, extensions, below)


def stream_tree(spark, root: str, max_size: int | None = None, min_size: int | None = None, extensions=None, below: str | None = None):
    """The files of a tree as a stream: all that are there, then those that are added or changed."""
    register(spark)
    return _load(spark.readStream, root, max_size, min_size, extensions, below)


def write_tree(rows, root: str, overwrite: bool = False) -> int:
    """Write ``path`` (below ``root``) and ``content`` of each row as a file, all or nothing; the number of rows.

    ``content`` is text or binary.  Rows without path or content have no file; of rows with the same path one stays.
    """
    register(rows.sparkSession)
    seen = Observation()
    rows = rows.select("path", "content").observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.format("source_tree").mode("overwrite" if overwrite else "append").save(local_path(root))
    return seen.get["n"]


def ext_of(path):
    """Column: a path's extension, as ``extension`` finds it."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def language_of(ext):
    """Column: the language of an extension, null if syntax mode does not know it."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(pairs, ext)


def prune(files, path_col: str = "path"):
    """The rows of a table of paths that a walk from the root would reach and read."""
    names = "|".join(d.replace(".", r"\.") for d in SKIP_DIRS)
    skipped = F.col(path_col).rlike(rf"(^|/)({names}|\.[^/.][^/]*|\.\.[^/]+)/")
    return files.filter(~skipped & ext_of(F.col(path_col)).isin(*SOURCE_EXTENSIONS))


def spread(df):
    """``df`` dealt over all cores where its files make fewer partitions than that, as a single small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_files(rows, path, content, ext="txt"):
    """A table's text column in the shape of files: each row is one."""
    return rows.select(path.cast("string").alias("path"), F.lit(ext).alias("ext"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
