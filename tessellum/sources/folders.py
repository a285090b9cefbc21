"""Folders that machines share, as data sources of Spark: a guarded listing (batch) and a feed of changes (stream).

Both walk a folder without following links and without entering subtrees that the rules leave out. The feed's offsets number
listings, kept in a folder of state; its batches are the differences of two of them, so a change in place, a lone deletion
and a commit on a known branch are seen, and a batch names what has changed and nothing else.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessellum.functions.text import glob_regex
from tessellum.sources.scan import SKIP_DIRS, SKIP_FILES, parse_ignore

LISTING = "relative string, size long, mtime long, reason string"
CHANGES = "relative string, change string, size long, mtime long"
IGNORE_FILE = ".gitignore"
#: Files that a task reads at once, and entries of a partition.
BATCH_BYTES, PART_ROWS = 16 << 20, 10_000


def local(path: str) -> str:
    """A folder's plain path; folders of other file systems than the shared or local one can't be walked."""
    plain = re.sub(r"^file:/+", "/", path)
    if "://" in plain:
        raise ValueError(f"{path} is not a folder of the machines' file system")
    return plain.rstrip("/") or "/"


@dataclass(frozen=True)
class Rules:
    """What a walk leaves out. ``ignore``: rules by folder; without it the ignore files that lie in the folders, read anew by
    each walk. ``include``: paths that stay whatever the rules say. ``names``: files that are taken besides the extensions."""

    extensions: tuple[str, ...]
    ignore: dict[str, list[str]] | None = None
    skip_globs: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    use_ignore_files: bool = True

    @classmethod
    def of(cls, extensions: list[str], ignore=None, skip_globs=None, include=None, names=None, use_ignore_files: bool = True) -> Rules:
        return cls(tuple(extensions), ignore, tuple(skip_globs or ()), tuple(include or ()), tuple(names or ()), use_ignore_files)

    def to_json(self) -> str:
        return json.dumps([list(self.extensions), self.ignore, list(self.skip_globs), list(self.include), list(self.names), self.use_ignore_files])

    @classmethod
    def from_json(cls, text: str) -> Rules:
        return cls.of(*json.loads(text))

    def lines(self, folder: str, path: str) -> list[str]:
        """The ignore rules of one folder."""
        if self.ignore is not None or not self.use_ignore_files:
            return (self.ignore or {}).get(folder, [])
        found = read_regular(os.path.join(path, IGNORE_FILE), 1 << 20)[0]
        return found.decode("utf-8", "replace").splitlines() if found else []

    def takes(self, relative: str) -> bool:
        """Whether the file's name is one that is wanted, and no glob leaves its path out."""
        name = relative.rsplit("/", 1)[-1]
        if name in SKIP_FILES or not (name in self.names or name.lower().endswith(self.extensions)):
            return False
        return not any(re.search(glob_regex(form), relative) for g in self.skip_globs for form in {g, g.replace("**/", "")})


Stack = list[tuple[str, list[tuple[re.Pattern, bool]]]]


def _ignored(relative: str, stack: Stack) -> bool:
    """What the last rule that matches says, outer folders first."""
    verdict = False
    for folder, rules in stack:
        below = relative[len(folder) + 1 :] if folder else relative
        for regex, ignored in rules:
            if regex.search(below):
                verdict = ignored
    return verdict


def link_reason(path: str) -> str:
    """Why a link can't be read: missing, not_file or unreadable; '' for one that can."""
    try:
        mode = os.stat(path).st_mode
    except OSError as e:
        return "unreadable" if isinstance(e, PermissionError) else "missing"
    return "not_file" if not stat.S_ISREG(mode) else "" if os.access(path, os.R_OK) else "unreadable"


def walk(root: str, rules: Rules, start: str = "", deep: bool = True) -> Iterator[tuple[str, int, int, str]]:
    """(path below the root, bytes, time of change in ns, reason) of the wanted files below ``start``.

    A reason says why a file won't be read: ``link`` (a link to a file; links aren't followed), ``missing``, ``not_file`` or
    ``unreadable``. A folder that rules leave out isn't entered unless a later rule takes something back or a forced path lies
    in it. Not ``deep``: only the entries of the folder itself, with folders as ``folder``.
    """
    stack: Stack = []
    parts = [""] + ["/".join(start.split("/")[: k + 1]) for k in range(start.count("/") + 1)] if start else [""]
    for folder in parts:
        stack.append((folder, [(re.compile(r.regex), r.ignored) for r in parse_ignore(rules.lines(folder, os.path.join(root, folder)))]))
    yield from _walk(root, rules, start, stack, deep)


def _walk(root: str, rules: Rules, folder: str, stack: Stack, deep: bool) -> Iterator[tuple[str, int, int, str]]:
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError:
        return  # gone or closed meanwhile
    for e in entries:
        relative = f"{folder}/{e.name}" if folder else e.name
        forced = relative in rules.include
        if e.is_dir(follow_symlinks=False):
            inside = any(p.startswith(relative + "/") for p in rules.include)
            taken_back = any(not ignored for _, own in stack for _, ignored in own)
            if not inside and (e.name in SKIP_DIRS or (_ignored(relative + "/", stack) and not taken_back)):
                continue
            if not deep:
                yield relative, 0, 0, "folder"
                continue
            own = [(re.compile(r.regex), r.ignored) for r in parse_ignore(rules.lines(relative, os.path.join(root, relative)))]
            yield from _walk(root, rules, relative, [*stack, (relative, own)], True)
        elif forced or (not any(p in SKIP_DIRS for p in relative.split("/")[:-1]) and rules.takes(relative) and not _ignored(relative, stack)):
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                continue
            if e.is_symlink():
                reason = link_reason(e.path) or "link"
            else:
                reason = "" if stat.S_ISREG(info.st_mode) else "not_file"
            yield relative, info.st_size, info.st_mtime_ns, reason


def read_regular(path: str, max_bytes: int | None = None) -> tuple[bytes | None, str]:
    """(bytes, '') of a regular file, ``max_bytes`` at most are read; (None, reason) of what is none. Links aren't followed
    and nothing blocks: a FIFO or device is opened without waiting, looked at and closed."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK | os.O_NOFOLLOW | os.O_CLOEXEC)
    except OSError as e:
        return None, "link" if os.path.islink(path) else "unreadable" if isinstance(e, PermissionError) else "missing" if not os.path.lexists(path) else "not_file"
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        return None, "not_file"
    with os.fdopen(fd, "rb") as f:
        return f.read() if max_bytes is None else f.read(max_bytes), ""


# ---- a listing


@dataclass
class _Folders(InputPartition):
    folders: list[str]
    files: list[tuple]


class _ListReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.rules, self.parts = local(options["root"]), Rules.from_json(options["rules"]), int(options.get("parts", "64"))

    def partitions(self):
        """Folders are opened from the top until there are enough of them; each is walked by one task."""
        open_, files = [""], []
        while open_ and len(open_) < self.parts:
            below = []
            for folder in open_:
                for row in walk(self.root, self.rules, folder, deep=False):
                    if row[3] == "folder":
                        below.append(row[0])
                    else:
                        files.append(row)
            open_ = below
        n = max(min(len(open_), self.parts), len(files) // PART_ROWS + 1)
        return [_Folders(open_[k::n], files[k::n]) for k in range(n)]

    def read(self, partition):
        yield from partition.files
        for folder in partition.folders:
            yield from walk(self.root, self.rules, folder)


class FolderListing(DataSource):
    """Wanted files below ``root`` (see ``walk``)."""

    @classmethod
    def name(cls):
        return "folder_listing"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _ListReader(self.options)


def listing(spark: SparkSession, root: str, rules: Rules) -> DataFrame:
    """(relative, size, mtime, reason) of the wanted files below a folder."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("root", root).option("rules", rules.to_json()).load()


def read_files(paths: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """The rows of ``paths`` (``relative``) with ``content``, its ``source_hash``, and the ``reason`` why there is none. A task
    holds some 16 MB of files, or one larger one."""
    base = local(root)
    kept = [c for c in paths.columns if c not in ("content", "reason", "source_hash")]
    source = paths.select(*kept)

    def run(batches):
        for b in batches:
            found, size, lo = [], 0, 0
            names = b.column("relative").to_pylist()
            for i, name in enumerate(names):
                content, reason = read_regular(os.path.join(base, name), max_bytes)
                found.append((content, reason))
                size += len(content or b"")
                if size > BATCH_BYTES or i + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, len(found)).columns, pa.array([c for c, _ in found], pa.binary()), pa.array([r for _, r in found], pa.string())], names=[*b.schema.names, "content", "reason"])
                    found, size, lo = [], 0, i + 1

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{types}, content binary, reason string").withColumn("source_hash", F.sha2("content", 256))


# ---- a feed


def git_folder(root: str) -> str:
    """The folder of a project's git, which a file may name (worktrees)."""
    path = os.path.join(root, ".git")
    content, _ = read_regular(path, 4096)
    if content and content.startswith(b"gitdir:"):
        return os.path.normpath(os.path.join(root, content[7:].decode().strip()))
    return path


def git_refs(root: str) -> dict[str, str]:
    """Branches of a project and what they point to: loose refs, else packed ones."""
    top = git_folder(root)
    common, _ = read_regular(os.path.join(top, "commondir"), 4096)
    base = os.path.normpath(os.path.join(top, common.decode().strip())) if common else top
    packed, _ = read_regular(os.path.join(base, "packed-refs"))
    out = {}
    for line in (packed or b"").decode("utf-8", "replace").splitlines():
        points, _, name = line.partition(" ")
        if name.startswith("refs/heads/"):
            out[name] = points
    heads = os.path.join(base, "refs", "heads")
    for folder, _, names in os.walk(heads):
        for name in names:
            content, _ = read_regular(os.path.join(folder, name), 4096)
            if content is not None:
                out[f"refs/heads/{os.path.relpath(os.path.join(folder, name), heads)}"] = content.decode("utf-8", "replace").strip()
    return out


@dataclass
class _Rows(InputPartition):
    rows: list[tuple]


class _ChangeReader(DataSourceStreamReader):
    """Offsets are ``{"n": number of a listing}``; 0 is the empty one. A listing is made anew when the files (or, ``on``
    refs, the branches) differ from the newest one, or when a batch was put back (``put_back``)."""

    def __init__(self, options):
        self.root, self.state, self.on = local(options["root"]), local(options["state"]), options.get("on", "files")
        self.rules = Rules.from_json(options["rules"])
        os.makedirs(self.state, exist_ok=True)

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for x in os.listdir(self.state) if (m := re.fullmatch(r"(\d+)\.json", x)))

    def _load(self, n: int) -> dict:
        if n == 0:
            return {"files": {}, "refs": {}, "again": ""}
        with open(os.path.join(self.state, f"{n}.json")) as f:
            return json.load(f)

    def _again(self) -> str:
        return (read_regular(os.path.join(self.state, "again"), 4096)[0] or b"").decode()

    def initialOffset(self):
        return {"n": 0}

    def latestOffset(self):
        n = max(self._numbers(), default=0)
        known, again = self._load(n), self._again()
        refs = git_refs(self.root) if self.on == "refs" else {}
        if n and known["again"] == again and self.on == "refs" and known["refs"] == refs:
            return {"n": n}
        files = {relative: [size, mtime] for relative, size, mtime, reason in walk(self.root, self.rules) if not reason}
        if n and known["again"] == again and self.on != "refs" and known["files"] == files:
            return {"n": n}
        made = os.path.join(self.state, f"{n + 1}.json")
        with open(made + ".new", "w") as f:
            json.dump({"files": files, "refs": refs, "again": again}, f)
        os.replace(made + ".new", made)
        return {"n": n + 1}

    def partitions(self, start, end):
        old, new = self._load(start["n"])["files"], self._load(end["n"])["files"]
        rows = [(x, "new" if x not in old else "changed", *new[x]) for x in sorted(new) if old.get(x) != new[x]]
        rows += [(x, "deleted", 0, 0) for x in sorted(old.keys() - new.keys())]
        return [_Rows(rows[k : k + PART_ROWS]) for k in range(0, len(rows), PART_ROWS)]

    def read(self, partition):
        yield from partition.rows

    def commit(self, end):
        for n in self._numbers():
            if n < end["n"]:
                os.unlink(os.path.join(self.state, f"{n}.json"))


class FolderChanges(DataSource):
    """A stream of what was added, changed and deleted below ``root``; with ``on`` refs, told when a branch has moved."""

    @classmethod
    def name(cls):
        return "folder_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):
        return _ChangeReader(self.options)


def changes(spark: SparkSession, root: str, rules: Rules, state: str, on: str = "files") -> DataFrame:
    """(relative, change, size, mtime): a stream of differences. ``state``: a folder of its own for the listings."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("root", root).option("rules", rules.to_json()).option("state", state).option("on", on).load()


def pending(state: str) -> dict[str, str]:
    """What batches that were put back hold: path -> change."""
    content, _ = read_regular(os.path.join(local(state), "pending"))
    return json.loads(content) if content else {}


def put_back(state: str, rows: dict[str, str], token: str) -> None:
    """Keep the changes of a batch that wasn't done; the feed gives a batch again at the next trigger, though nothing changes."""
    _replace(local(state), "pending", json.dumps(pending(state) | rows))
    _replace(local(state), "again", token)


def done(state: str) -> None:
    """The changes that were put back are done."""
    _replace(local(state), "pending", "{}")


def _replace(folder: str, name: str, text: str) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name + ".new"), "w") as f:
        f.write(text)
    os.replace(os.path.join(folder, name + ".new"), os.path.join(folder, name))
