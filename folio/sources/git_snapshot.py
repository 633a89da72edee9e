"""Files of a Git commit as a table: ``spark.read.format("git_snapshot")`` after ``register(spark)``.

By default the commit's tree is listed once, its entries are validated and bounded by the sizes that the tree gives, and the
selected files are dealt into partitions of about ``PART_BYTES``; each partition asks Git for its objects in one batch, every
object once, whatever number of paths it has. Excluded paths, and paths that a filter on ``source_path`` rules out, are never
read. Every file's bytes must hash to the object id that the tree names.

With the option ``mode`` set to ``archive`` the commit's archive is read as a stream instead, one partition a repository: every
member is validated, those that the profile excludes as well; byte bounds count the included ones only.
"""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from folio.functions.paths import canonical, compiled

SCHEMA = "commit_sha string, source_path string, content binary"
CHUNK = 1 << 16
BLOCK = 512


@dataclass(frozen=True)
class Limits:
    members: int = 20_000
    file_bytes: int = 4 << 20
    total_bytes: int = 128 << 20
    archive_bytes: int = 512 << 20
    pax_bytes: int = 4 << 20


class SnapshotError(ValueError):
    """A repository, archive or member that can't be trusted. Messages hold no content."""


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", repo, *args], capture_output=True, stdin=subprocess.DEVNULL)
    if done.returncode:
        raise SnapshotError(f"git {args[0]} failed")
    return done.stdout


class _Bounded:
    """A stream that refuses to give more than its bound."""

    def __init__(self, stream, most: int):
        self.stream, self.left = stream, most

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            part = self.stream.read(min(n, CHUNK))
            if not part:
                raise SnapshotError("the archive is cut short")
            self.left -= len(part)
            if self.left < 0:
                raise SnapshotError("the archive is too large")
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def rest_is_zero(self) -> bool:
        while part := self.stream.read(CHUNK):
            self.left -= len(part)
            if part.strip(b"\0") or self.left < 0:
                return False
        return True


def _octal(raw: bytes) -> int:
    text = raw.strip(b" \0")
    if not re.fullmatch(rb"[0-7]*", text):
        raise SnapshotError("a header holds a size that isn't octal")
    return int(text or b"0", 8)


def _pax(raw: bytes) -> dict[str, str]:
    out = {}
    while raw:
        head, _, _ = raw.partition(b" ")
        if not head.isdigit() or not 0 < int(head) <= len(raw) or raw[int(head) - 1 : int(head)] != b"\n":
            raise SnapshotError("a PAX record is malformed")
        key, equals, value = raw[len(head) + 1 : int(head) - 1].partition(b"=")
        if not equals:
            raise SnapshotError("a PAX record is malformed")
        out[key.decode("utf-8", "strict")] = value.decode("utf-8", "strict")
        raw = raw[int(head) :]
    return out


def members(stream, limits: Limits = Limits()) -> Iterator[tuple[str, bool, int, _Bounded]]:
    """(path, whether a directory, size, stream at its content) of a tar stream; the caller reads ``size`` bytes of files.

    Regular files, directories and PAX headers are all that may be there.
    """
    source, seen, pending, count = _Bounded(stream, limits.archive_bytes), set(), {}, 0
    while True:
        header = source.exactly(BLOCK)
        if not header.strip(b"\0"):
            if source.exactly(BLOCK).strip(b"\0") or not source.rest_is_zero() or pending:
                raise SnapshotError("the archive goes on behind its end")
            return
        if _octal(header[148:156]) != sum(header[:148]) + 8 * 32 + sum(header[156:]):
            raise SnapshotError("a header's checksum is wrong")
        kind, size = header[156:157], _octal(header[124:136])
        if kind in (b"x", b"g"):
            if size > limits.pax_bytes:
                raise SnapshotError("a PAX header is too large")
            records = _pax(source.exactly(size))
            source.exactly(-size % BLOCK)
            if kind == b"x":
                pending = records
            continue
        if kind not in (b"0", b"\0", b"5"):
            raise SnapshotError("a member is neither a file nor a directory")
        name = header[:100].rstrip(b"\0").decode("utf-8", "strict")
        if header[257:262] == b"ustar" and (prefix := header[345:500].rstrip(b"\0")):
            name = f"{prefix.decode('utf-8', 'strict')}/{name}"
        name, size = pending.get("path", name), int(pending.get("size", size))
        if any(k.startswith("GNU.sparse") for k in pending):
            raise SnapshotError("a member is sparse")
        pending = {}
        count += 1
        if count > limits.members:
            raise SnapshotError("the archive has too many members")
        folder = kind == b"5"
        path = name[:-1] if folder and name.endswith("/") else name
        try:
            if canonical(path) != path:
                raise ValueError
        except ValueError:
            raise SnapshotError("a member's path isn't canonical") from None
        if path in seen:
            raise SnapshotError("a member stands twice")
        seen.add(path)
        if folder and size:
            raise SnapshotError("a directory has content")
        yield path, folder, size, source


def selects(include: list[str], exclude: list[str]):
    """A profile's choice of paths as a function."""
    yes, no = ([re.compile(compiled(p).replace("\\z", "\\Z")) for p in patterns] for patterns in (include, exclude))
    return lambda path: any(p.match(f"/{path}") for p in yes) and not any(p.match(f"/{path}") for p in no)


@dataclass(frozen=True)
class Entry:
    path: str
    oid: str
    size: int


def entries(repo: str, commit: str) -> list[Entry]:
    """The files of a commit's tree in order of their paths; anything but files at canonical paths is an error."""
    if not re.fullmatch(r"[0-9a-f]{40}", commit):
        raise SnapshotError("a commit is given by 40 hexadecimal digits")
    if _git(repo, "status", "--porcelain=v1").strip():
        raise SnapshotError("the worktree isn't clean")
    if _git(repo, "rev-parse", "--verify", f"{commit}^{{commit}}").decode().strip() != commit:
        raise SnapshotError("there is no such commit")
    out = []
    for record in _git(repo, "ls-tree", "-r", "-l", "-z", commit).split(b"\0")[:-1]:
        head, _, path = record.partition(b"\t")
        mode, _, oid, size = head.decode().split()
        if mode not in ("100644", "100755"):
            raise SnapshotError("the tree holds a link or a submodule")
        out.append(Entry(path.decode("utf-8", "strict"), oid, int(size)))
    return sorted(out, key=lambda e: e.path)


def chosen(repo: str, commit: str, wanted: Callable[[str], bool], limits: Limits = Limits()) -> list[Entry]:
    """The entries to read, within the limits; the paths of all entries are validated."""
    every = entries(repo, commit)
    if len(every) > limits.members:
        raise SnapshotError("the tree has too many files")
    for e in every:
        try:
            if canonical(e.path) != e.path:
                raise ValueError
        except ValueError:
            raise SnapshotError("a file's path isn't canonical") from None
    own = [e for e in every if wanted(e.path)]
    if any(e.size > limits.file_bytes for e in own):
        raise SnapshotError("a file is too large")
    if sum(e.size for e in own) > limits.total_bytes:
        raise SnapshotError("the files are too large")
    return own


def dealt(files: list[Entry], part_bytes: int) -> list[list[Entry]]:
    """The files in parts of about so many bytes to read; all paths of an object are in one part, in order of the first."""
    objects: dict[str, list[Entry]] = {}
    for e in files:
        objects.setdefault(e.oid, []).append(e)
    parts, held = [[]], 0
    for own in objects.values():
        if parts[-1] and held + own[0].size > part_bytes:
            parts.append([])
            held = 0
        parts[-1] += own
        held += own[0].size
    return parts


def blobs(repo: str, files: list[Entry]) -> Iterator[tuple[str, bytes]]:
    """(path, content) of entries whose objects follow each other; each object is asked for once, in one process."""
    child = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    try:
        last = None
        for e in files:
            if e.oid != last:
                child.stdin.write(f"{e.oid}\n".encode())
                child.stdin.flush()
                if child.stdout.readline() != f"{e.oid} blob {e.size}\n".encode():
                    raise SnapshotError("an object isn't what the tree names")
                content = _Bounded(child.stdout, e.size + 1).exactly(e.size + 1)[:-1]
                make = hashlib.sha1 if len(e.oid) == 40 else hashlib.sha256
                if make(b"blob %d\0" % e.size + content).hexdigest() != e.oid:
                    raise SnapshotError("a file's bytes aren't those of the commit")
                last = e.oid
            yield e.path, content
    finally:
        child.kill()
        child.stdin.close()
        child.stdout.close()
        child.wait()


def snapshot(repo: str, commit: str, include: list[str], exclude: list[str], limits: Limits = Limits()) -> list[tuple[str, bytes]]:
    """The selected files of a commit in order of their paths, read from its archive."""
    tree = {e.path: e.oid for e in entries(repo, commit)}
    wanted, out, found, total = selects(include, exclude), [], set(), 0
    child = subprocess.Popen(["git", "-C", repo, "archive", "--format=tar", commit], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL)
    try:
        for path, folder, size, source in members(child.stdout, limits):
            if folder:
                continue
            found.add(path)
            keep = wanted(path)
            if keep and size > limits.file_bytes:
                raise SnapshotError("a file is too large")
            total += size if keep else 0
            if total > limits.total_bytes:
                raise SnapshotError("the files are too large")
            content = source.exactly(size)
            source.exactly(-size % BLOCK)
            if keep:
                digest = (hashlib.sha1 if len(tree.get(path, "")) == 40 else hashlib.sha256)(b"blob %d\0" % size + content).hexdigest()
                if digest != tree.get(path):
                    raise SnapshotError("a file's bytes aren't those of the commit")
                out.append((path, content))
        if child.wait() or found != set(tree):
            raise SnapshotError("the archive's paths aren't those of the commit")
    finally:
        child.kill()
        child.stdout.close()
        child.wait()
    return sorted(out)


PART_BYTES = 16 << 20


@dataclass
class _Part(InputPartition):
    repo: str
    files: list[Entry] | None  # none: the archive


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.commit = options["commit"]
        self.include = [p for p in options.get("include", "**").split(",") if p]
        self.exclude = [p for p in options.get("exclude", "").split(",") if p]
        self.archive = options.get("mode", "blobs") == "archive"
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        self.tests: list[Callable[[str], bool]] = []

    def _wanted(self) -> Callable[[str], bool]:
        selected = selects(self.include, self.exclude)
        return lambda path: selected(path) and all(test(path) for test in self.tests)

    def partitions(self) -> list[InputPartition]:
        if self.archive:
            return [_Part(p, None) for p in self.paths]
        return [_Part(p, files) for p in self.paths for files in dealt(chosen(p, self.commit, self._wanted()), self.part_bytes)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        files = snapshot(partition.repo, self.commit, self.include, self.exclude) if partition.files is None else blobs(partition.repo, partition.files)
        for path, content in files:
            if all(test(path) for test in self.tests):
                yield self.commit, path, content


class _FilteringReader(_Reader):
    """Spark refuses readers with this method unless ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on source_path are taken; Spark gets back the others."""
        for f in filters:
            if getattr(f, "attribute", None) != ("source_path",) or not isinstance(f, (EqualTo, In, StringStartsWith)):
                yield f
            elif isinstance(f, StringStartsWith):
                self.tests.append(lambda path, start=f.value: path.startswith(start))
            else:
                self.tests.append(lambda path, among=frozenset(f.value if isinstance(f, In) else [f.value]): path in among)


class GitSnapshotSource(DataSource):
    """Options: path (repositories, comma-separated), commit, include and exclude (patterns, comma-separated), mode (``blobs``
    or ``archive``), partBytes, pushFilters (``true`` where the session allows Python sources to take filters)."""

    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushFilters") == "true" else _Reader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSnapshotSource)
