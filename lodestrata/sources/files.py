"""A directory tree as a table: a Python data source for what Spark's readers don't show.

Spark's file readers hide dotfiles, empty files and broken links.  This source lists the
upper directories on the driver, until there are some hundreds to go on with; each of
those is listed, and its files read, by a task.  Ignored directories are never entered.
The tree must be on a file system that all executors mount at the same path.

A file of more than ``maxContentBytes`` gives several rows, cut behind line ends, so that
files of any size are counted and searched; ``first_line`` is the number of lines ahead of
a row.  A line longer than that is cut too, and the row that goes on with it
``continues``.  The last row of such a file has its ``digest``, made while it is read.  Of
a large binary file only the front that tells it is binary is read.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import rules

SCHEMA = "rel_path string, size long, is_symlink boolean, is_broken_symlink boolean, is_executable boolean, content binary, part int, first_line long, is_split boolean, continues boolean, digest string"


# Fixed names of character classes, and what each holds.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": " \\t-\\r", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
}


def _bracket(text: str, i: int) -> tuple[str, int] | None:
    """The class that opens at ``i`` as a pattern of one character, never ``/``, and where it ends; None if it doesn't end."""
    at = i + 1
    negated = text[at : at + 1] in ("!", "^")
    at += negated
    items, first, low = [], True, None
    while True:
        c = text[at : at + 1]
        if not c:
            return None
        if c == "]" and not first:
            break
        first = False
        if c == "[" and text[at + 1 : at + 2] == ":" and (end := text.find(":]", at + 2)) > 0:
            if (name := text[at + 2 : end]) not in CLASSES:
                return None
            items.append(CLASSES[name])
            at, low = end + 2, None
            continue
        is_range = c == "-" and low is not None and text[at + 1 : at + 2] not in ("", "]")
        at += is_range
        if text[at] == "\\":
            at += 1
            if at == len(text):
                return None
        c, at = text[at], at + 1
        if not is_range:
            items.append(re.escape(c))
        elif low <= c:
            items.append(f"{re.escape(low)}-{re.escape(c)}")
        low = None if is_range else c
    inner = "".join(items)
    one = (f"[^{inner}]" if inner else ".") if negated else (f"[{inner}]" if inner else "(?!)")
    return "(?!/)" + one, at + 1


def ignore_pattern(line: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file as (pattern of the relative path, negated, directories only); None if it matches nothing.

    ``**`` crosses folders only as a whole part of the path; elsewhere it is ``*``.
    """
    text = line.removesuffix("\n").removesuffix("\r")
    while text.endswith(" ") and (len(text) - 1 - len(text[:-1].rstrip("\\"))) % 2 == 0:
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    only_dirs = text.endswith("/")
    text = text.removesuffix("/")
    rooted = "/" in text
    text = text.removeprefix("/")
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            end = i + len(text[i:]) - len(text[i:].lstrip("*"))
            whole = end - i > 1 and (i == 0 or text[i - 1] == "/") and text[end : end + 1] in ("", "/")
            if not whole:
                out, i = out + "[^/]*", end
            elif end == len(text):
                out, i = out + ".+", end
            else:
                out, i = out + "(?:.*/)?", end + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            if not (found := _bracket(text, i)):
                return None
            out, i = out + found[0], found[1]
        elif c == "\\":
            if i + 1 == len(text):
                return None
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return (("" if rooted else "(?:.*/)?") + out, negated, only_dirs) if out else None


class Rules:
    """All rules of a folder as one pattern: the last rule that matches decides, so it is the first alternative."""

    def __init__(self, lines: Iterator[str]):
        found = [p for p in map(ignore_pattern, lines) if p][::-1]
        self.negated = [negated for _, negated, _ in found]
        self.pattern = re.compile("|".join(f"({p}{'/' if only_dirs else '/?'})" + r"\Z" for p, _, only_dirs in found), re.S)

    def __bool__(self):
        return bool(self.negated)

    def verdict(self, path: str) -> bool | None:
        """Whether ``path``, a folder's with ``/`` behind it, is ignored; None where no rule matches."""
        if not self or not (m := self.pattern.match(path)):
            return None
        return not self.negated[m.lastindex - 1]


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace", newline="\n") as f:
            return f.readlines()
    except OSError:
        return []


def read_patterns(path: str) -> Rules:
    return Rules(_lines(path))


def read_ignores(folder: str) -> Rules:
    return Rules(x for name in (".gitignore", ".ignore") for x in _lines(os.path.join(folder, name)))


def user_ignores() -> str:
    """Where the user's own ignore file is by convention."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def outer_ignores(root: str, user: str = "") -> list:
    """Ignore rules from outside the tree, the weakest first: the user's, the repository's own list, those of parents.

    Each is ``(base, lead, patterns)``: a path matches with ``base`` taken off and ``lead`` put in front.
    """
    above, at, lead = [], os.path.abspath(root), ""
    repository = (at, "") if os.path.isdir(os.path.join(at, ".git")) else None
    while not repository and os.path.dirname(at) != at:
        lead = f"{os.path.basename(at)}/{lead}"
        at = os.path.dirname(at)
        above.append((lead, read_ignores(at)))
        if os.path.isdir(os.path.join(at, ".git")):
            repository = at, lead
    found = [("", "", read_patterns(user))]
    if repository:
        found.append(("", repository[1], read_patterns(os.path.join(repository[0], ".git", "info", "exclude"))))
    return [x for x in [*found, *(("", lead, p) for lead, p in reversed(above))] if x[2]]


def ignored(path: str, is_dir: bool, ignores: list) -> bool:
    for base, lead, own in reversed(ignores):  # the deepest ignore file decides
        if (verdict := own.verdict(lead + path[len(base) :] + "/" * is_dir)) is not None:
            return verdict
    return False


def entries(root: str, rel: str, ignores: list, ignore_dirs: tuple[str, ...], use_ignores: bool) -> tuple[list, list[str]]:
    """Directories to enter, with the rules that hold in them, and files and links of one directory, in order."""
    folder = os.path.join(root, rel)
    if use_ignores and (own := read_ignores(folder)):
        ignores = [*ignores, (rel, "", own)]
    dirs, files = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return dirs, files
    for e in found:
        path, is_dir = rel + e.name, e.is_dir(follow_symlinks=False)
        if (is_dir and e.name in ignore_dirs) or ignored(path, is_dir, ignores):
            continue
        if is_dir:
            dirs.append((path + "/", ignores))
        elif e.is_file(follow_symlinks=False) or e.is_symlink():
            files.append(path)
    return dirs, files


def listing(root: str, ignore_dirs: tuple[str, ...], use_ignores: bool, start: list | None = None) -> Iterator[str]:
    """Relative paths of files and links below ``start``, or the whole tree; ignored directories aren't entered."""
    todo = list(reversed(start if start is not None else [("", outer_ignores(root) if use_ignores else [])]))
    while todo:
        dirs, files = entries(root, *todo.pop(), ignore_dirs, use_ignores)
        yield from files
        todo += reversed(dirs)


class Paths(InputPartition):
    """Files to read, and directories to list and read."""

    def __init__(self, paths: list[str], dirs: list):
        super().__init__(0)
        self.paths, self.dirs = paths, dirs


LINE_END = re.compile(rb"\r\n|\r|\n")


def _end(held: bytes) -> int:
    """Where a piece without an LF may be cut: not inside a character, nor between CR and a possible LF."""
    end = len(held) - held.endswith(b"\r")
    for back in range(1, min(4, end) + 1):
        c = held[end - back]
        if c & 0xC0 != 0x80:
            return end - back if c >= 0xC0 and end > back else end
    return end


def pieces(path: str, size: int, most: int) -> Iterator[tuple[bytes, int, int]]:
    """``(content, part, lines ahead)`` of a file, cut behind the last LF of every ``most`` bytes or so.

    Without an LF in as many bytes a line is cut, so no more than twice ``most`` is held.
    """
    with open(path, "rb") as f:
        if size <= most:
            yield f.read(), 0, 0
            return
        held, part, ahead = f.read(most), 0, 0
        if b"\0" in held[: rules.SNIFF_BYTES]:
            yield held[: rules.SNIFF_BYTES], 0, 0
            return
        while held:
            more = f.read(most)
            end = len(held) if not more else held.rfind(b"\n") + 1 or _end(held)
            if end:
                yield held[:end], part, ahead
                part, ahead = part + 1, ahead + len(LINE_END.findall(held, 0, end))
            held = held[end:] + more


def rows_of(path: str, size: int, most: int) -> Iterator[tuple]:
    """``pieces`` with whether each continues a line, and on the last of several the digest of all."""
    running, last = hashlib.sha256(), None
    for content, part, ahead in pieces(path, size, most):
        running.update(content)
        if last:
            yield *last, None
        last = content, part, ahead, size > most, bool(last) and not last[0].endswith(b"\n")
    if last:
        cut_short = last[1] == 0 and len(last[0]) < size
        yield *last, running.hexdigest() if size > most and not cut_short else None


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.batch = int(options.get("batch", 500))
        self.use_ignores = options.get("ignoreFiles", "true").lower() == "true"
        self.ignore_dirs = tuple(x for x in options.get("ignoreDirs", ",".join(rules.IGNORE_DIRS)).split(",") if x)
        self.most = int(options.get("maxContentBytes", 16 << 20))
        self.fan = int(options.get("directories", 256))
        self.user = options.get("userIgnores", "")

    def partitions(self):
        dirs, files = [("", outer_ignores(self.root, self.user) if self.use_ignores else [])], []
        while dirs and len(dirs) < self.fan:
            level, dirs = dirs, []
            for d in level:
                below, own = entries(self.root, *d, self.ignore_dirs, self.use_ignores)
                dirs += below
                files += own
        return [Paths(files[i : i + self.batch], []) for i in range(0, len(files), self.batch)] + [Paths([], [d]) for d in dirs] or [Paths([], [])]

    def read(self, partition):
        for rel in [*partition.paths] if not partition.dirs else listing(self.root, self.ignore_dirs, self.use_ignores, partition.dirs):
            path = os.path.join(self.root, rel)
            try:
                s = os.lstat(path)
            except OSError:
                continue
            if stat.S_ISLNK(s.st_mode):
                yield rel, 0, True, not os.path.exists(path), False, None, 0, 0, False, False, None
                continue
            flags = rel, s.st_size, False, False, bool(s.st_mode & 0o111)
            try:
                for row in rows_of(path, s.st_size, self.most):
                    yield *flags, *row
            except OSError:
                yield *flags, None, 0, 0, False, False, None


class FileTree(DataSource):
    """``spark.read.format("filetree")``; options ``ignoreDirs``, ``ignoreFiles``, ``userIgnores``, ``batch``, ``directories``, ``maxContentBytes``."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files below ``path`` with their content, ready for ``operators.records``."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").options(**{k: str(v) for k, v in ({"userIgnores": user_ignores()} | options).items()}).load(str(path))
