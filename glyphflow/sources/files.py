"""The files of one dictionary: by its include lines, else by numbered neighbours, else the one."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable

MOST_FILES = 64


def file_set(path: str, exists: Callable[[str], bool], includes: Callable[[str], list[str] | None]) -> tuple[list[str], str, list[tuple[str, str]]]:
    """(files, how they were found, problems).

    exists tells of a path whether it is there; includes gives the names that a file's
    header includes, or None if the file cannot be read. At most MOST_FILES are taken, and a
    rest is reported; files that include each other are taken once.
    """
    folder = path.rpartition("/")[0]
    first = includes(path)
    if first:
        return _included(path, folder, first, exists, includes)
    stem, dot, suffix = path.rpartition("/")[2].rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot else (suffix, "")
    m = re.search(r"[0-9]+\Z", stem)
    if m is None:
        return [path], "single", []
    name = lambda k: f"{folder}/{stem[: m.start()]}{k:0{len(m[0])}d}{suffix}"
    found = []
    while len(found) < MOST_FILES and exists(name(len(found) + 1)):
        found.append(name(len(found) + 1))
    if len(found) < 2 or path not in found:
        return [path], "single", []
    if path != found[0]:
        return file_set(found[0], exists, includes)
    full = len(found) == MOST_FILES
    return found, "numbered", [("tooManyFiles", path)] if full else []


def _included(path, folder, first, exists, includes):
    files, problems, queue = [path], [], deque((folder, n) for n in first)
    seen = {path}
    while queue:
        if len(files) >= MOST_FILES:
            problems.append(("tooManyFiles", ", ".join(n for _, n in queue)))
            break
        where, name = queue.popleft()
        target = f"{where}/{name}"
        if not exists(target):
            problems.append(("missingInclude", name))
            continue
        if target in seen:
            continue
        seen.add(target)
        more = includes(target)
        if more is None:
            problems.append(("missingInclude", name))
            continue
        files.append(target)
        queue.extend((target.rpartition("/")[0], n) for n in more)
    return files, "includes", problems
