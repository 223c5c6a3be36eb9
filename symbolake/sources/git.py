"""Reading commits: HEAD and changes between commits by the installed git program, if there is one."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class ChangeSet:
    """Paths changed between two commits; a rename is a deletion and an addition."""

    added: list[str] = field(default_factory=list)
    modified: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)

    def to_parse(self) -> list[str]:
        return self.added + self.modified

    def to_drop(self) -> list[str]:
        return self.modified + self.deleted

    def total(self) -> int:
        return len(self.added) + len(self.modified) + len(self.deleted)


def head_commit(path: str) -> str | None:
    """HEAD's commit read from the repository's files; None outside a repository."""
    git = Path(path) / ".git"
    try:
        if git.is_file():
            git = (Path(path) / git.read_text().partition(":")[2].strip()).resolve()
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref:"):
            return head
        ref = head.partition(":")[2].strip()
        if (git / ref).is_file():
            return (git / ref).read_text().strip()
        for line in (git / "packed-refs").read_text().splitlines():
            if line.endswith(" " + ref):
                return line.split()[0]
    except OSError:
        pass
    return None


def changed_files(path: str, base: str) -> ChangeSet:
    """What differs between the tree of `base` and HEAD's: copies are additions, type changes modifications."""
    got = subprocess.run(["git", "-C", path, "diff-tree", "-r", "-z", "--no-renames", "--name-status", base, "HEAD"], capture_output=True, text=True, check=True).stdout.split("\0")
    out = ChangeSet()
    for status, name in zip(got[::2], got[1::2], strict=False):
        {"A": out.added, "C": out.added, "M": out.modified, "T": out.modified, "D": out.deleted}.get(status[:1], out.modified).append(name)
    return out
