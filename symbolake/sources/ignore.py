"""Ignore rules of source trees: which paths the files .gitignore and .ignore of a tree exclude."""

from __future__ import annotations

import re


def pattern(text: str) -> re.Pattern:
    """An ignore pattern as a regular expression over a path below the rule's folder: `*` and `?` stay within a name, `**` crosses folders."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inner = text[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
        elif c == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out)


class Rules:
    """The rules of a tree, added folder by folder from the top; later ones decide."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []  # folder, pattern, folders only, kept

    def add(self, folder: str, lines: list[str]) -> None:
        for line in lines:
            s = line.rstrip("\r\n")
            s = s if s.endswith("\\ ") else s.rstrip()
            if not s or s.startswith("#"):
                continue
            keep, s = s.startswith("!"), s.removeprefix("!")
            only, s = s.endswith("/"), s.rstrip("/")
            if not s:
                continue
            # A pattern with a slash inside is tied to the rule's folder, any other fits at every depth below it.
            self.rules.append((folder, pattern(s.removeprefix("/") if "/" in s else f"**/{s}"), only, keep))

    def ignores(self, path: str, is_dir: bool) -> bool:
        """Whether a path is excluded by itself; what lies in an excluded folder is never asked for."""
        for folder, pat, only, keep in reversed(self.rules):
            if folder and not path.startswith(folder + "/") or only and not is_dir:
                continue
            if pat.fullmatch(path[len(folder) + 1 :] if folder else path):
                return not keep
        return False
