"""Where template strings end; shared by the scanners of script sources."""

from __future__ import annotations

import re

_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_INSERT = re.compile(r"""[{}`]|"(?:[^\\"\n]|\\.)*"|'(?:[^\\'\n]|\\.)*'|//[^\n]*|/\*.*?\*/""", re.S)


def template_end(text: str, at: int) -> int:
    """Where a template string ends whose text begins at `at`, with what is inserted in it and the templates in there; the text's end if it doesn't."""
    inside = ["`"]
    while m := (_TEMPLATE if inside[-1] == "`" else _INSERT).search(text, at):
        at, what = m.end(), m[0]
        if what == inside[-1] or what == "}":
            inside.pop()
            if not inside:
                return at
        elif what in ("`", "${", "{"):
            inside.append("`" if what == "`" else "{")
    return len(text)
