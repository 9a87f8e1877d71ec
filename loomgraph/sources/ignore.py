"""Ignore rules of a source tree, compiled to expressions on paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: folders that are never indexed
BUILT_IN = ("node_modules", "dist", "build", "coverage", "__pycache__", "site-packages")


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


@dataclass
class Rules:
    """``drop`` and ``keep`` are regexes on the path; a match of ``keep`` always wins."""

    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)

    def add(self, text: str, folder: str = "") -> Rules:
        """With the lines of an ignore file in ``folder`` (relative, empty for the root)."""
        drop, keep = list(self.drop), list(self.keep)
        scope = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            target = keep if line.startswith("!") else drop
            pattern = line.lstrip("!").rstrip("/")
            anchored = "/" in pattern
            body = _translate(pattern.lstrip("/"))
            target.append(f"^{scope}{'' if anchored else '(?:[^/]+/)*'}{body}(?:/|$)")
        return Rules(drop, keep)

    def matches(self, path: str) -> bool:
        """What :func:`ignored` says, for a path at hand."""
        built_in = any(p in BUILT_IN or p.startswith(".") and p not in (".", "..") for p in path.split("/"))
        return (built_in or any(re.search(r, path) for r in self.drop)) and not any(re.search(r, path) for r in self.keep)


def ignored(path: Column, rules: Rules) -> Column:
    parts = F.split(path, "/")
    built_in = F.exists(parts, lambda s: F.startswith(s, F.lit(".")) & ~s.isin(".", "..") | s.isin(*BUILT_IN))
    drop = built_in
    for r in rules.drop:
        drop = drop | path.rlike(r)
    keep = F.lit(False)
    for r in rules.keep:
        keep = keep | path.rlike(r)
    return drop & ~keep
