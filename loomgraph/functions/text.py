"""Column expressions for paths, names and scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by file extension, kind bonuses and stop words of the search
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".java": "java",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".h": "cpp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
}


def simple_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)(tests?|__tests__)/") | low.rlike(r"\.(test|spec)\.")


def is_deprioritized(path: Column) -> Column:
    low = F.lower(path)
    return is_test_file(path) | low.endswith(".d.ts") | low.contains(".generated.") | low.rlike(r"(^|/)(dist|build|coverage)/")


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, "/+$", ""), "/"), lambda s: s != "")


def route_parameters(path: Column) -> Column:
    """<int:id>, {id} and {id:rule} become :id; ${...} stays."""
    plain = F.regexp_replace(path, r"<(?:[^:<>]+:)?([^<>]+)>", ":$1")
    return F.regexp_replace(plain, r"(?<!\$)\{([A-Za-z_][A-Za-z0-9_]*)(?::[^{}]*)?\}", ":$1")


def join_route(prefix: Column, path: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.concat(segments(prefix), segments(path)), "/"))


def estimated_tokens(text: Column) -> Column:
    return F.round(F.octet_length(text) / 4).cast("long")


def glob_regex(glob: str) -> str:
    """An anchored regex: ** crosses directories, * and ? stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"
