"""Extraction of symbols and relations from source files: file -> (nodes, edges), as one distributed map over contents.

Python uses the interpreter's own parser; brace languages a small tokenizer that blanks comments and strings, then finds declarations
and their extents by brace depth. Prisma, dotenv and single-file components are line-oriented. A file that fails loses only itself.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from ..operators.scopes import nearest_ancestor
from ..plans.durable import materialize
from .references import Referrer, Symbol, file_routes

# fixed values: HTTP verbs, and Python builtins whose calls are no candidates
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
BUILTINS = set("abs all any bool bytes callable chr dict dir enumerate filter float format getattr hasattr hash id input int isinstance issubclass iter len list map max min next object open ord print range repr reversed round set setattr sorted str sum super tuple type vars zip".split())

#: language -> (kind, pattern) of declarations; group "name" is the symbol, (?P<owner>) an owner written beside it
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("Class", r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)"), ("Function", r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*\("), ("Function", r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*=>"), ("Method", r"(?m)^[ \t]+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<name>(?!(?:if|for|while|switch|catch|return|function|new)\b)[A-Za-z_$#][\w$]*)\s*\([^(){};]*\)\s*\{")],
    "typescript": [("Class", r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)"), ("Interface", r"\binterface\s+(?P<name>[A-Za-z_$][\w$]*)"), ("Enum", r"\benum\s+(?P<name>[A-Za-z_$][\w$]*)"), ("TypeAlias", r"\btype\s+(?P<name>[A-Za-z_$][\w$]*)(?:<[^=]*>)?\s*="), ("Module", r"\bnamespace\s+(?P<name>[A-Za-z_$][\w$.]*)"), ("Function", r"\bfunction\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\("), ("Function", r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"), ("Method", r"(?m)^[ \t]+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+|override\s+|get\s+|set\s+|\*\s*)*(?P<name>(?!(?:if|for|while|switch|catch|return|function|new)\b)[A-Za-z_$#][\w$]*)\s*(?:<[^()]*>)?\([^{};]*\)\s*(?::[^{};=]+)?\{")],
    "java": [("Class", r"\b(?:class|record)\s+(?P<name>\w+)"), ("Interface", r"(?<!@)\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Method", r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?(?!(?:return|new|else|throw)\b)(?:[\w.$]+(?:<[^;{}()]*>)?(?:\[\])*\s+)?(?P<name>(?!(?:if|for|while|switch|catch|return|new|synchronized)\b)\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]")],
    "csharp": [("Class", r"\b(?:class|struct|record)\s+(?P<name>\w+)"), ("Interface", r"\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Method", r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|async|override|virtual|abstract|sealed)\s+)+(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*\([^;{}()]*\)\s*(?:\{|=>|;)")],
    "go": [("Function", r"(?m)^func\s+(?P<name>\w+)\s*[\[(]"), ("Method", r"(?m)^func\s+\([^)]*\)\s*(?P<name>\w+)\s*\("), ("Interface", r"(?m)^type\s+(?P<name>\w+)\s+interface\b"), ("Class", r"(?m)^type\s+(?P<name>\w+)\s+struct\b"), ("TypeAlias", r"(?m)^type\s+(?P<name>\w+)\s+(?:=\s*)?(?!struct\b|interface\b)[\w\[*(.]")],
    "rust": [("Function", r"\bfn\s+(?P<name>\w+)"), ("Class", r"\bstruct\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Interface", r"\btrait\s+(?P<name>\w+)")],
    "php": [("Class", r"\b(?:class|trait)\s+(?P<name>\w+)"), ("Interface", r"\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Function", r"\bfunction\s+&?(?P<name>\w+)\s*\(")],
    "kotlin": [("Class", r"\b(?:class|interface|object)\s+(?P<name>\w+)"), ("Function", r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\(")],
    "swift": [("Class", r"\b(?:class|struct)\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("Interface", r"\bprotocol\s+(?P<name>\w+)"), ("Function", r"\bfunc\s+(?P<name>\w+)")],
    "c": [("Class", r"\b(?:struct|union)\s+(?P<name>\w+)\s*\{"), ("Enum", r"\benum\s+(?P<name>\w+)\s*\{"), ("TypeAlias", r"\btypedef\b[^;{}]*?\b(?P<name>\w+)\s*;"), ("Function", r"(?m)^(?!\s*(?:else|return|typedef)\b)[A-Za-z_][\w\s*]*?\b(?P<name>(?!(?:if|for|while|switch|return|sizeof)\b)\w+)\s*\([^;{}]*\)\s*\{")],
}
_FIELD = r"(?m)^[ \t]+(?:(?:public|private|protected|static|final|readonly|volatile|transient|declare)\s+)*"
DECLARATIONS["java"].append(("Property", _FIELD + r"(?!(?:return|new|package|import|throw|else)\b)[A-Za-z_][\w.]*(?:<[^;(){}]*>)?(?:\[\])*\s+(?P<name>\w+)\s*(?:=[^;{}]*)?;"))
DECLARATIONS["typescript"] += [("Property", _FIELD + r"(?!(?:return|const|let|var|type|throw|import|export|case|default|break|continue)\b)(?P<name>[A-Za-z_$][\w$]*)[?!]?\s*:\s*[^;{}()=]+(?:=[^;{}]*)?;"), ("Variable", r"(?m)^(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>)(?!\s*(?:async\s+)?function\b)")]
DECLARATIONS["cpp"] = [("Module", r"\bnamespace\s+(?P<name>\w+)\s*\{"), ("Class", r"\b(?:class|struct|union)\s+(?P<name>\w+)[^;{}()]*\{"), *DECLARATIONS["c"][1:3], ("Function", r"(?m)^[ \t]*(?!\s*(?:else|return|typedef|namespace)\b)[A-Za-z_][\w\s*&:<>,]*?\b(?P<name>(?!(?:if|for|while|switch|return|sizeof)\b)\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{")]
IMPORTS = {
    "javascript": r"""(?:\bfrom\s*|\bimport\s*|\brequire\s*\(\s*)["'](\.[^"']+)["']""", "typescript": r"""(?:\bfrom\s*|\bimport\s*|\brequire\s*\(\s*)["'](\.[^"']+)["']""", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;", "go": r'"([^"\n]+/[^"\n]+)"', "rust": r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;", "php": r"(?m)^\s*use\s+([\w\\]+)", "kotlin": r"(?m)^\s*import\s+([\w.]+)", "c": r'(?m)^\s*#\s*include\s+"([^"]+)"', "cpp": r'(?m)^\s*#\s*include\s+"([^"]+)"',
}
ROUTES = {
    "javascript": r"""\.(?P<verb>get|post|put|delete|patch|head|options|all)\(\s*["'`](?P<path>/[^"'`]*)["'`]\s*,""", "typescript": r"""\.(?P<verb>get|post|put|delete|patch|head|options|all)\(\s*["'`](?P<path>/[^"'`]*)["'`]\s*,""",
    "java": r"""@(?P<verb>Get|Post|Put|Delete|Patch)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*"(?P<path>[^"]*)\"""", "go": r'\.(?P<verb>GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\(\s*"(?P<path>/[^"]*)"', "rust": r'#\[(?P<verb>get|post|put|delete|patch)\(\s*"(?P<path>[^"]*)"', "php": r"""Route::(?P<verb>get|post|put|delete|patch)\(\s*['"](?P<path>[^'"]*)['"]""",
}
_BLANK = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def blanked(text: str) -> str:
    """The text with comments and the insides of strings as spaces; offsets and lines stay."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _parameters(path: str) -> str:
    path = re.sub(r"<(?:[^:<>]+:)?([^<>]+)>", r":\1", path)
    return re.sub(r"(?<!\$)\{([A-Za-z_]\w*)(?::[^{}]*)?\}", r":\1", path)


class Rows:
    """Nodes and edges of one file, in order of emission."""

    def __init__(self, path: str, tier: str = "baseline"):
        self.path, self.tier, self.nodes, self.edges = path, tier, [], []
        self.node("File", posixpath.basename(path), "", None, None)

    def id(self, qn: str) -> str:
        return f"{self.path}#{qn}" if qn else self.path

    def node(self, kind: str, name: str, qn: str, start: int | None, end: int | None, owner: str | None = None) -> str:
        if any(n[2] == qn for n in self.nodes):
            return self.id(qn)
        self.nodes.append((kind, name, qn, start, end))
        if qn:
            self.edge(self.id(owner or ""), self.id(qn), "Defines")
        return self.id(qn)

    def edge(self, source: str, target: str, kind: str, provenance: str | None = None, line: int | None = None) -> None:
        self.edges.append((source, target, kind, provenance, line))


def extract_python(path: str, text: str) -> Rows:
    out, tree = Rows(path), ast.parse(text)
    local: dict[str, list[str]] = {}

    def declare(body, owner: str) -> None:
        for x in body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                qn = f"{owner}.{x.name}" if owner else x.name
                out.node("Class" if isinstance(x, ast.ClassDef) else "Function", x.name, qn, x.lineno, x.end_lineno, owner)
                for base in x.bases if isinstance(x, ast.ClassDef) else ():
                    if (name := base.id if isinstance(base, ast.Name) else getattr(base, "attr", None)) and name != "object":
                        out.edge(out.id(qn), f"type:{name}", "Inherits", "heuristic", x.lineno)
                local.setdefault(x.name, []).append(out.id(qn))
                declare(x.body, qn)

    declare(tree.body, "")

    decorators = {id(d) for x in ast.walk(tree) for d in getattr(x, "decorator_list", [])}

    def visit(x, owner: str) -> None:
        for child in ast.iter_child_nodes(x):
            if id(child) in decorators:
                continue
            inner = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = f"{owner}.{child.name}" if owner else child.name
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        verbs = [d.func.attr.upper()] if d.func.attr in VERBS else []
                        if d.func.attr == "route":
                            listed = [k.value for k in d.keywords if k.arg == "methods"]
                            verbs = [e.value.upper() for e in listed[0].elts if isinstance(e, ast.Constant)] if listed and isinstance(listed[0], ast.List | ast.Tuple) else ["GET"]
                        for v in verbs:
                            name = f"{v} {_parameters(d.args[0].value)}"
                            out.edge(out.node("Route", name, name, d.lineno, d.end_lineno), out.id(inner), "References", "resolved")
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else None
                called = child.func.attr if isinstance(child.func, ast.Attribute) else None
                if called == "getenv" and child.args and isinstance(child.args[0], ast.Constant):
                    out.edge(out.id(owner), f"env:{child.args[0].value}", "References", "env-ref", child.lineno)
                if name in ("path", "re_path") and child.args and isinstance(child.args[0], ast.Constant):
                    route = f"ANY /{_parameters(str(child.args[0].value)).lstrip('/')}"
                    out.node("Route", route, route, child.lineno, child.end_lineno)
                elif name and name not in BUILTINS:
                    targets = local.get(name, [])
                    if len(targets) == 1:
                        out.edge(out.id(owner), targets[0], "Calls", "heuristic", child.lineno)
                    elif not targets:
                        out.edge(out.id(owner), f"call:{name}", "References", "call-ref", child.lineno)
                elif isinstance(child.func, ast.Attribute) and child.func.attr in VERBS and child.args and isinstance(child.args[0], ast.Constant) and str(child.args[0].value).startswith("/") and owner:
                    out.edge(out.id(owner), f"route:{child.func.attr.upper()} {child.args[0].value}", "References", "call-ref", child.lineno)
            elif isinstance(child, ast.Subscript) and isinstance(child.value, ast.Attribute) and child.value.attr == "environ" and isinstance(child.slice, ast.Constant):
                out.edge(out.id(owner), f"env:{child.slice.value}", "References", "env-ref", child.lineno)
            elif isinstance(child, ast.ImportFrom) and child.level:
                base = posixpath.dirname(path)
                for _ in range(child.level - 1):
                    base = posixpath.dirname(base)
                stem = posixpath.join(base, *(child.module or "").split(".")) if child.module else base
                for target in [stem] if child.module else [posixpath.join(stem, a.name) for a in child.names]:
                    out.edge(path, f"module:{target}", "Imports", None, child.lineno)
            visit(child, inner)

    visit(tree, "")
    return out


def extract_braces(path: str, text: str, lang: str, offset: int = 0, out: Rows | None = None) -> Rows:
    out = out or Rows(path)
    clean = blanked(text)
    line = lambda at: offset + sum(1 for _ in re.finditer("\n", text[:at])) + 1
    found = []
    for kind, pattern in DECLARATIONS[lang]:
        for m in re.finditer(pattern, clean):
            at, depth, end = m.start("name"), 0, None
            stop = re.compile(r"[{};]").search(clean, m.end() - 1)
            if stop and stop.group() == "{":
                for b in re.finditer(r"[{}]", clean[stop.start() :]):
                    depth += 1 if b.group() == "{" else -1
                    if depth == 0:
                        end = stop.start() + b.start()
                        break
            head = stop.start() if stop else len(clean)
            found.append((at, end if end is not None else clean.find("\n", at) % (len(clean) + 1), kind, m.group("name"), head))
    found.sort(key=lambda x: (x[0], -x[1]))
    open_: list[tuple[int, str, str]] = []
    taken: set[int] = set()
    symbols: list[Symbol] = []
    for at, end, kind, name, head in found:
        if at in taken:
            continue
        taken.add(at)
        while open_ and open_[-1][0] < at:
            open_.pop()
        owner, owner_kind = (open_[-1][1], open_[-1][2]) if open_ else ("", "")
        if kind == "Method" and lang in ("javascript", "typescript", "java", "csharp") and owner_kind not in ("Class", "Interface", "Enum"):
            continue
        if lang == "php" and kind == "Function" and owner_kind in ("Class", "Interface", "Enum"):
            kind = "Method"
        if kind == "Property" and owner_kind not in ("Class", "Interface") or kind == "Variable" and owner:
            continue
        if kind == "Function" and name[:1].isupper() and path.endswith(("x", ".js")) and (re.search(r"return\s*\(?\s*<|=>\s*\(?\s*<", clean[at:end]) or "defineComponent(" in clean[at:head]):
            kind = "Component"
        qn = f"{owner}.{name}" if owner and lang not in ("go",) else name
        out.node(kind, name, qn, line(at), line(end), owner)
        symbols.append(Symbol(at, end, kind, qn, name, head))
        open_.append((end, qn, kind))
    referrer = Referrer(out, text, clean, lang, symbols, line)
    referrer.all()
    for m in re.finditer(IMPORTS.get(lang, r"(?!)"), text):
        if clean[m.start()].strip() or lang in ("go", "c", "cpp"):
            only_types = lang == "typescript" and re.search(r"\b(?:import|export)\s+type\b[^;'\"]*$", text[max(0, m.start() - 300) : m.start()].rpartition(";")[2].rpartition("\n")[2])
            out.edge(path, f"module:{_import_target(path, m.group(1), lang)}", "ImportsType" if only_types else "Imports", None, line(m.start()))
    for m in re.finditer(ROUTES.get(lang, r"(?!)"), text):
        if clean[m.start()].strip():
            name = f"{'ANY' if m['verb'].lower() == 'all' else m['verb'].upper()} /{_parameters(m['path']).lstrip('/')}"
            referrer.handlers(out.node("Route", name, name, line(m.start()), line(m.end())), m.start(), m.end())
    for name, handler in file_routes(path, text) if lang in ("javascript", "typescript") else ():
        route = out.node("Route", name, name, 1, 1)
        if handler and handler in referrer.named:
            out.edge(route, out.id(referrer.named[handler][0].qn), "References", "resolved", 1)
    return out


def _import_target(path: str, spec: str, lang: str) -> str:
    """What an import names, as a path without extension: relative to the file, or as far as the language's names tell."""
    folder = posixpath.dirname(path)
    if lang in ("javascript", "typescript", "c", "cpp"):
        return posixpath.normpath(posixpath.join(folder, spec))
    if lang == "rust":
        stem = posixpath.splitext(posixpath.basename(path))[0]
        return posixpath.join(folder, spec) if stem in ("lib", "main", "mod") else posixpath.join(folder, stem, spec)
    return "*/" + re.sub(r"[.\\]", "/", spec)


def extract_component(path: str, text: str) -> Rows:
    out = Rows(path)
    name = posixpath.splitext(posixpath.basename(path))[0]
    out.node("Component", name, name, 1, text.count("\n") + 1)
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", text, re.S):
        extract_braces(path, m.group(1), "typescript", text[: m.start(1)].count("\n"), out)
    return out


def extract_prisma(path: str, text: str) -> Rows:
    out = Rows(path, "deep")
    blocks = [(m.group(1), m.group(2), m.start(), m.end()) for m in re.finditer(r"(?m)^\s*(model|type|enum)\s+(\w+)\s*\{[^}]*\}", text)]
    models = {name for kind, name, _, _ in blocks if kind != "enum"}
    for kind, name, start, end in blocks:
        first = text[:start].count("\n") + 1 + text[start:end].split(name)[0].count("\n")
        out.node("Enum" if kind == "enum" else "Class", name, name, first, text[:end].count("\n") + 1)
        for i, row in enumerate(text[start:end].strip("\n").splitlines()[1:] if kind != "enum" else []):
            if m := re.match(r"\s*(\w+)\s+(\w+)", row):
                out.node("Property", m.group(1), f"{name}.{m.group(1)}", first + i + 1, first + i + 1, name)
                if m.group(2) in models and m.group(2) != name:
                    out.edge(out.id(name), out.id(m.group(2)), "UsesType", None, first + i + 1)
    return out


def extract_env(path: str, text: str) -> Rows:
    out = Rows(path)
    for i, row in enumerate(text.splitlines(), 1):
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", row):  # values are never read
            out.node("Variable", m.group(1), m.group(1), i, i)
    return out


BY_EXTENSION = {".py": "python", ".prisma": "prisma", ".vue": "component", ".svelte": "component", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp", ".go": "go", ".rs": "rust", ".php": "php", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".c": "c", ".h": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp"}


def extract(path: str, text: str) -> Rows | None:
    base = posixpath.basename(path)
    kind = "env" if base.startswith(".env") else BY_EXTENSION.get(posixpath.splitext(path)[1].lower())
    if kind is None:
        return None
    special = {"python": extract_python, "prisma": extract_prisma, "component": extract_component, "env": extract_env}
    return special[kind](path, text) if kind in special else extract_braces(path, text, kind)


SCHEMA = "file string, ord int, is_node boolean, kind string, name string, qualified_name string, start_line int, end_line int, tier string, from_id string, to_id string, provenance string, line int, error string"


def extract_files(files: DataFrame, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, errors) of files (path, content): binary or text contents; larger files are reported and skipped."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("is_node", pa.bool_()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("tier", pa.string()), ("from_id", pa.string()), ("to_id", pa.string()), ("provenance", pa.string()), ("line", pa.int32()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(content) > max_bytes:
                    rows.append({"file": path, "error": f"{len(content)} bytes"})
                    continue
                try:
                    got = extract(path, content.decode("utf-8", "replace"))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"file": path, "error": f"{type(e).__name__}: {e}"})
                    continue
                if got is not None:
                    rows += [{"file": path, "ord": i, "is_node": True, "kind": n[0], "name": n[1], "qualified_name": n[2], "start_line": n[3], "end_line": n[4], "tier": got.tier} for i, n in enumerate(got.nodes)]
                    rows += [{"file": path, "ord": i, "is_node": False, "kind": e[2], "from_id": e[0], "to_id": e[1], "provenance": e[3], "line": e[4]} for i, e in enumerate(got.edges)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)
    # a total order: by path, then emission; ids rise along a global sort, a partition of which is far below 2**33 files
    rank = materialize(files.select(F.col("path").alias("file")).orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    rows = materialize(rows.join(rank, "file"))
    seq = F.col("rank") * 65536 + F.col("ord")
    nodes = rows.filter("is_node").select(seq.alias("seq"), F.when(F.col("qualified_name") == "", F.col("file")).otherwise(F.concat_ws("#", "file", "qualified_name")).alias("id"), "kind", "name", "file", "qualified_name", "start_line", "end_line", "tier", F.lit(False).alias("external"))
    edges = rows.filter("not is_node").select(seq.alias("seq"), "from_id", "to_id", "kind", "provenance", F.lit(None).cast("double").alias("confidence"), "line")
    return nodes, materialize(bind_modules(nodes, edges)), rows.filter("error is not null").select("file", "error")


def bind_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``module:`` targets joined to File nodes: the path itself, with an extension, or an index file of a folder; a package path (``*/``)
    to the file of that path below the nearest folder above the importing one."""
    files = nodes.filter(F.col("kind") == "File").select(F.col("id").alias("target"))
    stem = F.regexp_replace("target", r"\.[^./]+$", "")
    keys = files.select("target", F.explode(F.array_distinct(F.array("target", stem, F.regexp_replace(stem, r"/(index|__init__|mod)$", "")))).alias("key")).groupBy("key").agg(F.min("target").alias("target"))
    named = edges.filter(F.startswith("to_id", F.lit("module:"))).withColumn("key", F.regexp_replace(F.expr("substring(to_id, 8)"), r"\.(js|mjs|cjs|jsx)$", ""))
    package = F.startswith("key", F.lit("*/"))
    plain = named.filter(~package).join(keys, "key")
    below = named.filter(package).withColumn("name", F.expr("substring(key, 3)")).withColumn("file", F.col("from_id"))
    nearest = nearest_ancestor(below, keys.select(F.col("key").alias("path"))).withColumnRenamed("target", "key")
    found = below.drop("key").join(nearest, ["file", "name"]).join(keys, "key")
    columns = ["seq", "from_id", "to_id", "kind", "provenance", "confidence", "line"]
    bound = plain.drop("to_id").withColumnRenamed("target", "to_id").select(columns).unionByName(found.drop("to_id").withColumnRenamed("target", "to_id").select(columns))
    return edges.filter(~F.startswith("to_id", F.lit("module:"))).unionByName(bound.filter("from_id <> to_id"))


__all__ = ["BY_EXTENSION", "extension", "extract", "extract_files", "bind_modules"]
