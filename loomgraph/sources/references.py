"""What the symbols of a brace-language file refer to: calls, instantiations, supertypes, types, route handlers, requests, settings, models.

References to a name that the file defines once are edges; to one that it does not define, candidates (``call:``, ``type:``, ``route:``,
``env:``, ``prisma:``) that the derivations bind by imports; a name that it defines several times is left alone.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

# fixed values: words that look like calls or types and are none
KEYWORDS = set("if for while switch catch return function new typeof sizeof await yield throw case do else try finally with super this self synchronized assert using lock fixed foreach when match fn func fun def defer go select import require".split())
PLAIN_TYPES = set("String Integer Long Double Float Boolean Byte Short Character Object Void Number Array List Map Set Optional Collection Iterable Promise Record Partial Readonly Any Unit Int Bool Self Vec Option Result Box Task Exception Error Date Override".split())
HIGHER_ORDER = "map filter forEach reduce then catch finally some every find findIndex flatMap sort".split()
PRISMA_BASES = "prisma db tx".split()
PRISMA_CALLS = "findMany findFirst findUnique findFirstOrThrow findUniqueOrThrow create createMany update updateMany upsert delete deleteMany count aggregate groupBy".split()
PRISMA_WRAPS = {"AND", "OR", "NOT"}

_NAME = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?P<dot>[\w$\])]\s*\??\.\s*)?\b(?P<name>{_NAME})\s*(?:<[\w\s,.\[\]|]*>)?\(")
_NEW = re.compile(rf"\bnew\s+(?P<name>{_NAME}(?:\.{_NAME})*)")
_TYPE = re.compile(r"\b[A-Z]\w*\b")
#: language -> (how a header names what it extends, how what it implements); of languages with one list, all in the first
HEADERS = {
    "java": (r"\bextends\s+([^{]*?)(?=\bimplements\b|\bpermits\b|$)", r"\bimplements\s+([^{]*?)(?=\bpermits\b|$)"),
    "typescript": (r"\bextends\s+([^{]*?)(?=\bimplements\b|$)", r"\bimplements\s+([^{]*)$"),
    "javascript": (r"\bextends\s+([^{]*)$", r"(?!)"),
    "php": (r"\bextends\s+([^{]*?)(?=\bimplements\b|$)", r"\bimplements\s+([^{]*)$"),
    "csharp": (r":\s*([^{]*?)(?=\bwhere\b|$)", r"(?!)"),
    "kotlin": (r":\s*([^{]*)$", r"(?!)"),
    "swift": (r":\s*([^{]*)$", r"(?!)"),
    "cpp": (r":\s*([^{]*)$", r"(?!)"),
}
TYPED = ("java", "typescript", "csharp", "go", "kotlin", "php", "swift", "rust")
SETTINGS = re.compile(r"""process\.env\.([A-Za-z_]\w*)|process\.env\[\s*["']([A-Za-z_]\w*)["']|(?:System\.getenv|os\.Getenv|os\.getenv|getenv|env::var)\(\s*["']([A-Za-z_]\w*)["']|import\.meta\.env\.([A-Za-z_]\w*)""")
REQUEST = re.compile(r"""(?:\)|\b(?:fetch|axios|client|api|http|request|agent|page|inject))\s*\.\s*(get|post|put|delete|patch)\(\s*["'`](/[^"'`]*)["'`]\s*[,)]""")
PRISMA = re.compile(rf"\b(?:{'|'.join(PRISMA_BASES)})\.(\w+)\.(?:{'|'.join(PRISMA_CALLS)})\(")


@dataclass
class Symbol:
    at: int
    end: int
    kind: str
    qn: str
    name: str
    head: int  # where its body begins


def _split(text: str) -> list[str]:
    """Names of a comma-separated list of types, without arguments and qualifiers."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", text))
    names = [re.sub(r"\(.*", "", part).strip() for part in flat.split(",")]
    words = [n.split()[-1] for n in names if n.split()]
    return [re.split(r"[.\\:]+", w)[-1] for w in words if re.search(r"\w", w)]


class Referrer:
    """Adds the references of one file to its rows."""

    def __init__(self, out, text: str, clean: str, lang: str, symbols: list[Symbol], line):
        self.out, self.text, self.clean, self.lang, self.symbols, self.line = out, text, clean, lang, symbols, line
        self.named: dict[str, list[Symbol]] = {}
        for s in symbols:
            self.named.setdefault(s.name, []).append(s)
        self.declared = {s.at for s in symbols}

    def owner(self, at: int, kinds: tuple[str, ...] = ("Function", "Method", "Component")) -> str:
        """Id of the innermost symbol around a place; the file's outside of any."""
        inside = [s for s in self.symbols if s.at <= at <= s.end and s.kind in kinds]
        return self.out.id(max(inside, key=lambda s: s.at).qn) if inside else self.out.path

    def refer(self, source: str, name: str, kinds: tuple[str, ...], edge: str, prefix: str, at: int) -> None:
        local = [s for s in self.named.get(name, ()) if s.kind in kinds]
        if len(local) == 1:
            if source != (target := self.out.id(local[0].qn)):
                self.out.edge(source, target, edge, "heuristic", self.line(at))
        elif not local:
            kind, provenance = ("References", "call-ref") if prefix == "call" else (edge, "heuristic")
            self.out.edge(source, f"{prefix}:{name}", kind, provenance, self.line(at))

    def calls(self) -> None:
        made = set()
        for m in _NEW.finditer(self.clean):
            name = m["name"].split(".")[-1]
            made.add(m.start("name"))
            if name not in PLAIN_TYPES:
                self.refer(self.owner(m.start()), name, ("Class",), "Instantiates", "type", m.start())
        for m in _CALL.finditer(self.clean):
            at, name = m.start("name"), m["name"]
            if name in KEYWORDS or at in self.declared or at in made or self.clean[max(0, at - 1)] in "@#":
                continue
            around = [s for s in self.symbols if s.at <= at <= s.end]
            if around and max(around, key=lambda s: s.at).kind == "Interface":
                continue  # a signature
            if re.search(r"\b(?:new|func|fun|fn|function|def|class)\s+$", self.clean[max(0, at - 10) : at]):
                continue
            receiver = self.clean[max(0, at - 6) : at].rstrip(". ?\t") if m["dot"] else ""
            if m["dot"] and not re.search(r"\b(?:this|self|\$this)$", receiver):
                if name in HIGHER_ORDER:
                    self.callback(m.end())
                continue  # another object's method: its type is not known here
            self.refer(self.owner(at), name, ("Function", "Method"), "Calls", "call", at)

    def callback(self, at: int) -> None:
        """A function handed to a higher-order call by name."""
        if (m := re.match(rf"\s*({_NAME})\s*[,)]", self.clean[at : at + 80])) and len(self.named.get(m[1], ())) == 1:
            target = self.named[m[1]][0]
            if target.kind in ("Function", "Method"):
                self.out.edge(self.owner(at), self.out.id(target.qn), "Calls", "heuristic", self.line(at))

    def hierarchy(self) -> None:
        extends, implements = HEADERS.get(self.lang, (None, None))
        for s in self.symbols if extends else ():
            if s.kind not in ("Class", "Interface", "Enum"):
                continue
            header = re.sub(r"^\w+\s*(<[^{]*?>(?=\s*(?:extends|implements|:|\(|$)))?", "", self.clean[s.at : s.head])
            header = re.sub(r"^\s*\([^)]*\)", "", header)
            for pattern, edge in ((extends, "Inherits"), (implements, "Implements")):
                if m := re.search(pattern, header, re.S):
                    for name in _split(m[1]):
                        name = re.sub(r"^(?:public|private|protected|virtual)\s+", "", name)
                        known = [x for x in self.named.get(name, ()) if x.kind in ("Class", "Interface")]
                        interface = known[0].kind == "Interface" if known else self.lang == "csharp" and re.match(r"I[A-Z]", name)
                        kind = "Implements" if edge == "Implements" or (interface and s.kind == "Class") else "Inherits"
                        if name != s.name:
                            self.refer(self.out.id(s.qn), name, ("Class", "Interface"), kind, "type", s.at)
        if self.lang == "rust":
            for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", self.clean):
                if len(self.named.get(m[2], ())) == 1:
                    self.refer(self.out.id(self.named[m[2]][0].qn), m[1], ("Interface",), "Implements", "type", m.start())

    def types(self) -> None:
        """Types in the signatures of functions and methods, and of fields."""
        if self.lang not in TYPED:
            return
        for s in self.symbols:
            if s.kind not in ("Function", "Method", "Property"):
                continue
            begin = max(self.clean.rfind(c, 0, s.at) for c in "{};\n") + 1
            before, after = self.clean[begin : s.at], self.clean[s.at + len(s.name) : s.head]
            if s.kind == "Property":
                uses, returns = before + after, ""
            else:
                depth, close = 0, len(after)
                for i, c in enumerate(after):
                    depth += (c == "(") - (c == ")")
                    if c == ")" and depth == 0:
                        close = i
                        break
                uses, returns = after[:close], after[close:] if self.lang in ("typescript", "go", "kotlin", "php", "swift", "rust") else before
            for text, edge in ((uses, "UsesType"), (returns, "Returns")):
                for name in dict.fromkeys(_TYPE.findall(text)):
                    if name not in PLAIN_TYPES and name != s.name:
                        self.refer(self.out.id(s.qn), name, ("Class", "Interface", "Enum", "TypeAlias"), edge, "type", s.at)

    def handlers(self, route: str, at: int, end: int) -> None:
        """The function that serves a route: the last name among the arguments, or the method below an annotation."""
        if self.lang in ("java", "rust", "csharp"):
            below = [s for s in self.symbols if s.kind in ("Method", "Function") and s.at > at]
            if below:
                self.out.edge(route, self.out.id(min(below, key=lambda s: s.at).qn), "References", "resolved", self.line(at))
            return
        depth, stop = 1, end
        while stop < len(self.clean) and depth:
            depth += (self.clean[stop] in "([{") - (self.clean[stop] in ")]}")
            stop += 1
        inside = self.clean[end : stop - 1]
        if m := re.search(rf"(?:^|,)\s*(?:{_NAME}\.)*({_NAME})\s*,?\s*$", inside):
            local = [s for s in self.named.get(m[1], ()) if s.kind in ("Function", "Method")]
            if len(local) == 1:
                self.out.edge(route, self.out.id(local[0].qn), "References", "resolved", self.line(at))
        elif re.search(r"=>|\bfunction\b|\bfunc\s*\(", inside):
            name = f"{route.split('#', 1)[-1]} handler"
            self.out.edge(route, self.out.node("Function", name, name, self.line(end), self.line(stop - 1)), "References", "resolved", self.line(at))

    def outside(self) -> None:
        """Requests to routes, settings of the environment, and models of a database schema."""
        for m in REQUEST.finditer(self.text):
            if self.clean[m.start()].strip():
                self.out.edge(self.owner(m.start()), f"route:{m[1].upper()} {m[2]}", "References", "call-ref", self.line(m.start()))
        for m in SETTINGS.finditer(self.text):
            if self.clean[m.start()].strip():
                self.out.edge(self.owner(m.start()), f"env:{next(filter(None, m.groups()))}", "References", "env-ref", self.line(m.start()))
        for m in PRISMA.finditer(self.clean):
            self.out.edge(self.owner(m.start()), f"prisma:model:{m[1]}", "References", "prisma-ref", self.line(m.start()))
            if body := re.match(r"\s*\{\s*(?:where|data|select|orderBy)\s*:\s*\{([^{}]*)", self.clean[m.end() :]):
                for key in re.findall(r"(\w+)\s*:", body[1]):
                    if key not in PRISMA_WRAPS:
                        self.out.edge(self.owner(m.start()), f"prisma:field:{m[1]}.{key}", "References", "prisma-ref", self.line(m.start()))

    def all(self) -> None:
        self.calls()
        self.hierarchy()
        self.types()
        self.outside()


def _segments(path: str) -> str:
    """A route from folders: [id] and [...rest] are parameters, (groups) and index are no segments."""
    parts = []
    for p in path.split("/"):
        if not p or re.fullmatch(r"\(.*\)", p) or p == "index":
            continue
        p = re.sub(r"^\[\[?\.\.\..*\]\]?$", "*", p)
        parts.append(re.sub(r"^\[\[?(.+?)\]\]?$", r":\1", p))
    return "/" + "/".join(parts)


VERBS = "GET POST PUT DELETE PATCH HEAD OPTIONS".split()


def file_routes(path: str, text: str) -> list[tuple[str, str | None]]:
    """(route, name of the handler) that a file's place gives: Next's app and pages folders, SvelteKit, Astro and Nuxt."""
    exported = re.findall(r"\bexport\s+(?:async\s+)?(?:function|const)\s+(\w+)", text)
    verbs = [v for v in VERBS if v in exported]
    stem, _ = posixpath.splitext(path)
    if m := re.search(r"(?:^|/)app/(.*?)/?route$", stem):
        return [(f"{v} {_segments(m[1])}", v) for v in verbs]
    if m := re.search(r"(?:^|/)src/routes/(.*?)/?\+server$", stem):
        return [(f"{v} {_segments(m[1])}", v) for v in verbs]
    if m := re.search(r"(?:^|/)server/(api|routes)/(.+?)(?:\.(get|post|put|delete|patch))?$", stem):
        name = f"api/{m[2]}" if m[1] == "api" else m[2]
        return [(f"{(m[3] or 'any').upper()} {_segments(name)}", None)] if "defineEventHandler" in text or "eventHandler" in text else []
    if m := re.search(r"(?:^|/)pages/(.+)$", stem):
        if verbs:  # an endpoint that exports verbs
            return [(f"{v} {_segments(re.sub(r'[.]json$', '', m[1]))}", v) for v in verbs]
        default = re.search(r"\bexport\s+default\s+(?:async\s+)?(?:function\s+)?(\w+)", text)
        return [(f"ANY {_segments(m[1])}", default[1])] if m[1].startswith("api/") and default else []
    return []
