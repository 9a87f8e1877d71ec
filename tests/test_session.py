"""Index a small tree of several languages, ask about it, change it, and index it again."""

import struct
import sys
import zipfile

import pytest

from loomgraph.functions import text as paths
from loomgraph.session import Session, rendered
from loomgraph.sources import bytecode, sidecar, walk
from loomgraph.sources.extract import extract

TREE = {
    "src/shape.ts": "export interface Shape {\n  area(): number;\n}\nexport class Base {\n  run(): void {\n  }\n}\n",
    "src/circle.ts": "import { Base, Shape } from './shape';\nimport { help } from './util';\n// A round thing\nexport class Circle extends Base implements Shape {\n  area(): number {\n    return help(1);\n  }\n  run(): void {\n    new Base();\n  }\n}\n",
    "src/util.ts": "export function help(x: number) {\n  return process.env.KEY;\n}\napp.get('/u/:id', help);\n",
    "tests/util.test.ts": "import { help } from '../src/util';\nimport './missing';\nfunction check() {\n  help(2);\n  request(app).get('/u/7');\n}\n",
    "p/A.java": "package p;\nclass A extends B {\n  void go() { help(); }\n}\n",
    "p/B.java": "package p;\nclass B {\n  void go() { }\n  static void help() { }\n}\n",
    ".env": "KEY=1\n",
    "node_modules/x.js": "function no() {}\n",
    "skip/y.ts": "function no() {}\n",
    ".gitignore": "skip/\n",
    "pkg/__init__.py": "def made():\n    pass\n",
    "bad.py": "def (\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_index_ask_change(spark, tree):
    s = Session(spark)
    status = s.index_repository(str(tree))
    assert status["files"] == 9 and status["errors"] == 1 and status["languages"]["typescript"][0] == 4
    assert ids(s.files("src/"), "path") == ["src/circle.ts", "src/shape.ts", "src/util.ts"]
    assert ids(s.find_callers("help")) == ["p/A.java#A.go", "src/circle.ts#Circle.area", "tests/util.test.ts#check"]
    assert ids(s.find_implementations("Shape")) == ["src/circle.ts#Circle"]
    assert ids(s.find_overrides("src/circle.ts#Circle.run")) == ["src/shape.ts#Base.run"]
    assert ids(s.find_overridden_by("p/B.java#B.go")) == ["p/A.java#A.go"]
    assert ids(s.find_handlers("GET /u/:id")) == ["src/util.ts#help"]
    assert ids(s.find_routes("src/util.ts#GET /u/:id")) == ["tests/util.test.ts#check"]
    assert ids(s.find_referrers("KEY")) == ["src/util.ts#help"]
    assert ids(s.affected(["src/shape.ts"]), "path") == ["src/circle.ts"]
    assert ids(s.affected(["src/util.ts"], tests_only=True), "path") == ["tests/util.test.ts"]
    assert s.get_code_snippet("Circle")["snippet"].startswith("// A round thing\nexport class Circle")
    assert [r["id"] for r in s.search_code("a round")["results"]] == ["src/circle.ts#Circle"]
    assert s.search_code("  ")["results"] == []
    found = s.search_symbol("help", limit=1)
    assert found["truncated"] and not found["low_confidence"]
    assert s.node("Circle")["interfaces"] == ["src/shape.ts#Shape"] and not s.node("Circle")["authoritative"]
    assert '"section":"match"' in rendered(s.explore("what is a circle")).replace(" ", "")
    (tree / "src/util.ts").write_text("export function other() {\n}\n")
    (tree / "p/B.java").unlink()
    assert s.sync_index(str(tree)) == {"changed": ["src/util.ts"], "removed": ["p/B.java"]}
    assert ids(s.find_callers("help")) == [] and ids(s.search_symbol("other")["results"] and s.graph().named("other")) == ["src/util.ts#other"]
    assert s.sync_index(str(tree)) == {"changed": [], "removed": []}
    again = Session(spark)
    assert again.open(str(tree)) is not None and again.index_status(str(tree))["files"] == 8
    fresh = {(r["from_id"], r["to_id"], r["kind"]) for r in again.graph().edges.collect()}
    again.index_repository(str(tree))
    assert fresh == {(r["from_id"], r["to_id"], r["kind"]) for r in again.graph().edges.collect()}  # updates give what a full index does
    again.remove_index(str(tree))
    assert Session(spark).open(str(tree)) is None


def test_roots_and_globs():
    with pytest.raises(ValueError):
        walk.assert_safe_root("/usr")
    assert walk.assert_safe_root("/usr/x") == "/usr/x"
    assert paths.glob_regex("a/**/*.ts") == "^a/(?:.*/)?[^/]*\\.ts$"


@pytest.mark.parametrize(
    ("path", "text", "edge"),
    [
        ("a.cs", "class A : Base, IShape {\n}\n", ("a.cs#A", "type:IShape", "Implements")),
        ("a.kt", "class A : Base() {\n}\n", ("a.kt#A", "type:Base", "Inherits")),
        ("a.rs", "struct S {\n}\nimpl Shape for S {\n}\n", ("a.rs#S", "type:Shape", "Implements")),
        ("a.php", "<?php\nclass A extends B implements C {\n}\n", ("a.php#A", "type:C", "Implements")),
        ("a.java", "class A {\n  Reply go(Query q) {\n  }\n}\n", ("a.java#A.go", "type:Reply", "Returns")),
        ("a.java", "class A {\n  Reply go(Query q) {\n  }\n}\n", ("a.java#A.go", "type:Query", "UsesType")),
        ("a.go", "func a() {\n  b()\n}\nfunc b() {\n}\n", ("a.go#a", "a.go#b", "Calls")),
        ("src/routes/u/[id]/+server.ts", "export const GET = () => 1;\n", ("src/routes/u/[id]/+server.ts#GET /u/:id", "src/routes/u/[id]/+server.ts#GET", "References")),
        ("a.ts", "import type { T } from './t';\n", ("a.ts", "module:t", "ImportsType")),
        ("a.ts", "function f() {\n  prisma.user.findMany({ where: { id: 1 } });\n}\n", ("a.ts#f", "prisma:field:user.id", "References")),
    ],
)
def test_references(path, text, edge):
    assert edge in {e[:3] for e in extract(path, text).edges}


def class_bytes():
    """A class p.A extends q.B implements q.I with one method that calls q.B.go."""
    pool = [b"p/A", b"q/B", b"q/I", b"run", b"(I[Ljava/lang/String;)V", b"go", b"()V", b"Code"]
    out = b"".join(b"\x01" + struct.pack(">H", len(x)) + x for x in pool)  # 1 to 8
    out += b"".join(b"\x07" + struct.pack(">H", i) for i in (1, 2, 3))  # 9 to 11
    out += b"\x0c" + struct.pack(">HH", 6, 7) + b"\x0a" + struct.pack(">HH", 10, 12)  # 12: go()V, 13: q.B.go
    code = b"\xb6\x00\x0d\xb1"
    body = struct.pack(">HHI", 1, 1, len(code)) + code + struct.pack(">HH", 0, 0)
    method = struct.pack(">HHHH", 1, 4, 5, 1) + struct.pack(">HI", 8, len(body)) + body
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, 14) + out + struct.pack(">HHHHH", 1, 9, 10, 1, 11) + struct.pack(">HH", 0, 1) + method + struct.pack(">H", 0)


def test_class_files(spark, tmp_path):
    found = bytecode.parse_class(class_bytes())
    assert (found.name, found.parent, found.interfaces, found.methods[0].calls) == ("p.A", "q.B", ["q.I"], [("q.B", "go", "()V")])
    assert bytecode.descriptor_types("(I[Ljava/lang/String;)V") == (["int", "java.lang.String[]"], "void")
    assert {e[:3] for e in bytecode.extract_class("p/A.class", class_bytes()).edges} >= {("p/A.class#A", "type:B", "Inherits"), ("p/A.class#A", "type:I", "Implements")}
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("p/A.class", class_bytes())
        z.writestr("p/Bad.class", b"\xca\xfe")
    (tmp_path / "A.class").write_bytes(class_bytes())
    (tmp_path / "no.jar").write_bytes(b"nothing")
    classes, errors = bytecode.classpath(spark, [str(tmp_path / n) for n in ("a.jar", "A.class", "no.jar")])
    rows = classes.collect()
    assert [(r["class"], r["archive"].endswith("a.jar"), r["methods"][0]["parameters"]) for r in rows] == [("p.A", True, ["int", "java.lang.String[]"])]
    assert errors.count() == 2
    assert bytecode.receiver_hierarchy(classes, "p.A") == ["p.A", "q.B", "q.I"]


SIDECAR = """
import json, sys
print(json.dumps({"type": "ready", "language": "x"}), flush=True)
for line in sys.stdin:
    r = json.loads(line)
    bad = any("bad" in f for f in r["files"])
    nodes = [{"id": f, "kind": "Nothing" if bad else "File", "name": f, "file": f, "qualifiedName": "", "tier": "deep", "range": {"startLine": 1, "endLine": 2}} for f in r["files"]]
    print(json.dumps({"type": "result", "id": r["id"], "nodes": nodes, "edges": [{"from": r["files"][0], "to": "b", "kind": "Imports"}]}), flush=True)
"""


def test_sidecar(spark, tmp_path):
    (tmp_path / "s.py").write_text(SIDECAR)
    one = sidecar.Sidecar("x", (".x",), (sys.executable, str(tmp_path / "s.py")))
    assert one.available() and not sidecar.Sidecar("y", (".y",), ("/no/such/program",)).available()
    files = spark.createDataFrame([("a.x",), ("bad.x",), ("c.other",)], "path string").coalesce(1)
    rows = sidecar.analyze(files, "/w", one, batch=1).collect()
    assert [(r["id"], r["kind"], r["end_line"]) for r in rows if r["is_node"]] == [("a.x", "File", 2)]
    assert [(r["from_id"], r["kind"]) for r in rows if r["is_node"] is False] == [("a.x", "Imports")]
    assert [r["file"] for r in rows if r["error"]] == ["bad.x"]
