"""Java class files, alone or in archives: types, methods, supertypes and calls, without running anything.

The class file format is the published one of the Java Virtual Machine specification. A file that does not decode loses only itself.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: limits of an archive, and the sizes of constant-pool entries by tag
MAX_CLASSES, MAX_ARCHIVE, MAX_ENTRY = 20_000, 128 << 20, 16 << 20
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
INTERFACE, SYNTHETIC = 0x0200, 0x1000
#: operand bytes of each opcode; -1: tableswitch, -2: lookupswitch, -3: wide
OPERANDS = [0] * 16 + [1, 2, 1, 2, 2] + [1] * 5 + [0] * 28 + [1] * 5 + [0] * 73 + [2] + [0] * 20 + [2] * 16 + [1, -1, -2] + [0] * 6 + [2] * 4 + [2, 2, 2, 4, 4, 2, 1, 2, 0, 0, 2, 2, 0, 0, -3, 3, 2, 2, 4, 4]


@dataclass
class Method:
    name: str
    descriptor: str
    calls: list[tuple[str, str, str]] = field(default_factory=list)  # owner, name, descriptor


@dataclass
class ClassFile:
    name: str  # binary name, with dots
    parent: str | None
    interfaces: list[str]
    is_interface: bool
    methods: list[Method]


def descriptor_types(descriptor: str) -> tuple[list[str], str]:
    """(parameter types, return type) of a method descriptor: ``(I[Ljava/lang/String;)V`` is int, java.lang.String[] and void."""
    types, i, dims = [], 0, 0
    while i < len(descriptor):
        c = descriptor[i]
        if c == "[":
            dims += 1
        elif c in PRIMITIVES or c == "L":
            end = descriptor.index(";", i) if c == "L" else i
            types.append((descriptor[i + 1 : end].replace("/", ".") if c == "L" else PRIMITIVES[c]) + "[]" * dims)
            i, dims = end, 0
        i += 1
    if not descriptor.startswith("(") or ")" not in descriptor or not types:
        raise ValueError(f"no method descriptor: {descriptor}")
    return types[:-1], types[-1]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        value = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return value[0] if len(value) == 1 else value

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise ValueError("class file ends early")
        self.at += n


def _code_calls(code: bytes, reference) -> Iterator[tuple[str, str, str]]:
    """Targets of the invoke instructions of a method's code."""
    at = 0
    while at < len(code):
        op = code[at]
        if 0xB6 <= op <= 0xB9:  # invokevirtual, invokespecial, invokestatic, invokeinterface
            if (found := reference(int.from_bytes(code[at + 1 : at + 3], "big"))) is not None:
                yield found
        size = OPERANDS[op] if op < len(OPERANDS) else 0
        if size >= 0:
            at += 1 + size
        elif size == -3:
            at += 6 if code[at + 1] == 0x84 else 4
        else:
            base = (at + 4) & ~3
            if size == -1:
                low, high = struct.unpack_from(">ii", code, base + 4)
                at = base + 12 + 4 * (high - low + 1)
            else:
                at = base + 8 + 8 * struct.unpack_from(">i", code, base + 4)[0]


def parse_class(data: bytes) -> ClassFile:
    r = _Reader(data)
    if r.take("I") != 0xCAFEBABE:
        raise ValueError("no class file")
    r.skip(4)
    pool: list = [None] * r.take("H")
    i = 1
    while i < len(pool):
        tag = r.take("B")
        if tag == 1:
            size = r.take("H")
            pool[i] = data[r.at : r.at + size].decode("utf-8", "replace")
            r.skip(size)
        elif tag in (7, 8, 12, 9, 10, 11, 16, 19, 20):
            pool[i] = (tag, r.take("H" if SIZES[tag] == 2 else "HH"))
        else:
            r.skip(SIZES[tag])
            i += tag in (5, 6)  # these take two places
        i += 1

    def class_name(index: int) -> str | None:
        return pool[pool[index][1]].replace("/", ".") if index else None

    def reference(index: int) -> tuple[str, str, str] | None:
        if index >= len(pool) or not isinstance(pool[index], tuple) or pool[index][0] not in (10, 11):
            return None
        owner, pair = pool[index][1]
        name, descriptor = pool[pair][1]
        return class_name(owner), pool[name], pool[descriptor]

    flags, this, parent, n = r.take("HHHH")
    interfaces = [class_name(r.take("H")) for _ in range(n)]

    def attributes() -> Iterator[tuple[str, bytes]]:
        for _ in range(r.take("H")):
            name, size = pool[r.take("H")], r.take("I")
            start = r.at
            r.skip(size)
            yield name, data[start : start + size]

    for _ in range(r.take("H")):  # fields
        r.skip(6)
        for _ in attributes():
            pass
    methods = []
    for _ in range(r.take("H")):
        access, name, descriptor = r.take("HHH")
        method = Method(pool[name], pool[descriptor])
        for kind, body in attributes():
            if kind == "Code":
                size = struct.unpack_from(">I", body, 4)[0]
                method.calls = list(dict.fromkeys(_code_calls(body[8 : 8 + size], reference)))
        if not access & SYNTHETIC:
            methods.append(method)
    return ClassFile(class_name(this), class_name(parent), interfaces, bool(flags & INTERFACE), methods)


def _simple(name: str) -> str:
    return name.rpartition(".")[2].rpartition("$")[2]


def extract_class(path: str, data: bytes):
    """A class file's rows: its type and methods, and supertypes as candidates; what lies in java.lang is no news."""
    from .extract import Rows

    found, out = parse_class(data), Rows(path)
    name = _simple(found.name)
    out.node("Interface" if found.is_interface else "Class", name, name, None, None)
    if found.parent and found.parent != "java.lang.Object":
        out.edge(out.id(name), f"type:{_simple(found.parent)}", "Inherits", "heuristic")
    for i in found.interfaces:
        if not i.startswith("java.lang."):
            out.edge(out.id(name), f"type:{_simple(i)}", "Inherits" if found.is_interface else "Implements", "heuristic")
    return out


def _unpacked(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(entry, bytes) of a class file, or of those in an archive (a jmod has four bytes before its zip)."""
    if path.endswith(".class"):
        yield path, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [x for x in archive.infolist() if x.filename.endswith(".class") and x.file_size <= MAX_ENTRY]
        for x in names[:MAX_CLASSES]:
            yield x.filename, archive.read(x)


CLASSES = "archive string, ord int, class string, parent string, interfaces array<string>, is_interface boolean, methods array<struct<name:string,descriptor:string,parameters:array<string>,returns:string>>, calls array<struct<method:string,owner:string,name:string,descriptor:string>>, error string"


def classpath(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes, errors) of class files and archives; a class that several hold is that of the first, by the order of ``paths``."""
    schema = spark.createDataFrame([], CLASSES).toArrow().schema

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    for i, (entry, data) in enumerate(_unpacked(path, content.as_py())):
                        try:
                            c = parse_class(data)
                            methods = [dict(zip(("name", "descriptor", "parameters", "returns"), (m.name, m.descriptor, *descriptor_types(m.descriptor)), strict=True)) for m in c.methods]
                            calls = [{"method": m.name + m.descriptor, "owner": o, "name": n, "descriptor": d} for m in c.methods for o, n, d in m.calls]
                            rows.append({"archive": path, "ord": i, "class": c.name, "parent": c.parent, "interfaces": c.interfaces, "is_interface": c.is_interface, "methods": methods, "calls": calls})
                        except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
                            rows.append({"archive": path, "ord": i, "error": f"{entry}: {type(e).__name__}: {e}"})
                except (zipfile.BadZipFile, OSError) as e:
                    rows.append({"archive": path, "ord": 0, "error": f"{type(e).__name__}: {e}"})
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    files = spark.read.format("binaryFile").load(paths).filter(F.col("length") <= MAX_ARCHIVE)
    rows = files.select("path", "content").mapInArrow(run, CLASSES)
    place = F.array_position(F.array(*(F.lit(p) for p in paths)), F.regexp_replace("archive", "^file:/*", "/"))
    first = Window.partitionBy("class").orderBy(F.when(place > 0, place).otherwise(len(paths) + 1), "archive", "ord")
    classes = rows.filter("error is null").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn", "error")
    return classes, rows.filter("error is not null").select("archive", "error")


def receiver_hierarchy(classes: DataFrame, name: str) -> list[str]:
    """A class and its supertypes, nearest first: superclass before interfaces, each once; one look-up a level."""
    order, level = [name], [name]
    while level:
        found = {r["class"]: [x for x in (r["parent"], *(r["interfaces"] or ())) if x] for r in classes.filter(F.col("class").isin(level)).select("class", "parent", "interfaces").collect()}
        level = [x for x in dict.fromkeys(x for c in level for x in found.get(c, ())) if x not in order]
        order += level
    return order
