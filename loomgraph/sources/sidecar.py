"""Analyzers in processes of their own: a batch of files goes in as one line of JSON, nodes and edges come back, line by line.

The process announces itself with a ``ready`` message, is sent one ``analyze`` request a batch of files, and answers with a ``result`` or an
``error``. What it says is checked against the graph's vocabulary, so that a faulty analyzer cannot put a malformed row into the graph; a
batch that fails loses only itself.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGE_KINDS, NODE_KINDS, PROVENANCES, STRATEGIES, TIERS

SCHEMA = "is_node boolean, id string, kind string, name string, file string, qualified_name string, start_line int, end_line int, tier string, from_id string, to_id string, provenance string, confidence double, strategy string, line int, error string"


@dataclass(frozen=True)
class Sidecar:
    language: str
    extensions: tuple[str, ...]
    command: tuple[str, ...]
    timeout: float = 60.0

    def available(self) -> bool:
        """Whether the process starts and announces itself; an analyzer that does not is left out of the registry."""
        try:
            out = subprocess.run(self.command, input="", capture_output=True, text=True, timeout=self.timeout, check=False).stdout
        except (OSError, subprocess.TimeoutExpired):
            return False
        return any(m.get("type") == "ready" for m in map(_lenient, out.splitlines()))


def _lenient(line: str) -> dict:
    try:
        found = json.loads(line)
        return found if isinstance(found, dict) else {}
    except ValueError:
        return {}


def request(number: int, root: str, files: list[str]) -> str:
    return json.dumps({"type": "analyze", "id": number, "root": root, "files": files}) + "\n"


def _text(message: dict, *names: str) -> None:
    for n in names:
        if not isinstance(message.get(n), str):
            raise ValueError(f"{n} is no text: {message}")


def node_row(n: dict) -> dict:
    _text(n, "id", "name", "file", "qualifiedName")
    if n.get("kind") not in NODE_KINDS or n.get("tier") not in TIERS:
        raise ValueError(f"unknown kind or tier: {n}")
    span = n.get("range") or {}
    return {"is_node": True, "id": n["id"], "kind": n["kind"], "name": n["name"], "file": n["file"], "qualified_name": n["qualifiedName"], "start_line": span.get("startLine"), "end_line": span.get("endLine"), "tier": n["tier"]}


def edge_row(e: dict) -> dict:
    _text(e, "from", "to")
    if e.get("kind") not in EDGE_KINDS or e.get("provenance") not in (None, *PROVENANCES) or e.get("strategy") not in (None, *STRATEGIES):
        raise ValueError(f"unknown kind, provenance or strategy: {e}")
    at = e.get("at") or {}
    return {"is_node": False, "from_id": e["from"], "to_id": e["to"], "kind": e["kind"], "provenance": e.get("provenance"), "confidence": e.get("confidence"), "strategy": e.get("strategy"), "line": at.get("line")}


def parse_result(lines: Iterator[str], number: int) -> list[dict]:
    """Rows of the result of a request; an ``error`` message, a malformed line or no result at all raises."""
    for line in lines:
        message = json.loads(line)
        kind = message.get("type")
        if kind not in ("ready", "result", "error"):
            raise ValueError(f"unknown message: {line[:200]}")
        if kind == "error":
            raise ValueError(str(message.get("message")))
        if kind == "result" and message.get("id") == number:
            return [*map(node_row, message["nodes"]), *map(edge_row, message["edges"])]
    raise ValueError("ended without a result")


def analyze(files: DataFrame, root: str, sidecar: Sidecar, batch: int = 500) -> DataFrame:
    """Rows of SCHEMA for the files (path) that the sidecar serves; a process a batch, started by the task that holds it."""

    def run(batches):
        schema = pa.schema([(n, {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}.get(t, pa.string())) for n, t in (c.strip().split() for c in SCHEMA.split(","))])
        number = 0
        for b in batches:
            paths = b.column("path").to_pylist()
            for i in range(0, len(paths), batch):
                number += 1
                part = paths[i : i + batch]
                try:
                    done = subprocess.run(sidecar.command, input=request(number, root, part), capture_output=True, text=True, timeout=sidecar.timeout, check=False)
                    rows = parse_result(iter(done.stdout.splitlines()), number)
                except (OSError, ValueError, KeyError, TypeError, subprocess.TimeoutExpired) as e:
                    rows = [{"file": p, "error": f"{type(e).__name__}: {e}"} for p in part]
                yield from pa.Table.from_pylist(rows, schema=schema).to_batches()

    served = F.lit(False)
    for e in sidecar.extensions:
        served |= F.lower("path").endswith(e)
    return files.filter(served).select("path").mapInArrow(run, SCHEMA)
