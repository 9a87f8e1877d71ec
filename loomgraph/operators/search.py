"""Symbol search, code search and question terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import language
from ..graph import Graph
from ..plans.durable import materialize
from .relations import plain_score

# fixed values: words that a question's terms leave out
STOP_WORDS = (
    "how what where why when who which the are was were does did and for with this that its into from use used uses work works get set via between about you"
).split()
_TOKEN = re.compile(r'(\w+):"([^"]*)"|"([^"]*)"|(\S+)')
FILTERS = ("path", "kind", "lang", "name")


def parse_query(raw: str) -> tuple[str, dict[str, str]]:
    """(free text, filters): ``path: kind: lang: name:`` with quotes; other ``key:value`` stays text; the last of a filter wins."""
    text, filters = [], {}
    for key, quoted, phrase, word in _TOKEN.findall(raw):
        name, colon, value = word.partition(":")
        if key and key.lower() in FILTERS:
            filters[key.lower()] = quoted
        elif colon and value and name.lower() in FILTERS:
            filters[name.lower()] = value.strip('"')
        else:
            text.append(f"{key}:{quoted}" if key else phrase or word)
    return " ".join(t for t in text if t), filters


def text_score(q: str) -> Column:
    """Exact 100, prefix 60, part of the name 30, of the qualified name 12; a shorter name counts more."""
    q, name, qn = q.lower(), F.lower("name"), F.lower("qualified_name")
    match = F.when((name == q) | (qn == q), 100).when(F.startswith(name, F.lit(q)), 60).when(F.contains(name, F.lit(q)), 30).when(F.contains(qn, F.lit(q)), 12).otherwise(0)
    return plain_score() + match + F.greatest(F.lit(0), 16 - F.length("name"))


def search_symbols(graph: Graph, query: str, limit: int = 50, kind: str | None = None, exact: bool = False) -> DataFrame:
    """Ranked symbols. The predicate is one conjunctive filter on the node scan, the ranking a top-k."""
    text, filters = parse_query(query)
    name, qn = F.lower("name"), F.lower("qualified_name")
    kind = filters.get("kind", kind)
    keep = F.lit(bool(text or filters or kind))
    if text:
        q = text.lower()
        keep &= ((name == q) | (qn == q)) if exact else (F.contains(name, F.lit(q)) | F.contains(qn, F.lit(q)))
    if kind:
        keep &= F.lower("kind") == kind.lower()
    if "path" in filters:
        keep &= F.contains(F.lower("file"), F.lit(filters["path"].lower()))
    if "lang" in filters:
        keep &= language(F.col("file")) == filters["lang"].lower()
    if "name" in filters:
        keep &= F.contains(name, F.lit(filters["name"].lower())) | F.contains(qn, F.lit(filters["name"].lower()))
    scored = graph.nodes.filter(keep).withColumn("score", text_score(text) if text else plain_score())
    return scored.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def search_symbols_with_confidence(graph: Graph, query: str, limit: int = 50, kind: str | None = None, exact: bool = False) -> tuple[DataFrame, bool]:
    """(hits, whether none of them is exact or begins with the text)."""
    hits = search_symbols(graph, query, limit, kind, exact)
    return hits, hits.transform(low_confidence, query).first()[0]


def low_confidence(hits: DataFrame, query: str) -> DataFrame:
    """One flag: there are hits for a text, and none is exact or begins with it."""
    q = parse_query(query)[0].lower()
    strong = F.bool_or((F.lower("name") == q) | F.startswith(F.lower("name"), F.lit(q)) | (F.lower("qualified_name") == q))
    return hits.agg((F.lit(bool(q)) & (F.count("*") > 0) & ~F.coalesce(strong, F.lit(False))).alias("low_confidence"))


def question_terms(text: Column) -> Column:
    """Lower-cased words of three letters or more that are no stop words, each once, in order."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))


def terms_of(question: str) -> list[str]:
    """:func:`question_terms` of a text at hand."""
    words = re.split("[^a-z0-9_]+", question.lower())
    return list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in STOP_WORDS))


def search_terms(graph: Graph, terms: list[str], limit: int = 200) -> DataFrame:
    """Symbols by the number of terms that find them, then by their best rank for one."""
    if not terms:
        return graph.nodes.limit(0).select("id", F.lit(0).cast("long").alias("hits"), F.lit(0).alias("best"))
    asked = F.explode(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(F.lower("name"), t) | F.contains(F.lower("qualified_name"), t)))
    rows = graph.nodes.withColumn("term", asked)
    name, qn, t = F.lower("name"), F.lower("qualified_name"), F.col("term")
    match = F.when((name == t) | (qn == t), 100).when(F.startswith(name, t), 60).when(F.contains(name, t), 30).otherwise(12)
    rows = rows.withColumn("score", plain_score() + match + F.greatest(F.lit(0), 16 - F.length("name")))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "qualified_name", "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).groupBy("id").agg(F.count("*").alias("hits"), F.min("rank").alias("best"))


def comment_start(lines: Column, declaration: Column) -> Column:
    """1-based line where the comment lines directly above a declaration begin."""
    before = F.reverse(F.slice(lines, 1, F.greatest(declaration - 1, F.lit(0))))
    is_comment = lambda s: F.trim(s).rlike(r"^(//|/\*|\*|#|--)")
    run = F.aggregate(before, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, s: F.struct((a["n"] + F.when(a["on"] & is_comment(s), 1).otherwise(0)).alias("n"), (a["on"] & is_comment(s)).alias("on")))
    return declaration - run["n"]


def bodies(graph: Graph) -> DataFrame:
    """Symbols with their text, comments above included; a symbol without source or range drops out."""
    rows = graph.nodes.filter((F.col("kind") != "File") & F.col("start_line").isNotNull()).join(graph.sources.select(F.col("path").alias("file"), "lines"), "file")
    start = comment_start(F.col("lines"), F.col("start_line"))
    return rows.withColumn("body", F.array_join(F.slice("lines", start, F.col("end_line") - start + 1), "\n")).drop("lines")


def search_code(texts: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(seq, id, via_terms, hits) from (seq, id, qualified_name, body): phrase hits in order; only without any, the terms of the question
    that a body holds, most first, then by qualified name. A blank query finds nothing."""
    found = texts.select("seq", "id", F.lit(False).alias("via_terms"), F.lit(1).alias("hits"))
    if not query.strip():
        return found.limit(0)
    phrase = materialize(found.where(F.contains(F.lower(texts["body"]), F.lit(query.lower()))).orderBy("seq").limit(limit))
    terms = terms_of(query)
    if len(terms) < 2 or not phrase.isEmpty():
        return phrase
    hits = sum((F.contains(F.lower("body"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return texts.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "qualified_name", "id").limit(limit).select("seq", "id", F.lit(True).alias("via_terms"), "hits")


def search_code_with_confidence(texts: DataFrame, query: str, limit: int = 50) -> tuple[DataFrame, bool]:
    """(results, whether they come by terms)."""
    found = search_code(texts, query, limit)
    return found, not found.filter("via_terms").isEmpty()


def snippet(graph: Graph, targets: DataFrame) -> DataFrame:
    """(id, file, start_line, end_line, snippet): lines of the first target with a range, the comment above it included."""
    first = targets.filter(F.col("start_line").isNotNull()).orderBy("ord").limit(1)
    found = first.join(graph.sources.select(F.col("path").alias("file"), "lines"), "file")
    found = found.withColumn("start_line", comment_start(F.col("lines"), F.col("start_line")))
    body = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return found.select("id", "file", "start_line", "end_line", body.alias("snippet"))
