"""The query language: a parser, and plans over the postings.

Words side by side are alternatives. There are AND, OR, NOT, + and -, parentheses, phrases in
quotes with an optional slop, words and phrases whose last word is a beginning (``fo*``, ``"a fo"*``),
ranges of terms (``[a TO b]``, ``{a TO *}``), sets of terms (``IN [a b]``), ``*`` for everything,
boosts, and the fields body, doc_id and segment_id. A word that holds several terms is a phrase.
Whatever else the text says is a typed error.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.errors import EngineError
from pagewright.lineage import written_once
from pagewright.operators import fulltext

FIELDS = ("body", "doc_id", "segment_id")
_TOKEN = re.compile(
    r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-])(?=\S)|(?P<quote>\"(?P<phrase>[^\"]*)\"(?:~(?P<slop>\d+)|(?P<begins>\*))?)|(?P<range>(?P<from>[\[{])\s*(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<to>[\]}]))|(?P<set>IN\s*\[(?P<members>[^\]]*)\])|(?P<op>AND|OR|NOT)(?=[\s()]|$)|(?:(?P<field>[A-Za-z_]\w*):(?=\S))|(?P<boost>\^(?P<by>\d+(?:\.\d+)?))|(?P<word>[^\s()\"^:]+))"
)
_UNSUPPORTED = re.compile(r"[\[\]{}?]|\*.|^IN$|^TO$")
_TERM = re.compile(r"[^\W_]+")


@dataclass
class Phrase:
    """Terms in a row; ``slop`` is how many places all of them together may be off, ``begins`` that the last is a beginning."""

    terms: list[str]
    slop: int = 0
    begins: bool = False


@dataclass
class Keyed:
    field: str
    value: str


@dataclass
class Range:
    """Values from ``low`` to ``high``; a None is open, ``ends`` says which ends belong to it."""

    field: str
    low: str | None
    high: str | None
    ends: tuple[bool, bool]


@dataclass
class OneOf:
    field: str
    values: list[str]


@dataclass
class Everything:
    pass


@dataclass
class Clause:
    """must, should or must_not, and the node it is about."""

    occur: str
    node: Node


@dataclass
class Bool:
    clauses: list[Clause] = field(default_factory=list)
    boost: float = 1.0


Node = Phrase | Keyed | Range | OneOf | Everything | Bool


def failed(message: str) -> EngineError:
    return EngineError("E_SEARCH_FAILED", message)


def terms_of(word: str) -> list[str]:
    return [t.lower() for t in _TERM.findall(word) if len(t.encode()) < 40]


def parse(text: str) -> Bool:
    """The query's clauses; raises E_SEARCH_FAILED where the text can't be read."""
    tokens: list[tuple[str, re.Match]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise failed(f"cannot read the query at {text[at:]!r}")
        kind = next(k for k in ("open", "close", "sign", "quote", "range", "set", "op", "field", "boost", "word") if m[k] is not None)
        if kind == "word" and m["word"] in ("+", "-"):
            raise failed("a sign needs a clause")
        if kind == "word" and _UNSUPPORTED.search(m["word"]):
            raise failed(f"not supported: {m['word']}")
        tokens.append((kind, m))
        at = m.end()
    node, rest = _alternatives(tokens, 0)
    if rest != len(tokens):
        raise failed("a parenthesis is closed that wasn't opened")
    return node


def _alternatives(tokens: list, at: int) -> tuple[Bool, int]:
    out, operator, negate = Bool(), None, False
    while at < len(tokens) and tokens[at][0] != "close":
        kind, m = tokens[at]
        if kind == "op":
            if m["op"] == "NOT":
                negate = True
            elif not out.clauses or operator or negate:
                raise failed(f"{m['op']} needs a clause on both sides")
            else:
                operator = m["op"]
            at += 1
            continue
        occur = "must_not" if negate else "should"
        if kind == "sign":
            occur = "must" if m["sign"] == "+" else "must_not"
            at += 1
            if at == len(tokens) or tokens[at][0] in ("close", "op", "sign", "boost"):
                raise failed("a sign needs a clause")
        node, at = _primary(tokens, at)
        if operator == "AND":
            if out.clauses[-1].occur == "should":
                out.clauses[-1].occur = "must"
            if occur == "should":
                occur = "must"
        out.clauses.append(Clause(occur, node))
        operator, negate = None, False
    if operator or negate:
        raise failed("the query ends with an operator")
    return out, at


def _primary(tokens: list, at: int) -> tuple[Node, int]:
    kind, m = tokens[at]
    name = "body"
    if kind == "field":
        name = m["field"]
        if name not in FIELDS:
            raise failed(f"unknown field: {name}")
        at += 1
        if at == len(tokens):
            raise failed("a field needs a value")
        kind, m = tokens[at]
    if kind == "open":
        node, at = _alternatives(tokens, at + 1)
        if at == len(tokens):
            raise failed("a parenthesis isn't closed")
    elif kind == "range":
        low, high = (None if x == "*" else x.lower() if name == "body" else x for x in (m["low"], m["high"]))
        node = Range(name, low, high, (m["from"] == "[", m["to"] == "]"))
    elif kind == "set":
        node = OneOf(name, [t for w in m["members"].split() for t in (terms_of(w) if name == "body" else [w])])
    elif kind == "word" and m["word"] == "*":
        node = Everything()
    elif kind in ("quote", "word"):
        value = m["phrase"] if kind == "quote" else m["word"].removesuffix("*")
        begins = bool(m["begins"]) or kind == "word" and m["word"].endswith("*")
        node = Phrase(terms_of(value), int(m["slop"] or 0), begins) if name == "body" else Keyed(name, value)
    else:
        raise failed("a clause is missing")
    at += 1
    if at < len(tokens) and tokens[at][0] == "boost":
        node = Bool([Clause("should", node)], float(tokens[at][1]["by"]))
        at += 1
    return node, at


def terms_in(node: Node) -> list[str]:
    """All terms that the plan looks up in the postings."""
    if isinstance(node, Phrase):
        return node.terms
    return [t for c in node.clauses for t in terms_in(c.node)] if isinstance(node, Bool) else []


def _bounds(node: Range | OneOf, value: Column) -> list[Column]:
    """What a value must meet to be in a range or a set."""
    if isinstance(node, OneOf):
        return [value.isin(node.values) if node.values else F.lit(False)]
    low, high = node.low is not None, node.high is not None
    return [*([value >= node.low if node.ends[0] else value > node.low] if low else []), *([value <= node.high if node.ends[1] else value < node.high] if high else [])]


def _reads(node: Node, term: Column) -> Column:
    if isinstance(node, Bool):
        return functools.reduce(Column.__or__, (_reads(c.node, term) for c in node.clauses), F.lit(False))
    if isinstance(node, Range | OneOf) and node.field == "body":
        return functools.reduce(Column.__and__, _bounds(node, term), F.lit(True))
    if isinstance(node, Phrase) and node.terms:
        return term.isin(node.terms) | term.startswith(node.terms[-1]) if node.begins else term.isin(node.terms)
    return F.lit(False)


def reads(text: str) -> Column:
    """Which terms' postings a query looks at, so that no others are unpacked."""
    return _reads(parse(text), F.col("term")) if text.strip() else F.lit(False)


class Index:
    """What a query reads: postings (term, segment_id, tf, positions, and doc_len if they have it), lengths, and segments for keyed fields."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, stats: tuple[int, float], segments: DataFrame):
        self.postings, self.lengths, (self.n, self.avg_len), self.segments = postings, lengths, stats, segments
        self.df: dict[str, int] = {}
        self.whole = postings

    def of(self, terms: list[str]) -> Index:
        """The index cut down to the postings of some terms, with their document frequencies from one job."""
        rows = self.postings.where(F.col("term").isin(terms)) if terms else self.postings.where("false")
        out = Index(rows, self.lengths, (self.n, self.avg_len), self.segments)
        out.whole = self.whole
        with written_once(rows.sparkSession):
            out.df = {r["term"]: r["count"] for r in rows.groupBy("term").count().collect()} if terms else {}
        return out

    def _idf(self, term: str) -> float:
        df = self.df.get(term, 0)
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def _weight(self) -> Column:
        return fulltext.weight(F.col("tf"), F.col("doc_len"), F.lit(max(self.avg_len, 1e-9)))

    def scores(self, node: Node) -> DataFrame:
        """(segment_id, score) of the segments that match. What isn't looked up as terms scores 1, an id 0."""
        if isinstance(node, Keyed):
            return self.segments.where(F.col(node.field) == node.value).select("segment_id", F.lit(0.0).alias("score"))
        if isinstance(node, Everything):
            return self.segments.select("segment_id", F.lit(1.0).alias("score"))
        if isinstance(node, Range | OneOf):
            value = F.col("term" if node.field == "body" else node.field)
            rows = self.whole if node.field == "body" else self.segments
            for condition in _bounds(node, value):
                rows = rows.where(condition)
            return rows.select("segment_id").distinct().withColumn("score", F.lit(1.0))
        if isinstance(node, Phrase):
            return self._phrase(node)
        return self._bool(node)

    def _words(self, clauses: dict[str, list[int]]) -> DataFrame:
        """(segment_id, score, clause) of single terms, each with the clauses it stands for: one scan for all of them."""
        rows = self.postings.where(F.col("term").isin(list(clauses)))
        if "doc_len" not in rows.columns:
            rows = rows.join(self.lengths, "segment_id")
        idf = F.create_map(*(F.lit(x) for t in clauses for x in (t, self._idf(t))))
        tags = F.create_map(*(x for t, k in clauses.items() for x in (F.lit(t), F.array(*map(F.lit, k)))))
        return rows.select("segment_id", (idf[F.col("term")] * self._weight()).alias("score"), F.explode(tags[F.col("term")]).alias("clause"))

    def _phrase(self, node: Phrase) -> DataFrame:
        if not node.terms:
            return self.segments.where("false").select("segment_id", F.lit(0.0).alias("score"))
        if len(node.terms) == 1 and not node.begins:
            return self._words({node.terms[0]: [0]}).select("segment_id", "score")
        if len(node.terms) == 1:
            return self._beginning(node.terms[0]).select("segment_id", F.lit(1.0).alias("score"))
        own = [self.postings.where(F.col("term") == t).select("segment_id", "positions") for t in node.terms]
        if node.begins:
            own[-1] = self._beginning(node.terms[-1])
        rows = own[0].select("segment_id", F.col("positions").alias("p0"))
        for k, more in enumerate(own[1:], 1):
            rows = rows.join(more.select("segment_id", F.col("positions").alias(f"p{k}")), "segment_id")

        # For each place of the first term: where the terms so far can end, and how many places they are off by then.
        def step(states: Column, k: int) -> Column:
            least = lambda q: F.array_min(F.transform(states, lambda s: s["off"] + F.abs(q - s["at"] - 1)))
            return F.filter(F.transform(f"p{k}", lambda q: F.struct(q.alias("at"), least(q).alias("off"))), lambda s: s["off"] <= node.slop)

        def near(p: Column) -> Column:
            states = F.array(F.struct(p.alias("at"), F.lit(0).alias("off")))
            for k in range(1, len(own)):
                states = step(states, k)
            return F.size(states) > 0

        found = rows.select("segment_id", F.size(F.filter("p0", near)).alias("tf")).where("tf > 0").join(self.lengths, "segment_id")
        known = node.terms[:-1] if node.begins else node.terms
        return found.select("segment_id", (F.lit(sum(map(self._idf, known))) * self._weight()).alias("score"))

    def _beginning(self, prefix: str) -> DataFrame:
        """(segment_id, positions) of all terms that begin so."""
        return self.whole.where(F.col("term").startswith(prefix)).groupBy("segment_id").agg(F.flatten(F.collect_list("positions")).alias("positions"))

    def _bool(self, node: Bool) -> DataFrame:
        words: dict[str, list[int]] = {}
        rows: list[DataFrame] = []
        must = 0
        for c in (c for c in node.clauses if c.occur != "must_not"):
            tag = -1
            if c.occur == "must":
                tag, must = must, must + 1
            if isinstance(c.node, Phrase) and len(c.node.terms) == 1 and not c.node.begins:
                words.setdefault(c.node.terms[0], []).append(tag)
            else:
                rows.append(self.scores(c.node).select("segment_id", "score", F.lit(tag).alias("clause")))
        if words:
            rows.append(self._words(words))
        if not rows:
            return self.segments.where("false").select("segment_id", F.lit(0.0).alias("score"))
        out = functools.reduce(DataFrame.unionByName, rows).groupBy("segment_id").agg(F.sum("score").alias("score"), F.array_distinct(F.collect_list(F.when(F.col("clause") >= 0, F.col("clause")))).alias("musts"))
        if must:
            out = out.where(F.size("musts") == must)
        for c in (c for c in node.clauses if c.occur == "must_not"):
            out = out.join(self.scores(c.node).select("segment_id"), "segment_id", "left_anti")
        return out.select("segment_id", (F.col("score") * node.boost).alias("score"))


def search(spark: SparkSession, index: Index, text: str, k: int) -> DataFrame:
    """(segment_id, bm25_score, bm25_rank) of the ``k`` best segments; an empty query or ``k`` finds nothing."""
    if not text.strip() or k <= 0:
        return spark.createDataFrame([], "segment_id string, bm25_score double, bm25_rank int")
    node = parse(text)
    cut = index.of(sorted(set(terms_in(node))))
    return fulltext.top_one(cut.scores(node).withColumnRenamed("score", "bm25_score"), k, "bm25_score", rank="bm25_rank")
