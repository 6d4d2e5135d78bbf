"""Personal data by fixed rules and a skip-chain conditional random field.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers.
What looks like them but passes no rule (other groupings of the same digits,
an address without its domain's end, a number without its plus) is decided by
a random field over a document's candidates: nodes are rule matches, whose
labels are fixed, and the other candidates; neighbours in the text share a
chain potential; repeated or similar ones, however far apart, share a skip
potential. Loopy message passing gives each open candidate its most probable
label. Text that has neither a digit nor an at sign can hold no candidate, so
its label is certain and it needs no node.

The field's weights (a bias and shape weights by label, a table for neighbours,
one each for equal and for similar candidates) maximise the conditional
likelihood under the same message passing, with a Gaussian prior, on a bounded
sample: the FITTED documents with rule matches and the FITTED others of the
smallest hashes, of at most NODES candidates each. There a rule match is shown a
second time, as it would look if it passed no rule: half of them linked to it,
with its label hidden, half of them alone, as none; open candidates without a link to a rule match count as none, linked ones are
left open. Occurrences of one key are linked each to the next, so a token
repeated n times costs n edges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
NEAR, ROUNDS, DAMPING = 60, 30, 0.3
FITTED, NODES, STEPS, RATE = 1_500, 200, 60, 0.15

# The rules' patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")
#: Digits with at most two separators between them, as many as there are.
_RUN = re.compile(r"[0-9](?:[ ().-]{0,2}+[0-9])*+")
_GAP = re.compile(r"[ ().-]++")
LEAST_DIGITS = 7
_HOST = re.compile(r"[A-Za-z0-9-]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from the at signs, so that a long word without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def rule_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind as in KINDS."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Runs of LEAST_DIGITS digits or more with separators, with an opening bracket or plus, that touch no letter. A run that starts at a letter starts after its first gap. Each run is looked at once."""
    for m in _RUN.finditer(text):
        s, e = m.span()
        if _letter(text, e):
            continue
        if _letter(text, s - 1):
            gap = _GAP.search(text, s, e)
            if not gap:
                continue
            s = gap.end() - 1 if gap.end() - gap.start() == 2 and text[gap.end() - 1] == "(" else gap.end()
        elif s and text[s - 1] in "(+" and not _letter(text, s - 2):
            s -= 1
        if sum(c.isdigit() for c in text[s:e]) >= LEAST_DIGITS:
            yield s, e


def open_candidates(text: str, rules: list[Span]) -> list[tuple[int, int]]:
    """Spans outside the rules' that the random field decides on. They never overlap: of a number and the address that it begins, the address."""
    found = list(numbers(text))
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1)
        if m and start < at:
            found.append((start, m.end()))
        at = text.find("@", at + 1)
    taken, out, i = sorted((s, e) for _, s, e in rules), [], 0
    reach = 0
    for s, e in sorted(found):
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        if s >= reach:
            if out and s < out[-1][1]:
                if e - s > out[-1][1] - out[-1][0]:
                    out[-1] = (s, e)
            else:
                out.append((s, e))
    return out


def shape_of(body: str) -> str:
    digits = sum(c.isdigit() for c in body)
    if "@" in body:
        return "@." if "." in body.partition("@")[2] else "@"
    marks = "".join(c for c in "+(. -" if c in body)
    return f"{min(digits, 24)}{marks}"


def disguised(kind: str, body: str) -> str:
    """A rule match as it would look if it passed no rule."""
    if kind == "email":
        local, _, domain = body.partition("@")
        return f"{local}@{domain.partition('.')[0]}"
    digits = "".join(c for c in body if c.isdigit())
    return {"phone": body.lstrip("+").replace("(", "").replace(")", ""), "card": ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "ip": body.replace(".", "-")}[kind]


def keys_of(body: str) -> list[str]:
    """Candidates with a key in common are linked: the same digits or address, or the same last nine digits or local part."""
    body = body.lower()
    if "@" in body:
        return [body, "~" + body.partition("@")[0] + "@"]
    digits = "".join(c for c in body if c.isdigit())
    return [digits, "~" + digits[-9:]] if len(digits) >= 9 else [digits]


class Nodes:
    """The candidates of one text with their fixed labels and edges (of skip edges also the kind: 0 equal, 1 similar)."""

    def __init__(self, text: str, rules: list[Span]):
        nodes = [(s, e, LABELS.index(k)) for k, s, e in rules] + [(s, e, 0) for s, e in open_candidates(text, rules)]
        self.spans = sorted(nodes)
        self.fixed = [bool(n[2]) for n in self.spans]
        self.shapes = [shape_of(text[s:e]) for s, e, _ in self.spans]
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1) if self.spans[i + 1][0] - self.spans[i][1] <= NEAR]
        last: dict[str, int] = {}
        skip: dict[tuple[int, int], int] = {}
        for i, (s, e, _) in enumerate(self.spans):
            for key in keys_of(text[s:e]):
                if key in last:
                    skip.setdefault((last[key], i), int(key[0] == "~"))
                last[key] = i
        self.skip = sorted((i, j, kind) for (i, j), kind in skip.items())


@dataclass
class Graph:
    """Candidates and edges of any number of texts. labels: -1 where open; known: labels to learn from, -1 where left open."""

    shapes: list[str]
    labels: np.ndarray
    known: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def of(cls, nodes: Nodes) -> Graph:
        labels = np.array([k if fixed else -1 for (_, _, k), fixed in zip(nodes.spans, nodes.fixed, strict=True)], int)
        return cls(nodes.shapes, labels, labels, np.array(nodes.chain, int).reshape(-1, 2), np.array(nodes.skip, int).reshape(-1, 3))

    @classmethod
    def read(cls, rows: list[str]) -> Graph:
        shapes, labels, known, chain, skip, at = [], [], [], [], [], 0
        for x in map(json.loads, rows):
            shapes += x["shapes"]
            labels += x["labels"]
            known += x["known"]
            chain += [(i + at, j + at) for i, j in x["chain"]]
            skip += [(i + at, j + at, kind) for i, j, kind in x["skip"]]
            at += len(x["shapes"])
        return cls(shapes, np.array(labels, int), np.array(known, int), np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 3))


def lesson(text: str) -> str | None:
    """The graph of one text to learn from, with rule matches shown again in disguise, linked or alone; None if it has no candidate or too many."""
    rules = rule_spans(text)
    nodes = Nodes(text, rules)
    n = len(nodes.spans)
    if not 0 < n <= NODES:
        return None
    labels = [k if fixed else -1 for (_, _, k), fixed in zip(nodes.spans, nodes.fixed, strict=True)]
    linked = {i for a, b, _ in nodes.skip for i, other in ((a, b), (b, a)) if nodes.fixed[other]}
    known = [k if fixed else (-1 if i in linked else 0) for i, ((_, _, k), fixed) in enumerate(zip(nodes.spans, nodes.fixed, strict=True))]
    shapes, skip = list(nodes.shapes), list(nodes.skip)
    for i, (s, e, k) in enumerate(nodes.spans):
        draw = zlib.crc32(f"{i}:{text[s:e]}".encode("utf-8", "surrogatepass")) % 8
        if nodes.fixed[i]:
            if draw < 4:
                skip.append((i, len(shapes), int(draw == 3 and LABELS[k] in ("email", "phone"))))
            shapes.append(shape_of(disguised(LABELS[k], text[s:e])))
            labels.append(-1)
            known.append(k if draw < 4 else 0)
    return json.dumps({"shapes": shapes, "labels": labels, "known": known, "chain": nodes.chain, "skip": skip})


def _softmax(x: np.ndarray, axis: int | tuple) -> np.ndarray:
    x = np.exp(x - x.max(axis, keepdims=True))
    return x / x.sum(axis, keepdims=True)


class Field:
    """Weights: bias and shape by label, tables of neighbours, of equal and of similar candidates."""

    def __init__(self, shapes: list[str]):
        k = len(LABELS)
        self.place = {s: i for i, s in enumerate(shapes)}
        self.prior = {"bias": np.r_[0.0, np.full(k - 1, -2.0)], "shape": np.zeros((len(shapes) + 1, k)), "near": np.zeros((k, k)), "linked": np.array([np.eye(k) * 3, np.eye(k) * 1.5])}
        self.weights = {c: w.copy() for c, w in self.prior.items()}

    def _beliefs(self, graph: Graph, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs of the nodes, log messages and the edges' tables, by damped loopy message passing; labels: fixed where not negative."""
        w, n, k = self.weights, len(graph.shapes), len(LABELS)
        unary = w["bias"] + w["shape"][[self.place.get(s, len(self.place)) for s in graph.shapes]].reshape(n, k)
        fixed = np.flatnonzero(labels >= 0)
        unary[fixed] = -1e3
        unary[fixed, labels[fixed]] = 0
        source, target = (np.concatenate([graph.chain[:, i], graph.skip[:, i], graph.chain[:, 1 - i], graph.skip[:, 1 - i]]) for i in (0, 1))
        edges = len(source) // 2
        back = np.r_[np.arange(edges) + edges, np.arange(edges)]
        table = np.concatenate([np.broadcast_to(w["near"], (len(graph.chain), k, k)), w["linked"][graph.skip[:, 2]]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        message = np.zeros((2 * edges, k))
        for _ in range(ROUNDS if edges else 0):
            belief = unary.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + table
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            step = (1 - DAMPING) * (new - message)
            message = message + step
            if np.abs(step).max() < 1e-4:
                break
        belief = unary
        np.add.at(belief, target, message)
        pairs = (belief[source] - message[back])[:edges, :, None] + (belief[target] - message)[:edges, None, :] + table[:edges]
        return belief, message, pairs

    def labels(self, graph: Graph) -> list[int]:
        """The most probable label of each node."""
        return self._beliefs(graph, graph.labels)[0].argmax(1).tolist()

    def expected(self, graph: Graph, labels: np.ndarray) -> dict[str, np.ndarray]:
        """How often each weight is used on average, given the fixed labels."""
        belief, _, pairs = self._beliefs(graph, labels)
        p, q = _softmax(belief, 1), _softmax(pairs, (1, 2))
        out = {c: np.zeros_like(w) for c, w in self.weights.items()}
        out["bias"] += p.sum(0)
        np.add.at(out["shape"], [self.place.get(s, len(self.place)) for s in graph.shapes], p)
        chains = len(graph.chain)
        out["near"] += q[:chains].sum(0)
        np.add.at(out["linked"], graph.skip[:, 2], q[chains:])
        out["near"] = (out["near"] + out["near"].T) / 2
        out["linked"] = (out["linked"] + out["linked"].transpose(0, 2, 1)) / 2
        return out

    def fit(self, graph: Graph) -> Field:
        """Climbs the conditional log likelihood: what the known labels use less what the field expects without them."""
        first = {c: np.zeros_like(w) for c, w in self.weights.items()}
        second = {c: np.zeros_like(w) for c, w in self.weights.items()}
        for step in range(1, STEPS + 1 if len(graph.shapes) else 1):
            have, guess = self.expected(graph, np.where(graph.known >= 0, graph.known, graph.labels)), self.expected(graph, graph.labels)
            for c, w in self.weights.items():
                slope = have[c] - guess[c] - (w - self.prior[c])
                first[c] = 0.9 * first[c] + 0.1 * slope
                second[c] = 0.99 * second[c] + 0.01 * slope**2
                w += RATE * (first[c] / (1 - 0.9**step)) / (np.sqrt(second[c] / (1 - 0.99**step)) + 1e-6)
            self.weights["shape"][-1] = 0  # of shapes not seen
        return self


def lessons(docs: DataFrame, text: str = "text") -> Graph:
    """FITTED texts with rule matches and FITTED with open candidates only, of the smallest hashes. A task hands on as many of its own at most."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[list, list] = ([], [])
        for batch in batches:
            for h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body or not _SIGN.search(body):
                    continue
                open_only = int(not rule_spans(body))
                held = best[open_only]
                if (len(held) < FITTED or h < -held[0][0]) and (graph := lesson(body)):
                    (heapq.heappush if len(held) < FITTED else heapq.heappushpop)(held, (-h, graph))
        rows = [(kind, -h, graph) for kind, held in enumerate(best) for h, graph in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kind", "h", "graph"])

    rows = docs.select(F.coalesce(F.xxhash64(text), F.lit(0)), text).mapInArrow(choose, "kind int, h long, graph string")
    rows = rows.distinct()
    for by in (["kind", F.pmod(F.xxhash64("h"), F.lit(64))], ["kind"]):  # many tasks' rows meet in two steps
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h", "graph"))).where(F.col("rank") <= FITTED)
    return Graph.read([r["graph"] for r in rows.orderBy("kind", "rank").select("graph").collect()])


def learned(docs: DataFrame, text: str = "text") -> Field:
    """The field fitted on the documents' own rule matches. 2 * FITTED small graphs at most come to the driver."""
    graph = lessons(docs, text)
    return Field(sorted(set(graph.shapes))).fit(graph)


def spans_of(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and all spans with those that the field adds, both by start and kind."""
    if not text or not _SIGN.search(text):
        return [], []
    rules = rule_spans(text)
    nodes = Nodes(text, rules)
    added = [] if all(nodes.fixed) else [(LABELS[k], s, e) for (s, e, _), fixed, k in zip(nodes.spans, nodes.fixed, field.labels(Graph.of(nodes)), strict=True) if k and not fixed]
    return rules, sorted(rules + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find_spans(docs: DataFrame, field: Field | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) of every document.

    Null and empty texts have no spans; repeated rows are repeated. Other
    columns are not read.
    """
    field = field or learned(docs, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans_of(x, field) for x in batch.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "base", "spans"])

    struct = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(find, f"doc_id long, base {struct}, spans {struct}")


def redacted(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; all other columns and rows as they are.

    Null texts stay null, empty ones empty; of spans that overlap the first
    is replaced and the rest of the others goes with it. Repeated rows are
    redacted alike, an empty table stays empty, other columns are not read
    whatever their names.
    """
    field = field or learned(docs, text)
    at = docs.columns.index(text)

    def redact_one(body: str | None) -> str | None:
        _, spans = spans_of(body, field)
        parts, end = [], 0
        for kind, s, e in spans:
            if s >= end:
                parts += [body[end:s], f"<{kind.upper()}>"]
            end = max(end, e)
        return "".join([*parts, body[end:]]) if spans else body

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact_one(x) for x in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new)

    return docs.mapInArrow(redact, docs.schema)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def span_digest(found: DataFrame) -> DataFrame:
    """find_spans() as counts of the rules' spans, their digest, and all spans as a string."""

    def text(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest_of(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
