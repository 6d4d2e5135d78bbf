import itertools
import random
import re
import time

import numpy as np

from convomill.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_rules_equal_the_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1290.@+-() %é\n") for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    texts += ["a@b.c@d.e.f x@y z@.q 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (512) 555-4069", "٣٣٣ +١٢"]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.rule_spans(t) == brute(t), t[:80]


def test_repeats_are_labelled_alike(spark):
    rows = [(i, f"call +1 (512) 555-{4000 + i} now, mail a{i}@b.example.com or 10.0.0.{i}", 1) for i in range(100)]
    rows += [(200, "call +1 (512) 555-4069 now, or later " + "word " * 100 + "again 1 512 555 4069 ok", 1), (201, "only 1 512 555 4069 ok", 1), (202, None, 1), (203, "", 1), (204, "4" * 100000 + "@" + "a" * 100000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.span_digest(pii.find_spans(docs)).collect()}
    assert [x.split(":")[0] for x in got[200].spans.split(",")] == ["phone", "phone"] and got[200].n_phone == 1
    assert got[201].spans == "" and got[202].spans == got[203].spans == ""
    for i, t, _ in rows:
        assert got[i].base_sha256 == pii.digest_of(brute(t) if t and len(t) < 9999 else pii.rule_spans(t or ""))
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert "555" not in red[200] and red[200].count("<PHONE>") == 2 and red[5].endswith("<EMAIL> or <IP>") and red[202] is None


def test_long_runs_and_repeated_rows(spark):
    long = "0" * 5000 + "1.2.3.4"
    rows = [(1, f"x {long} y"), (2, "a" * 300 + "@" + "b" * 300), (2, "a" * 300 + "@" + "b" * 300), (3, "a1@" * 50000), (None, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.span_digest(pii.find_spans(docs)).collect()
    assert len(got) == 5 and next(r for r in got if r.doc_id == 1).n_ip == 1 and next(r for r in got if r.doc_id is None).n_email == 1
    assert pii.open_candidates(rows[1][1], []) == [(0, 601)]
    assert pii.redacted(docs).where("doc_id = 1").first().text == "x <IP> y"


def test_numbers_equal_their_pattern():
    """Also where a run touches a letter, and in time that grows with the text."""
    pattern = re.compile(r"(?<![0-9A-Za-z])[(+]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])")
    rng = random.Random(8)
    for _ in range(60_000):
        text = "".join(rng.choice("123456789012345678901234567890 ().-+ (a@é") for _ in range(rng.randint(0, 30)))
        assert list(pii.numbers(text)) == [m.span() for m in pattern.finditer(text)], text
    for text in ("1 " * 500_000 + "1a", "a1 " * 300_000, "1 " * 500_000 + "1"):
        began = time.perf_counter()
        list(pii.numbers(text))
        assert time.perf_counter() - began < 1


def test_candidates_do_not_overlap():
    assert pii.open_candidates("12345678901@host", []) == [(0, 16)] and pii.open_candidates("call 1234567 x@y 7654321", []) == [(5, 12), (13, 16), (17, 24)]
    rng = random.Random(9)
    for _ in range(5000):
        text = "".join(rng.choice("1234567890123456789 -.@@ab(") for _ in range(40))
        found = pii.open_candidates(text, [])
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def chance(field, graph, labels):
    """Log weight of one labelling, written out."""
    w = field.weights
    unary = sum(w["bias"][k] + w["shape"][field.place.get(s, len(field.place))][k] for s, k in zip(graph.shapes, labels, strict=True))
    return unary + sum(w["near"][labels[i], labels[j]] for i, j in graph.chain) + sum(w["linked"][kind][labels[i], labels[j]] for i, j, kind in graph.skip)


def test_messages_equal_enumeration():
    """On graphs without cycles message passing is exact; with one cycle the labels agree."""
    rng = np.random.default_rng(1)
    field = pii.Field(["a", "b"])
    for c, w in field.weights.items():
        w += rng.normal(0, 1, w.shape)
    field.weights["near"] += field.weights["near"].T
    field.weights["linked"] += field.weights["linked"].transpose(0, 2, 1)
    for chain, skip, exact in (([(0, 1), (1, 2)], [(0, 3, 0), (2, 4, 1)], True), ([(0, 1), (2, 3)], [], True), ([(0, 1), (1, 2), (2, 3)], [(0, 4, 0), (1, 4, 1)], False)):
        labels = np.array([-1, -1, 2, -1, -1])
        graph = pii.Graph(["a", "b", "c", "a", "b"], labels, labels, np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 3))
        weights = {x: np.exp(chance(field, graph, x)) for x in itertools.product(range(5), repeat=5) if x[2] == 2}
        truth = np.array([[sum(v for x, v in weights.items() if x[i] == k) for k in range(5)] for i in range(5)]) / sum(weights.values())
        belief = pii._softmax(field._beliefs(graph, labels)[0], 1)
        assert not exact or np.abs(belief - truth).max() < 1e-3
        assert field.labels(graph) == truth.argmax(1).tolist()


def test_fitting_climbs_and_restores_disguised_matches():
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    text = lambda: f"call +1 (512) 555-{digits(4)} or +44 20 {digits(4)} {digits(4)} mail u{digits(3)}@mail{digits(1)}.example.com at 10.0.{rng.randint(1, 99)}.7 order {digits(10)} and {digits(8)} or {digits(12)}"
    train, held = ([g for g in (pii.lesson(text()) for _ in range(n)) if g] for n in (300, 100))
    graph, unseen = pii.Graph.read(train), pii.Graph.read(held)
    field = pii.Field(sorted(set(graph.shapes)))
    gap = lambda f: np.abs(f.expected(graph, graph.known)["linked"] - f.expected(graph, graph.labels)["linked"]).sum()
    before = gap(field)
    field.fit(graph)
    assert gap(field) < 0.3 * before
    got, hidden = np.array(field.labels(unseen)), (unseen.labels < 0) & (unseen.known > 0)
    assert hidden.sum() > 50 and (got[hidden] == unseen.known[hidden]).mean() > 0.9
    alone = pii.Graph(["7", "11 ", "9.", "@", "24", "1 2"], *[np.full(6, -1)] * 2, np.empty((0, 2), int), np.empty((0, 3), int))
    assert field.labels(alone) == [0] * 6
    clean = (unseen.labels < 0) & (unseen.known == 0)
    assert clean.sum() > 100 and (got[clean] == 0).mean() > 0.95


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(docs).count() == 0 and pii.redacted(docs).count() == 0
