"""The decontamination operator against a plain restatement of its rules: tuples of tokens for hashes, loops for joins."""

import random

import regex

from convomill.llm import decontam, queries

SF = "/root/testdata/sf0.001"
MARKS = (decontam.NUM, decontam.NAME, decontam.UNIT)
NUMBER, NAME, UNIT = (regex.compile(p) for p in (decontam._NUMBER, decontam._NAME, decontam._UNIT))


def tokens(text, before=""):
    """Each token is (what it counts as, its value or None)."""
    body = f"{before} {text}" if before else text
    if regex.search("[0-9]", body):
        body = NAME.sub(lambda m: MARKS[1] + m[1], UNIT.sub(lambda m: MARKS[2] + m[1], body))
        body = NUMBER.sub(lambda m: f" {MARKS[0]}{m[0]} ", body).lower()
        body = regex.sub("(?<=[0-9])[.,:/](?=[0-9])", "", body)
    else:
        body = NAME.sub(lambda m: MARKS[1] + m[1], body).lower()
    words = [w for w in regex.split(r"[^\p{L}\p{N}-]+", body) if w][1 if before else 0 :]
    return [(w[0], w) if w[0] in MARKS else (w, None) for w in words]


def forms(text, before=""):
    made = tokens(text, before)
    yield made
    if any(kind == MARKS[1] for kind, _ in made):
        yield [(w[1:], None) if kind == MARKS[1] else (kind, w) for kind, w in made]


def windows(text, lengths, before=""):
    """(key, slots, place, length, inner, form)."""
    for form, made in enumerate(forms(regex.sub("[-]", " ", text or ""), before)):
        n = len(made)
        cuts = [(i, min(n, 8), False) for i in range(max(1, n - 7))] if n else []
        cuts += [(i, k, True) for k in lengths for i in range(n - k + 1)]
        for i, k, inner in cuts:
            part = made[i : i + k]
            yield (inner, tuple(kind for kind, _ in part)), tuple(w for _, w in part if w), i, k, inner, form


def index_of(text):
    found = {(key, slots, at, k, inner, form == 0 and not inner) for key, slots, at, k, inner, form in windows(text, range(4, 8))}
    for before in ("a", "1"):
        found |= {(key, slots, at, k, inner, False) for key, slots, at, k, inner, _ in windows(text, range(4, 8), before) if at == 0}
    longest = max((k for _, _, _, k, _, _ in found), default=0)
    found = {(key, slots, at, inner, k - len(slots) < 4, base) for key, slots, at, k, inner, base in found if k == longest}
    base = [(key, slots, at, poor) for key, slots, at, _, poor, is_base in found if is_base]
    first, valued = {}, {}
    for key, slots, at, _ in base:
        first[key], valued[key, slots] = min(at, first.get(key, at)), min(at, valued.get((key, slots), at))
    least = min((poor for *_, poor in base), default=False)
    places = [(at, first[key], valued[key, slots], slots) for key, slots, at, poor in base if poor == least]
    once = [(at, w, v) for at, w, v, slots in places if slots or at == v]
    counts = tuple(len({x[i] for x in once}) for i in (1, 2, 0))
    at_place = {at: (w, v) for at, w, v, _ in places}
    rows = {(key, slots, at, inner, poor, *at_place[at]) for key, slots, at, inner, poor, _ in found if at in at_place and (slots or at == at_place[at][1])}
    return rows, counts


def agreement(pairs):
    values, others = len({i for i, _ in pairs}), len({d for _, d in pairs})
    return (min(values, others) / len(pairs) if pairs else 1.0, values, any(i != d for i, d in pairs))


def judged(docs, items):
    """(doc_id, item_id): (n_windows, item_windows, n_slots, consistency, reparameterised)."""
    index = {i: index_of(t) for i, t in items}
    lengths = {k for rows, _ in index.values() for key, _, _, inner, *_ in rows if inner for k in [len(key[1])]}
    by_key = {}
    for item, (rows, _) in index.items():
        for key, *rest in rows:
            by_key.setdefault(key, []).append((item, *rest))
    out = {}
    for doc, text in docs:
        met = {}
        for key, slots, place, *_ in windows(text, lengths):
            for item, islots, at, inner, poor, window, valued in by_key.get(key, []):
                if not inner or not poor or slots == islots:
                    met.setdefault(item, []).append((slots, islots, place, at, poor, window, valued))
        for item, rows in met.items():
            n_windows, n_valued, n_places = index[item][1]
            first = [r for r in rows if r[3] == r[5]]
            equal = [r for r in rows if r[0] == r[1]]
            plain = {r[5] for r in rows if not r[0]}
            pairs = lambda of: {p for r in of for p in zip(r[1], r[0], strict=True)}
            pooled, same = agreement(pairs(first)), agreement(pairs(equal))
            runs = []
            for offset in {r[2] - r[3] for r in rows if r[0]}:
                run = [r for r in rows if r[0] and r[2] - r[3] == offset]
                placed = len({(r[3], r[5]) for r in run if (r[0] == r[1] or not r[4]) and r[5] not in plain})
                if placed and placed + len(plain) >= min(6, n_places) and agreement(pairs(run))[0] >= 1:
                    runs.append(agreement(pairs(run)))
            agreed = None
            if len({r[5] for r in first}) >= min(6, n_windows) and (len(plain) >= min(6, n_windows) or pooled[0] >= 1):
                agreed = pooled
            elif len({r[6] for r in equal}) >= min(6, n_valued):
                agreed = same
            elif runs:
                agreed = max(runs)
            if agreed:
                out[doc, item] = (len({r[5] for r in rows}), n_windows, agreed[1], agreed[0], agreed[2])
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_slots, r.consistency, r.reparameterised) for r in df.collect()}


def test_query_equals_the_plain_rules(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = judged([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert found(queries.op1_template_decontamination(spark, SF)) == want and want


def test_random_items_equal_the_plain_rules(spark):
    """Few words, so that templates repeat; items short and long, copied whole, in part, with other values and in other case."""
    rng = random.Random(12)
    word = lambda: rng.choice(["box", "red", "Anna", "Boris", "12", "7 kg", "3.5", "sells", "the", "of", "met", "a"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 5, 7, 8, 9, 14, 25]))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for i in range(150):
        body = rng.choice(items)[1] or ""
        change = rng.choice([lambda x: x, str.upper, str.lower, lambda x: x.replace("12", "40").replace("Anna", "Clara"), lambda x: x.replace("7", "9", 1), lambda x: x[len(x) // 4 :]])
        docs.append((i, f"{text(rng.choice([0, 0, 5]))} {change(body)} {text(rng.choice([0, 0, 5]))}".strip()))
    docs += [(200, None), (201, ""), (202, docs[0][1] + " x" * 50_000), (203, docs[1][1]), (203, docs[1][1])]
    got = found(decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = judged(docs, items)
    assert got == want and len({i for _, i in want}) > 20
