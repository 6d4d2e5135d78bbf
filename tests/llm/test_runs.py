import hashlib
import random
import zlib

from convomill.llm import queries, runs

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def all_runs(w, least=12):
    """Every period of its own: maximal stretches that agree with themselves one period on, of at least two periods, that no smaller period has."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(least, 2 * p))


def digest(words):
    got = all_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in got)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(got, key=lambda r: (-r[1], r[0], r[2])) if got else None
    main = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(got), *main, sha("".join(f"{s},{n},{p}\n" for s, n, p in got)), sha(" ".join(kept)))


def naive_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def dense(w):
    rank = {v: i for i, v in enumerate(sorted(set(w)))}
    return [rank[x] for x in w]


def test_lyndon_array_equals_its_definition():
    rng = random.Random(1)
    for _ in range(3000):
        w = dense([rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 16))])
        assert runs.lyndon_array(w) == naive_lyndon(w)


def words_in(rng, n):
    """Random words with planted repetitions, some of them inside others."""
    w = [rng.choice("abc") for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        at, p, times = rng.randrange(n + 1), rng.randint(1, 9), rng.randint(2, 5)
        w[at:at] = (w[at : at + p] or ["a"]) * times
    return w


def test_runs_equal_brute_force():
    rng = random.Random(2)
    texts = [words_in(rng, rng.randint(0, 60)) for _ in range(1500)] + [["a"] * 200, ["a", "b"] * 100, [], ["x"]]
    for least in (4, 12):
        got = runs.text_runs([[w.encode() for w in t] for t in texts], least)
        assert got == [all_runs(t, least) for t in texts]


def test_odd_rows(spark):
    long = [f"w{i}" for i in range(30_000)]
    texts = [None, "", " \n\t", "a\x0bb\x0ca\rb " * 8, "é ü " * 9, "a b " * 12, " ".join(long * 3), "a " * 11, "a " * 12, "a " * 12]
    rows = [(i, t, 1, "k", i) for i, t in enumerate(texts)] + [(None, "x y " * 6, 1, "k", 0), (3, texts[3], 1, "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, collapsed string, key int")
    found = runs.periodic_runs(df)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted((str(r.doc_id), *[r[c] for c in COLUMNS]) for r in runs.run_digest(found).collect())
    want = []
    for r in rows:
        w = [x.decode() for x in runs.words_of(r[1])]
        want.append((str(r[0]), *(digest(w) if len(w) < 1000 else (1, 0, 90_000, 30_000, 3000, hashlib.sha256(b"0,90000,30000\n").hexdigest(), hashlib.sha256(" ".join(long).encode()).hexdigest()))))
    assert got == sorted(want)
    assert runs.run_digest(runs.periodic_runs(df.limit(0))).count() == 0


def test_query_equals_brute_force(spark):
    """All documents of sf0.001, rewritten as the query says."""
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = [x.decode() for x in runs.words_of(r.text)]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        want[r.doc_id] = digest(w)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_baier_runs(spark, SF).collect()}
    assert got == want and any(v[0] for v in want.values())
