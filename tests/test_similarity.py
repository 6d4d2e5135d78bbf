from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from convomill.operators import similarity
from convomill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_jaccard_join_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:60])], "rep int, norm string")
    right = spark.createDataFrame([(i, t) for i, t in enumerate(texts[60:])], "rep int, norm string")
    j = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = {(i, k) for i, a in enumerate(texts[:60]) for k, b in enumerate(texts[60:]) if j(a, b) >= 0.5}
    assert {(r.left_id, r.right_id) for r in similarity.jaccard_join(left, right, 0.5).collect()} == want
    ratios = {(i, k) for i, k in want if SequenceMatcher(None, texts[i], texts[60 + k]).ratio() >= 0.8333}
    got = similarity.string_duplicates(left, right, 0.8333).collect()
    assert {(r.left_id, r.right_id) for r in got} <= ratios | want and {(r.left_id, r.right_id) for r in got} >= {p for p in ratios if p in want}


def test_short_prompts_meet_in_proportion_to_what_is_found(spark):
    """Ten-word prompts, four of whose words all share: the common words stay out of the join, and none of the pairs is lost."""
    n = 100_000
    common = ["what", "is", "the", "of"]
    word = lambda seed: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(40_000)).cast("string"))
    base = spark.range(n).select("id", F.concat_ws(" ", *map(F.lit, common), *[word(i) for i in range(6)]).alias("norm"))
    left = base.where("id % 2 = 0")
    copies = left.where("id % 50 = 0").select((F.col("id") + 1_000_000).alias("id"), F.concat(F.expr("substring_index(norm, ' ', 9)"), F.lit(" changed")).alias("norm"))
    right = base.where("id % 2 = 1").unionByName(copies)
    sides = [x.withColumnRenamed("id", "rep") for x in (left, right)]
    pairs, _ = similarity.jaccard_candidates(*sides, 0.6)
    found = similarity.jaccard_join(*sides, 0.6)
    got = {(r.left_id, r.right_id) for r in found.collect()}
    assert {(i, i + 1_000_000) for i in range(0, n, 50)} <= got and all(r < 1_000_000 or r - 1_000_000 == l for l, r in got if l % 50 == 0)
    assert pairs.count() < 5 * len(got)


def test_hot_words_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SALTED", 50)
    texts = [f"hot {'warm ' * (i % 2)}x{i % 40}" for i in range(400)]
    left, right = (spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 3 == k], "rep int, norm string") for k in (0, 1))
    j = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = {(i, k) for i, a in enumerate(texts) for k, b in enumerate(texts) if i % 3 == 0 and k % 3 == 1 and j(a, b) >= 0.45}
    assert {(r.left_id, r.right_id) for r in similarity.jaccard_join(left, right, 0.45).collect()} == want


def test_characters_bound_the_ratio(spark):
    """Never below the ratio, equal to difflib's own bound, and pairs below it never reach Python."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d1é") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(zip(texts[::2], texts[1::2], strict=True)), "x string, y string")
    bounded = df.withColumn("bound", similarity.ratio_bound(similarity.character_counts(F.col("x")), similarity.character_counts(F.col("y"))))
    for r in bounded.collect():
        m = SequenceMatcher(None, r.x, r.y)
        assert r.bound >= m.ratio() - 1e-12 and ("é" in r.x + r.y or abs(r.bound - m.quick_ratio()) < 1e-12)
    side = lambda k: spark.createDataFrame([(i, t) for i, t in enumerate(["one two three four abcdefgh", "one two three four xyzuvwst", "one two three four abcdefgi"]) if (i > 0) == k], "rep int, norm string")
    left, right = side(False), side(True)
    assert similarity.jaccard_join(left, right, 0.6 * 0.9).count() == 2 and similarity.ratio_candidates(left, right, 0.9).count() == 1
    assert {(r.left_id, r.right_id) for r in similarity.string_duplicates(left, right, 0.9).collect()} == {(0, 2)}


def test_vectors_flags_and_pruning(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    c = spark.createDataFrame([(10, [2.0, 0.1]), (11, [1.0, 1.0]), (12, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.card_id for r in similarity.top_matches(q, c, 2).collect()}
    assert got == {(1, 1): 10, (1, 2): 11, (2, 1): 11, (2, 2): 10}
    existing = spark.createDataFrame([(10, "d", "f" * 300, "b")], "note_id long, deck string, front string, back string")
    cards = spark.createDataFrame([(1, "keep"), (3, "blank")], "note_id long, extra string")
    flagged = {r.note_id: r for r in similarity.flag_duplicates(cards, similarity.top_matches(q, c, 1), existing, 0.85).collect()}
    assert flagged[1].extra == "keep" and flagged[1].duplicate_flags.is_likely_duplicate and len(flagged[1].duplicate_flags.matched_card.front) == 200
    assert not flagged[3].duplicate_flags.is_likely_duplicate and flagged[3].duplicate_flags.similarity_score == 0.0 and flagged[3].duplicate_flags.matched_card is None
    turns = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("c", 0, None)], "conversation_id string, turn_index int, is_duplicate boolean")
    pruned = {r.conversation_id: r for r in similarity.prune_conversations(turns).collect()}
    assert pruned["b"].dropped and not pruned["a"].dropped and pruned["a"].duplicate_turns == [0] and pruned["c"].non_duplicate_turns == [0]


def test_unequal_and_broken_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [None, 1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    c = spark.createDataFrame([(10, [2.0, 0.0]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.card_id) for r in similarity.top_matches(q, c, 2).collect()} == {(1, 10), (5, 10)}
    assert similarity.top_matches(q, c.limit(0), 2).count() == 0


def brute(turns, cards, threshold):
    """By the written rules: the word gate, then the matching-blocks ratio, on either side."""
    def like(a, b):
        x, y = set(a.split()), set(b.split())
        return bool(x and y) and len(x & y) / len(x | y) >= 0.6 * threshold and SequenceMatcher(None, a, b).ratio() >= threshold

    return {t.turn_id: min((c.card_id for c in cards if like(t.prompt, c.front) or like(t.answer, c.back)), default=None) for t in turns}


def test_duplicates_on_whole_tables_equal_brute_force(spark):
    turns, cards = catalog.turn_card_sides(spark, SF)
    want = brute(turns.collect(), cards.collect(), 0.82)
    got = catalog.QUERIES["lexical_dedup"](spark, SF).collect()
    assert {r.turn_id: r.card_id for r in got} == want and all(r.is_duplicate == (want[r.turn_id] is not None) for r in got) and len(got) == len(want)
    assert 0 < sum(v is not None for v in want.values()) < len(want)
    vectors = {r.query_id: r.is_duplicate for r in similarity.semantic_duplicates(turns.withColumnRenamed("turn_id", "vec_id"), cards.withColumnRenamed("card_id", "vec_id"), 0.3).collect()}
    hybrid = {k: "string" if v is not None else "semantic" for k, v in want.items() if v is not None or vectors.get(k)}
    assert {r.turn_id: r.method for r in catalog.QUERIES["hybrid_dedup"](spark, SF).collect()} == hybrid and set(hybrid.values()) == {"string", "semantic"}
    kept = catalog.QUERIES["prune_turns"](spark, SF).collect()
    assert {r.turn_id for r in kept} == set(want) - set(hybrid) and [(-r.score, r.turn_id) for r in kept] == sorted((-r.score, r.turn_id) for r in kept)
    assert similarity.prune_turns(turns, cards, "string").count() == sum(v is None for v in want.values())
    with pytest.raises(ValueError, match="unknown"):
        similarity.duplicate_turns(turns, cards, "other")
