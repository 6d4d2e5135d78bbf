"""Lexical and vector duplicates against a collection of cards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import text_blocks, word_blocks
from .ratio import Ratio
from .vectors import near_matches, top_matches

GATE = 0.6
#: Meetings that a text asks for at most, the price of a comparison in joined rows, texts of a block at most.
MATCHES, COMPARED, SALTED = 6, 16, 20_000
# The characters of normalised texts.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float, distinct: bool = False) -> DataFrame:
    """left_id, right_id, jaccard of texts (rep, norm) whose word sets reach the threshold; distinct: of equal texts of a side that of the smallest rep alone.

    Words are ordered rarest first, and two texts are compared if they share
    enough words among their first ones (word_blocks.alike()). Each text asks
    for as many meetings as cost it least: a short one whose last words are
    common for few, so that these stay out of the join, a long one for more.
    Sets are compared whole, as hashes. A word of more than SALTED texts is
    dealt over several blocks.
    """
    return word_blocks.alike_pairs(*word_blocks.word_blocks(left, right, threshold, distinct, SALTED, MATCHES, COMPARED), threshold)


def jaccard_candidates(left: DataFrame, right: DataFrame, threshold: float) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """l_id, r_id of the pairs that jaccard_join() compares, and the blocks of both sides."""
    blocks = word_blocks.word_blocks(left, right, threshold, False, SALTED, MATCHES, COMPARED)
    return word_blocks.alike_pairs(*blocks, threshold, compare=False).select(F.col("left_id").alias("l_id"), F.col("right_id").alias("r_id")), blocks


def character_counts(text: Column) -> Column:
    """How often each of CHARACTERS occurs, all others together last."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in CHARACTERS]
    return F.array(*counts, F.length(text) - sum(counts[1:], counts[0]))


def ratio_bound(x: Column, y: Column) -> Column:
    """Of two arrays of character_counts(): what the matching-blocks ratio cannot exceed, as matching characters are common ones."""
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, c: n + c)
    return 2.0 * size(F.zip_with(x, y, lambda a, b: F.least(a, b))) / (size(x) + size(y))


def _bounds(l: np.ndarray, r: np.ndarray, x: pa.Array, y: pa.Array) -> np.ndarray:  # noqa: E741
    """ratio_bound() of many pairs."""
    x, y = (np.asarray(c.flatten(), np.int32).reshape(len(c), -1) for c in (x, y))
    return 2.0 * np.minimum(x[l], y[r]).sum(1) / (x.sum(1)[l] + y.sum(1)[r])


def ratio_candidates(left: DataFrame, right: DataFrame, threshold: float, distinct: bool = False) -> DataFrame:
    """left_id, right_id, x, y of the pairs that pass the word gate and the characters' bound: only these are compared in Python."""
    pairs = written(jaccard_join(left, right, GATE * threshold, distinct).select("left_id", "right_id"))
    return text_blocks.compared(pairs, left, right, character_counts, lambda l, r, x, y, _, __: _bounds(l, r, x, y), threshold - 1e-9, texts=True).drop("score")


def string_duplicates(left: DataFrame, right: DataFrame, threshold: float = 0.82, distinct: bool = False, first: bool = False) -> DataFrame:
    """left_id, right_id, ratio of texts (rep, norm) that pass the word gate and the ratio; distinct: as in jaccard_join(); first: of a left text some pairs, that of the smallest right_id among them."""
    def ratios(l: np.ndarray, r: np.ndarray, x: pa.Array, y: pa.Array, left_texts: pa.Array, right_texts: pa.Array) -> np.ndarray:  # noqa: E741
        out = np.zeros(len(l))
        near = np.flatnonzero(_bounds(l, r, x, y) >= threshold - 1e-9)  # the bound is difflib's quick_ratio() or above
        known: dict[int, Ratio] = {}  # of the second texts
        mine, done = left_texts.take(pa.array(l[near])).to_pylist(), -1
        for i, a in zip(near, mine, strict=True):
            if first and l[i] == done:
                continue
            if r[i] not in known:
                if not first or len(known) == 500:  # else all pairs of a second text are together
                    known.clear()
                known[r[i]] = Ratio(right_texts[r[i]].as_py())
            out[i] = known[r[i]](a, threshold)
            if out[i] >= threshold:
                done = l[i]
        return out

    pairs = written(jaccard_join(left, right, GATE * threshold, distinct).select("left_id", "right_id"))
    return text_blocks.compared(pairs, left, right, character_counts, ratios, threshold, first=first).withColumnRenamed("score", "ratio")


SIDES = (("prompt", "front"), ("answer", "back"))


def lexical_join(turns: DataFrame, cards: DataFrame, threshold: float, ratio: float | None = None, first: bool = False) -> DataFrame:
    """turn_id, card_id, side and score (word Jaccard; with ratio the matching-blocks ratio) of distinct texts on both sides.

    turns (turn_id, prompt, answer) and cards (card_id, front, back) hold
    normalised texts; a prompt is held against fronts, an answer against
    backs. Identifiers are the smallest of an equal text. Null and empty
    texts meet nothing. first: as in string_duplicates().
    """
    found = []
    for mine, theirs in SIDES:
        left, right = (df.select(F.col(key).alias("rep"), F.col(text).alias("norm")).where("norm != ''") for df, key, text in ((turns, "turn_id", mine), (cards, "card_id", theirs)))
        pairs = jaccard_join(left, right, threshold, distinct=True) if ratio is None else string_duplicates(left, right, ratio, True, first)
        found.append(pairs.toDF("turn_id", "card_id", "score").withColumn("side", F.lit(theirs)))
    return found[0].unionByName(found[1])


def lexical_duplicates(turns: DataFrame, cards: DataFrame, threshold: float = 0.82) -> DataFrame:
    """turn_id, is_duplicate and card_id (the smallest that it repeats, else null) for every turn: prompt like a front, or answer like a back."""
    hits = written(lexical_join(turns, cards, GATE * threshold, threshold, first=True).groupBy("turn_id", "side").agg(F.min("card_id").alias("card_id")))
    found = []
    for mine, theirs in SIDES:
        texts = written(turns.where(F.col(mine) != "").select("turn_id", F.unhex(F.sha2(F.col(mine), 256)).alias("digest")))  # texts themselves stay where they are
        own = hits.where(F.col("side") == theirs).select(F.col("turn_id").alias("rep"), "card_id")
        caught = texts.groupBy("digest").agg(F.min("turn_id").alias("rep")).join(own, "rep").select("digest", "card_id")
        found.append(texts.join(caught, "digest").select("turn_id", "card_id"))
    least = found[0].unionByName(found[1]).groupBy("turn_id").agg(F.min("card_id").alias("card_id"))
    return turns.select("turn_id").join(least, "turn_id", "left").select("turn_id", F.col("card_id").isNotNull().alias("is_duplicate"), "card_id")


def semantic_duplicates(queries: DataFrame, cards: DataFrame, threshold: float = 0.85, **names: str) -> DataFrame:
    """query_id, card_id, score, is_duplicate for every query that has a vector."""
    return top_matches(queries, cards, 1, **names).select("query_id", "card_id", "score", (F.col("score") >= threshold).alias("is_duplicate"))


def duplicate_turns(turns: DataFrame, cards: DataFrame, method: str = "string", string_threshold: float = 0.82, vector_threshold: float = 0.85, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """turn_id and method (string or semantic) of the turns that repeat a card.

    turns: turn_id, prompt, answer and, but for string, embedding; cards:
    card_id, front, back and embedding. hybrid compares vectors only for
    those that no text has caught. vectors: (turn_id, embedding) and (card_id,
    embedding) as tables of their own, so that no text is moved to its vector;
    those of other identifiers count for nothing.
    """
    if method not in ("string", "semantic", "hybrid"):
        raise ValueError(f"unknown method {method}")
    caught, rest = None, turns
    if method != "semantic":
        caught = lexical_duplicates(turns, cards, string_threshold).where("is_duplicate").select("turn_id", F.lit("string").alias("method"))
        caught = caught if method == "string" else written(caught)
        rest = turns.join(caught, "turn_id", "left_anti")
    if method == "string":
        return caught
    named = lambda df, key: df.select(F.col(key).alias("vec_id"), "embedding")
    if vectors is not None:
        rest, cards = vectors[0].join(rest.select("turn_id"), "turn_id", "left_semi"), vectors[1].join(cards.select("card_id"), "card_id", "left_semi")
    by_vector = near_matches(named(rest, "turn_id"), named(cards, "card_id"), vector_threshold).select(F.col("query_id").alias("turn_id"), F.lit("semantic").alias("method"))
    return by_vector if caught is None else caught.unionByName(by_vector)


def prune_turns(turns: DataFrame, cards: DataFrame, method: str = "string", string_threshold: float = 0.82, vector_threshold: float = 0.85, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """turns (with score) that repeat no card, best score first, ties by turn_id. vectors: as in duplicate_turns()."""
    found = duplicate_turns(turns, cards, method, string_threshold, vector_threshold, vectors).select("turn_id")
    return turns.join(found, "turn_id", "left_anti").orderBy(F.desc("score"), "turn_id")


def prune_conversations(turns: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Per conversation: its turns, duplicate_turns, non_duplicate_turns, and dropped where every turn is a duplicate."""
    def indexes(when: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when, F.col("turn_index"))))

    dup = F.coalesce("is_duplicate", F.lit(False))
    return turns.groupBy(key).agg(F.count("*").alias("turn_count"), indexes(dup).alias("duplicate_turns"), indexes(~dup).alias("non_duplicate_turns"), F.every(dup).alias("dropped"))


def flag_duplicates(cards: DataFrame, matches: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """cards (note_id, any other fields) with duplicate_flags from their best match (query_id, card_id, score)."""
    e = existing.select(F.col("note_id").alias("m_id"), F.col("deck").alias("m_deck"), F.substring("front", 1, 200).alias("m_front"), F.substring("back", 1, 200).alias("m_back"))
    m = matches.join(e, F.col("card_id") == F.col("m_id"), "left")
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    flags = F.struct(
        hit.alias("is_likely_duplicate"), F.coalesce(F.round("score", 4), F.lit(0.0)).alias("similarity_score"), F.lit(threshold).alias("threshold_used"),
        F.when(F.col("m_id").isNotNull(), F.struct(F.col("m_deck").alias("deck"), F.col("m_front").alias("front"), F.col("m_back").alias("back"))).alias("matched_card"),
    )
    return cards.join(m, cards["note_id"] == m["query_id"], "left").select(*[cards[c] for c in cards.columns], flags.alias("duplicate_flags"))

