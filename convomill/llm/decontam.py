"""Benchmark decontamination by template windows [native].

A text's template has typed placeholders for its numbers, names (capitalised
words inside a sentence) and units (unit words after a number); case and
punctuation fall away. Windows of WINDOW template tokens of documents and
benchmark items are joined on their hash. A document is contaminated by an
item if enough distinct windows of the item match and the slots agree: what
the item's equal values became in the document must be equal too, so a
re-parameterised question is found and a chance meeting of placeholders isn't.
Texts with names have a second form in which these are words as others, so a
copy in another case is found; and an item's first token has the forms that it
may take after other text.
The slots are held against each other over all places at once, over the
windows that are equal with their values, and over each aligned run (the places
of one offset between document and item); one of the three is enough.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: WINDOW is what three doublings give.
WINDOW, MIN_WINDOWS, MIN_LITERALS, MIN_CONSISTENCY = 8, 6, 4, 1.0
#: Items of SHORTEST tokens at least are looked for inside documents; shorter ones are met by equal whole documents only.
SHORTEST = 4
SEND_TO_ALL = 2_000_000
# Unit words.
UNITS = "mm|cm|m|km|mg|g|kg|lb|lbs|oz|ml|l|s|sec|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|inch|inches|feet|ft|miles?|meters?|metres?|grams?|liters?|litres?|dollars?|euros?|cents?|percent|degrees?"
_NUMBER = r"(?<![\p{L}\p{N}])[$€£]?[0-9]+(?:[.,:/][0-9]+)*%?(?![\p{L}\p{N}])"
_NAME = r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
_UNIT = rf"(?<=[0-9] )((?i:{UNITS}))(?![\p{{L}}\p{{N}}])"
NUM, NAME, UNIT = "\ue001", "\ue002", "\ue003"


def valued_tokens(text: Column, before: str = "") -> Column:
    """Tokens in lower case; a placeholder is its mark followed by the value it stands for. Texts without digits are spared the patterns that need one. before: a token that the text is taken to follow."""
    body = F.concat(F.lit(f"{before} "), text) if before else text
    names = F.regexp_replace(body, _NAME, f"{NAME}$1")
    counted = F.regexp_replace(F.regexp_replace(body, _UNIT, f"{UNIT}$1"), _NAME, f"{NAME}$1")
    counted = F.regexp_replace(F.lower(F.regexp_replace(counted, _NUMBER, f" {NUM}$0 ")), r"(?<=[0-9])[.,:/](?=[0-9])", "\ue004")  # one value stays one token
    body = F.when(body.rlike("[0-9]"), counted).otherwise(F.lower(names))
    body = F.trim(F.regexp_replace(body, r"[^\p{L}\p{N}\ue001-\ue004]+", " "))
    return F.regexp_replace(body, r"^\S+ ?", "") if before else body


def windows(docs: DataFrame, text: str, *keep: Column, lengths: Iterable[int] = (), before: str = "") -> DataFrame:
    """keep, form, h, slots, place (from 0), len and inner for each window of each text; a text of fewer than WINDOW tokens is one window. inner: further windows, of the lengths given (SHORTEST to WINDOW - 1). form: 1 where names are words as others, of texts with names.

    A window's hash is built by doubling: of tokens, of pairs, of fours, of
    eights; so each array is passed over once. What a row carries on does not
    grow with its text. Slots are looked for in texts that have any.
    """
    def doubled(h: str, by: int) -> Column:
        return F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))

    def overlapped(fours: str, k: int) -> Column:
        return F.zip_with(fours, F.slice(fours, k - 3, F.size(fours)), lambda x, y: F.xxhash64(x, y, F.lit(k)))

    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("body"))
    names = d.columns[:-1]
    marked = F.col("body").contains(NUM) | F.col("body").contains(NAME) | F.col("body").contains(UNIT)
    d = d.withColumn("body", F.when(marked, F.regexp_replace("body", "[\ue001-\ue003]", " ")).otherwise(F.col("body")))
    d = d.select(*names, valued_tokens(F.col("body"), before).alias("valued"))
    forms = F.when(F.col("valued").contains(NAME), F.array("valued", F.translate("valued", NAME, ""))).otherwise(F.array("valued"))
    d = d.select(*names, F.posexplode(forms).alias("form", "valued"))
    names = [*names, "form"]
    d = d.withColumn("some", F.col("valued").rlike("[\ue001-\ue003]"))
    template = F.when(F.col("some"), F.regexp_replace("valued", "([\ue001-\ue003])\\S+", "$1")).otherwise(F.col("valued"))
    d = d.withColumns({"v": F.when(F.col("some"), F.split("valued", " ")), "h": F.transform(F.filter(F.split(template, " "), lambda x: x != ""), lambda x: F.xxhash64(x))}).drop("valued")
    # a filter would be pushed below and have all patterns run once more; texts without a window have a null array instead
    n = F.when(F.size("h") > 0, F.greatest(F.size("h") - WINDOW + 1, F.lit(1)))
    d = d.withColumns({"size": F.size("h"), "n": n, "len": F.least(F.size("h"), F.lit(WINDOW))})
    for by in (1, 2):
        d = d.withColumn("h", doubled("h", by))
    lengths = list(lengths)
    d = d.withColumns({f"h{k}": overlapped("h", k) for k in lengths} | {"h": doubled("h", 4)})
    none = F.array().cast("array<string>")

    def placed(h: str, n: Column, length: Column, inner: bool) -> Column:
        h = F.when(n > 0, F.slice(h, 1, F.greatest(n, F.lit(0))))
        marks = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.filter(F.slice("v", i, length), lambda x: x.rlike("^[\ue001-\ue003]")))
        found = F.when(F.col("some") & (n > 0), F.zip_with(h, marks, lambda h, s: F.struct(h.alias("h"), s.alias("slots")))).otherwise(F.transform(h, lambda h: F.struct(h.alias("h"), none.alias("slots"))))
        return F.transform(found, lambda x, i: F.struct(x["h"].alias("h"), x["slots"].alias("slots"), i.alias("place"), length.alias("len"), F.lit(inner).alias("inner")))

    found = placed("h", F.col("n"), F.col("len"), False)
    if lengths:
        every = [found, *(placed(f"h{k}", F.col("size") - k + 1, F.lit(k), True) for k in lengths)]
        found = F.flatten(F.filter(F.array(*every), lambda x: x.isNotNull()))
    return d.select(*names, F.inline(found))


def benchmark_index(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """The places of the items' windows in all forms: h, item_id, islots, at, len, inner, poor; window (the first place of the hash), valued (the first place of the hash with these slots); and the item's counts of them: item_windows, item_valued, item_places.

    Windows of few literal tokens are left out where the item has others.
    Without slots a repeated window has one row. An item of SHORTEST to
    WINDOW - 1 tokens has two hashes, as a whole text and as an inner window.
    """
    forms = lambda before: windows(benchmark, text, F.col(key).cast("long").alias("item_id"), lengths=range(SHORTEST, WINDOW), before=before).withColumnsRenamed({"slots": "islots", "place": "at"})
    w = forms("").withColumn("base", (F.col("form") == 0) & ~F.col("inner"))
    for before in ("a", "1"):  # what makes a name or a unit of the first token
        w = w.unionByName(forms(before).where("at = 0").withColumn("base", F.lit(False)))
    w = w.join(w.groupBy("item_id").agg(F.max("len").alias("longest")), "item_id").where("len = longest").drop("longest", "form")
    w = w.withColumn("poor", F.col("len") - F.size("islots") < MIN_LITERALS).distinct()
    w = written(w)  # the plan of what follows would repeat all this
    base = w.where("base").select("item_id", "h", "islots", "at", "poor")
    first = base.groupBy("item_id", "h").agg(F.min("at").alias("window"))
    valued = base.groupBy("item_id", "h", "islots").agg(F.min("at").alias("valued"))
    least = base.groupBy("item_id").agg(F.min("poor").alias("least"))
    base = base.join(least, "item_id").where("poor = least").join(first, ["item_id", "h"]).join(valued, ["item_id", "h", "islots"])
    once = (F.size("islots") > 0) | (F.col("at") == F.col("valued"))
    counts = base.where(once).groupBy("item_id").agg(F.countDistinct("window").alias("item_windows"), F.countDistinct("valued").alias("item_valued"), F.countDistinct("at").alias("item_places"))
    w = w.drop("base").distinct().join(base.select("item_id", "at", "window", "valued"), ["item_id", "at"])
    return w.where(once).join(counts, "item_id")


def _agreement(pairs: Column) -> Column:
    """consistency (1 where each item value has one document value and the other way round), n_slots and reparameterised of distinct pairs of values."""
    values, others = (F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) for side in ("i", "d"))
    consistency = F.when(F.size(pairs) > 0, F.least(values, others) / F.size(pairs)).otherwise(F.lit(1.0))
    return F.struct(consistency.alias("consistency"), values.cast("long").alias("n_slots"), F.exists(pairs, lambda p: p["i"] != p["d"]).alias("reparameterised"))


def _distinct(lists: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(lists)))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document and item that meet: doc_id, text_hash, item_id, n_windows, item_windows, n_slots, consistency, reparameterised.

    Needs MIN_WINDOWS distinct windows (all, of an item with fewer), and where
    placeholders are needed to reach them, slots of MIN_CONSISTENCY at least,
    over all places or over an aligned run; or as many windows with the
    item's own values. The last three columns are of all places where these
    agree, else of the equal windows, else of the best run.
    An item of fewer than WINDOW tokens is met by an equal whole document and,
    from SHORTEST tokens on, inside any document (there with its own values,
    where it has few literal tokens).
    Null and empty texts and items meet nothing. Copies and repeated rows meet alike, with a
    row per identifier and text. Columns named like ours do not matter.
    """
    index = written(benchmark_index(benchmark))
    few = index.count() <= SEND_TO_ALL
    body = F.coalesce(F.col(text), F.lit(""))
    lengths = sorted(r.len for r in index.where("inner").select("len").distinct().collect())  # WINDOW - SHORTEST at most
    w = windows(docs, text, F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), lengths=lengths).drop("form", "len", "inner")
    met = w.join(F.broadcast(index) if few else index, "h").where(F.size("slots") == F.size("islots"))
    met = met.where(~F.col("inner") | ~F.col("poor") | (F.col("slots") == F.col("islots")))
    pairs = F.zip_with("islots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    first, equal = F.col("at") == F.col("window"), F.col("islots") == F.col("slots")
    run = F.when(F.size("slots") > 0, F.col("place") - F.col("at"))  # null: windows without slots, which count for every run
    whole = ["doc_id", "text_hash", "item_id", "item_windows", "item_valued", "item_places"]
    per = met.groupBy(*whole, run.alias("run")).agg(
        F.collect_set("window").alias("met"), F.collect_set(F.when(first, F.col("window"))).alias("met_first"), F.collect_set(F.when(equal, F.col("valued"))).alias("met_equal"), F.collect_set(F.when(equal | ~F.col("poor"), F.struct("at", "window"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(F.when(first, pairs)))).alias("pairs_first"), F.array_distinct(F.flatten(F.collect_set(F.when(equal, pairs)))).alias("pairs_equal"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    got = per.groupBy(*whole).agg(
        F.size(_distinct("met")).alias("n_windows"), F.size(_distinct("met_first")).alias("n_first"), F.size(_distinct("met_equal")).alias("n_equal"), F.flatten(F.collect_list(F.when(F.col("run").isNull(), F.col("met")))).alias("plain"),
        _distinct("pairs_first").alias("pairs_first"), _distinct("pairs_equal").alias("pairs_equal"), F.collect_list(F.when(F.col("run").isNotNull(), F.struct("places", _agreement(F.col("pairs")).alias("agreement")))).alias("runs"),
    )
    needed = lambda of: F.least(F.lit(MIN_WINDOWS), F.col(of))
    pooled, same = _agreement(F.col("pairs_first")), _agreement(F.col("pairs_equal"))
    placed = lambda r: F.size(F.filter(r["places"], lambda x: ~F.array_contains("plain", x["window"])))
    runs = F.filter("runs", lambda r: (placed(r) > 0) & (placed(r) + F.size("plain") >= needed("item_places")) & (r["agreement"]["consistency"] >= MIN_CONSISTENCY))
    agreed = F.when((F.col("n_first") >= needed("item_windows")) & ((F.size("plain") >= needed("item_windows")) | (pooled["consistency"] >= MIN_CONSISTENCY)), pooled)
    agreed = F.coalesce(agreed, F.when(F.col("n_equal") >= needed("item_valued"), same), F.array_max(F.transform(runs, lambda r: r["agreement"])))
    return got.withColumn("agreed", agreed).where("agreed is not null").select("doc_id", "text_hash", "item_id", F.col("n_windows").cast("long"), "item_windows", "agreed.n_slots", "agreed.consistency", "agreed.reparameterised")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the contaminated ones; columns as they are, whatever their names.

    Null and empty texts stay, copies and repeated rows go alike; where docs
    or benchmark are empty, all stay.
    """
    found = contaminated(docs, benchmark, text, key).select("text_hash").distinct()
    names = docs.columns
    own = next(c for c in (f"hash_{i}" for i in range(len(names) + 1)) if c not in names)
    return docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(found.withColumnRenamed("text_hash", own), own, "left_anti").select(*names)
