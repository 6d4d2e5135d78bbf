import random

from convomill.llm import decontam


def items():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    plain = [(i, text(20 + i)) for i in range(10)]
    asked = [(100, "a farmer called Maria sells 12 boxes of 30 kg each to the market and keeps 12 for her friend Maria how much does she sell"), (101, "short item of five"), (102, None), (103, "")]
    return text, plain, asked


def test_finds_passages_and_changed_parameters(spark):
    text, plain, asked = items()
    swapped = "so a farmer called Elena sells 7 boxes of 55 lbs each to the market and keeps 7 for her friend Elena how much does she sell, thanks"
    broken = "so a farmer called Elena sells 7 boxes of 55 lbs each to the market and keeps 9 for her friend Boris how much does she sell, thanks"
    rows = [(i, f"{text(50)}. {t.upper()}!! {text(30)}", i) for i, t in plain]
    rows += [(50, text(4000)), (51, swapped), (52, broken), (53, "It was a short item of five, yes"), (54, None), (55, ""), (56, text(3)), (57, " ".join(plain[0][1].split()[:10]) + " " + text(20)), (58, " ".join(plain[3][1].split()[2:18])), (None, plain[2][1])]
    rows = [(r[0], r[1], 5) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, 1) for x in plain + asked], "item_id long, text string, pos int")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) >= {(i, i) for i, _ in plain} | {(51, 100), (58, 3), (None, 2)}
    assert {d for d, _ in got} == {*range(10), 51, 53, 58, None} and (53, 101) in got
    assert got[51, 100].reparameterised and got[51, 100].consistency == 1.0 and not got[3, 3].reparameterised
    kept = {r.doc_id for r in decontam.decontaminated(docs, bench).collect()}
    assert kept == {50, 52, 54, 55, 56, 57}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, bench).count() == 0 and decontam.decontaminated(docs, bench).count() == 1
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_clashing_names(spark):
    _, plain, _ = items()
    names = ["text_hash", "item_id", "h", "hash_0", "item_windows", "slots"]
    docs = spark.createDataFrame([(i, t if i < 5 else t[:20], *["x"] * len(names)) for i, t in plain], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in names]]))
    bench = spark.createDataFrame([(*x, "y") for x in plain], "item_id long, text string, text_hash string")
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, 8, 9}


def test_slots_agree_in_both_directions(spark):
    asked = "a driver needs 12 litres for 90 miles and then 12 litres for 40 miles on the way back home"
    bench = spark.createDataFrame([(1, asked)], "item_id long, text string")
    swap = lambda a, b, c, d: asked.replace("12 litres for 90", f"{a} litres for {b}").replace("12 litres for 40", f"{c} litres for {d}")
    rows = [(1, swap(7, 55, 7, 31)), (2, swap(7, 55, 8, 31)), (3, swap(7, 7, 7, 7)), (4, asked), (5, swap(90, 12, 90, 41))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {1, 4, 5}


def test_repeated_templates(spark):
    priced = lambda rows: " and ".join(f"the price of box {a} is {b} coins" for a, b in rows)
    item = priced([(1, 10), (2, 20), (3, 30), (4, 40)])
    once = "a farmer sells 12 boxes of 30 apples each to the market and keeps 12 for the long winter months"
    others = [once.replace("12", str(100 + i)).replace("30", str(200 + i)) for i in range(9)]
    counted = " ".join(str(i) for i in range(1, 51))
    rows = [(1, f"see here: {item}."), (2, ". ".join(others)), (3, ". ".join([*others, once])), (4, priced([(7, 71), (8, 82), (9, 93), (6, 64)])), (5, counted), (6, " ".join(str(i * i) for i in range(900, 990))), (7, item.replace("coins and the price of box 3", "coins and so the price of box 3")), (8, priced([(1, 5)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, once), (3, counted)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 3), (7, 1)}
    assert not got[1, 1].reparameterised and not got[3, 2].reparameterised and got[2, 2].reparameterised and got[2, 2].consistency == 1.0


def test_short_items(spark):
    lead = "this long page has some words before the question and many after it"
    bench = spark.createDataFrame([(1, "Name the longest river of all"), (2, "Why so?"), (3, "What is 3 plus 9?"), (4, "please count all 30 red apples twice"), (5, "name the longest river")], "item_id long, text string")
    rows = [(1, "name the longest river of ALL!"), (2, f"{lead}: name the longest river of all? {lead}"), (3, "why so"), (4, f"{lead} why so {lead}"), (5, "What is 4 plus 7?"), (6, f"{lead} what is 4 plus 7 {lead}"), (7, f"{lead} what is 3 plus 9 {lead}"), (8, f"{lead} please count all 55 red apples twice"), (9, "name the longest river of"), (10, "what is plus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 5), (3, 2), (5, 3), (7, 3), (8, 4), (9, 5)}


def test_other_case_and_context(spark):
    asked = "What is the capital city of the old northern kingdom today?"
    named = "yesterday Maria and her brother Jonas met old Pedro near the harbour, Anna waited for 12 Hours with Boris"
    bench = spark.createDataFrame([(1, asked), (2, named), (3, "Hours of rain and wind fell upon the quiet town")], "item_id long, text string")
    rows = [(1, f"some lead text {asked}"), (2, asked.upper()), (3, f"so {named.lower()} there"), (4, named.upper()), (5, named), (6, named.replace("Maria", "Elena").replace("Jonas", "Peter")), (7, "it had 5 hours of rain and wind fell upon the quiet town"), (8, named.lower().replace("maria", "elena").replace("the harbour", "a lake").replace("jonas", "ben")), (9, f"Some lead. {asked}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 3), (9, 1)}
    assert {k for k, r in got.items() if r.reparameterised} == {(6, 2)}
    assert all(r.n_windows == r.item_windows for (d, _), r in got.items() if d != 6)
