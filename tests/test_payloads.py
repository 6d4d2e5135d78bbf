import json

import pytest
from pyspark.sql import functions as F

from convomill.operators import payloads

DEEP = '{"a":' * 5000 + "1" + "}" * 5000
TEXTS = [
    '{"a": 1}', ' \n{"a": [1, {"b": "}"}]}\n', '```json\n{"a": 1}\n```', "```\n{}\n```", '{"a": "\\alpha \\n"}', 'Here: {"a": 1} and {"b": 2}', '[{"a": 1}]', 'x [1] {"a": 1}', '{"a": 1} tail', '{"a": 1}{"b": 2}',
    '{"a": 1}] {"b"}', '{"a": 1}]}', '{"a": 1}, {"b": 2}', '{"a": 1}}', '{"a": NaN}', '{"a": 1, "a": 2}', "{'a': 1}", '{"a": "\\ud83d"}', '{"a": "\\ud83d\\ude00 é"}', '{"a": "x\ny"}', "", None, "no json", "{", '{"a": {"b": [', DEEP, '```json\n{"a": "\\q"}\n```', '{"a": 1.0e400}',
]


def test_responses_equal_the_readings_in_order(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, response string")
    got = {r.i: r for r in payloads.parse_responses(df).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want, error = payloads.first_object(text)
        assert (got[i].parsed is None) == (want is None) and (got[i].error is None) == (want is not None), text
        if want is not None:
            assert str(json.loads(got[i].parsed)) == str(json.loads(want)), text


def test_well_formed_responses_do_not_reach_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:5])], "i int, response string")
    assert df.withColumn("parsed", payloads.plain_object(F.col("response"))).where("parsed is null").count() == 0


@pytest.mark.parametrize(
    ("cards", "want"),
    [
        ('[{"front": "a"}, "text", null, 3, {"front": "b", "extra": 1}]', [(0, "a", None, None, None), (4, "b", None, None, None)]),
        ('[{"front": "a", "turn_index": "3", "confidence": "0.5", "tags": "x, y,"}]', [(0, "a", 3, 0.5, ["x", "y"])]),
        ('[{"front": "a", "turn_index": "many", "confidence": [], "tags": ["x ", "", 7]}]', [(0, "a", None, None, ["x", "7"])]),
        ('[{"front": 5, "tags": null}]', [(0, "5", None, None, None)]),
        ("[]", []), ('"none"', []), ("null", []), ('{"front": "a"}', []),
    ],
)
def test_one_bad_card_costs_no_other(spark, cards, want):
    df = spark.createDataFrame([(1, f'{{"cards": {cards}}}')], "id int, parsed string")
    got = [(r.card_index, r.front, r.turn_index, r.confidence, r.tags) for r in payloads.explode_cards(df, ["id"]).collect()]
    assert got == want
