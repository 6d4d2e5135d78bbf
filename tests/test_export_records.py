import json
import random

import pytest
from pyspark.sql import functions as F

from convomill.sources import exports


def mapping(i, text):
    return {"id": f"m{i}", "title": "T", "mapping": {"a": {"message": {"id": "a", "author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": [text]}}}}}


def messages(i, text):
    return {"uuid": f"u{i}", "name": "N", "chat_messages": [{"sender": "human", "created_at": "2025-01-01T00:00:00Z", "content": [{"type": "text", "text": text}]}]}


TEXTS = ["plain", 'quote " and \\ and {"a": [1]}, {', "},{\"title\":", "\\\\\\", "é日😀", "[]{}", "line\nend\t", "x" * 500, '","}]']


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("shape", ["array", "indented", "lines"])
def test_any_split_gives_all_records(spark, tmp_path, split, shape):
    """Ranges start in texts, escapes, characters and between records."""
    records = [(mapping, messages)[i % 2](i, TEXTS[i % len(TEXTS)]) for i in range(20 if split > 7 else 4)]
    if shape == "lines":
        body = "\n".join(json.dumps(r, ensure_ascii=False) for r in records)
    else:
        body = "﻿" * (split == 64) + json.dumps(records, indent=1 if shape == "indented" else None, ensure_ascii=shape == "array")
    (tmp_path / "a.json").write_text(body, encoding="utf-8")
    (tmp_path / "b.json").write_text("[]")
    got = exports.export_records(spark, tmp_path.as_uri(), split).orderBy("start").collect()
    assert [r.error for r in got] == [None] * len(records) and [json.loads(r.record) for r in got] == records
    data = body.encode()
    assert all(data[r.start :].startswith(r.record.encode()) for r in got)


def test_cuts_on_random_files(spark):
    """The second pass alone, from every place, with what a plain reading says stands open there."""
    rng = random.Random(7)
    for _ in range(40):
        records = [mapping(i, "".join(rng.choice('a"\\{}[],:é ') for _ in range(rng.randint(0, 12)))) for i in range(rng.randint(0, 4))]
        data = json.dumps(records, ensure_ascii=rng.random() < 0.5).encode()
        places = sorted({0, len(data), *[rng.randrange(len(data) + 1) for _ in range(6)]})
        depth, inside, escaped, state = 0, False, False, {}
        for i, b in enumerate(data):
            state[i] = (depth, inside, escaped)
            if inside:
                inside, escaped = (b != 34 or escaped), b == 92 and not escaped
            else:
                inside, depth = b == 34, depth + (b in b"[{") - (b in b"]}")
        found = []
        for a, z in zip(places, places[1:], strict=False):
            p = exports.Range("", a, z, *state[a][:2], 1)
            cut, closed = exports._cut(data[a:z], p, state[a][2])
            if not closed:
                cut, closed = exports._cut(data[a:], p, state[a][2])
            assert closed
            found += [json.loads(text) for _, text, error in cut if not error]
            assert not [error for *_, error in cut if error]
        assert found == records


def test_bad_records_are_reported_and_cost_no_other(spark, tmp_path):
    good = [mapping(1, "one"), messages(2, "two")]
    body = f'[{json.dumps(good[0])}, 17, "text", {{"other": 1}}, {{"id": }}, null, {json.dumps(good[1])}, {{"id": "cut'
    (tmp_path / "a.json").write_text(body)
    for split in (16, 1 << 20):
        rows, errors = exports.read_messages(spark, tmp_path.as_uri(), split)
        assert sorted((r.conversation_id, r.role, r.text) for r in rows.collect()) == [("m1", "user", "one"), ("u2", "human", "two")]
        said = [r.error for r in errors.collect()]
        assert any(e.startswith("not closed") for e in said) and "no JSON" in said and "of no known dialect" in said and any("null" in e for e in said) and any("17" in e or "7" in e for e in said)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([mapping(i, "x" * 200) for i in range(300)]))
    x = exports.export_records(spark, tmp_path.as_uri(), 4096)
    tasks = x.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) > 10 and sum(r["count"] for r in tasks) == 300
