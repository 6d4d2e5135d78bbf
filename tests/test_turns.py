import itertools

from convomill.operators import turns
from convomill.operators.turns import ASSISTANT_START


def plain_pairs(entries):
    """The pairing rules as a state machine."""
    out, user, replies, lead, seen = [], None, [], [], False

    def close():
        nonlocal user, replies
        if user is not None and replies:
            out.append((user, "\n\n".join(replies)))
        user, replies = None, []

    for role, text in entries:
        if role == "user":
            seen = True
            if lead:
                out.append((ASSISTANT_START, "\n\n".join(lead)))
                lead = []
            if user is not None and replies:
                close()
            if text:
                user = text if user is None else user + "\n\n" + text
        elif role == "assistant" and text:
            if user is not None:
                replies.append(text)
            elif not seen:
                lead.append(text)
    close()
    if lead:
        out.append((ASSISTANT_START, "\n\n".join(lead)))
    return out


def test_all_short_sequences(spark):
    kinds = [("user", "u"), ("user", ""), ("assistant", "a"), ("assistant", ""), ("tool", "t")]
    cases = [c for n in range(6) for c in itertools.product(kinds, repeat=n)]
    rows = [(f"{k:05d}", i, role, f"{text}{i}" if text else text, str(i)) for k, c in enumerate(cases) for i, (role, text) in enumerate(c)]
    got = {}
    for r in turns.pair_turns(spark.createDataFrame(rows, "path string, pos int, role string, text string, ts_raw string")).orderBy("path", "turn_index").collect():
        got.setdefault(r.path, []).append((r.prompt, r.answer))
    for k, c in enumerate(cases):
        want = plain_pairs([(role, f"{text}{i}" if text else text) for i, (role, text) in enumerate(c)])
        assert got.get(f"{k:05d}", []) == want, c


def test_non_content_messages(spark):
    rows = [("p", 0, "user", "q", "1"), ("p", 1, "assistant", '{"content_type":"thoughts"}', "2"), ("p", 2, "assistant", "real", "3"), ("p", 3, "user", "q2", "4"), ("p", 4, "assistant", '{"content_type":"Code"}', "5")]
    got = turns.pair_turns(spark.createDataFrame(rows, "path string, pos int, role string, text string, ts_raw string")).orderBy("turn_index").collect()
    assert [(r.answer, r.user_ts, r.assistant_ts) for r in got] == [("real", "1", "3"), ('{"content_type":"Code"}', "4", "5")]


def test_transcripts(spark):
    text = "# My title\n\n- URL: https://x.y/z\n- Title: Other\n- no colon\n\n---\n\ndropped\n[2025-01-01 10:00] Human:\nHello\nthere\n\n[t2] assistant:\nHi\n[x] system:\nstill body\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", "# Only header")], "path string, value string")
    parts = turns.transcript_parts(files)
    meta = {(r.path, r.key): r.value for r in turns.transcript_metadata(parts).collect()}
    assert meta == {("a.md", "title"): "Other", ("a.md", "url"): "https://x.y/z", ("b.md", "title"): "Only header"}
    entries = turns.parse_entries(parts).orderBy("entry").collect()
    assert [(r.role, r.ts_raw, r.text) for r in entries] == [("user", "2025-01-01 10:00", "Hello\nthere"), ("assistant", "t2", "Hi\n[x] system:\nstill body")]
