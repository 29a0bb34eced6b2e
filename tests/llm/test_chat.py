import hashlib
import random
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from waymark.llm import chat, queries


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"\\<|>/s[]INST end turn\né", *chat.CONTROL_OPENINGS, chat.TURN_END]), max_size=40))
def test_escape_is_reversible(pieces):
    text = "".join(pieces)
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL_OPENINGS)
    assert chat.read_turn(chat.format_turn(text, text)[0]) == (text, text)


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_edge_rows_and_examples(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "[INST]c\\"), (2, 0, "user", "only"), (None, 0, None, "x"), (None, None, "assistant", "y"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == brute(rows)
    examples = sorted(chat.render_examples(formatted).filter("conv_id = 1").collect(), key=lambda r: r.example)
    assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in examples] == ["b</s>", "[INST]c\\"]
    assert examples[1].text.startswith(examples[0].text) and chat.TURN_START + "user" in examples[0].text
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = queries.op10_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_examples_hold_their_whole_context(spark):
    turns = [("user", "q<|end|>"), ("assistant", "aé"), ("user", "r"), ("assistant", "</s>b"), ("assistant", "c\\"), ("user", "tail"), ("user", "")]
    segments = [chat.format_turn(*t)[0] for t in turns]
    rows = [(c, k, *t) for c in (1, 2) for k, t in enumerate(turns)] + [(3, 0, "user", "only")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [r for r in chat.render_examples(formatted).collect() if r.conv_id == 1]
    assert [(r.example, r.text) for r in got] == [(0, "".join(segments[:2])), (1, "".join(segments[:4])), (2, "".join(segments[:5])), (None, "".join(segments[5:]))]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in got[:3]] == ["aé", "</s>b", "c\\"]
    back = {r.conv_id: (r.n_turns, r.n_examples, r.formatted_chars) for r in chat.read_back(formatted).collect()}
    assert back[1] == back[2] == (7, 3, sum(len(r.text) for r in got))
    assert back[3] == (1, 0, len(chat.format_turn("user", "only")[0]))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = queries.op10_chat_format(spark, sf)
    rel = con.sql(queries.ORACLE_SQL["op10_chat_format"])
    assert rel.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_stored_rows_in_any_order(spark):
    """Rows that were stored and come back in another order, and examples too, read the same; long turns, ties and repeated rows."""
    rng = random.Random(3)
    rows = [(rng.randrange(6), rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "</s>b", "c\\", "", None])) for _ in range(80)]
    rows += [(9, 0, "user", "long " * 100_000), (9, 1, "assistant", "x" * 300_000 + "<|end|>"), (None, 1, "assistant", "y"), (None, 0, "user", "z")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(map(tuple, chat.read_back(formatted, dealt=True).collect()), key=str)
    assert {r[0]: tuple(r[1:5]) for r in want} == brute(rows)
    assert sorted(map(tuple, chat.read_back(formatted.orderBy(F.rand(1))).collect()), key=str) == want
    assert sorted(map(tuple, chat.read_examples(chat.render_examples(formatted).orderBy(F.rand(2))).collect()), key=str) == want
