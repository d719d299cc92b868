import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat
from lectern.llm.queries import op1_chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    made = {}
    for c, turns in out.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in turns), "".join(x for _, _, r, x in turns if r == "assistant")
        made[c] = (len(turns), digest(said), len(loss), digest(loss))
    return made


def check(spark, rows, **k):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("at", F.lit(1))
    windows = chat.chat_windows(df, **k)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(windows).collect()}
    assert got == expected(rows)
    return windows


def test_round_trip_of_hostile_nulls_ties_and_repeats(spark):
    rows = [
        (1, 0, "system", "be <s>good</s>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "[\\INST] <\\s> <</SYS>> \\ [[INST]"), (1, 2, "assistant", "tie"),
        (2, 0, None, None), (2, 1, "assistant", ""), (2, None, "user", "null turn"), (None, 0, "user", "no conversation"), (None, 1, "assistant", "é 漢 𝄞"),
        (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "[INST]", "odd role"),
    ]
    check(spark, rows)


def test_windows_keep_the_budget_repeat_history_and_target_once(spark):
    rows = [(9, 0, "system", "rules " * 10)] + [(9, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 37)) for i in range(1, 700)] + [(9, 700, "user", "long " * 3000)]
    windows = check(spark, rows, budget=400, history=100).orderBy("first_turn").collect()
    assert len(windows) > 20 and sum(w.over_budget for w in windows) == 1
    assert all(w.formatted.startswith("<s>[INST]system[/INST]rules") for w in windows)
    assert sum(w.n_repeated > 1 for w in windows) > 10
    assert [w.first_turn for w in windows[1:]] == [w.last_turn + 1 for w in windows[:-1]]


def test_windows_are_filled(spark):
    """On a long chat of ordinary turns the budget is used, and never passed; beside a large system turn what it leaves is."""
    turns = lambda c, n: [(c, i, "user" if i % 2 else "assistant", f"turn {i} " + "some more words here " * (i % 17)) for i in range(1, n)]
    rows = [(1, 0, "system", "be brief"), *turns(1, 1500), *turns(2, 1500), (3, 0, "system", "rules " * 600), *turns(3, 400)]
    windows = check(spark, rows).collect()
    for c, least in ((1, 1700), (2, 1700), (3, 1700)):
        sizes = [w.tokens for w in sorted((w for w in windows if w.conv_id == c), key=lambda w: w.first_turn)[:-1]]
        assert max(sizes) <= 2048 and sum(sizes[1:]) / len(sizes[1:]) > least, (c, sizes)


def test_very_long_turn_and_empty_table(spark):
    check(spark, [(1, 0, "user", "x " * 200_000), (1, 1, "assistant", "y" * 300_000)])
    assert chat.chat_digests(chat.chat_windows(spark.createDataFrame([], SCHEMA))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>[]/\\sINTYSx ", max_size=30))
def test_escape_is_reversible(text):
    import re

    control, escaped = re.compile(chat.CONTROL), re.compile(chat.ESCAPED)
    out = control.sub(r"\1\\\2\3", text)
    assert escaped.sub(r"\1\2\3", out) == text
    assert not any(c in out for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op1_chat(spark, sf).collect()}
    assert got == expected(rows)


def test_a_large_system_turn_leaves_its_windows_within_the_budget(spark):
    rows = [(1, 0, "system", "rule " * 950)] + [(1, i, "user" if i % 2 else "assistant", "word " * (i % 9 + 1)) for i in range(1, 200)]
    windows = check(spark, rows).collect()
    assert 1904 <= max(w.tokens for w in windows) <= 2048 and not any(w.over_budget for w in windows)
    assert all(w.formatted.startswith("<s>[INST]system[/INST]rule rule") for w in windows)


def test_a_long_turn_takes_the_place_of_history(spark):
    rows = [(1, 0, "system", "rule " * 150)] + [(1, i, "user" if i % 2 else "assistant", "word " * (700 if i % 5 == 0 else 40)) for i in range(1, 60)]
    assert not any(w.over_budget for w in check(spark, rows).collect())


def test_turns_without_numbers_are_sliced(spark):
    rows = [(1, None, "user" if i % 2 else "assistant", f"{i % 700} says something") for i in range(3000)] + [(1, 5, "system", "late")] + [(2, 7, "assistant", "alike")] * 1500
    windows = check(spark, rows)
    assert windows.filter("over_budget").count() == 0
