import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitbars.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, conv string, block string"
ROLES = ["user", "assistant", "system", "tool", "", None, "[INST]", "a[SAYS]b"]
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "[AND]", "[\\INST]", "\\", "\\\\", "[", "<", "]", ">", "a", "é", "\n", " ", "[ROLE]", "[SAYS]", "[/ROLE]", "IN", "ST]", "日"]


@pytest.fixture(scope="module")
def turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "f", "c", "b") for r in rows], SCHEMA).repartition(3)

    return make


def plain(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, own in by_conv.items():
        own = [(r.decode(), t.decode()) for _, _, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in own)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(own), sha(told), len(loss), sha(loss))
    return out


def found(frame):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in frame.collect()}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for k in range(rng.randrange(1, 14)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(BITS) for _ in range(rng.randrange(9)))
            turn = None if rng.random() < 0.05 else rng.choice([k, k, k, k // 2])
            rows.append((conv or None, turn, rng.choice(ROLES), text))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_every_turn_comes_back(turns, block):
    rows = corpus(150, 1)
    assert found(chat.digest(chat.format_chats(turns(rows), block=block))) == plain(rows)


def test_blocks_do_not_change_the_output(turns):
    rows = turns(corpus(60, 2))
    whole = sorted(map(str, chat.format_chats(rows).collect()))
    assert whole == sorted(map(str, chat.format_chats(rows, block=2).collect()))


def test_merged_turns_share_their_marks(turns):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "[AND]"), (1, 4, "assistant", "d"),
            (1, 5, "tool", "t")]
    r = chat.format_chats(turns(rows)).collect()[0]
    assert r["formatted"] == "[SYS]s[/SYS][INST]a[AND]b[/INST]<s>[\\AND][AND]d</s>[ROLE]tool[SAYS]t[/ROLE]"
    at, under = 0, []
    for run in r["loss_runs"]:
        under += [r["formatted"][at : at + run["chars"]]] * run["loss"]
        at += run["chars"]
    assert under == ["[\\AND]", "d"] and at == len(r["formatted"])


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join), min_size=1, max_size=20))
def test_escaping_is_undone(spark, texts):
    t = chat.Template()
    got = (
        spark.createDataFrame([(x,) for x in texts], "x string")
        .select("x", chat.escape(F.col("x"), t).alias("e"))
        .select("x", "e", chat.unescape(F.col("e"), t).alias("u"))
        .collect()
    )
    assert all(r["u"] == r["x"] and not any(m in r["e"] for m in t.marks) for r in got)


def test_long_conversation_is_formatted_in_blocks(turns):
    rows = [(1, k, "user" if k % 3 else "assistant", f"text {k} [INST]") for k in range(5000)] + [(2, 0, "user", "x" * 200000)]
    assert found(chat.digest(chat.format_chats(turns(rows)))) == plain(rows)


def test_odd_tables(turns):
    assert chat.digest(chat.format_chats(turns([]))).collect() == []
    rows = [(None, None, None, None), (1, -5, "user", ""), (1, -600, "assistant", ""), (2, 0, "assistant", None)]
    assert found(chat.digest(chat.format_chats(turns(rows)))) == plain(rows)


def test_a_mask_that_does_not_fit_is_an_error(turns):
    chats = chat.format_chats(turns([(1, 0, "user", "a"), (1, 1, "assistant", "b")])).withColumn("formatted", F.concat(F.lit("x"), "formatted"))
    with pytest.raises(Exception, match="does not fit"):
        chat.digest(chats).collect()


def test_no_python_in_the_plan(turns):
    plan = chat.digest(chat.format_chats(turns(corpus(3, 1))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_unusable_marks():
    for mark in ("INST", "[a[b]", "[a\\b]", "[]"):
        with pytest.raises(ValueError):
            chat.Template(joint=mark)
