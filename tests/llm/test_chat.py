"""Prefix-target expansion: exact round trip, masks, defined cases."""

import hashlib
import random

from roadtrace.llm import chat, queries

F = chat.F
CONV = "conv_id long, turn long, role string, text string"


def example_rows():
    rnd = random.Random(3)
    bits = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|", "\\", "<", "|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>",
            "<</SYS>>", "\n", "é", "𝛼", "ok ", "\\|", "\x00", "$1", "[", "/"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", text(), None]), rnd.choice([text(), text(), None]))
            for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t} <|im_end|>") for t in range(300)]
    rows += [(None, 1, "user", "hi"), (None, 2, "assistant", "yo"), (101, 5, "assistant", "b"), (101, 5, "assistant", "a"),
             (101, None, "user", "first"), (102, 0, "assistant", "same"), (102, 0, "assistant", "same")]
    rnd.shuffle(rows)
    return rows


def conversations(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in out.items()}


def test_examples_against_brute_force(spark):
    rows = example_rows()
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS segs", "2 AS turns", "3 AS formatted")
    out = chat.expand(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).collect()
    convs = conversations(rows)
    for c, turns in convs.items():
        mine = sorted((r for r in out if r.conv_id == c), key=lambda r: len(r.turns))
        ends = [i + 1 for i, (role, _) in enumerate(turns) if role == "assistant"]
        if not ends or ends[-1] != len(turns):
            ends.append(len(turns))
        assert [len(r.turns) for r in mine] == ends
        for r, end in zip(mine, ends):
            assert [(t.role, t.text) for t in r.turns] == turns[:end]
            own = turns[end - 1][0] == "assistant"
            assert r.target == (end if own else None) and r["last"] == (end == len(turns)) and r.n_turns == len(turns)
            assert r.loss == (turns[end - 1][1] if own else "")
            for s in ("</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>"):
                assert s not in r.formatted
            assert r.formatted.count("<|im_end|>") == end
    assert {r.conv_id for r in out} == set(convs)
    assert chat.expand(spark.createDataFrame([], CONV)).collect() == []


def test_query_reads_back_the_control_strings(spark):
    got = {r.conv_id: r for r in queries.QUERIES["op4_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    ok = "</s>[INST] ok [/INST]"
    r = got[-7]
    assert (r.n_turns, r.loss_chars) == (2, len(ok)) and r.loss_sha256 == hashlib.sha256(ok.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
