import hashlib
import random
from collections import defaultdict

import pyarrow as pa

from corpuslens.llm.chat import BEGIN, CONTROL, END, assemble, conversation_digests, format_turns, read_turn, unescape

PARTS = ["<s>", "</s>", "[INST]", "\x1b", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "<", "<<SYS>>", "|", "😀", "im_end", ""]


def random_turns(seed, n):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices(PARTS, k=rng.randint(0, k)))
    return [(text(4), None if rng.random() < 0.1 else text(9)) for _ in range(n)]


def test_assembled_bytes_read_back():
    turns = random_turns(1, 2000)
    made, a, b = assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    for (role, text), formatted, i, j in zip(turns, made.to_pylist(), a, b):
        assert read_turn(formatted) == (role, text or "")
        assert unescape(formatted.encode()[i:j].decode()) == (text or "")
        assert not any(c in formatted[len(BEGIN) : -len(END)] for c in CONTROL)
    empty, _, _ = assemble(pa.array([], pa.string()), pa.array([], pa.string()))
    assert len(empty) == 0


def brute(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant" and t[2])
        out[conv] = (
            len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def test_conversations(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, "sys\ntem"]), t) for _, t in random_turns(3, 400)]
    rows += rows[:20] + [(7, 0, "assistant", "long " * 50_000), (8, 0, "user", "")]
    rows = [(*r, "clash") for r in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    for parts in (None, 5):
        got = {r.conv_id: tuple(r)[1:5] for r in conversation_digests(format_turns(df, partitions=parts)).collect()}
        assert got == brute([r[:4] for r in rows])


def test_hot_conversation_is_dealt_over_tasks(spark):
    rows = [(1, i, "user", f"text {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = format_turns(df, partitions=4)
    sizes = [p for p in turns.rdd.glom().map(len).collect()]
    assert max(sizes) < 2500
    assert conversation_digests(turns).first().n_turns == 4000


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_turns(df)).count() == 0
