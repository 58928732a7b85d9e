import hashlib
import random

import pytest

from burdenlens.llm import chat


def expected(rows):
    """conv -> (turns, hash, masked characters, hash) as the rows say it."""
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(turns), sums[0], len(loss), sums[1])
    return out


def conversations(seed):
    rnd = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "&lt;|", "&amp;", "<", "|", "\n", "wörd ", "a b "]
    rows = []
    for conv in range(6):
        for turn in range([1, 3, 40][conv % 3]):
            role = "system" if turn == 0 and conv % 2 else rnd.choice(["user", "assistant", "a\nb&#10;"])
            text = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 2, 9, 60])))
            rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_read_back(spark, seed):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(frame, budget=60, history=20, stretch=300).collect()
    for w in made:
        turns = chat.read_back(w["text"])
        alone = len(turns) == 1 or (len(turns) == 2 and turns[0][0] == "system")
        assert w["tokens"] <= 60 or alone
        assert all(w["repeated"] <= s["start"] for s in w["mask"])
        assert "".join(f"<|im_start|>" for _ in turns).count("<") == w["text"].count("<|im_start|>")
    assert len(made) > 6 and any(w["part"] for w in made) and any(w["repeated"] for w in made)
    got = chat.read_back_sums(chat.windows(frame, budget=60, history=20, stretch=300)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == expected(rows)


def test_system_turn_is_retained(spark):
    rows = [(1, 0, "system", "be kind")] + [
        (1, t, ["assistant", "user"][t % 2], f"w{t} " * 9) for t in range(1, 12)
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(frame, budget=50, history=20).orderBy("part", "window").collect()
    assert len(made) > 3
    for w in made:
        assert chat.read_back(w["text"])[0] == ("system", "be kind")
    # what follows in one window is repeated as history in the next one, out of the mask
    second = made[1]
    assert len(chat.read_back(second["text"][: second["repeated"]])) == 2


def test_long_system_turn_and_long_target(spark):
    """The system turn stays where it leaves no room, history goes first, and no turn is cut."""
    rows = [(1, 0, "system", "rule " * 80)] + [
        (1, t, ["assistant", "user"][t % 2], f"w{t} " * (70 if t == 4 else 6)) for t in range(1, 7)
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(frame, budget=50, history=20).orderBy("part", "window").collect()
    assert len(made) > 3
    for w in made:
        turns = chat.read_back(w["text"])
        assert turns[0][0] == "system" and turns[0][1] == "rule " * 80
        assert len(turns) <= 2  # there is no room for history
    got = chat.read_back_sums(chat.windows(frame, budget=50, history=20)).head()
    assert tuple(got)[1:5] == expected(rows)[1]


def test_nulls_ties_repeats_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string, PART string"
    rows = [
        (None, None, None, None, "x"),
        (1, 0, "user", "b", None),
        (1, 0, "user", "a", "y"),
        (1, 0, "user", "a", "y"),
        (1, 1, "assistant", None, "y"),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.read_back_sums(chat.windows(frame)).collect()}
    assert got[1]["n_turns"] == 4 and got[None]["n_turns"] == 1
    assert got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(
        b"user\na\nuser\na\nuser\nb\nassistant\n\n"
    ).hexdigest()
    assert chat.read_back_sums(chat.windows(frame.limit(0))).count() == 0
