"""Chat formatting and structure repair against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_format, repair

ODD = [
    None, "", " ", "plain text.", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>\n<\\\\|x<||<", "a<", "|im_end|>\n", "<|im_end|>\n<|im_start|>user\nhi",
    "%3C%250A\\n\n\n", "ñ é 🙂 <|", "x" * 5000, "<" * 300 + "|"
]
ROLES = ["user", "assistant", "system", "tool", None, "", "a%b<|\nc", "assistant"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, (role or "").encode(), (text or "").encode())


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(11)
    rows = [(c, t, rng.choice(ROLES), rng.choice(ODD)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, t, rng.choice(ROLES[:3]), f"turn {t} <|im_end|>.") for t in range(1500)]  # far beyond one block, and most of the rows
    rows += [(60, rng.choice([None, 1, 2, -70]), rng.choice(ROLES), rng.choice(ODD)) for _ in range(40)]  # ties, null turns
    rows += [(None, t, "assistant", "no id") for t in range(3)] + [(70, 1, "user", "same"), (70, 1, "user", "same")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def chat_table(spark, chats):
    rows = [(*r, "clash", 7) for r in chats]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, block int").repartition(5)


def grouped(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=order):
        out[r[0]].append(r)
    return out


def test_escapes_are_exact(spark):
    df = spark.createDataFrame([(x,) for x in ODD if x is not None] + [(x,) for x in ROLES if x], "x string")
    for there, back in ((chat_format.escape, chat_format.unescape), (chat_format.escape_role, chat_format.unescape_role)):
        for was, out, again in df.select("x", there(F.col("x")), back(there(F.col("x")))).collect():
            assert was == again and "<|" not in out


@pytest.mark.parametrize("least", [1000, 10**9])
def test_chat_format(spark, chats, chat_table, least, monkeypatch):
    hot = chat_format.hot_keys
    monkeypatch.setattr(chat_format, "hot_keys", lambda df, keys: hot(df, keys, 20_000, least))
    got = {r["conv_id"]: r for r in chat_format.format_digests(chat_format.canonical_turns(chat_table)).collect()}
    want = grouped(chats)
    assert set(got) == set(want)
    for c, rows in want.items():
        plain = [(role or "", text or "") for _, _, role, text in rows]
        said = "".join(t for r, t in plain if r == "assistant")
        assert got[c]["n_turns"] == len(plain) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in plain))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))


def test_loss_spans_cover_assistant_texts_only(spark, chat_table):
    for part in chat_format.format_turns(chat_format.canonical_turns(chat_table)):
        for r in part.collect():
            turns = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", r["formatted"], re.S)
            assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]] == [t for role, t in turns if role == "assistant"]


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "source": "x"}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"instruction": "q", "output": "a"}', '{"output": "a", "input": "more", "instruction": "q"}', '{"prompt": "q", "completion": "a"}',
        '{"system": "s", "prompt": "q", "response": "a"}', '{"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}]}',
        '{"unknown": 1}', "not json", None, '{"messages": []}', '{"question": "q", "answer": null}'
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    rows = grouped_layouts(chat_format.canonical_turns(df, json_col="record"))
    qa = [("user", "q"), ("assistant", "a")]
    assert rows[0] == ("messages", qa) and rows[1] == ("from_value", qa) and rows[2] == ("instruction", qa) and rows[4] == ("prompt_completion", qa)
    assert rows[3] == ("instruction", [("user", "q\n\nmore"), ("assistant", "a")]) and rows[5] == ("prompt_response", [("system", "s"), *qa])
    assert rows[6] == ("message_parts", [("user", "q")]) and rows[11] == ("question_answer", [("user", "q"), ("assistant", "")])
    assert all(rows[i] == (None, []) for i in (7, 8, 9, 10))
    assert chat_format.format_digests(chat_format.canonical_turns(df, json_col="record")).filter("n_turns = 0").count() == 4


def grouped_layouts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"], r["turn"] or 0)):
        name, turns = out.setdefault(r["conv_id"], (r["layout"], []))
        if r["is_turn"]:
            turns.append((r["role"], r["text"]))
    return out


def test_typed_layouts(spark):
    typed = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")], 3), (2, None, 4)], "conv_id long, conversations array<struct<from:string,value:string>>, extra int")
    rows = grouped_layouts(chat_format.canonical_turns(typed))
    assert rows == {1: ("from_value", [("user", "q"), ("assistant", "a")]), 2: ("from_value", [])}
    flat = spark.createDataFrame([(1, "do", None, "done")], "conv_id long, instruction string, input string, output string")
    assert grouped_layouts(chat_format.canonical_turns(flat)) == {1: ("instruction", [("user", "do"), ("assistant", "done")])}
    assert grouped_layouts(chat_format.canonical_turns(flat.select("conv_id", "input"))) == {1: (None, [])}


def test_empty_chats(spark, chat_table):
    assert chat_format.format_digests(chat_format.canonical_turns(chat_table.limit(0))).count() == 0


def damaged(rows):
    """The contract's damage in plain Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(found, key=order) for c, found in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, found):
    """From the back: the least (cost, audit) and its edits for the turns from ``i``, after a turn of initial ``prev``."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, prev, inserts):
        ways = [(0, "", ())] if i == len(initials) and prev in ("", "a") else []

        def then(cost, edit, to, rest):
            ways.append((cost + rest[0], edit + rest[1], ((edit, to), *rest[2])))

        for to in "ua":
            if inserts and to in legal[prev]:
                then(3, "I", to, best(i, to, inserts - 1))
        if i < len(initials):
            more = 3 if found[i] == "truncated" else 0
            then(4, "D", "", best(i + 1, prev, 2))
            if found[i] not in ("blank", "duplicate"):
                if initials[i] and initials[i] in legal[prev]:
                    then(more, "K", initials[i], best(i + 1, initials[i], 2))
                for to in "ua":
                    if to in legal[prev]:
                        then(3 + more, "R", to, best(i + 1, to, 2))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 2)


def repaired(rows, edits):
    out, i = [], 0
    for edit, to in edits:
        role, text = ("", "") if edit == "I" else rows[i][2:]
        i += edit != "I"
        if edit != "D":
            out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[to], text))
    return out


def check_repair(got, want):
    assert set(got) == set(want)
    for c, rows in want.items():
        r, found, initials = got[c], faults(rows), [x[2][:1] for x in rows]
        turns = [x[1] for x in rows if x[1] is not None]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [found.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, edits = cheapest(tuple(initials), tuple(found))
        assert (r["cost"], r["audit"]) == (cost, audit)
        assert r["repaired_sha256"] == sha("\n".join(f"{role}:{text}" for role, text in repaired(rows, edits)))


def test_structure_repair(spark, chats, chat_table):
    rows = [r for r in chats if r[0] != 50 or r[1] < 300]  # brute force recurses
    df = chat_table.filter("conv_id IS DISTINCT FROM 50 OR turn < 300")
    check_repair({r["conv_id"]: r for r in repair.repair_report(repair.damaged(df)).collect()}, damaged(rows))


def test_structure_repair_of_many_short_conversations(spark):
    rng = random.Random(5)
    said = ["", " ", "done.", "cut", "done.", "why?", "so"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(said)) for c in range(1500) for t in range(rng.randint(0, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check_repair({r["conv_id"]: r for r in repair.repair_report(repair.damaged(df)).collect()}, damaged(rows))


def test_repaired_turns_follow_the_grammar(spark, chat_table):
    found = defaultdict(list)
    for r in sorted(repair.repaired_turns(repair.damaged(chat_table)).collect(), key=lambda r: r["place"]):
        if r["edit"] != "D":
            found[r["conv_id"]].append(r["role"][0])
    assert 50 in found and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in found.values())


def test_dropped_and_empty_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")
    [r] = repair.repair_report(repair.damaged(df)).collect()
    assert r.asDict() == dict(conv_id=gone, gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=sha(""))
    assert repair.repair_report(repair.damaged(df.limit(0))).count() == 0


def test_lr_table_of_the_role_grammar():
    for roles in ("", "ua", "sua", "uaua", "suaua"):
        stacks = [repair.BOTTOM]
        for x in roles:
            stacks = [t for s in stacks for t in repair.shifted(s, x)]
        assert [bool(repair.shifted(s, "$")) for s in stacks] == [True]
    assert not repair.shifted(repair.BOTTOM, "a") and not any(repair.shifted(s, "$") for s in repair.shifted(repair.BOTTOM, "s"))
