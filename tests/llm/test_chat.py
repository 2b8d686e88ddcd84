import pytest
from pyspark.sql import functions as F

from foretell.llm.chat import escape, format_chats, messages, read_back, unescape

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, head string"
HARD = ["", "\\", "<", "[", "<\\", "\\<", "\\\\[", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "a\nb\n\n", "é🙂 ", "[n", "<<[[\\\\"]


def plain(events):
    """Fold in order of (conversation, turn, sequence); later edits of earlier turns void what came before them."""
    key = lambda v: (v is not None, v or 0)
    out = {}
    for conv, turn in sorted({(e[0], e[1]) for e in events}, key=lambda x: (key(x[0]), key(x[1]))):
        cuts = [e[2] for e in events if e[0] == conv and key(e[1]) < key(turn) and e[3] in ("edit", "regenerate") and e[2] is not None]
        mine = sorted((e for e in events if (e[0], e[1]) == (conv, turn)), key=lambda e: (key(e[2]), e[3] or "message", e[4] or "", e[5] or ""))
        msgs = []
        for _, _, seq, kind, role, text in mine:
            if cuts and (seq is None or seq <= max(cuts)):
                continue
            if kind not in ("delta", "edit", "regenerate") or not msgs:
                msgs.append([role or "", text or ""])
            elif kind == "delta":
                msgs[-1][1] += text or ""
            else:
                msgs[-1][1] = text or ""
        out.setdefault(conv, []).extend(map(tuple, msgs))
    return out


EVENT_ROWS = [
    (1, 0, 1, "message", "user", "hello"), (1, 1, 2, "delta", "assistant", "wor"), (1, 1, 3, "delta", "assistant", "ld"), (1, 1, 4, "regenerate", "assistant", "again "), (1, 1, 5, "delta", "assistant", "more"),
    (2, 0, 1, "message", "user", "a"), (2, 1, 2, "message", "assistant", "old"), (2, 0, 3, "edit", "user", "b"), (2, 1, 4, "message", "assistant", "new"), (2, 2, None, None, None, None),
    (3, 0, 1, "message", "user", "x"), (3, 0, 1, "message", "user", "x"), (None, None, None, "message", "system", "s"), (4, 0, 1, "unknown", "us\ner", "t"), (5, 0, 9, "edit", "user", "first"),
]


def test_fold_and_read_back(spark):
    log = spark.createDataFrame([(*e, "z") for e in EVENT_ROWS], EVENTS).repartition(4)
    want = plain(EVENT_ROWS)
    got = {}
    for r in messages(log).orderBy("conv_id", "turn", "ord").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: v for k, v in want.items() if v}
    for r in read_back(format_chats(log)).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss_text == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        for s in r.loss_spans:
            assert r.formatted[s.start + s.length : s.start + s.length + 10] == "<|im_end|>"


@pytest.mark.parametrize("text", HARD)
def test_escape_is_reversible_and_hides_controls(spark, text):
    e, back = spark.createDataFrame([(text,)], "t string").select(escape(F.col("t")).alias("e")).select("e", unescape(F.col("e"))).first()
    assert back == text
    assert not any(c in e for c in ("<|", "</s>", "[INST]", "[/INST]", "<s>"))


def test_long_conversation_and_empty_log(spark):
    rows = [(7, i, i, "message", "assistant" if i % 2 else "user", HARD[i % len(HARD)] * 20, "z") for i in range(3000)]
    r = read_back(format_chats(spark.createDataFrame(rows, EVENTS))).first()
    assert [t.text for t in r.turns] == [x[5] for x in rows]
    log = spark.createDataFrame([], EVENTS)
    assert format_chats(log).count() == 0
    assert "Python" not in read_back(format_chats(log))._jdf.queryExecution().toString()
