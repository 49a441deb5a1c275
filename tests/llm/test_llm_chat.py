from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from risklattice.llm import chat


def test_round_trip_and_mask(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 0, "assistant", "\\"), (1, 1, "assistant", None), (1, 2, None, "<#\\<\\\\#\n</turn>\n### x <text>\n"),
            (1, 2, "assistant", "b\\"), (1, 2, "assistant", "b\\"), (1, None, "a <text>\nb", "é😀"), (None, 3, "assistant", ""), (2, 5, "user", "z" * 100_000), (3, 0, "user", "$1 \\$1")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("own"))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    wanted = defaultdict(list)
    for conv, turn, role, text in rows:
        wanted[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(wanted)
    for conv, said in wanted.items():
        said.sort()
        spoken = "".join(f"{r}\n{t}\n" for *_, r, t in said)
        learnt = "".join(t for *_, r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(spoken.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_spans_point_into_the_string(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "assistant", "x#y"), (1, 2, "assistant", "é")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(turns).first()
    assert [r.formatted[s.start : s.start + s.n_chars] for s in r.loss] == ["x\\#y", "é"]
    assert len(r.formatted) == sum(r.turn_chars)


def test_typed_parts(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    parts = [text("see </turn>"), ("image", None, "s3://a", 700, 336, None, None), ("audio", None, "b", None, None, 2.02, None), text("and"), ("document", None, "c", None, None, None, 3), ("video", None, "d", None, None, None, None), None]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [text("<|image 0|>")]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    chats = chat.format_chats(turns, parts="parts")
    r = chat.read_chats(chats).first()
    assert [(a.turn, a.place, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [
        (0, 0, "image", "s3://a", 1 + 3 * 144), (0, 1, "audio", "b", 51), (0, 2, "document", "c", 1536), (0, 3, "video", "d", 0)]
    assert r.n_tokens_expanded == 433 + 51 + 1536
    assert r.turns[0].text == "see </turn>\n<|image 0|>\n\n<|audio 1|>\nand\n<|document 2|>\n\n<|video 3|>\n"
    assert r.turns[1].text == "<|image 0|>" and r.loss_text == "<|image 0|>" and "\\<|image 0|>" in r.formatted


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(turns)).count() == 0
