"""Chat formatting, token files and WARC derivatives: exact round trips and edge rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagwell.llm import chat, tokens, warc
from lagwell.llm.queries import tokenizer_path

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x</s>", "<<SYS>> <</SYS>>", "⁣", "<⁣|", "[⁣INST]", "\\[INST]", "", "<", "<|", "é\n\n ", "[INST", "</s"]


def test_turn_rows_render_and_read_back(spark):
    rows = [(1, 0, "user", NASTY[0], "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", NASTY[1], "x"), (1, None, "system", "first", "x"), (None, 0, "tool<|text|>", "t", "x"), (None, 0, "tool<|text|>", "t", "x"), (2, 0, None, "r", "x")]
    rows += [(10 + i, 0, "assistant", t, "x") for i, t in enumerate(NASTY)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.from_table(df))).collect()}
    assert [(t.role, t.text) for t in out[1].turns_read] == [("system", "first"), ("user", NASTY[0]), ("assistant", ""), ("assistant", NASTY[1])]
    assert out[1].loss_texts == ["", NASTY[1]]
    assert [(t.role, t.text) for t in out[None].turns_read] == [("tool<|text|>", "t")] * 2 and out[None].loss_texts == []
    assert [(t.role, t.text) for t in out[2].turns_read] == [("", "r")]
    for i, t in enumerate(NASTY):
        assert out[10 + i].loss_texts == [t]
        inner = re.sub(r"^<\|turn\|>assistant<\|text\|>|</s>$", "", out[10 + i].formatted)
        assert not any(c in inner for c in chat.CONTROL)
    assert chat.render(chat.from_table(df.limit(0))).count() == 0


def test_layouts_are_chosen_per_record(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"completion": "b", "prompt": "a"}', '{"prompt": "a", "response": "b"}', '{"instruction": "a", "output": "b"}',
        '{"instruction": "a", "input": "c", "output": "b"}', '{"system_prompt": "s", "question": "a", "response": "b"}',
        '{"other": 1}', "{broken", None, '{"prompt": null, "response": "b"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "layout int, record string").withColumnRenamed("layout", "i")
    out = {r.i: r for r in chat.from_json_records(df, "record").collect()}
    for i, name in enumerate(["messages", "conversation", "prompt_completion", "prompt_response", "instruction_output"]):
        assert out[i].layout == name and [(t.role, t.text) for t in out[i].turns] == [("user", "a"), ("assistant", "b")]
    assert out[5].turns[0].text == "a\n\nc" and [t.role for t in out[6].turns] == ["system", "user", "assistant"]
    assert [out[i].turns for i in (7, 8, 9)] == [None] * 3
    assert [(t.role, t.text) for t in out[10].turns] == [("user", ""), ("assistant", "b")]


def test_table_layouts_and_unknown_fields(spark):
    df = spark.createDataFrame([(1, "a", None)], "conv_id bigint, instruction string, output string")
    assert [(t.role, t.text) for t in chat.from_table(df).first().turns] == [("user", "a"), ("assistant", "")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.from_table(df.withColumnRenamed("output", "answer"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70000), max_size=40))
def test_packed_values_come_back(values):
    v = np.array(values, np.uint32)
    control, data = tokens.pack(v)
    assert len(control) == -(-len(v) // 4) and (tokens.unpack(control, data, len(v)) == v).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aZ1 ,.'!\n\té×ßčж \x1c<|>_", max_size=30), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    t = tokens.encoder(tokenizer_path()).tokenizer
    ids, counts = tokens.encoder(tokenizer_path())(pa.array([*texts, "<|endoftext|>", "don't  you'll, x"]))
    ends = np.cumsum(counts)
    want = [e.ids + [0] for e in t.encode_batch([*texts, "<|endoftext|>", "don't  you'll, x"], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "SHARD", 50)
    rows = [(5, "one two three " * 9, "u"), (None, "n", "u"), (3, None, "u"), (3, "", "u"), (1, "x" * 500, "u"), (9, "same", "u"), (9, "same", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    out = tokens.token_table(df, tokenizer_path(), f"file://{tmp_path}/a").collect()
    t = Tokenizer.from_file(tokenizer_path())
    assert sorted(r.n_tokens for r in out) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows)
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 3, 3, 5, 9, 9]
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out]])[:-1].tolist()
    assert tokens.token_table(df.limit(0), tokenizer_path(), f"file://{tmp_path}/b").count() == 0


def test_warc_records_link_and_round_trip(spark):
    rows = [(1, "http://a/?x=1", "<html lang=de><title>T &amp; t</title><p>one<p>two <a href='/l'>l</a>", "r"), (2, None, None, "r"), (3, "u\r\nX: y", "", "r"), (1, "http://a/?x=1", "<p>one", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_id string")
    answers = warc.responses(pages)
    made = warc.derive(answers)
    back = warc.parsed(warc.serialised(made))
    ids = {r.record_id: r for r in answers.collect()}
    got = back.collect()
    assert len(got) == 8 and sorted(r.block for r in got) == sorted(r.block for r in made.collect())
    for r in got:
        head = {h.name: h.value for h in r.headers}
        source = ids[r.refers_to]
        assert head["WARC-Source-Payload-Digest"] == {h.name: h.value for h in source.headers}["WARC-Payload-Digest"]
        assert head["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and head["WARC-Source-Content-Type"].startswith("text/html")
    first = next(r for r in got if r.warc_type == "conversion" and bytes(r.block) == b"one\ntwo l")
    assert first.target_uri == "http://a/?x=1"
    assert any(b"title: T & t\r\nlanguage: de\r\n" in bytes(r.block) and b"outlink: /l\r\n" in bytes(r.block) for r in got)
    assert sorted(bytes(r.member) for r in warc.archived(pages).collect()) == sorted(bytes(r.member) for r in warc.serialised(made).collect())
    assert warc.derive(made).count() == 0 and warc.responses(pages.limit(0)).count() == 0
    assert got[0].record_id in {r.record_id for r in warc.derive(answers).collect()}


def test_token_table_equals_encoding_whole_texts(spark):
    import zlib
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    docs = [(5, "Words and numbers 123, été!\n\n  x"), (2, None), (9, "<|endoftext|> the end"), (1, "a " * 40_000 + "zzz"), (7, "")]
    at = 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_table(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), tokenizer_path()).collect()}
    for i, t in sorted(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
