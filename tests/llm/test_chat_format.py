from helpers import by_key, sha

from catalogloom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, example string, last int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "e", 1) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "be \\h ### kind"),
    (1, 1, "user", "</turn>\n### user:\nhi"),
    (1, 2, "assistant", "ok \\\\b </turn></turn>\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "still here"),
    (2, 0, "user", "no reply"),
    (3, 1, "assistant", "second"),
    (3, 0, "assistant", "first ####"),
    (4, None, None, "null turn and role"),
    (4, 0, "a:\nb", "odd role"),
    (4, 0, "assistant", "tie"),
    (4, 0, "assistant", "tie"),
    (None, 0, "assistant", "no conversation id 漢é"),
]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_reads_back_exactly(spark):
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_examples(table(spark, ROWS))).collect()}
    for conv, rows in by_key(ROWS, 0).items():
        rows, got = ordered(rows), found[conv]
        loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        assert got["n_turns"] == len(rows)
        assert got["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), sha(loss))
    assert len(found) == 5


def test_one_example_per_reply(spark):
    examples = by_key(chat_format.format_examples(table(spark, ROWS)).collect(), "conv_id")
    one = sorted(examples[1], key=lambda r: r["example"])
    assert [r["loss_start"] is not None for r in one] == [True, True, False]
    for a, b in zip(one, one[1:]):  # each goes on from the one before
        assert b["text"].startswith(a["text"])
    text, start, n = one[0]["text"], one[0]["loss_start"], one[0]["loss_chars"]
    assert text[start + n :] == "</turn>\n" and text[:start].endswith("### assistant:\n")
    assert [r["loss_start"] for r in examples[2]] == [None]
    assert sum(r["formatted_chars"] for r in chat_format.read_back(chat_format.format_examples(table(spark, ROWS))).collect()) == sum(
        len(r["text"]) for rows in examples.values() for r in rows
    )


def test_long_conversation(spark):
    rows = [(9, k, "assistant" if k % 2 else "user", f"t{k} " * 40) for k in range(120)]
    got = chat_format.read_back(chat_format.format_examples(table(spark, rows))).first()
    assert (got["n_turns"], got["loss_sha256"]) == (120, sha("".join(r[3] for r in rows if r[2] == "assistant")))


def test_no_python_and_empty(spark):
    frame = chat_format.read_back(chat_format.format_examples(table(spark, [])))
    assert frame.collect() == []
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
