import duckdb

from tessera.llm import chat


def turns():
    shared = [(0, "system", "s"), (1, "user", "q")]
    rows = []
    for conv, more in ((0, [(2, "assistant", "good"), (3, "user", "t")]), (1, [(2, "assistant", "bad")]), (2, []), (3, [(2, "assistant", None)]), (4, [(2, None, "x")])):
        rows += [(conv, *t) for t in shared + more]
    rows += [(6, 0, "user", "a"), (6, 0, "user", "a"), (7, None, "user", "b"), (8, 0, "user", "same"), (9, 0, "user", "same"), (None, 0, "user", "lost")]
    return rows


def test_equals_sql_in_small_blocks(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op2_chat_formatting(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.execute(chat.OP2_SQL).fetchall()
    columns = ["pair_id", "part", "place", "start", "role", "segment", "loss_mask"]
    assert sorted(tuple(r[k] for k in columns) for r in got.collect()) == sorted(want)
    assert {r["part"] for r in got.where("pair_id = 0").collect()} == {"prompt", "chosen", "rejected"}
    small = chat.preferences(chat.answered_otherwise(df), block=1)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got.collect()))


def test_strings(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string")
    rows = {r["pair_id"]: r for r in chat.assembled(chat.preferences(df.selectExpr("conv_id div 2 pair_id", "if(conv_id % 2 = 0, 'chosen', 'rejected') side", "turn", "role", "text"))).collect()}
    assert rows[0]["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert rows[0]["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nt<|end|>\n"
    assert [tuple(s) for s in rows[0]["chosen_spans"]] == [(0, len("<|assistant|>\ngood<|end|>\n"))]
    assert rows[4]["chosen"] == "" and rows[4]["rejected"] == ""


def test_neighbours_answer(spark):
    long = "word " * 40_000
    rows = [(0, 0, "user", "q", 1), (0, 1, "assistant", "mine", 2), (0, 2, "user", "thanks", 3), (1, 0, "user", "r", 4), (1, 1, "assistant", long, 5), (2, 0, "assistant", "alone", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r["pair_id"]: r for r in chat.assembled(chat.preferences(chat.answered_otherwise(df))).collect()}
    assert got[0]["prompt"] == "<|user|>\nq<|end|>\n" and got[0]["chosen"].startswith("<|assistant|>\nmine") and got[0]["rejected"] == f"<|assistant|>\n{long}<|end|>\n"
    assert got[1]["prompt"] == "<|user|>\nr<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nmine<|end|>\n"
    assert got[2]["prompt"] == "<|assistant|>\nalone<|end|>\n" and got[2]["chosen"] == got[2]["rejected"] == ""
    assert chat.preferences(chat.answered_otherwise(df.limit(0))).count() == 0
