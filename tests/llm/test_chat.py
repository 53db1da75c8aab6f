import duckdb
import pytest

from sieveline.llm import chat, queries

TURN = "array<struct<role:string,text:string>>"


def render(turns):
    return "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        whole = render([(r, t)])
        if r == "assistant":
            out.append(f"{at + len('<|im_start|>assistant') + 1}:{at + len(whole) - 1}")
        at += len(whole)
    return ",".join(out)


CASES = [
    ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]),
    ([("user", "a")], [("user", "a")]),
    ([], [("assistant", "only")]),
    (None, None),
    ([("system", None), ("user", "q"), ("assistant", "é😀")], [("system", None), ("user", "q"), (None, "x"), ("assistant", "")]),
    ([("user", None)], [("user", "")]),
    ([("user", "a"), ("assistant", "b"), ("user", "c")], [("user", "a"), ("assistant", "b")]),
]


def test_equals_brute_force(spark):
    rows = [(i, a, b, "p") for i, (a, b) in enumerate(CASES)]
    got = chat.format_preferences(spark.createDataFrame(rows, f"k int, chosen {TURN}, rejected {TURN}, prompt string"), "k").orderBy("k").collect()
    for (a, b), r in zip(CASES, got, strict=True):
        a, b = a or [], b or []
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert (r.n_common, r.prompt, r.chosen, r.rejected) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        assert (r.chosen_spans, r.rejected_spans) == (spans(a[n:]), spans(b[n:]))
        for text, marks, side in ((r.chosen, r.chosen_spans, a), (r.rejected, r.rejected_spans, b)):
            assert [text[int(x) : int(y)] for x, y in (m.split(":") for m in marks.split(",") if m)] == [(t or "") + "<|im_end|>" for role, t in side[n:] if role == "assistant"]


def test_pairs(spark):
    rows = [(0, 2, "assistant", "b", "c"), (0, 1, "user", "a", "c"), (1, 1, "user", "z", "c"), (1, 2, "assistant", "y", "c"), (4, 1, "user", "alone", "c"), (None, 1, "user", "n", "c"), (4, 1, "user", "alone", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in chat.conversation_pairs(turns).collect()}
    plain = lambda x: [(t.role, t.text) for t in x]
    assert plain(got[0].rejected) == [("user", "a"), ("assistant", "y")] and plain(got[1].rejected) == [("user", "z"), ("assistant", "b")]
    assert plain(got[4].rejected) == [("user", "alone")] and plain(got[None].rejected) == []
    assert chat.conversation_pairs(turns.limit(0)).count() == 0
    plan = chat.format_preferences(chat.conversation_pairs(turns), "conv_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op3_chat_preferences", "op7_minhash_near_dups", "op9_secret_scan", "op10_topk_maxscore"])
def test_sql_agrees(spark, name):
    top = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    df = queries.QUERIES[name](spark, top)
    got = sorted(map(tuple, df.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert got == sorted(want, key=repr) and got
