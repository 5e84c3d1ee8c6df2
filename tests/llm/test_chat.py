from aerolytics.llm import chat, registry

from oracle import compare, connect

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, pos string"


def test_query_equals_sql(spark):
    compare(connect(SF), registry.op7_chat(spark, SF), registry.ORACLE["op7_chat"])


def brute(rows):
    """Conversations that no longer one begins with, the least id of equal ones."""
    convs = {}
    for c, turn, role, text, _ in {r for r in rows if r[0] is not None}:
        convs.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    seqs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    keep = {}
    for c, s in seqs.items():
        if any(o != c and ((len(x) > len(s) and x[: len(s)] == s) or (x == s and o < c)) for o, x in seqs.items()):
            continue
        keep[c] = s
    return keep


def snapshots():
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "see you")]
    rows = []
    for c, n in ((1, 2), (2, 3), (3, 5), (4, 5), (5, 1)):  # snapshots and a copy
        rows += [(c, i * 3, *turns[i], "x") for i in range(n)]
    rows += [(6, 0, "user", "hi", "x"), (7, 0, "user", "hi", "x"), (7, 1, "assistant", None, "x"), (8, 0, None, "", "x"), (None, 0, "user", "lost", "x"), (9, None, "user", "first", "x"), (9, 0, "user", "second", "x")]
    return rows + rows[:4] + [(10, i, "user", f"turn {i}", "x") for i in range(40)] + [(11, i, "user", f"turn {i}", "x") for i in range(39)]


def test_snapshots_collapse_across_blocks(spark):
    rows = snapshots()
    out = chat.collapse(spark.createDataFrame(rows, SCHEMA), block=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.pos)):
        got.setdefault(r.conv_id, []).append(r.rendered)
    assert got == {c: [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s] for c, s in brute(rows).items()}
    assert {r.conv_id: r.copies for r in out}[3] == 2


def test_empty_table_and_no_python(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.collapse(none).count() == 0
    plan = chat.collapse(none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
