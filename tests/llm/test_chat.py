from pyspark.sql import functions as F

from helixmark.llm import chat, queries


def test_markers():
    assert chat.blocks("User: hi\nthere\nAssistant: x\n### Human\nfoo\n[bot] bar") == [("user", "hi\nthere"), ("assistant", "x"), ("user", "foo"), ("assistant", "bar")]
    assert chat.blocks(None) == [("none", "")] and chat.blocks("a: b") == [("assistant", "b")]
    assert chat.blocks("Assistants are: good") == [("none", "Assistants are: good")]


def test_parts_of_one_transcript_decode_as_the_whole(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    conv = conv.withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.when(F.col("conv_id") % 3 == 0, 7).otherwise(F.col("conv_id")))
    raw = queries.transcripts(conv)
    rows = chat.arranged(raw, "conv_id", "turn", "raw", F.col("role"))
    assert rows.rdd.getNumPartitions() > 3
    model = chat.fit(rows)
    got = chat.parse(rows.drop("role"), model).toPandas().sort_values(["ident", "place", "block"])
    for ident, g in raw.toPandas().sort_values(["conv_id", "turn"]).groupby("conv_id"):
        blocks = [b for x in g.raw for b in chat.blocks(x)]
        path, _ = chat.viterbi(model, model.emissions([chat.observe(*b) for b in blocks]))
        assert [chat.ROLES[r] for r in path] == got[got.ident == ident].role.tolist()


def test_viterbi_against_all_paths():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(3)
    s = len(chat.ROLES)
    model = chat.Model(np.log(rng.dirichlet(np.ones(s))), np.log(rng.dirichlet(np.ones(s), s)), [])
    e = np.log(rng.random((5, s)))
    score = lambda p: model.start[p[0]] + sum(model.after[a, b] for a, b in zip(p, p[1:])) + sum(e[t, r] for t, r in enumerate(p))
    assert chat.viterbi(model, e)[0] == list(max(product(range(s), repeat=5), key=score))


def test_held_out_roles(spark):
    """Turns of held-out transcripts: all with the parser's names are right; most with names that it doesn't know, whose role only their place and lines tell."""
    d = "/root/testdata/sf0.01"
    given = queries.transcripts(spark.read.parquet(f"{d}/conversations.parquet")).select("conv_id", "turn", "role", "known", "marked").toPandas()
    out = queries.op4_chat(spark, d).toPandas()
    held = set(out[out.held_out].conv_id)
    found = given[given.conv_id.isin(held)].merge(out.drop_duplicates(["conv_id", "turn"])[["conv_id", "turn", "role"]], on=["conv_id", "turn"], how="left", suffixes=("_true", ""))
    right = (found.role == found.role_true).groupby([found.known, found.marked]).mean()
    assert right[True, True] == 1 and right[False, True] > 0.6 and found[found.marked].role.notna().all()


def test_edge_cases(spark):
    rows = [(1, 0, None, "user"), (1, 1, "", None), (None, 0, "User: a", "x"), (1, 1, "", None), (1, None, "Bot: b\nUser: c", "assistant"), (2, 0, "Human: " + "long " * 50000, "user")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, text string, role string, block int")
    a = chat.arranged(df, "conv_id", "turn", "text", F.col("role"))
    out = chat.parse(a.drop("role"), chat.fit(a))
    assert out.count() == 7
    none = chat.arranged(df.limit(0), "conv_id", "turn", "text", F.col("role"))
    assert chat.parse(none.drop("role"), chat.fit(none)).count() == 0


def test_turns_within_one_text(spark):
    """Named lines are turns of their own, and a line without a marker can open one."""
    assert chat.blocks("Call of Monday\nAlice: hi\nBob: hello") == [("none", "Call of Monday"), ("name", "hi"), ("name", "hello")]
    short, long = "what is that?", "word " * 40
    learned = [(k, 0, f"User: {short}\n{long}\nUser: {short}\nAssistant: {long}\n{long}", ["user", "assistant", "user", "assistant", "assistant"]) for k in range(20)]
    rows = [*learned, (50, 0, f"User: {short}\n{long}\n{long}\n{short}\nBot: {long}", None), (51, 0, "Alice: hi\nmore\nBob: hello\nAlice: so", None)]
    a = chat.arranged(spark.createDataFrame(rows, "id long, place long, text string, roles array<string>"), "id", "place", "text", F.col("roles"))
    out = chat.parse(a.drop("roles"), chat.fit(a, by_line=True), by_line=True).orderBy("ident", "block").collect()
    assert [(r["role"], r["line"]) for r in out if r["ident"] == 50] == [("user", 0), ("assistant", 1), ("user", 3), ("assistant", 4)]
    assert [r["line"] for r in out if r["ident"] == 51][-2:] == [2, 3] and len([r for r in out if r["ident"] == 51]) in (3, 4)
    assert [r["turn_text"].split("\n")[1:-2] for r in out if r["ident"] == 50][1] == [long, long]


def test_whole_transcripts(spark):
    """op4 finds turns in texts of many, some of them without a marker; every line comes out once."""
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    texts = queries.joined(queries.transcripts(conv))
    assert texts.count() < conv.count() / 3
    out = queries.op4_chat(spark, "/root/testdata/sf0.01").toPandas()
    bare = queries.transcripts(conv).where("NOT marked").select("conv_id", "turn").toPandas()
    found = bare.merge(out, on=["conv_id", "turn"])
    assert len(found) > 0.35 * len(bare) and (found.role == found.given_role).mean() > 0.75


def test_long_transcripts_are_written_as_they_are_decided(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(7))
    rows = chat.arranged(queries.transcripts(conv), "conv_id", "turn", "raw", F.col("role"))
    model = chat.fit(rows)
    shown = lambda most: sorted(map(str, chat.parse(rows.drop("role"), model, most=most).collect()))
    assert shown(0) == shown(3000) == shown(chat.HELD)
