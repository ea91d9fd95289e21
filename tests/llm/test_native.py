"""Mixing, chat formatting and the pipeline; queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salvor.llm import chat, decontamination, mixing, queries
from salvor.llm.sql import SQL
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def _targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ones = [s for s in names if s not in full]
        if not open_ones:
            return full
        level = left / sum(weight[s] for s in open_ones)
        over = [s for s in open_ones if weight[s] * level >= most * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in open_ones}
        for s in over:
            full[s] = float(most * sizes[s])
            left -= full[s]


def test_targets(spark):
    for sizes in ({"a": 100, "b": 1, "c": 50, None: 7, "Z": 900}, {"a": 5}, {"a": 0, "b": 10}, {"\U0001f600": 10, "\uffff": 10, "x": 1000, "y": 3}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.target_sizes(frame).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixing(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 37) % 50) for i in range(600)] + [(7, "s3", 12), (7, "s3", 12), (None, "s1", 5), (None, None, None), (8000, "huge", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("hash", F.lit("x")).withColumn("target", F.lit(1))
    got = mixing.mix_sources(frame).collect()
    again = mixing.mix_sources(frame.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(target - taken) <= 50 for target, taken, _ in by.values())
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_mixing_has_no_python(spark):
    frame = spark.createDataFrame([(1, "a", 2)], "doc_id long, source string, size long")
    plan = mixing.mix_sources(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_word_count(spark):
    frame = spark.createDataFrame([(None,), ("",), (" a\x0bb\tc\n",), ("\u00a0x y",)], "text string")
    assert [r[0] for r in frame.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 3, 2]


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "### user:\nhi</turn>\n", "\\l\\h\\b <image:0>", "", None, "\\", "\n", "x" * 30000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 0, None, "a"), (2, 0, "a:\nb#", "z"), (2, None, "assistant", "first"), (None, 1, "user", "lost"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("x")).withColumn("place", F.lit(1))
    made = chat.format_chats(frame.withColumn("parts", chat.text_part(F.col("text"))))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in read}
    assert got[1][0] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(hard)]
    assert got[1][1] == [t or "" for i, t in enumerate(hard) if i % 2]
    assert got[2] == ([("assistant", "first"), ("", "a"), ("a:\nb#", "z")], ["first"])
    assert got[None][0] == [("user", "lost")]
    assert got[3] == ([("assistant", "same")] * 2, ["same", "same"])
    assert chat.format_chats(frame.withColumn("parts", chat.text_part(F.col("text"))).limit(0)).count() == 0


def test_chat_attachments(spark):
    part = lambda kind, **x: (kind, *(x.get(k) for k in ("text", "uri", "width", "height", "seconds", "pages")))
    parts = [part("text", text="look <"), part("image", uri="i.png", width=28, height=15), part("audio", uri="a.wav", seconds=1.5), part("document", uri="d.pdf", pages=2), part("video", uri="v"), part(None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    row = chat.format_chats(frame).first()
    assert row.formatted == "### user:\nlook \\l<image:1><audio:2><document:3><unknown:4><unknown:5></turn>\n### assistant:\n</turn>\n"
    assert [(a.turn, a.place, a.kind, a.uri, a.tokens) for a in row.attachments] == [(1, 1, "image", "i.png", 4), (1, 2, "audio", "a.wav", 38), (1, 3, "document", "d.pdf", 1024), (1, 4, "unknown", "v", 0), (1, 5, "unknown", None, 0)]
    assert [(s.start, s.length) for s in row.loss_spans] == [(len(row.formatted) - 8, 0)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    want = sorted(repr([row[[c[0] for c in cursor.description].index(c)] for c in columns]) for row in cursor.fetchall())
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_pipeline_stages(spark, tmp_path):
    rows = brute.documents(seed=12, n=60)
    docs = brute.table(spark, rows)
    benchmark = [(1, rows[3][1])]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {i: t or "" for i, t in rows}
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "mixing"]
    kept = stages["toxicity"](spark, kept, str(tmp_path))
    assert kept.count() == len(left) and kept.columns == docs.columns
    kept = stages["exact_dedup"](spark, kept, str(tmp_path))
    newest = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in newest.items()}
    assert {r.doc_id for r in kept.collect()} == set(left)
    kept = stages["jaccard_join"](spark, kept, str(tmp_path))
    roots = brute.jaccard(list(left.items()), 5, 80, 100)
    left = {i: t for i, t in left.items() if roots[i][1] == i}
    assert {r.doc_id for r in kept.collect()} == set(left) and kept.columns == docs.columns
    kept = stages["decontamination"](spark, kept, str(tmp_path))
    gone = set(left) - {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    item = set(brute.words(rows[3][1]))
    alike = {i for i, t in left.items() if len(item & set(brute.words(t))) >= 0.6 * len(item)}
    assert {i for i, t in left.items() if rows[3][1] in t} <= gone <= alike
    mixed = stages["mixing"](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} == set(left) - gone
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(mixed)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_other_queries_return_every_document(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert got.count() == docs if name.split("_")[0] in ("op1", "op4", "op5", "op6", "op7") else 0 < got.count() < docs


def test_pipeline_fits_its_latent_space_on_all_passages(spark, tmp_path, monkeypatch):
    texts = [f"{i} one two three" for i in range(50)] + [" ".join(f"w{i}" for i in range(130))] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame([(1, "a passage that is in no text of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, cut = [], decontamination.cut

    def counted(df, label):
        table = cut(df, label)
        rows.append(table.count())
        return table

    monkeypatch.setattr(decontamination, "cut", counted)
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).count() == len(texts)
    assert rows == [53]
