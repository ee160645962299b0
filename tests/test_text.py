import uuid

import pytest
from pyspark.sql import functions as F

from lorebase.functions import chunker, ids, vectors
from lorebase.functions import text as T
from lorebase.operators import extraction


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "c string").select(column).first()[0]


@pytest.mark.parametrize(
    ("made", "value", "want"),
    [
        (T.strip, "　 a b \t", "a b"),
        (T.basic_clean, "  a \r\n\tb\r\r\n c  ", "a\nb\n\nc"),
        (T.token_count, "ab 12 漢字, x", 5),
        (T.token_estimate, "ab, c!", 4),
        (T.agent_tokens, "abcde漢", 3),
        (T.agent_tokens, "  ", 0),
        (T.compact, " a \n b ", "a b"),
        (T.compact, "x" * 400, "x" * 319 + "…"),
        (T.drop_thinking, "a<THINK>b\nc</think>d", "ad"),
        (T.repair_separators, "entity<|sep?>a<|SEP｜>b< <|done>", "entity<|SEP|>a<|SEP|>b< <|DONE|>"),
        (T.status, " Done ", "completed"),
        (T.status, "", "pending"),
        (T.status, "odd", "odd"),
        (T.size_in_bytes, "2 kb", 2048),
        (T.size_in_bytes, "1.5MB", 1572864),
        (T.size_in_bytes, "big", None),
        (T.sanitize_output, "hi\n```text\nentity<|SEP|>A<|SEP|>t<|SEP|>d\nnote\n<|DONE|>\nrest```", "entity<|SEP|>A<|SEP|>t<|SEP|>d\nnote\n<|DONE|>"),
        (T.sanitize_output, " only words ", "only words"),
    ],
)
def test_text(spark, made, value, want):
    assert one(spark, made(F.col("c")), value) == want


def test_lists(spark):
    assert one(spark, T.csv_of(F.array(F.lit(" a "), F.lit(""), F.lit("b")))) == "a,b"
    items = F.array(F.struct(F.lit("a").alias("raw"), F.lit("b").alias("result")), F.struct(F.lit("b").alias("raw"), F.lit("c").alias("result")))
    assert one(spark, T.replace_all(F.col("c"), items), "ab") == "cc"
    assert one(spark, T.slices(F.col("c"), 2), "abcde") == ["ab", "cd", "e"]
    assert one(spark, T.first_non_empty(F.lit(None).cast("string"), F.lit(""), F.lit("0"))) == "0"


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert one(spark, vectors.cosine(v(1.0, 0.0), v(2.0, 0.0))) == 1
    assert [one(spark, vectors.cosine(a, b)) for a, b in ((v(), v()), (v(1.0), v(1.0, 2.0)), (v(0.0), v(1.0)))] == [-1, -1, -1]
    assert one(spark, vectors.mean(F.array(v(1.0, 3.0), v(3.0, 5.0)))) == [2, 4]


def test_uuid5(spark):
    for key in ("a:b:c", "漢字", ""):
        assert one(spark, ids.uuid5(F.col("c")), key) == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), key))


@pytest.mark.parametrize(
    ("text", "limits", "least", "has"),
    [
        ("# One\nalpha beta\n# Two\ngamma delta", (20, 1), 1, ["# One", "# Two"]),
        ("第一章 开始\n内容\n第二章 结束\n内容", (20, 1), 1, ["第一章", "第二章"]),
        ("one two\n\nthree four", (20, 1), 1, ["one", "four"]),
        ("# A\nx\n## B\ny\n### C\nz", (80, 10), 1, ["# A", "## B", "### C"]),
        ("word " * 500, (80, 10), 1, ["word"]),
    ],
)
def test_chunker_keeps_content(text, limits, least, has):
    out = chunker.chunk(text, chunker.Limits(*limits))
    assert len(out) >= least and all(h in "\n".join(out) for h in has)


def test_chunker_limits():
    assert chunker.chunk(None) == chunker.chunk(" \n ") == []
    lines = "\n".join(f"w{i} x y z" for i in range(50))
    out = chunker.chunk(lines, chunker.Limits(20, 5))
    assert all(chunker.tokens(c) <= 20 for c in out) and sum(map(chunker.tokens, out)) == chunker.tokens(lines)
    assert chunker.by_headings("intro\n# a\nx\n## b\ny\n# c") == ["intro\n", "# a\nx\n", "## b\ny\n", "# c"]
    assert len(chunker.split_by_tokens("a " * 5000, 100)) > 1


def test_chunk_documents(spark):
    docs = spark.createDataFrame([("g", "d", "# A\none\n# B\ntwo"), ("g", "e", None)], "group_id string, doc_id string, text string")
    rows = chunker.chunk_documents(docs, chunker.Limits(1, 1)).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.chunk_index) for r in rows] == [("d::chunk_1", 0), ("d::chunk_2", 1)]


def test_extraction(spark):
    raw = "\n".join(["entity<|SEP|> A <|SEP|>Org<|SEP|>x<|SEP|>y", "", "entity<|SEP|>B<|SEP|>Org", "relation<|SEP|>A<|SEP|>B<|SEP|>d<|SEP|>t<|SEP|>seven", "relation<|SEP|>A<|SEP|>B<|SEP|>d<|SEP|><|SEP|>8", "odd", "entity<|SEP|><|SEP|>t<|SEP|>d", "<|DONE|>", "entity<|SEP|>C<|SEP|>t<|SEP|>d"])
    lines = extraction.tagged_lines(spark.createDataFrame([("k", raw), ("n", None)], "k string, raw string"), ["k"])
    assert [tuple(r)[2:] for r in extraction.entities(lines, ["k"]).collect()] == [("A", "Org", "x<|SEP|>y")]
    assert [tuple(r)[1:] for r in extraction.relations(lines, ["k"]).orderBy("line").collect()] == [(4, "A", "B", "d", "t", None), (5, "A", "B", "d", "", 8)]
    assert [r.error for r in extraction.errors(lines, ["k"]).orderBy("line").collect()] == ["line 3: invalid entity fields count=3", "line 4: invalid confidence 'seven'", "line 6: unknown kind 'odd'", "line 7: entity missing name/type"]
