"""Table functions in SQL give what the DataFrame functions give."""

from textquarry.functions import splitters, sqltables

TEXTS = ["# Head\n\nSome words here. And more words!\n\n- a list\n- of items\n" * 12, "def f():\n    return 1\n\nclass A:\n    pass\n" * 15, "one\ntwo three, four. " * 60, "", None, "中文。测试！" * 60, "x" * 900]


def test_all_splitters_in_sql(spark):
    sqltables.register(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    docs.createOrReplaceTempView("texts_to_split")
    for name in splitters.SPLITTERS:
        got = spark.sql(f"SELECT d.doc_id, c.position, c.chunk FROM texts_to_split d, LATERAL chunks(d.text, '{name}', 200, 20) c")
        want = splitters.split_documents(docs, splitters.ChunkConfig(name, 200, 20))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name
    for nested in (True, False):
        got = spark.sql(f"SELECT d.doc_id, c.* FROM texts_to_split d, LATERAL chunk_hierarchy(d.text, 200, 20, {nested}) c")
        want = splitters.split_hierarchy(docs, 200, 20, nested=nested)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
