import random

from pyspark.sql import functions as F

from embedmesh.llm import templates

ITEM = "A train leaves the station with John Smith at 9 and travels 120 km in 3 hours. How many km does John Smith travel in 5 hours if the speed of the train stays the same?"


def asked(name, a, b, c, a2=None, name2=None):
    return f"A train leaves the station with {name} at {a} and travels {b} km in {c} hours. How many km does {name2 or name} travel in {a2 or 7} hours if the speed of the train stays the same?"


def test_tokens(spark):
    row = spark.range(1).select(templates.tokens(F.lit("He met Anna Lee, Bo paid 3.5 kg and 20% (Éa x).")).alias("t")).select("t", templates.template(F.col("t")).alias("c")).first()
    assert row.t == ["he", "met", "\x01anna lee\x02", "\x01bo\x02", "paid", "3.5", "\x03kg\x02", "and", "20", "\x03%\x02", "éa", "x"]
    assert row.c == ["he", "met", "<name>", "<name>", "paid", "<num>", "<unit>", "and", "<num>", "<unit>", "éa", "x"]


def test_contamination(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = [
        (1, filler(50) + ". " + ITEM + " " + filler(40)),
        (2, filler(30) + ". " + asked("Maria Lopez", 8, 300, 6) + " " + filler(900)),
        (3, filler(80)),
        (4, None),
        (5, ""),
        (6, ITEM),
        (6, ITEM),
        (7, " ".join(str(i) for i in range(300))),
        (8, ITEM[:60] + " " + filler(30)),
        (9, filler(20) + " the quick brown fox jumps over it " + filler(20)),
        (None, ITEM),
        (11, filler(9) + ". " + ITEM.lower()),
        (10, filler(2) + " " + ITEM.upper() + " " + filler(3)),
        (12, filler(9) + "\n  Too few -- words!\n" + filler(9)),
        (13, filler(9) + " too few words " + filler(9)),
    ]
    items = [(100, ITEM), (101, "1 2 3 4 5 6 7 8 9 10"), (102, None), (103, "too few words"), (104, "the quick brown fox jumps over it"), (None, "a b c d e f g h i"), (100, ITEM)]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("windows", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    by = {(r.doc_id, r.item_id): r for r in got.collect()}
    # 101 is all numbers and goes by its values, 103 is short and goes by whole lines
    assert set(by) == {(1, 100), (2, 100), (6, 100), (7, 101), (9, 104), (10, 100), (11, 100), (12, 103)}
    assert by[7, 101].windows == by[7, 101].item_windows == 3 and not by[7, 101].reparameterised
    assert not by[1, 100].reparameterised and by[2, 100].reparameterised
    assert by[1, 100].windows == by[1, 100].item_windows and by[2, 100].slots > 5
    kept = templates.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 8, 13]
    by_shuffle = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=0, broadcast_ids=0)
    assert sorted(map(tuple, by_shuffle.collect())) == sorted(map(tuple, by.values()))


def test_inconsistent_slots_do_not_count(spark):
    item = "one 5 two 5 three 5 four 5 five 5 six 5 seven 5 eight 5 nine 5 ten 5"
    docs = [(1, item.replace("5", "9")), (2, "one 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8 nine 9 ten 10")]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.doc_id, r.reparameterised) for r in got.collect()] == [(1, True)]


def test_empty(spark):
    none, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert templates.contaminated(none, item).collect() == []
    assert templates.contaminated(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), item.limit(0)).collect() == []


def test_windows_of_values_and_unspaced_scripts(spark):
    sums = "What is 12 + 35 - 7 * 4 / 2?"
    chinese = "从前有一座山山里有一座庙庙里有一个老和尚在给小和尚讲故事"
    docs = [(1, "say " + sums + " now"), (2, "What is 13 + 35 - 7 * 4 / 2?"), (3, "他说" + chinese + "他又说"), (4, "从前有一座桥山外没有一座庙城里有一个人"), (5, " ".join(["1,000", "2.5"] * 500))]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, sums), (2, chinese)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (3, 2)]


def test_sql_agrees(spark, tmp_path):
    import duckdb

    sums = "What is 12 + 35 - 7 * 4 / 2?"
    docs = [(1, "say " + sums), (2, asked("Maria Lopez", 8, 300, 6)), (3, "a\nyes, no\nb"), (4, "yes no and 1 2 3 4 5 6 7 8 9 10 11"), (5, "从前有一座山山里 has it"), (None, ITEM), (7, None), (8, ITEM.upper())]
    items = [(1, sums), (2, ITEM), (3, "Yes; no"), (4, "2 3 4 5 6 7 8 9 10"), (5, "从前有一座山山里"), (6, "!"), (7, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "item_id", "windows", "item_windows", "slots", "agreeing", "reparameterised"]
    got = sorted(tuple(r[n] for n in names) for r in templates.contaminated(d, b).collect())
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", b.toPandas())
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({templates.SQL})").fetchall()) and {(x[0], x[1]) for x in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (8, 2)}


def test_long_texts_need_no_stack(spark):
    docs = [(1, "Lorem Ipsum " * 100_000), (2, "so " + "1," * 100_000), (3, "lorem ipsum dolor " * 600_000), (4, "x " + "Ab " * 5_000 + ITEM), (5, " " * 1_000_000 + "7" + " " * 1_000_000)]
    got = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [4]
