from pyspark.sql import functions as F

from scoreloom.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b", "x"), (2, "a  b ", "x"), (3, "A b", "y"), (4, None, None), (5, " \n\t\x0b\f\r", "z"), (6, "", "z"), (2, "a  b ", "x"), (7, "é" * 50_000, "w")]


def result(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")  # a clashing extra column
    return sorted(tuple(r) for r in exact_dedup(docs, **more).select("doc_id", "keep_id", "group_size", "kept").collect())


EXPECTED = sorted([(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 3, 1, True), (4, 5, 3, False), (5, 5, 3, True), (6, 5, 3, False), (7, 7, 1, True)])


def test_longest_then_smallest_id_stays(spark):
    assert result(spark, ROWS) == EXPECTED


def test_chance_hits_are_verified_byte_by_byte(spark):
    assert result(spark, ROWS, key=lambda plain: F.pmod(F.xxhash64(plain), F.lit(2))) == EXPECTED


def test_tie_goes_to_the_smaller_id(spark):
    assert result(spark, [(9, "ab ", None), (8, " ab", None)]) == [(8, 8, 2, True), (9, 8, 2, False)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_null_id(spark):
    assert exact_dedup(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string")).where("kept").count() == 1
    rows = {r["doc_id"]: r["kept"] for r in exact_dedup(spark.createDataFrame([(None, "a  b"), (5, "ab"), (6, "ab")], "doc_id long, text string")).collect()}
    assert rows == {None: False, 5: True, 6: False}
    assert [r["kept"] for r in exact_dedup(spark.createDataFrame([(None, "a b"), (None, "ab")], "doc_id long, text string")).collect()] == [True, True]


def test_extreme_ids_and_repeated_ids_with_other_texts(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    assert result(spark, [(low, "x", None), (high, "x", None), (0, " x", None), (0, "y", None), (7, "y", None)]) == sorted([(low, 0, 3, False), (high, 0, 3, False), (0, 0, 3, True), (0, 0, 2, True), (7, 0, 2, False)])
    assert result(spark, [(low, "x", None), (high, "x", None)]) == [(low, low, 2, True), (high, low, 2, False)]


def test_levels_are_merged_fan_by_fan(spark):
    from scoreloom.llm import exact_dedup as module

    rows = [(i, f"t{i % 40}", None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(9)
    runs = module.flush(docs.select("doc_id", F.char_length("text").alias("length"), F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")))
    assert runs.select("run").distinct().count() == 9
    ones = {fan: sorted(map(tuple, module.compact(runs, ["key"], fan).collect())) for fan in (2, 3, 100)}
    assert ones[2] == ones[3] == ones[100] and len(ones[2]) == 40 and all(n == 10 and 0 <= keep < 40 for _, n, keep in ones[2])
    verdicts = module.exact_dedup(docs, fan=2, filter_words=1)
    assert verdicts.where("kept").count() == 40 and verdicts.where("group_size <> 10").isEmpty()


def test_filter_admits_its_keys_and_few_others(spark):
    from scoreloom.llm import exact_dedup as module

    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    admitted = module.hit_filter(keys, 1 << 12)
    assert admitted.count() <= 1 << 12
    probed = module.probe(spark.range(3000).select("id", F.xxhash64("id").alias("key")), admitted, 1 << 12)
    assert probed.where("id < 1000 AND NOT hit").isEmpty() and probed.where("id >= 1000 AND hit").count() < 30
