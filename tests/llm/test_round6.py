import random

from pyspark.sql import functions as F

from satchel.llm import column_bwt, ngram_join, shared


def shuffled(spark, run) -> int:
    """Bytes that the stages of run() write for shuffles, and its result."""
    context = spark.sparkContext

    def stages():
        found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = set(stages())
    result = run()
    return sum(n for stage, n in stages().items() if stage not in before), result


def test_sieve_keeps_all_partners_and_few_others(spark):
    known = shared.written(spark.range(0, 40_000, 8).select(F.xxhash64("id").alias("key")), "known")
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("key"))
    found = {r.id for r in shared.sieved(rows, known, "key").select("id").collect()}
    assert found >= set(range(0, 40_000, 8)) and len(found) < 5000 + 0.06 * 35_000
    assert shared.sieved(rows, known.where("key is null"), "key").count() == 0
    few = shared.written(spark.createDataFrame([(b"b", None), (None, 1), (b"c", 2)], "k binary, v int"), "few")
    rows = spark.createDataFrame([(b"a", 1), (b"c", 2), (None, 2)], "k binary, v int")
    assert [tuple(r) for r in shared.sieved(rows, few, "k", "v").collect()] == [(b"c", 2)]


def test_column_bwt_shuffles_only_texts_with_wanted_segments(spark):
    g = random.Random(6)
    texts = [("%x" % g.getrandbits(12_000)) for _ in range(400)]
    once = spark.createDataFrame([(t,) for t in texts], "text string").select(column_bwt.text_key().alias("text_key"), "text")
    first = once.where(F.col("text") == texts[7]).select("text_key")
    cuts = first.select("text_key", F.lit(5).cast("long").alias("anchor"), F.lit(10).alias("first"), F.lit(3).alias("windows"), F.lit(4).alias("left"))
    wanted = shared.written(column_bwt._packed(cuts), "cuts")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        light, column_bwt.light = column_bwt.light, lambda df: df  # as for tables too large for a broadcast
        n, rows = shuffled(spark, lambda: column_bwt._raw(once, wanted, 200).collect())
    finally:
        column_bwt.light = light
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r.anchor, r.first, r.left, bytes(r.raw)) for r in rows] == [(5, 10, 4, texts[7].encode()[10:212])]
    assert n < 200_000  # the texts have 1.2 MB


def test_column_bwt_leaves_only_spans_and_their_sieve(spark):
    text = "".join(random.Random(7).choices("abcdefgh ", k=900))
    rows = spark.createDataFrame([(1, text), (2, "x" + text), (3, text[100:500]), (4, "short"), (5, None)], "doc_id long, text string")
    since = len(shared.MADE)
    found = sorted(tuple(r)[1:] for r in column_bwt.repeats_report(rows).collect())
    assert found == sorted(column_bwt.brute_force([text, "x" + text, text[100:500], "short", None]))
    assert len(shared.MADE) == since + 2


def test_ngram_join_moves_only_fragments_of_several_sets(spark, monkeypatch):
    g, moved = random.Random(8), []
    texts = [" ".join(f"w{g.randrange(5000)}" for _ in range(120)) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (60, texts[5] + " end")], "doc_id long, text string")

    def spy(left, known, key, weight, how="inner"):
        if key == "key":
            moved.append(left.count())
        return shared.joined(left, known, key, weight, how)

    monkeypatch.setattr(ngram_join, "joined", spy)
    found = {r.doc_id: r.component_id for r in ngram_join.components_by_similarity(rows).collect()}
    assert found == {i: i for i in range(60)} | {60: 5}
    assert 0 < moved[0] < 200  # of more than a thousand
