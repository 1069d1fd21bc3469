"""Quality rules, resampling and conversation tries against brute force, on small tables with nulls, repeats and ties."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.llm import crc_ring, mixing, ngram_join, prefix_trie, ratio_rules, shared, suffix_decontam


@pytest.fixture(scope="module")
def rows():
    g = random.Random(1)
    some = ["aa", "Bb", "c1", "déf", "x", "|", "#a", "  "]
    out = [(i, " ".join(g.choice(some) for _ in range(g.randrange(0, 60))) + g.choice(["", ". ", "\n!"])) for i in range(300)]
    out += [(1007, None), (1008, ""), (1050, "q " * 30), (1051, " a\nb\na\n\n\n a" * 4), (1052, "a b c d e " * 500 + "　 x")]
    return out + [(2000 + i, " ".join("".join(g.choices("abcdefgh", k=4)) for _ in range(40))) for i in range(40)]


@pytest.mark.parametrize(("most", "buckets"), [(2, 1 << 14), (1, 64), (4, 100)])
def test_quality_rules(spark, rows, most, buckets):
    labels = [(i, i % 2) for i, _ in rows if i < 290 or i > 2010] + [(1, 0), (None, 1), (5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    good = {i for i, q in labels if q == 1 and i is not None} - {i for i, q in labels if q == 0}
    good = {i for i in good if zlib.crc32(str(i).encode()) % 3 != 1}
    found = {r[0]: tuple(r)[1:] for r in ratio_rules.quality_rules(docs, marks, buckets_=buckets, most=most).collect()}
    assert found == ratio_rules.brute_force(rows, good, buckets, most)


def test_quality_rules_odd_rows(spark, rows):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "w " * 9 + "z" * 70000 + " y")], "doc_id long, text string").withColumn("Ratio", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = ratio_rules.judged(docs, [0] * 8)
    assert found.columns == ["doc_id", "text", "Ratio", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio_", "n_features", "kept"]
    assert sorted((r.n_words, r.base_failed) for r in found.collect()) == [(3, True), (3, True), (11, True)]
    assert ratio_rules.quality_rules(docs.limit(0), none).count() == 0
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept != r.base_failed and r.ratio == 0 for r in ratio_rules.quality_rules(whole, none).collect())


def test_quality_rules_drop_what_isnt_like_the_trusted(spark):
    g = random.Random(2)
    word = lambda end: "".join(g.choices("abcdefgh", k=1)) + end
    rows = [(i, " ".join(word("%%%" if i % 4 == 0 else "") for _ in range(16))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in ratio_rules.quality_rules(docs, labels).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(400))


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 64)])
def test_resampling(spark, rows, most, buckets):
    rows = [(None if i is not None and i % 9 == 0 else i, t) for i, t in rows] + [(1050, "q " * 30), (None, None)]
    target = [t for _, t in rows[::17]] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5)
    found = crc_ring.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=buckets)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(crc_ring.brute_force(rows, target, most=most, buckets=buckets), key=str)


def test_resampling_of_empty_tables(spark, rows):
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert crc_ring.resampled(none, docs).count() == 0
    assert sorted(map(tuple, crc_ring.resampled(docs, none).collect()), key=str) == sorted(crc_ring.brute_force(rows, []), key=str)


def test_running_crcs_in_slices():
    raw = ("Ab cd " * 50 + "long" * 100 + ", zé").encode()
    words = raw.decode().lower().replace(",", "").split()
    want = {zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    for each in (1, 7, 64, 1 << 20):
        parts = list(crc_ring.crcs(raw, 3, each))
        assert sum(n for n, _ in parts) == len(words) and set(np.concatenate([x for _, x in parts]).tolist()) == want


@pytest.fixture(scope="module")
def turns():
    g = random.Random(4)
    said = [("user", "hi"), ("assistant", "hello é"), (None, "x"), ("user", None), ("", ""), ("system", "be kind")]
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 290), 300, 5]:
        out += [(c, k if g.random() < 0.9 else None, *g.choice(said[: 2 + c % 5])) for k in range(g.randrange(1, 9))]
    out += [(400, k, "user", str(k % 3)) for k in range(700)] + [(401, k, "user", str(k % 3)) for k in range(650)]  # long ones
    out += [(c, k, "user", f"same {k}") for c in range(500, 560) for k in range(6)]  # copies
    return out + [(None, 0, "user", "nobody's"), (7, 1, "user", "hi"), (7, 1, "user", "hi")]


@pytest.mark.parametrize(("partitions", "nodes"), [(8, 50_000), (61, 10)])
def test_prefix_trie(spark, turns, partitions, nodes):
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == 8)
    try:
        found = prefix_trie.prefix_trie(table, nodes, 40 if nodes == 10 else 1 << 16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(map(tuple, found), key=str) == sorted(prefix_trie.brute_force(turns), key=str)


def test_prefix_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, None, None, "z" * 100_000) for c in (1, 2, 3, 3, 101)]
    assert sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == sorted(prefix_trie.brute_force(rows), key=str)


def test_states_of_paths_are_put_together():
    g = random.Random(9)
    steps = [(1, g.randrange(prefix_trie.PRIME), g.randrange(prefix_trie.PRIME)) for _ in range(9)]
    whole = (0, 0, 0)
    for s in steps:
        whole = prefix_trie.appended(whole, s)
    for cut in range(10):
        a, b = (0, 0, 0), (0, 0, 0)
        for s in steps[:cut]:
            a = prefix_trie.appended(a, s)
        for s in steps[cut:]:
            b = prefix_trie.appended(b, s)
        assert prefix_trie.appended(a, b) == whole


def test_decontamination_of_few_words_equals_brute_force(spark):
    g = random.Random(11)
    some = lambda n, of: " ".join(g.choice(of) for _ in range(n))
    docs = [(i, some(g.randrange(0, 60), "ab" if i % 3 else "aAbcd")) for i in range(60)] + [(100, "a " * 300), (101, None), (102, "x. Y-z"), (103, "b " * 40 + some(30, "abcd"))]
    items = [(f"i{k}", some(g.randrange(0, 25), "ab" if k % 2 else "abcd")) for k in range(30)] + [("i9", "x y z"), ("i10", "X Y"), (None, "a " * 14), ("i5", "a " * 14), ("n", None)]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id string, text string")
    for window in (10, 3):
        for block in (4, 20_000):
            found = suffix_decontam.decontaminated(left, right, window, block_items=block)
            want = suffix_decontam.brute_force(docs, items, window)
            for r in found.collect():
                n_words, n_hit, n_items, _, _, longest, at, item = want[r.doc_id]
                assert (r.decon_words, r.decon_hit, len(r.decon_items), r.decon_longest, r.decon_longest_at, r.decon_longest_item) == (n_words, n_hit, n_items, longest, at, item), (window, block, r)
                assert sum(s["last"] - s["first"] + 1 for s in r.decon_spans) == n_hit


def test_decontamination_of_repetition_is_linear():
    import time

    def seconds(items, text):
        block = suffix_decontam.Block([str(i) for i in range(len(items))], items, 10)
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, hashes, at = shared.WordHasher(shared.ALNUM)(data, np.array([0, len(data)]))
        began = time.perf_counter()
        hits = suffix_decontam.Hits(block, hashes, at)
        out = hits.runs(), {d: len(x) for d, x in hits.items().items()}, hits.longest()
        return time.perf_counter() - began, out

    took, (runs, items, longest) = seconds(["w " * 400], "w " * 40_000)
    assert [x.tolist() for x in runs] == [[0], [0], [40_000]] and items == {0: 1} and longest == [(0, 0, 400, 0)]
    assert took < 20
    prompt = " ".join(f"p{k}" for k in range(13))
    took, (runs, items, longest) = seconds([f"{prompt} q{k} r{k}" for k in range(20_000)], f"{prompt} and then some other words " * 400)
    assert items == {0: 20_000} and len(runs[0]) == 400 and longest == [(0, 0, 13, 0)]
    assert took < 20


def test_mix_solver_ends_on_any_table_of_classes():
    g = np.random.default_rng(5)
    for k in range(400):
        w = np.floor(np.exp(g.normal(5, 3, (int(g.integers(1, 9)), int(g.integers(1, 9))))) * (g.random() < 0.95)).astype(float)
        target = w.sum(1) * g.uniform(0.05, 2.0, len(w))
        if not target.sum():
            continue
        wanted, share = target.sum(), w.sum(0) / w.sum()

        def evaluated(mu, w=w, target=target, wanted=wanted, share=share, base=1.5 if k % 2 else 1.0):
            v, gradient, h = mixing.dual(w, target, mu, base, 2.0)
            weight = 1e-3 * wanted
            return v - wanted * share @ mu + weight / 2 * (mu @ mu), gradient - wanted * share + weight * mu, h + weight * np.eye(len(mu))

        mu = mixing.descended(evaluated, w.shape[1], wanted, 1e-9, 150)
        assert np.abs(evaluated(mu)[1]).max() <= 1e-6 * wanted
        rates, _ = mixing.source_rates(w, target, mu, 1.5 if k % 2 else 1.0, 2.0)
        assert (w * rates).sum(1) == pytest.approx(target, rel=1e-6)


def test_near_duplicates_keep_columns_of_any_type(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None)], "doc_id long, text string")
    rows = rows.withColumn("m", F.expr("map('k', doc_id)")).withColumn("s", F.struct(F.array("doc_id").alias("x"))).withColumn("b", F.lit(b"\x00"))
    kept = ngram_join.one_of_each(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r.m["k"]) for r in kept.collect()) == [(1, 1), (3, 3)]


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    g = random.Random(4)
    word = lambda: "".join(g.choices("abcdefgh", k=4))
    good = [" ".join(word() for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(None, good[0]), (None, None), (7, good[7]), (7, good[7]), (70, ""), (71, good[1] + " " + "x " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "if(doc_id % 5 = 0, null, 's') as source", "cast(length(text) as long) as n_chars", "map('k', doc_id) as tags", "array(struct(doc_id as score)) as stay_key", "1 as decon_hit", "2 as copies")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, " ".join(good[3].split()[5:20])), (None, None)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == table.columns
        if name == "decontaminate":
            ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect())
            # 3 holds the benchmark; copies of 0 and 1 go (the latter adds five shingles), and one row of 7 stays
            assert ids == sorted([*((False, i) for i in range(60) if i != 3), (False, 70), (True, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 60
