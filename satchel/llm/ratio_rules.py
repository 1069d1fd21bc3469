"""Quality rules: plain counts, and the likelihood ratio of hashed n-grams between trusted and raw text.

The words of a text, one and two at a time, fall into buckets by the crc32 of their words.  The corpus is a multinomial over buckets,
and so are the trusted documents (labelled as good); a bucket's gain is the logarithm of the ratio of its smoothed shares, in
whole thousandths.  A document's verdict is the sum of its gains against a threshold per n-gram, in whole numbers, so that
every run and every partitioning decides alike.

Everything is expressions over arrays and one small aggregate: texts are never shuffled, and neither a text nor its words
leave their row.  The driver sees the counts of the buckets only, whose number is a parameter.

Null and empty texts have no words and fail the base rules.  Repeated rows and equal texts get equal results, null ids
too; an empty table gives an empty result; without trusted documents all gains are 0, so that only the base rules decide.
Further columns of docs are kept as they are; the new ones get underscores where names clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

WIDTH = 5  # words of the windows that are looked for twice
FACTOR = 31  # n-grams are numbers in this base, with the crc32 of words as digits
FAR = 33_554_393  # so that two pairs of words fit 63 bits
SPACE = r"[\x20\x09-\x0D]+"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_features", "kept")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def words(text: str | Column) -> Column:
    """The words of a text: runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def indices(n: Column) -> Column:
    """0, 1, ... n - 1 as an array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def runs(most: int) -> list:
    """For n = 1 to ``most`` a function of h, the crc32 of each word: a number for every n consecutive words."""
    if not 1 <= most <= 6:
        raise ValueError("n-grams of 1 to 6 words fit a number")

    def longer(before, n: int):
        return lambda h: let(before(h), lambda g: F.transform(indices(F.size(h) - (n - 1)), lambda i: F.get(g, i) * FACTOR + F.get(h, i + (n - 1))))

    out = [lambda h: h]
    for n in range(2, most + 1):
        out.append(longer(out[-1], n))
    return out


def hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x))


def repeated(w: Column, h: Column) -> Column:
    """How many words stand in windows of WIDTH words that occur twice or more in w; h are the words' crc32.

    Where no four words occur twice by their crc32 no window does; only other texts have their windows hashed (64 bits) and
    sorted with their places."""

    def covered(at: Column) -> Column:  # of sorted places where such windows begin
        steps = F.transform(indices(F.size(at) - 1), lambda k: F.least(F.get(at, k + 1) - F.get(at, k), F.lit(WIDTH)))
        return F.aggregate(steps, F.lit(WIDTH), lambda a, b: a + b)

    def twice(order: Column) -> Column:  # (hash, place) of all windows, sorted
        def same(k: Column) -> Column:
            x = F.get(order, k)["h"]
            return F.get(order, k - 1)["h"].eqNullSafe(x) | F.get(order, k + 1)["h"].eqNullSafe(x)

        again = F.filter(indices(F.size(order)), same)
        return F.when(F.size(again) > 0, let(F.sort_array(F.transform(again, lambda k: F.get(order, k)["i"])), covered)).otherwise(0)

    windows = F.transform(indices(F.size(w) - (WIDTH - 1)), lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))).alias("h"), i.alias("i")))
    fours = let(runs(2)[1](h), lambda p: F.transform(indices(F.size(p) - 2), lambda i: F.get(p, i) * FAR + F.get(p, i + 2)))
    return let(fours, lambda q: F.when(F.size(F.array_distinct(q)) < F.size(q), let(F.sort_array(windows), twice)).otherwise(0))


def trusted(docs: DataFrame, labels: DataFrame, usable: Column, sample_docs: int) -> DataFrame:
    """docs with _trusted: whether the doc_id is among at most ``sample_docs`` ids that are labelled as good, and not also as
    bad, in the order of a hash.  So many ids are broadcast."""
    good = labels.where("quality in (0, 1) and doc_id is not null").where(usable).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("doc_id", F.lit(True).alias("_trusted"))
    return docs.join(F.broadcast(good), "doc_id", "left").withColumn("_trusted", F.coalesce("_trusted", F.lit(False)))


def gains(docs: DataFrame, labels: DataFrame, usable: Column, buckets_: int, most: int, sample_docs: int) -> list[int]:
    """Of each bucket floor(1000 ln(t / s)): its count among trusted documents against that in all documents at the same total,
    one added to both, so that what is too rare to be expected among the trusted says nothing."""
    marked = trusted(docs.select("doc_id", "text"), labels, usable, sample_docs)
    every = let(hashed(words("text")), lambda h: F.concat(*(F.transform(run(h), lambda x: x % buckets_) for run in runs(most))))
    flat = marked.select("_trusted", F.explode(every).alias("b"))
    found = flat.groupBy("b").agg(F.count(F.lit(1)).alias("s"), F.count_if("_trusted").alias("t")).collect()
    counts = {r.b: (r.s, r.t) for r in found}  # a row per bucket
    all_s, all_t = sum(s for s, _ in counts.values()), sum(t for _, t in counts.values())
    rows = (counts.get(b, (0, 0)) for b in range(buckets_))
    return [_gain(s, t, all_s, all_t) for s, t in rows]


def _gain(s: int, t: int, all_s: int, all_t: int) -> int:
    return math.floor(1000 * math.log((t + 1.0) * all_s / (float(s) * all_t + all_s))) if all_s else 0


def judged(docs: DataFrame, gain: list[int], least: int = -100, most: int = 2) -> DataFrame:
    """All columns of docs, then the counts, whether the base rules fail, the sum of gains, the number of n-grams, and
    whether the document is kept: base rules passed, and gains of ``least`` thousandths an n-gram or more."""
    of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # a constant
    text = F.coalesce("text", F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        duplicates = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        n = F.size(w)
        features = sum((F.greatest(n - k, F.lit(0)) for k in range(most)), F.lit(0))

        def more(h: Column) -> Column:
            ratio = sum((F.aggregate(run(h), F.lit(0).cast("long"), lambda a, x: a + F.get(of, (x % len(gain)).cast("int"))) for run in runs(most)), F.lit(0).cast("long"))
            return F.struct(n.alias("n"), F.length(F.array_join(w, "")).alias("chars"), duplicates.alias("lines"), repeated(w, h).alias("twice"), ratio.alias("ratio"), features.alias("features"))

        return let(hashed(w), more)

    row, *names = unused(docs.columns, "_found", *RESULT)
    found = docs.withColumn(row, let(words("text"), counts))
    get = F.col(row)
    failed = (get["n"] < 10) | (100 * get["twice"].cast("long") > 20 * get["n"].cast("long"))
    kept = ~failed & (get["ratio"] >= least * get["features"].cast("long"))
    values = (get["n"], get["chars"], F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), get["lines"], get["twice"], failed, get["ratio"], get["features"], kept)
    kinds = ("long",) * 5 + ("boolean", "long", "long", "boolean")
    return found.select(*docs.columns, *(v.cast(k).alias(x) for v, k, x in zip(values, kinds, names, strict=True)))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, mod 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def quality_rules(docs: DataFrame, labels: DataFrame, buckets_: int = 1 << 14, most: int = 2, sample_docs: int = 20_000) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, then ratio and n_features.

    Trusted are documents that labels call good, outside the held-out fold (1 of fold())."""
    gain = gains(docs, labels, fold() != 1, buckets_, most, sample_docs)
    found = judged(docs.select("doc_id", "text"), gain, most=most)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_features")


def brute_force(docs: list[tuple], good: set, buckets_: int = 1 << 14, most: int = 2, least: int = -100) -> dict:
    """What quality_rules must return, from plain loops (for tests): doc_id to the rest."""
    import re
    import zlib
    from collections import Counter

    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    of = lambda w: [sum(zlib.crc32(x.encode()) * FACTOR ** (n - 1 - k) for k, x in enumerate(w[i : i + n])) % buckets_ for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(of(cut(t)))
        if i in good:
            target.update(of(cut(t)))
    s, t_ = sum(raw.values()), sum(target.values())
    gain = {b: _gain(raw[b], target[b], s, t_) for b in range(buckets_)}
    out = {}
    for i, t in docs:
        w, seen, lines = cut(t), Counter(), Counter()
        n_dup = 0
        for line in (t or "").split("\n"):
            if cut(line):
                n_dup += lines[line] > 0
                lines[line] += 1
        windows = [tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)]
        seen.update(windows)
        twice = len({k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(WIDTH)})
        failed = len(w) < 10 or 100 * twice > 20 * len(w)
        ratio, n = sum(gain[b] for b in of(w)), len(of(w))
        out[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), n_dup, twice, failed, not failed and ratio >= least * n, ratio, n)
    return out
