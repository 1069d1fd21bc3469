"""Mixing sources to target weights by entropy balancing.

Every source has a weight; its target is its share of the words to take, but at most ``cap`` times its own words, the
excess being shared again by weight.  The mix must also keep the corpus's share of words in every class of documents
(by default classes of length), so that reaching a source's target doesn't trade its long documents for short ones.

Document rates are those nearest to one common rate (in relative entropy, counted in words) that meet these constraints
on words: r = min(cap, base * exp(lambda_source + mu_class)).  The multipliers are the minimum of the convex dual.  For
given mu each lambda has a closed form, so Newton's method runs over mu alone, whose gradient and Hessian are sums over
sources, taken in one distributed pass over a table of a row per source; only these sums reach the driver.  Where caps
make the shares impossible, a small ridge on mu settles for the nearest; targets of sources are always kept.  Newton's steps
are damped where caps bend the dual, and end in any case.

Rates are then rounded to whole copies with a keyed hash per document and a common shift of that hash per source, the
weighted quantile at the target.  It is read from a histogram of each source: documents above the sizes ``fine`` are cut
between bins, and the smallest documents (that hold eight bins' words) at a point within a bin: they make up for what the
others left, so that the words taken come within one small document of the target.  Only the points of that bin are sorted; where they are many, it is
cut into bins again.  All states are tables, whatever the number of sources.  A source with a large share of the
documents is looked up by broadcast, all others by a shuffle.

Null source is a source of its own, the last; null texts have size 0; documents of size 0 are taken 0 words.  A source
without words has target 0.  Rows that are equal in doc_id and text are rounded one by one, by their place in the
input.  Long texts are one row of counts.  Reruns agree.  An empty table gives an empty table.  Further columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import MADE, SPACED, forget, light, looked_up, modest_batches, pieces, text_bytes, written

WORD = r"[^\x20\x09-\x0D]+"
LENGTH_CLASSES = 8
BINS = 1024
SORTED = 200_000  # points of a source's last bin that are sorted without cutting it again


def _counted(text: pa.Array) -> pa.Array:
    data, offsets = text_bytes(text)
    out = np.zeros(len(text), np.int64)
    for a, b in pieces(offsets, 1 << 22):
        inside = SPACED[data[offsets[a] : offsets[b]]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = offsets[a : b + 1] - offsets[a]
        begin = at[:-1][np.diff(at) > 0]
        first[begin] = inside[begin]  # a text's first word doesn't continue that of the text before
        out[a:b] = np.diff(np.searchsorted(np.flatnonzero(first), at))
    return pa.array(out)


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than white space; null is 0."""
    return F.arrow_udf(_counted, "long")(text)


def length_class(size: Column) -> Column:
    """Documents of 1 to 3 words, 4 to 15, 16 to 63, ... and the longest."""
    return F.least(F.lit(LENGTH_CLASSES - 1), F.floor((F.length(F.bin(size)) - 1) / 2)).cast("int")


def _steady(docs: DataFrame) -> DataFrame:
    """docs, if it is a scan of files, whose rows come in the same order each time; else written and read back."""
    if docs.inputFiles() and "Exchange" not in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    return written(docs, "mixed")


def _small(df: DataFrame) -> bool:
    return light(df) is not df


def _by_source(rows: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their source in a written table of skey and n, the number of rows of each."""
    return rows.join(light(known.drop("n")), "skey") if _small(known) else looked_up(rows, known, "skey", "n", total)


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in the order of code points, null last; no task sees all of them."""
    row = F.monotonically_increasing_id()  # the partition in the upper bits, the row below
    placed = written(sources.orderBy(F.col("source").isNull(), "source").withColumn("row", row), "ordered")
    part = F.shiftright("row", 33)
    first, total = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        first.append((r.part, total))
        total += r["count"]
    offsets = sources.sparkSession.createDataFrame(first or [(0, 0)], "part long, first long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("place", F.col("first") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "row")


def _targeted(ranked: DataFrame, weights: tuple, share: float, cap: int) -> DataFrame:
    """Sources with their targets: shares by weight, none above cap times its size; a pass over the sources a round."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    weighed = ranked.withColumn("weight", weight)
    words, total_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    left = total = share * (words or 0)
    open_weight = total_weight or 1.0
    most = F.col("source_size") * F.lit(float(cap))

    def fair() -> Column:
        return F.lit(float(left)) * F.col("weight") / F.lit(float(open_weight))

    closed = -1
    while True:  # what is above its cap once stays so, as the share of the others only grows
        n, size, w = weighed.where(fair() > most).agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
        if n == closed or n == 0 or total_weight - w <= 0:
            if n and total_weight - w <= 0:
                return weighed.withColumn("target", most)
            return weighed.withColumn("target", F.when(fair() > most, most).otherwise(fair()))
        closed, left, open_weight = n, total - float(cap) * size, total_weight - w


def source_rates(words: np.ndarray, target: np.ndarray, mu: np.ndarray, base: float, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of each source's classes, and lambda, such that a source's words at these rates are its target.

    Classes reach the cap in the order of mu; with k of them at the cap lambda has a closed form, and the first k for
    which the others stay below the cap holds.  A source whose target is all it can give has all rates at the cap.
    """
    order = np.argsort(-mu, kind="stable")
    w, lift = words[:, order], np.exp(mu[order])
    capped = cap * (np.cumsum(w, 1) - w)
    rest = np.cumsum((w * lift)[:, ::-1], 1)[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = (target[:, None] - capped) / (base * rest)  # exp(lambda)
    holds = (rest > 0) & (scale > 0) & (base * scale * lift <= cap * (1 + 1e-12))
    k = holds.argmax(1)
    found = holds[np.arange(len(w)), k] & (target < cap * words.sum(1) * (1 - 1e-12))
    chosen = np.where(found, scale[np.arange(len(w)), k], 1.0)
    rates = np.minimum(cap, base * chosen[:, None] * np.exp(mu)[None])
    rates[~found] = np.where(target[~found, None] > 0, cap, 0.0)
    return rates, np.where(found, np.log(chosen), np.inf)


def dual(words: np.ndarray, target: np.ndarray, mu: np.ndarray, base: float, cap: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The sources' part of the dual (lambda minimised), its gradient and Hessian by mu."""
    rates, lam = source_rates(words, target, mu, base, cap)
    inner = np.isfinite(lam)
    taken = words * rates
    z = np.where(inner, lam, 0.0)[:, None] + mu[None]
    below = base * np.exp(z) <= cap
    value = np.where(below, base * np.exp(z), cap * (1 + z - np.log(cap / base)))
    value = np.where(inner[:, None], words * value, taken * mu[None]).sum() - (target[inner] * lam[inner]).sum()
    free = np.where(below & inner[:, None], taken, 0.0)
    total = free.sum(1)
    some = total > 0
    hessian = np.diag(free.sum(0)) - (free[some] / total[some, None]).T @ free[some]
    return float(value), taken.sum(0), hessian


def descended(evaluated, n: int, wanted: float, tolerance: float, most_steps: int) -> np.ndarray:
    """The multipliers where the convex dual (value, gradient, hessian) is least: Newton's method with a damping that grows
    when a step has to be shortened, as caps make the dual smooth in pieces only.

    Ends in any case: after ``most_steps``, with the multipliers of the smallest gradient.  Whatever they are, the sources'
    targets hold; only the shares of the classes are then as near as the steps have come."""
    mu, damping = np.zeros(n), 0.0
    value, g, h = evaluated(mu)
    best = (np.abs(g).max(), mu)
    for _ in range(most_steps):
        if best[0] <= tolerance * wanted or damping > 1e8:
            break
        move = -np.linalg.solve(h + damping * np.diag(np.maximum(np.diag(h), 1e-9 * wanted)), g)
        move *= min(1.0, 4.0 / max(1e-300, np.abs(move).max()))
        step = 1.0
        while step >= 1e-3:
            tried = evaluated(mu + step * move)
            if tried[0] <= value + 1e-4 * step * (g @ move) + 1e-13 * abs(value) or np.abs(tried[1]).max() < 0.5 * np.abs(g).max():
                break
            step /= 2
        if step < 1e-3:
            damping = max(10 * damping, 1e-2)
            continue
        damping = max(3 * damping, 1e-3) if step < 1 else damping / 10 if damping > 1e-6 else 0.0
        mu, (value, g, h) = mu + step * move, tried
        best = min(best, (np.abs(g).max(), mu), key=lambda x: x[0])
    return best[1]


def balanced(sources: DataFrame, shares: list[float] | None, base: float, cap: float, ridge: float = 1e-3, tolerance: float = 1e-9, most_steps: int = 150) -> np.ndarray:
    """mu by class: Newton's method on the dual over a written table (words by class, target), a pass a step.

    ``shares``: the share of each class in the words taken; None keeps the corpus's.
    """
    n = len(sources.first().words)
    totals = sources.agg(F.sum("target"), *(F.sum(F.col("words")[c]) for c in range(n))).first()
    wanted, classes = float(totals[0]), np.array(totals[1:], float)
    if wanted <= 0:
        return np.zeros(n)
    share = classes / classes.sum() if shares is None else np.asarray(shares, float)
    goal = wanted * share
    each = sources.select("words", "target")
    each = each.coalesce(1) if _small(sources) else each

    def evaluated(mu: np.ndarray):
        def rows(batches):
            value, g, h = 0.0, np.zeros(n), np.zeros((n, n))
            for batch in batches:
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                v, a, b = dual(w, batch.column(1).to_numpy(zero_copy_only=False), mu, base, cap)
                value, g, h = value + v, g + a, h + b
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([g.tolist()], pa.list_(pa.float64())), pa.array([h.ravel().tolist()], pa.list_(pa.float64()))], ["v", "g", "h"])

        parts = each.mapInArrow(rows, "v double, g array<double>, h array<double>").collect()  # one row a task
        weight = ridge * wanted
        value = sum(p.v for p in parts) - goal @ mu + weight / 2 * (mu @ mu)
        return value, sum(np.array(p.g) for p in parts) - goal + weight * mu, sum(np.array(p.h) for p in parts).reshape(n, n) + weight * np.eye(n)

    return descended(evaluated, n, wanted, tolerance, most_steps)


def _rated(sources: DataFrame, mu: np.ndarray, base: float, cap: float) -> DataFrame:
    """skey, n, source_size, target and rates, an array by class, of each source."""
    schema = "skey string, n long, source_size long, target double, rates array<double>"

    def rows(batches):
        for batch in batches:
            w = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mu))
            rates, _ = source_rates(w, batch.column(3).to_numpy(zero_copy_only=False), mu, base, cap)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rates.tolist(), pa.list_(pa.float64()))], ["skey", "n", "source_size", "target", "rates"])

    return sources.select("skey", "n", "source_size", "target", "words").mapInArrow(rows, schema)


def _bin(theta: Column, low: Column, step: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((theta - low) / step))).cast("int")


def _chosen(counts: DataFrame, levels: int) -> DataFrame:
    """By source, where its levels are cut: rows (skey, target, bin, words and numbers of points by level).

    cuts: the bin below which the points of each level are taken.  ``last`` is the level that makes up for the others: ``at``
    is the bin in which its need is reached (BINS: never), ``need`` what this bin's points have to give, and ``points``
    their number.
    """
    kind = "skey string, cuts array<int>, last int, at int, need double, points long"

    def rows(batches):
        held: dict[str, list] = {}

        def done(key: str) -> tuple:
            words, points = np.zeros((levels, BINS)), np.zeros((levels, BINS), np.int64)
            for _, target, bin_, w, n in held.pop(key):
                words[:, bin_], points[:, bin_] = w, n
            # the smallest documents that have enough words to make up for a bin of the others
            all_ = words.sum(1)
            enough = np.flatnonzero(all_ >= 8 * all_.sum() / BINS)
            last = int(enough.max() if len(enough) else all_.argmax())
            cuts, left = [0] * levels, [i for i in range(levels) if i != last]
            for level in left:
                total = np.concatenate([[0.0], np.cumsum(words[[i for i in range(levels) if i >= level or i == last]].sum(0))])
                cuts[level] = int(np.abs(total - target).argmin())
                target -= words[level, : cuts[level]].sum()
            total = np.concatenate([[0.0], np.cumsum(words[last])])
            at = int(np.searchsorted(total[1:], target, "left")) if target > 0 else 0
            inside = at < BINS and target > 0
            cuts[last] = at
            need, n = (target - total[at], points[last, at]) if inside else (0.0, 0)
            return key, cuts, last, at, float(need), int(n)

        def packed(found: list[tuple]):
            types = (pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["skey", "cuts", "last", "at", "need", "points"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] not in held and held:
                    found.append(done(next(iter(held))))
                held.setdefault(row[0], []).append(row)
            if found:
                yield packed(found)
        if held:
            yield packed([done(next(iter(held)))])

    return counts.select("skey", "target", "bin", "words", "points").repartition("skey").sortWithinPartitions("skey").mapInArrow(rows, kind)


def _reached(points: DataFrame) -> DataFrame:
    """skey and cut of sorted points (skey, need, theta, size): those with theta < cut have words nearest to the need."""

    def rows(batches):
        now, total, cut, over = None, 0.0, 0.0, True
        for batch in batches:
            out = []
            for key, need, theta, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, cut))
                    now, total, over = key, 0.0, False
                if not over:
                    over = total + size >= need
                    cut = theta if over and need - total <= total + size - need else float(np.nextafter(theta, np.inf))
                    total += size
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([c for _, c in out], pa.float64())], ["skey", "cut"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([cut])], ["skey", "cut"])

    return points.select("skey", "need", "theta", "size").repartition("skey").sortWithinPartitions("skey", "theta").mapInArrow(rows, "skey string, cut double")


def _cuts(described: DataFrame, rated: DataFrame, total: int, cap: int, fine: tuple[int, ...]) -> DataFrame:
    """skey, n, cuts (by level, the bin below which copies are taken), last, at and cut: in bin ``at`` of level ``last``, those
    with theta < cut are taken as well."""
    levels, low, step = len(fine) + 1, F.lit(-float(cap) - 2), F.lit((2.0 * cap + 4) / BINS)
    theta = F.explode(F.array(*(F.lit(float(k)) - F.col("rate") - F.col("u") for k in range(1, cap + 1)))).alias("theta")
    level = _level(fine).alias("level")
    points = described.where("size > 0 and target > 0").select("skey", "target", "size", level, theta).withColumn("bin", _bin(F.col("theta"), low, step))

    def by_level(value: Column) -> Column:
        return F.array(*(F.sum(F.when(F.col("level") == i, value).otherwise(0)) for i in range(levels)))

    counts = points.groupBy("skey", "bin").agg(F.max("target").alias("target"), by_level(F.col("size")).alias("words"), by_level(F.lit(1)).alias("points"))
    found = written(_chosen(counts, levels).join(rated.select("skey", "n"), "skey"), "chosen")
    open_ = found.where("points > 0").select("skey", "n", "last", "at", "need")
    inside = _by_source(points.drop("target"), open_, total).where("level = last and bin = at").select("skey", "need", "theta", "size")
    most, width = found.agg(F.max("points")).first()[0] or 0, (2.0 * cap + 4) / BINS
    while most > SORTED and width > 1e-15:
        # cut the bin again; what lies below the one in which the need is reached is taken
        inside = written(inside, "points")
        edges = inside.groupBy("skey").agg(F.min("theta").alias("low"), F.max("theta").alias("high"), F.max("need").alias("target"), F.count(F.lit(1)).alias("n"))
        edges = written(edges, "edges")
        binned = _by_source(inside.drop("need"), edges, total).withColumn("bin", _bin(F.col("theta"), F.col("low"), F.greatest((F.col("high") - F.col("low")) / BINS, F.lit(1e-300))))
        counts = binned.groupBy("skey", "bin").agg(F.max("target").alias("target"), F.array(F.sum("size")).alias("words"), F.array(F.count(F.lit(1))).alias("points"))
        shift = written(_chosen(counts, 1).join(edges.select("skey", "n"), "skey"), "chosen")
        inside = _by_source(binned.drop("target", "n", "low", "high"), shift.select("skey", "n", "at", "need"), total).where("bin = at").select("skey", "need", "theta", "size")
        fewer = shift.agg(F.max("points")).first()[0] or 0
        if fewer >= most:
            break
        most, width = fewer, width / BINS
    cut = written(_reached(inside), "cut")
    return found.join(cut, "skey", "left").select("skey", "n", "cuts", "last", "at", F.coalesce("cut", F.lit(-float(cap) - 3)).alias("cut"))


def _level(fine: tuple[int, ...]) -> Column:
    """0 for the largest documents, and one more for each size of ``fine`` that a document doesn't exceed."""
    return sum((F.when(F.col("size") <= limit, 1).otherwise(0) for limit in fine), F.lit(0))


def _copies(cap: int, fine: tuple[int, ...]) -> Column:
    """A document gains its k-th copy at theta = k - rate - u; those below its source's cut are taken."""
    low, step = F.lit(-float(cap) - 2), F.lit((2.0 * cap + 4) / BINS)
    level = _level(fine)
    out = F.lit(0)
    for k in range(1, cap + 1):
        theta = F.lit(float(k)) - F.col("rate") - F.col("u")
        place = _bin(theta, low, step)
        within = (level == F.col("last")) & (place == F.col("at")) & (theta < F.col("cut"))
        out = out + F.when((place < F.element_at("cuts", level + 1)) | within, 1).otherwise(0)
    return out


def mixed_copies(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 17, fine: tuple[int, ...] = (250, 60), classes: Column | None = None, n_classes: int = LENGTH_CLASSES, class_shares: list[float] | None = None, keep: tuple[str, ...] = ("doc_id",), again: bool = False) -> DataFrame:
    """row (a struct of the columns ``keep``), size, source_size, target and copies.

    Weights go to the sources in the order of code points, null last, and repeat.  ``classes``: the class number (0 to
    n_classes - 1) of each document, None for classes of length; ``class_shares``: their shares in the mix, None for the
    corpus's.  ``again``: read docs a second time for the result, rather than write the columns ``keep`` in between.
    """
    modest_batches(docs.sparkSession)
    docs = _steady(docs)
    since = len(MADE)
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    uid = F.xxhash64(F.lit(seed), "doc_id", "text")

    def sized(carried: tuple[str, ...]) -> DataFrame:
        size = word_count(F.col("text"))
        kind = F.lit(-1) if classes is None else classes.cast("int")
        out = docs.select(F.struct(*carried, F.lit(0).alias("carried")).alias("row"), F.col("source").alias("source"), skey.alias("skey"), size.alias("size"), uid.alias("uid"), F.monotonically_increasing_id().alias("rid"), kind.alias("kind"))
        return out.withColumn("kind", length_class(F.col("size"))) if classes is None else out

    slim = written(sized(() if again else keep), "mix")
    total = slim.count()
    twins = written(slim.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twins")
    lone = twins.isEmpty()

    def drawn(rows: DataFrame) -> DataFrame:
        """u, uniform in [0, 1), by a keyed hash; rows with equal ids and texts also by their place."""
        def unit(*of) -> Column:
            return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))

        if lone:
            return rows.withColumn("u", unit("uid"))
        marked = twins.withColumn("twin", F.lit(True))
        rows = rows.join(light(marked.drop("n")), "uid", "left") if _small(twins) else looked_up(rows, marked, "uid", "n", total, "left")
        return rows.withColumn("u", F.when(F.col("twin"), unit("uid", "rid")).otherwise(unit("uid"))).drop("twin")

    words = F.array(*(F.sum(F.when(F.col("kind") == c, F.col("size")).otherwise(0)).cast("double") for c in range(n_classes))).alias("words")
    sources = slim.groupBy("skey", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"), words)
    sources = written(_targeted(_ranked(sources), weights, share, cap).select("skey", "n", "source_size", "target", "words"), "sources")
    if total:
        base, mu = float(share), balanced(sources, class_shares, float(share), float(cap))
    else:
        base, mu = float(share), np.zeros(n_classes)
    rated = written(_rated(sources, mu, base, float(cap)), "rated")

    def ready(rows: DataFrame) -> DataFrame:
        found = _by_source(drawn(rows), rated, total)
        return found.withColumn("rate", F.element_at("rates", F.col("kind") + 1)).select("row", "skey", "size", "source_size", "target", "rate", "u")

    described = ready(slim)
    cuts = written(_cuts(described, rated, total, cap, fine).drop("n").join(rated, "skey", "right"), "known")
    found = _by_source(drawn(sized(keep) if again else slim), cuts, total).withColumn("rate", F.element_at("rates", F.col("kind") + 1))
    forget(docs.sparkSession, since, keep=(docs, slim, twins, cuts))
    copies = F.when((F.col("target") > 0) & (F.col("size") > 0), F.coalesce(_copies(cap, fine), F.lit(0))).otherwise(0)
    return found.select(F.col("row").dropFields("carried").alias("row") if keep else "row", "size", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mixed_copies(docs.select("doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def materialised(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    found = mixed_copies(docs, keep=tuple(docs.columns), again=True, **options)
    return found.select("row", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).select("row.*").select(*docs.columns)
