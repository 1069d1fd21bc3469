"""Crossovers and mutations as expressions of genotype columns, draw columns and parameters.

Draws are uniform numbers in [0, 1): ``u`` columns are one number, ``us`` columns an array with one number per locus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import choose, draw, nearest_of

Pair = tuple[Column, Column]


def _mix(a: Column, b: Column, us: Column, pick) -> Column:
    """Locus by locus pick(a, b, u)."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), us.alias("u")), lambda s: pick(s["a"], s["b"], s["u"]))


# Crossovers


def one_point(a: Column, b: Column, u: Column) -> Pair:
    """Cut in [1, length - 1)."""
    n = F.size(a)
    cut = choose(u, 1, F.greatest(n - 1, F.lit(2)))
    return F.concat(F.slice(a, F.lit(1), cut), F.slice(b, cut + 1, n - cut)), F.concat(F.slice(b, F.lit(1), cut), F.slice(a, cut + 1, n - cut))


def two_point(a: Column, b: Column, u: Column, v: Column) -> Pair:
    """The loci from the first to the second cut change sides."""
    n = F.size(a)
    first = choose(u, 1, F.greatest(n - 2, F.lit(2)))
    second = first + choose(v, 0, F.greatest(n - 1 - first, F.lit(1)))

    def son(x: Column, y: Column) -> Column:
        return F.concat(F.slice(x, F.lit(1), first), F.slice(y, first + 1, second - first), F.slice(x, second + 1, n - second))

    return son(a, b), son(b, a)


def uniform(a: Column, b: Column, us: Column, p: float = 0.5) -> Pair:
    """Loci change sides with probability p (also the discrete crossover of real genes)."""
    return _mix(a, b, us, lambda x, y, u: F.when(u < p, y).otherwise(x)), _mix(a, b, us, lambda x, y, u: F.when(u < p, x).otherwise(y))


def half_uniform(a: Column, b: Column, us: Column) -> Pair:
    """HUX: differing loci change sides with probability 1/2."""
    return uniform(a, b, us, 0.5)


def arithmetic(a: Column, b: Column, ratio: float = 0.8) -> Pair:
    r = float(ratio)
    return F.zip_with(a, b, lambda x, y: x * r + y * (1 - r)), F.zip_with(a, b, lambda x, y: y * r + x * (1 - r))


def blend(a: Column, b: Column, us: Column, low: float, high: float, alpha: float = 0.5) -> Column:
    """BLX-alpha: uniform in the range of both, widened on each side by alpha times its width."""
    def pick(x, y, u):
        least, most = F.least(x, y), F.greatest(x, y)
        wide = (most - least) * alpha
        return nearest_of(least - wide + u * (most - least + 2 * wide), low, high)

    return _mix(a, b, us, pick)


def flat(a: Column, b: Column, us: Column) -> Column:
    return _mix(a, b, us, lambda x, y, u: F.least(x, y) + u * F.abs(x - y))


def linear(a: Column, b: Column, low: float, high: float) -> tuple[Column, Column, Column]:
    def son(p: float, q: float) -> Column:
        return F.zip_with(a, b, lambda x, y: nearest_of(x * p + y * q, low, high))

    return son(0.5, 0.5), son(1.5, -0.5), son(-0.5, 1.5)


def wright(a: Column, b: Column, us: Column, low: float, high: float) -> Column:
    return _mix(a, b, us, lambda x, y, u: nearest_of(x + u * (x - y), low, high))


# Mutations


def one_locus(g: Column, u: Column, v: Column, low: int, high: int) -> Column:
    """One locus becomes another value of [low, high)."""
    at = choose(u, 0, F.size(g))
    return F.transform(g, lambda x, i: F.when(i == at, _other(x, v, low, high)).otherwise(x))


def _other(x: Column, v: Column, low: int, high: int) -> Column:
    if high - low < 2:
        return x
    k = choose(v, low, high - 1)
    return F.when(k >= x, k + 1).otherwise(k).cast("int")


def several_loci(g: Column, us: Column, vs: Column, points: int, low: int, high: int) -> Column:
    """The loci of the ``points`` least draws change."""
    bar = F.element_at(F.array_sort(us), F.least(F.lit(points), F.size(us)))
    return _mutated(g, us, vs, lambda x, u, v: F.when(u <= bar, _other(x, v, low, high)).otherwise(x))


def uniform_mutation(g: Column, us: Column, vs: Column, p: float, low: int, high: int) -> Column:
    """Each locus changes with probability p; bits are low 0, high 2."""
    return _mutated(g, us, vs, lambda x, u, v: F.when(u < p, _other(x, v, low, high)).otherwise(x))


def _mutated(g: Column, us: Column, vs: Column, change) -> Column:
    return F.transform(F.arrays_zip(g.alias("g"), us.alias("u"), vs.alias("v")), lambda s: change(s["g"], s["u"], s["v"]))


def _real(g: Column, us: Column, vs: Column, p: float, low: float, high: float, new) -> Column:
    return _mutated(g, us, vs, lambda x, u, v: F.when(u < p, nearest_of(new(x, v), low, high)).otherwise(x))


def random_reset(g: Column, us: Column, vs: Column, low: float, high: float, p: float = 0.05) -> Column:
    return _real(g, us, vs, p, low, high, lambda x, v: F.lit(low) + v * (high - low))


def random_range(g: Column, us: Column, vs: Column, low: float, high: float, interval: float = 2.0, p: float = 0.6) -> Column:
    return _real(g, us, vs, p, low, high, lambda x, v: x + (2 * v - 1) * interval)


def _digit(v: Column, k: int) -> Column:
    """Further uniform numbers from one draw."""
    x = v * float(1 << 20) * (2 * k + 3) * 0.6180339887498949
    return x - F.floor(x)


def geometric(g: Column, us: Column, vs: Column, low: float, high: float, base: float = 2.0, least: float = 1e-5, mutation_range: float = 0.1, p: float = 0.05) -> Column:
    """Steps of range * sum of base^-k, each k with probability 1/16, to either side: Mühlenbein's (base 2, k to 15) and
    the modal discrete mutation (k while base^-k is at least ``least``)."""
    steps = 15 if least == 2.0**-15 else int(math.log(least) / math.log(base)) * -1
    width = mutation_range * (high - low)

    def new(x, v):
        gamma = sum((F.when(_digit(v, k) < 0.0625, float(base**-k)).otherwise(0.0) for k in range(steps + 1)), F.lit(0.0))
        return x + F.when(_digit(v, 99) < 0.5, 1.0).otherwise(-1.0) * width * gamma

    return _real(g, us, vs, p, low, high, new)


def muhlenbein(g: Column, us: Column, vs: Column, low: float, high: float, mutation_range: float = 0.1, p: float = 0.05) -> Column:
    return geometric(g, us, vs, low, high, 2.0, 2.0**-15, mutation_range, p)


def modal_continuous(g: Column, us: Column, vs: Column, low: float, high: float, base: float = 2.0, least: float = 1e-5, mutation_range: float = 0.1, p: float = 0.6) -> Column:
    """As the discrete one, but each step is drawn from a triangle around base^-k that reaches half-way to its neighbours."""
    steps = int(math.log(least) / math.log(base)) * -1
    width = mutation_range * (high - low)

    def new(x, v):
        gamma = F.lit(0.0)
        for k in range(steps + 1):
            middle, below, above = base**-k, (base**-k - base ** -(k + 1)) / 2, (base ** (1 - k) - base**-k) / 2
            t = _digit(v, 200 + k)
            share = below / (below + above)
            step = F.when(t < share, middle - below + F.sqrt(t * below * (below + above))).otherwise(middle + above - F.sqrt((1 - t) * above * (below + above)))
            gamma = gamma + F.when(_digit(v, k) < 0.0625, step).otherwise(0.0)
        return x + F.when(_digit(v, 99) < 0.5, 1.0).otherwise(-1.0) * width * gamma

    return _real(g, us, vs, p, low, high, new)


def non_uniform(g: Column, us: Column, vs: Column, low: float, high: float, generation: int, most: int, b: float = 5.0, p: float = 0.05) -> Column:
    """Towards either end by a part that shrinks with the generations."""
    e = (1 - generation / most) ** b

    def new(x, v):
        part = 1 - F.pow(F.greatest(_digit(v, 1), F.lit(1e-300)), F.lit(e))
        return F.when(_digit(v, 99) < 0.5, x - (x - low) * part).otherwise(x + (high - x) * part)

    return _real(g, us, vs, p, low, high, new)


def mixed_non_uniform(g: Column, us: Column, vs: Column, generation: int, most: int, b: float = 5.0, p: float = 0.05) -> Column:
    """non_uniform over mixed_domains: real loci move freely, the others to the nearest whole number."""
    e = (1 - generation / most) ** b

    def change(s: Column, i: Column) -> Column:
        x, high = s["g"], F.when((i == 10) | (i == 11), 4.0).otherwise(1.0)
        part = 1 - F.pow(F.greatest(_digit(s["v"], 1), F.lit(1e-300)), F.lit(e))
        y = F.when(_digit(s["v"], 99) < 0.5, x - x * part).otherwise(x + (high - x) * part)
        return F.when(s["u"] < p, F.when(i < 10, y).otherwise(F.round(y))).otherwise(x)

    return F.transform(F.arrays_zip(g.alias("g"), us.alias("u"), vs.alias("v")), change)


def mixed_domains(length: int) -> list[tuple[float, float]]:
    """Ten real loci in [0, 1], two of five ways, the rest of two ways."""
    return [(0.0, 1.0) if i < 10 else (0.0, 4.0) if i < 12 else (0.0, 1.0) for i in range(length)]


# Clustering genotypes: a label per bag


def medoid_pair(g: Column, us: Column, vs: Column, low: int, high: int, p: float) -> Column:
    """Uniform flips of bag indices; if the first two genes are equal then, the second moves on, within bounds."""
    m = uniform_mutation(g, us, vs, p, low, high)
    return F.transform(m, lambda x, i: F.when((i == 1) & (x == m[0]), F.when(x + 1 < high, x + 1).otherwise(F.greatest(x - 1, F.lit(low)))).otherwise(x))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used; also inside functions of elements, where Spark would
    compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _held(use, **values: Column) -> Column:
    """use(struct of the values), each computed once."""
    return once(F.struct(*(v.alias(k) for k, v in values.items())), use)


def ordered_labels(g: Column) -> Column:
    """Labels from 0 in the order of falling size, ties by label."""

    def placed(y: Column) -> Column:
        kinds = F.array_sort(F.transform(F.array_distinct(y), lambda k: F.struct((-F.size(F.filter(y, lambda x: x == k))).alias("n"), k.alias("k"))))
        return once(F.transform(kinds, lambda s: s["k"]), lambda order: F.transform(y, lambda x: (F.array_position(order, x) - 1).cast("int")))

    return once(g, placed)


def merged(g: Column, us: Column, p: float, least: int = 2) -> Column:
    """Clusters merge into their predecessor with probability p (us by label), while more than ``least`` are left."""

    def target(x: Column, h: Column, k: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), lambda c: (c <= x) & ~((F.get(h["us"], c) < p) & (k - c >= least))))

    def labels(h: Column) -> Column:
        return once(F.array_max(h["g"]) + 1, lambda k: F.transform(h["g"], lambda x: F.when(x <= 0, x).otherwise(target(x, h, k)).cast("int")))

    return ordered_labels(_held(labels, g=g, us=us))


def split(g: Column, us: Column, vs: Column, p: float, most: int) -> Column:
    """Half of the members of a cluster get a new label with probability p (us by label, vs by locus), up to ``most``."""

    def label(x: Column, i: Column, h: Column, f: Column) -> Column:
        before = F.aggregate(F.slice(f["fresh"], F.lit(1), F.greatest(x, F.lit(0))), F.lit(0), lambda s, v: s + v)
        new = f["k"] + before
        return F.when((F.get(f["fresh"], x) == 1) & (F.get(h["vs"], i) < 0.5) & (new < most), new).otherwise(x).cast("int")

    def labels(h: Column) -> Column:
        k = F.array_max(h["g"]) + 1
        fresh = F.transform(F.sequence(F.lit(0), k - 1), lambda c: (F.get(h["us"], c) < p).cast("int"))
        return _held(lambda f: F.transform(h["g"], lambda x, i: label(x, i, h, f)), k=k, fresh=fresh)

    return _held(labels, g=g, us=us, vs=vs)


def reclassified(g: Column, us: Column, vs: Column, p: float, least: int = 2) -> Column:
    """Clusters dissolve with probability p while ``least`` stay; their members get a label of those that stay."""

    def labels(h: Column) -> Column:
        stay = F.filter(F.sequence(F.lit(0), F.array_max(h["g"])), lambda c: (F.get(h["us"], c) >= p) | (c < least))
        return once(stay, lambda t: F.transform(h["g"], lambda x, i: F.when(F.array_contains(t, x), x).otherwise(F.get(t, F.floor(F.get(h["vs"], i) * F.size(t)).cast("int"))).cast("int")))

    return ordered_labels(_held(labels, g=g, us=us, vs=vs))


def implanted(a: Column, b: Column, us: Column, vs: Column, ws: Column, p_cluster: float, p_locus: float) -> Column:
    """Unguided cluster crossover: of each cluster of a (us by label), members scatter with p_locus (vs by locus) over the
    labels, and the members of the same cluster of b join it (ws by locus)."""

    def label(x: Column, i: Column, h: Column, k: Column) -> Column:
        donor = F.get(h["b"], i)
        scattered = F.when((F.get(h["us"], x) < p_cluster) & (F.get(h["vs"], i) < p_locus), F.floor(F.get(h["ws"], i) * k)).otherwise(x)
        return F.when((donor < k) & (F.get(h["us"], donor) < p_cluster), donor).otherwise(scattered).cast("int")

    def labels(h: Column) -> Column:
        return once(F.array_max(h["a"]) + 1, lambda k: F.transform(h["a"], lambda x, i: label(x, i, h, k)))

    return ordered_labels(_held(labels, a=a, b=b, us=us, vs=vs, ws=ws))


# Wrappers of operators, in the form that ``evolution.Problem`` takes


def repeated(cross, times: int):
    """The sons of ``times`` crossovers of the same parents, each with draws of its own."""
    return lambda a, b, seed, key: tuple(son for t in range(times) for son in cross(a, b, seed + 101 * t, key))


def by_component(crosses):
    """Of genotypes that are arrays of components: each component is crossed by its own operator."""
    return lambda a, b, seed, key: tuple(F.array(*part) for part in zip(*(c(a[i], b[i], seed + 101 * i, key) for i, c in enumerate(crosses)), strict=True))


def mutated_components(mutations):
    """Of genotypes that are arrays of components: each component is mutated by its own operator."""
    return lambda g, seed, key: F.array(*(m(g[i], seed + 101 * i, key) for i, m in enumerate(mutations)))


def mutated_repeatedly(mutation, times: int):
    """``times`` mutations one after the other, each with draws of its own."""
    def mutate(g, seed, key):
        for t in range(times):
            g = mutation(g, seed + 101 * t, key)
        return g

    return mutate


def mutants(pop: DataFrame, mutation, seed: int, p: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Of (ind_id, genotype): the mutants of those that are drawn with probability p, and the others, which stay sterile."""
    fertile = draw(seed, F.col("ind_id")) < p
    changed = pop.where(fertile).withColumn("genotype", mutation(F.col("genotype"), seed + 1, F.col("ind_id")))
    return changed, pop.where(~fertile)
