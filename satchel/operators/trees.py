"""Typed expression trees as rows: a program is an array of primitive codes in prefix order, and all operators are columns.

A schema names primitives with the type that they return and the types that they take; its tables are constants of the
plan.  The end of a subtree follows from a running count of open arguments.  So a population of any size is created,
crossed, mutated and evaluated by plans over its rows; nothing is collected, and draws are keyed columns.

Where no operator applies (no node of the type, a tree of one node, no primitive that fits) the program stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import choose, draw


@dataclass(frozen=True)
class Primitive:
    """``apply`` makes the value from the arguments' columns; a terminal gets the row's array of inputs."""

    name: str
    returns: str
    takes: tuple[str, ...] = ()
    apply: Callable[..., Column] | None = None


class Schema:
    """Primitives by code (their place), the type of a whole program, and the most nodes of one."""

    def __init__(self, primitives: list[Primitive], root: str, most: int = 31) -> None:
        self.primitives, self.most = list(primitives), most
        types = sorted({p.returns for p in primitives} | {t for p in primitives for t in p.takes} | {root})
        self.number = {t: k for k, t in enumerate(types)}
        self.root = self.number[root]
        for t in types:
            if not any(p.returns == t and not p.takes for p in primitives):
                raise ValueError(f"no terminal of type {t}")
        self.widest = max(len(p.takes) for p in primitives)
        self._by = [sorted((k for k, p in enumerate(primitives) if p.returns == t), key=lambda k: len(primitives[k].takes)) for t in types]

    @cached_property
    def arity(self) -> Column:
        """By code the number of arguments."""
        return F.lit([len(p.takes) for p in self.primitives])

    @cached_property
    def type(self) -> Column:
        return F.lit([self.number[p.returns] for p in self.primitives])

    @cached_property
    def takes(self) -> Column:
        """By code the types of the arguments."""
        return F.array(*(F.lit([self.number[t] for t in p.takes]).cast("array<int>") for p in self.primitives))

    @cached_property
    def codes(self) -> Column:
        """By type its codes in the order of arity."""
        return F.array(*(F.lit(ks) for ks in self._by))

    @cached_property
    def upto(self) -> Column:
        """By type how many of its codes have at most 0, 1, ... arguments."""
        return F.array(*(F.lit([sum(len(self.primitives[k].takes) <= n for k in ks) for n in range(self.widest + 1)]) for ks in self._by))

    @cached_property
    def alike(self) -> Column:
        """By code those that return and take the same types."""
        shape = [(p.returns, p.takes) for p in self.primitives]
        return F.array(*(F.lit([j for j, t in enumerate(shape) if t == s]) for s in shape))

    @cached_property
    def over(self) -> Column:
        """By code the functions of its type that take its type."""
        return F.array(*(F.lit([j for j, q in enumerate(self.primitives) if q.returns == p.returns and p.returns in q.takes]).cast("array<int>") for p in self.primitives))

    def code(self, name: str) -> int:
        return next(k for k, p in enumerate(self.primitives) if p.name == name)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _places(first: Column | int, n: Column) -> Column:
    """first, first + 1, ... n - 1."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(n > first, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>"))


def _part(p: Column, a: Column, z: Column) -> Column:
    return F.slice(p, a + 1, F.greatest(z - a, F.lit(0)))


def end_of(schema: Schema, p: Column, at: Column) -> Column:
    """The place behind the subtree that begins at a place."""
    start = F.struct(F.lit(1).alias("open"), at.cast("int").alias("end"))

    def step(s: Column, i: Column) -> Column:
        more = F.struct((s["open"] - 1 + F.get(schema.arity, F.get(p, i))).alias("open"), (i + 1).cast("int").alias("end"))
        return F.when(s["open"] > 0, more).otherwise(s)

    return F.aggregate(_places(at.cast("int"), F.size(p)), start, step, lambda s: s["end"])


def valid(schema: Schema, p: Column) -> Column:
    """Whether p is one whole tree of the schema's type with every argument of the type that its place asks for."""
    start = F.struct(F.lit(True).alias("ok"), F.array(F.lit(schema.root)).alias("open"))

    def step(s: Column, c: Column) -> Column:
        fits = F.get(s["open"], F.lit(0)).eqNullSafe(F.get(schema.type, c))
        return F.struct((s["ok"] & fits).alias("ok"), F.concat(F.get(schema.takes, c), F.slice(s["open"], 2, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).alias("open"))

    return F.aggregate(p, start, step, lambda s: s["ok"] & (F.size(s["open"]) == 0))


def grown(schema: Schema, kind: Column, most: Column, seed: int, *keys) -> Column:
    """A random tree of a type with at most so many nodes: in each place a function of the type that is asked for, drawn
    among those that leave a node for every open argument, or a terminal where none does."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.array(kind.cast("int")).alias("open"))

    def step(s: Column, i: Column) -> Column:
        t = F.get(s["open"], F.lit(0))
        rest = F.slice(s["open"], 2, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        room = F.greatest(F.lit(0), F.least(F.lit(schema.widest), most.cast("int") - F.size(s["out"]) - 1 - F.size(rest)))
        able, terminals = F.get(F.get(schema.upto, t), room), F.get(F.get(schema.upto, t), F.lit(0))
        code = F.get(F.get(schema.codes, t), choose(draw(seed, *keys, i), F.when(able > terminals, terminals).otherwise(0), able))
        more = _let(code, lambda c: F.struct(F.concat(s["out"], F.array(c)).alias("out"), F.concat(F.get(schema.takes, c), rest).alias("open")))
        return F.when(F.size(s["open"]) > 0, more).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(most.cast("int"), F.lit(1))), start, step, lambda s: s["out"])


def created(spark: SparkSession, schema: Schema, n: int, least: int = 1, seed: int = 1) -> DataFrame:
    """(ind_id, genotype): n programs whose sizes are bounded by draws in [least, schema.most]."""
    size = choose(draw(seed, F.col("id"), F.lit("size")), least, schema.most + 1)
    return spark.range(n).select(F.col("id").alias("ind_id"), grown(schema, F.lit(schema.root), size, seed, F.col("id")).alias("genotype"))


def _drawn(list_: Column, u: Column) -> Column:
    """One element of a list, null if it is empty."""
    return F.get(list_, F.floor(u * F.size(list_)).cast("int"))


def _replaced(p: Column, a: Column, z: Column, by: Column) -> Column:
    return F.concat(_part(p, F.lit(0), a), by, _part(p, z, F.size(p)))


def crossed(schema: Schema, a: Column, b: Column, u: Column, v: Column) -> Column:
    """Array of two children: a subtree of a (not its root) changes places with one of b of the same type such that neither
    child has too many nodes."""

    def at(i: Column) -> Column:  # the place in a, or null
        return _let(end_of(schema, a, i), lambda e: _let(candidates(i, e), lambda c: _let(_drawn(c, v), lambda j: children(i, e, j))))

    def candidates(i: Column, e: Column) -> Column:
        def fits(j: Column) -> Column:
            n = end_of(schema, b, j) - j
            return (F.size(a) - (e - i) + n <= schema.most) & (F.size(b) - n + (e - i) <= schema.most)

        same = F.filter(_places(1, F.size(b)), lambda j: F.get(schema.type, F.get(b, j)) == F.get(schema.type, F.get(a, i)))
        return F.filter(same, fits)

    def children(i: Column, e: Column, j: Column) -> Column:
        def made(f: Column) -> Column:
            return F.array(_replaced(a, i, e, _part(b, j, f)), _replaced(b, j, f, _part(a, i, e)))

        return F.when(j.isNotNull(), _let(end_of(schema, b, j), made))

    first = F.when(F.size(a) > 1, choose(u, 1, F.size(a)))
    return F.coalesce(F.when(F.size(a) > 1, _let(first, at)), F.array(a, b))


KINDS = ("subtree", "grow", "truncate", "promote", "demote", "one_node", "all_nodes")


def mutated(schema: Schema, p: Column, kind: str, seed: int, *keys) -> Column:
    """subtree: a new subtree in place of one; grow: in place of a terminal; truncate: a terminal in place of a subtree;
    promote: a function above a subtree, its other arguments being terminals; demote: the largest argument of its type
    in place of a function; one_node, all_nodes: primitives that return and take the same types.  Roots stay but for the last two."""
    if kind not in KINDS:
        raise ValueError(f"no mutation named {kind}")
    n = F.size(p)

    def u(what: str) -> Column:
        return draw(seed, *keys, F.lit(what))

    def like(c: Column, w: Column) -> Column:
        return _drawn(F.get(schema.alike, c), w)

    if kind == "all_nodes":
        return F.transform(p, lambda c, i: like(c, draw(seed, *keys, i)))
    if kind == "one_node":
        return _let(choose(u("at"), 0, n), lambda i: F.transform(p, lambda c, k: F.when(k == i, like(c, u("code"))).otherwise(c)))
    arity = lambda i: F.get(schema.arity, F.get(p, i))
    able = _places(1, n)
    if kind == "grow":
        able = F.filter(able, lambda i: arity(i) == 0)
    elif kind in ("truncate", "demote"):
        able = F.filter(able, lambda i: arity(i) > 0)
    kind_of = lambda i: F.get(schema.type, F.get(p, i))

    def terminal(t: Column, w: Column) -> Column:
        return F.get(F.get(schema.codes, t), choose(w, 0, F.get(F.get(schema.upto, t), F.lit(0))))

    def arguments(i: Column) -> Column:
        """Where the arguments of the node at i begin, and where they end."""
        none = F.array().cast("array<struct<a:int,z:int>>")

        def step(s: Column, _: Column) -> Column:
            first = F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1)["z"], (i + 1).cast("int"))
            return F.concat(s, F.array(F.struct(first.alias("a"), end_of(schema, p, first).alias("z"))))

        return F.aggregate(_places(0, arity(i)), none, step)

    def changed(i: Column, e: Column) -> Column:
        if kind in ("subtree", "grow"):
            room = schema.most - (n - (e - i))
            return _replaced(p, i, e, grown(schema, kind_of(i), F.greatest(F.lit(1), choose(u("size"), 1, room + 1)), seed, *keys, F.lit("new")))
        if kind == "truncate":
            return _replaced(p, i, e, F.array(terminal(kind_of(i), u("code"))))
        if kind == "demote":
            mine = F.filter(arguments(i), lambda s: kind_of(s["a"]) == kind_of(i))
            best = F.array_max(F.transform(mine, lambda s: F.struct((s["z"] - s["a"]).alias("n"), (-s["a"]).alias("a"))))
            return _let(best, lambda s: F.when(s.isNotNull(), _replaced(p, i, e, _part(p, -s["a"], -s["a"] + s["n"]))).otherwise(p))
        # promote: the subtree becomes the first argument of its type
        fits = F.filter(F.get(schema.over, F.get(p, i)), lambda c: n + F.get(schema.arity, c) <= schema.most)

        def above(c: Column) -> Column:
            takes = F.get(schema.takes, c)
            own = F.array_position(takes, kind_of(i)).cast("int") - 1
            args = F.transform(takes, lambda t, k: F.when(k == own, _part(p, i, e)).otherwise(F.array(terminal(t, draw(seed, *keys, F.lit("fill"), k)))))
            return F.when(c.isNotNull(), _replaced(p, i, e, F.concat(F.array(c), F.flatten(args)))).otherwise(p)

        return _let(_drawn(fits, u("code")), above)

    found = _let(_drawn(able, u("at")), lambda i: F.when(i.isNotNull(), _let(end_of(schema, p, i), lambda e: changed(i, e))))
    return F.coalesce(F.when(n > 1, found), p)


def value(schema: Schema, p: Column, inputs: Column) -> Column:
    """The value (double) of a program on an array of inputs, whatever program stands in the row: codes are read backwards
    onto a stack whose first element is the last value."""
    none = F.array().cast("array<double>")

    def step(stack: Column, c: Column) -> Column:
        out = stack
        for k, q in enumerate(schema.primitives):
            n = len(q.takes)
            made = q.apply(*(F.get(stack, F.lit(i)) for i in range(n))) if n else q.apply(inputs)
            out = F.when(c == k, F.concat(F.array(made.cast("double")), F.slice(stack, n + 1, F.greatest(F.size(stack) - n, F.lit(0))))).otherwise(out)
        return out

    return F.aggregate(F.reverse(p), none, step, lambda s: F.get(s, F.lit(0)))


def arithmetic(width: int, constants: tuple[float, ...] = (0.5, 1.0, 2.0), most: int = 31) -> Schema:
    """Numbers and truths over ``width`` inputs: sums, products, comparisons, connectives and a choice."""
    number, truth = "number", "truth"
    terminals = [Primitive(f"x{k}", number, (), lambda x, k=k: F.get(x, F.lit(k))) for k in range(width)] + [Primitive(str(c), number, (), lambda x, c=c: F.lit(c)) for c in constants]
    terminals.append(Primitive("true", truth, (), lambda x: F.lit(1.0)))
    both = (number, number)
    functions = [Primitive("+", number, both, lambda a, b: a + b), Primitive("-", number, both, lambda a, b: a - b), Primitive("*", number, both, lambda a, b: a * b), Primitive("neg", number, (number,), lambda a: -a)]
    functions += [Primitive("<", truth, both, lambda a, b: (a < b).cast("double")), Primitive("and", truth, (truth, truth), lambda a, b: F.least(a, b)), Primitive("not", truth, (truth,), lambda a: 1 - a), Primitive("if", number, (truth, number, number), lambda c, a, b: F.when(c > 0, a).otherwise(b))]
    return Schema(terminals + functions, number, most)
