"""Expression programs and grammar trees as prefix lists of symbols.

A program is a list of (symbol, arity); it is compiled to a Column, so that Catalyst evaluates it.  Editing works on
prefix lists: a subtree is a slice, found by counting open arguments.  Draws come from a seeded generator per call.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Program = list[str]

PRIMITIVES: dict[str, tuple[int, Callable[..., Column]]] = {
    "+": (2, lambda a, b: a + b), "-": (2, lambda a, b: a - b), "*": (2, lambda a, b: a * b),
    "/": (2, lambda a, b: F.when(b == 0, F.lit(1.0)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))),
    "neg": (1, lambda a: -a), "abs": (1, F.abs), "min": (2, F.least), "max": (2, F.greatest),
    "<": (2, lambda a, b: (a < b).cast("double")), "if": (3, lambda c, a, b: F.when(c > 0, a).otherwise(b)),
}


def arity(symbol: str) -> int:
    return PRIMITIVES[symbol][0] if symbol in PRIMITIVES else 0


def end_of(program: Program, at: int) -> int:
    """The place behind the subtree that begins at a place."""
    open_ = 1
    while open_:
        open_ += arity(program[at]) - 1
        at += 1
    return at


def column(program: Program) -> Column:
    """Symbols that aren't primitives are numbers or column names."""
    stack: list[Column] = []
    for s in reversed(program):
        if s in PRIMITIVES:
            n, f = PRIMITIVES[s]
            args = [stack.pop() for _ in range(n)]
            stack.append(f(*args))
        else:
            try:
                stack.append(F.lit(float(s)))
            except ValueError:
                stack.append(F.col(s))
    return stack[0]


def grown(terminals: list[str], size: int, seed: int) -> Program:
    """A random program of at most ``size`` symbols."""
    g = random.Random(seed)

    def tree(most: int) -> Program:
        fit = [s for s in PRIMITIVES if arity(s) < most]
        if most < 2 or not fit or g.random() < 0.2:
            return [g.choice(terminals)]
        s = g.choice(fit)
        out, left = [s], most - 1
        for k in range(arity(s), 0, -1):
            part = tree(max(1, left // k))
            out, left = out + part, left - len(part)
        return out

    return tree(size)


def swapped(a: Program, b: Program, most: int, seed: int) -> tuple[Program, Program]:
    """Subtree crossover; programs that would grow beyond ``most`` stay as they are."""
    g = random.Random(seed)
    i, j = g.randrange(len(a)), g.randrange(len(b))
    x, y = a[i : end_of(a, i)], b[j : end_of(b, j)]
    one, two = a[:i] + y + a[i + len(x) :], b[:j] + x + b[j + len(y) :]
    return (one if len(one) <= most else a), (two if len(two) <= most else b)


def mutated(p: Program, terminals: list[str], most: int, seed: int, kind: str = "subtree") -> Program:
    """subtree, grow, truncate, promote, demote, one_node or all_nodes."""
    g = random.Random(seed)
    i = g.randrange(len(p))
    j = end_of(p, i)

    def like(s: str) -> str:
        return g.choice([x for x in PRIMITIVES if arity(x) == arity(s)] if arity(s) else terminals)

    if kind == "all_nodes":
        return [like(s) for s in p]
    if kind == "one_node":
        return p[:i] + [like(p[i])] + p[i + 1 :]
    if kind == "truncate":
        return p[:i] + [g.choice(terminals)] + p[j:]
    if kind == "promote":
        inner = g.randrange(i, j)
        return p[:i] + p[inner : end_of(p, inner)] + p[j:]
    if kind == "demote":
        s = g.choice([x for x in PRIMITIVES if arity(x) == 2])
        return p[:i] + [s] + p[i:j] + [g.choice(terminals)] + p[j:] if len(p) + 2 <= most else p
    room = most - (len(p) - (j - i))
    if kind == "grow" and arity(p[i]):
        room = max(room, j - i)
    return p[:i] + grown(terminals, max(1, room), seed + 1) + p[j:]


class Grammar:
    """Rules: non-terminal to alternatives (lists of symbols).  Derivations are drawn uniformly among all of a size."""

    def __init__(self, rules: dict[str, list[list[str]]], start: str) -> None:
        self.rules, self.start = rules, start
        self.count = lru_cache(None)(self._count)

    def _ways(self, symbols: tuple[str, ...], size: int) -> int:
        if not symbols:
            return int(size == 0)
        if symbols[0] not in self.rules:
            return self._ways(symbols[1:], size)
        return sum(self.count(symbols[0], k) * self._ways(symbols[1:], size - k) for k in range(1, size + 1))

    def _count(self, symbol: str, size: int) -> int:
        """Derivation trees of a non-terminal with so many productions."""
        return sum(self._ways(tuple(r), size - 1) for r in self.rules[symbol]) if size > 0 else 0

    def derive(self, size: int, seed: int, symbol: str | None = None) -> list:
        """A tree [symbol, child, ...] with exactly ``size`` productions."""
        s = symbol or self.start
        sizes = [k for k in range(1, size + 1) if self.count(s, k)]
        return self._drawn(random.Random(seed), s, size if self.count(s, size) else max(sizes))

    def _drawn(self, g: random.Random, symbol: str, n: int) -> list:
        pick = g.randrange(self.count(symbol, n))
        for r in self.rules[symbol]:
            w = self._ways(tuple(r), n - 1)
            if pick < w:
                return [symbol, *self._children(g, tuple(r), n - 1)]
            pick -= w
        raise AssertionError

    def _children(self, g: random.Random, symbols: tuple[str, ...], n: int) -> list:
        if not symbols:
            return []
        if symbols[0] not in self.rules:
            return [symbols[0], *self._children(g, symbols[1:], n)]
        ways = [self.count(symbols[0], k) * self._ways(symbols[1:], n - k) for k in range(1, n + 1)]
        pick = g.randrange(sum(ways))
        for k, w in enumerate(ways, 1):
            if pick < w:
                return [self._drawn(g, symbols[0], k), *self._children(g, symbols[1:], n - k)]
            pick -= w
        raise AssertionError

    def terminals(self, tree) -> list[str]:
        return [tree] if isinstance(tree, str) else [t for c in tree[1:] for t in self.terminals(c)]

    def nodes(self, tree, path=()) -> list[tuple[tuple[int, ...], str]]:
        if isinstance(tree, str):
            return []
        return [(path, tree[0])] + [n for i, c in enumerate(tree[1:], 1) for n in self.nodes(c, (*path, i))]

    def size(self, tree) -> int:
        return len(self.nodes(tree))

    def _at(self, tree, path):
        for i in path:
            tree = tree[i]
        return tree

    def _put(self, tree, path, new):
        if not path:
            return new
        return [self._put(c, path[1:], new) if i == path[0] else c for i, c in enumerate(tree)]

    def crossed(self, a, b, most: int, seed: int, symbols: set[str] | None = None):
        """Branches of one non-terminal change sides; symbols: only branches of these (selective crossover)."""
        g = random.Random(seed)
        pairs = [(p, q) for p, s in self.nodes(a) for q, t in self.nodes(b) if s == t and (symbols is None or s in symbols)]
        if not pairs:
            return a, b
        p, q = g.choice(pairs)
        one, two = self._put(a, p, self._at(b, q)), self._put(b, q, self._at(a, p))
        return (one if self.size(one) <= most else a), (two if self.size(two) <= most else b)

    def regrown(self, tree, most: int, seed: int, kind: str = "any", symbols: set[str] | None = None):
        """A branch is derived anew: any size that fits, larger (expand) or smaller (reduce)."""
        g = random.Random(seed)
        p, s = g.choice([n for n in self.nodes(tree) if symbols is None or n[1] in symbols] or self.nodes(tree))
        now = self.size(self._at(tree, p))
        low, high = {"expand": (now + 1, most - self.size(tree) + now), "reduce": (1, now - 1)}.get(kind, (1, most - self.size(tree) + now))
        sizes = [k for k in range(max(1, low), high + 1) if self.count(s, k)]
        return self._put(tree, p, self.derive(g.choice(sizes), seed + 1, s)) if sizes else tree

    def _recursive(self, tree) -> list[tuple[tuple[int, ...], str, list[int]]]:
        """Branches with a child of their own symbol, and the places of such children."""
        found = [(p, s, [i for i, c in enumerate(self._at(tree, p)) if i and not isinstance(c, str) and c[0] == s]) for p, s in self.nodes(tree)]
        return [f for f in found if f[2]]

    def recursed(self, tree, most: int, seed: int):
        """One step more of a recursion: a branch below a branch of its own symbol moves into a further production of it,
        whose other symbols are derived anew.  The tree itself, if it has no recursion or nothing fits in ``most``."""
        g = random.Random(seed)
        if not (places := self._recursive(tree)):
            return tree
        p, s, below = g.choice(places)
        at = (*p, g.choice(below))
        rules = [(r[:k], r[k + 1 :]) for r in self.rules[s] for k, x in enumerate(r) if x == s]
        fits = [(a, b, n) for a, b in rules for n in range(most - self.size(tree)) if self._ways((*a, *b), n)]
        if not fits:
            return tree
        a, b, n = g.choice(fits)
        drawn = self._children(g, (*a, *b), n)
        return self._put(tree, at, [s, *drawn[: len(a)], self._at(tree, at), *drawn[len(a) :]])

    def unrecursed(self, tree, seed: int):
        """One step less: a branch gives way to a child of its own symbol.  The tree itself, if it has no recursion."""
        g = random.Random(seed)
        if not (places := self._recursive(tree)):
            return tree
        p, _, below = g.choice(places)
        return self._put(tree, p, self._at(tree, (*p, g.choice(below))))


# Several trees per individual: an operator on one of them (drawn, or named by its index), or on all


def lifted_pair(operator: Callable, a: list, b: list, seed: int, index: int | None = None) -> tuple[list, list]:
    """operator(x, y, seed) -> (x, y) on the trees at one place of both individuals."""
    at = random.Random(seed).randrange(min(len(a), len(b))) if index is None else index
    x, y = operator(a[at], b[at], seed)
    return [*a[:at], x, *a[at + 1 :]], [*b[:at], y, *b[at + 1 :]]


def lifted(operator: Callable, trees: list, seed: int, index: int | None = None, every: bool = False) -> list:
    """operator(x, seed) -> x on one tree, or with ``every`` on each with a seed of its own."""
    at = random.Random(seed).randrange(len(trees)) if index is None else index
    return [operator(t, seed + i) if every or i == at else t for i, t in enumerate(trees)]


def exchanged(a: list, b: list, seed: int, index: int | None = None) -> tuple[list, list]:
    """Whole trees at one place change sides."""
    return lifted_pair(lambda x, y, _: (y, x), a, b, seed, index)
