"""Score expressions over edge and node statistics.

An expression gives a Spark column over a table of edge statistics (``column``), a plain
number inside the merge kernel (``value``), and the statistics it needs (``needs``).
Statistics: cnt, sum, min, max, size_u, size_v (numbers), levels (sorted affinities ``a``, each
with its count ``n``: at most 256 for bytes) and those of registered providers.
``parse`` reads the nested template notation, e.g. ``OneMinus<MeanAffinity<G, V>>``;
type arguments that aren't expressions or integers are passed over.

All scores are doubles (integral scores would wrap), and every statistic is merged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST, LARGEST = 1.1754943508222875e-38, 3.4028234663852886e38  # of float32


@dataclass(frozen=True)
class Provider:
    """A statistic of one's own over the affinities of an edge.

    ``aggregate`` gives the column over grouped contacts (of their ``aff``, an affinity in
    [0, 1]), ``merge`` the statistic of two merged edges.
    """

    name: str
    aggregate: Callable[[Column], Column]
    merge: Callable[[object, object], object]


PROVIDERS: dict[str, Provider] = {}


def provide(provider: Provider) -> Score:
    """Register a statistic; the score that reads it.  Such scores merge over the whole graph."""
    if provider.name in BUILT_IN:
        raise ValueError(f"{provider.name} is a statistic already")
    PROVIDERS[provider.name] = provider
    return Statistic(provider.name)


BUILT_IN = ("cnt", "sum", "min", "max", "levels", "maxima", "size_u", "size_v")


class Score:
    needs: frozenset[str] = frozenset()
    #: Merged statistics stay between those of the parts, so merging can go component by component.
    between = True

    def column(self) -> Column:
        raise NotImplementedError

    def value(self, s: dict) -> float:
        raise NotImplementedError


@dataclass(frozen=True)
class Statistic(Score):
    """The generic leaf: a statistic by its name."""

    name: str

    @property
    def needs(self):
        return frozenset({self.name})

    @property
    def between(self):
        return self.name in ("min", "max")

    def column(self):
        return F.col(self.name).cast("double")

    def value(self, s):
        return float(s[self.name])


class _Leaf(Score):
    def __eq__(self, other):
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self):
        return hash((type(self), tuple(sorted(vars(self).items()))))

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(f'{v}' for v in vars(self).values())})"


class MinSize(_Leaf):
    needs, between = frozenset({"size_u", "size_v"}), False

    def column(self):
        return F.least("size_u", "size_v").cast("double")

    def value(self, s):
        return float(min(s["size_u"], s["size_v"]))


class MaxSize(MinSize):
    def column(self):
        return F.greatest("size_u", "size_v").cast("double")

    def value(self, s):
        return float(max(s["size_u"], s["size_v"]))


class MinAffinity(_Leaf):
    needs = frozenset({"min"})

    def column(self):
        return F.col("min").cast("double")

    def value(self, s):
        return s["min"]


class MaxAffinity(_Leaf):
    """Largest affinity, at least 0."""

    needs = frozenset({"max"})

    def column(self):
        return F.greatest(F.lit(0.0), F.col("max").cast("double"))

    def value(self, s):
        return max(0.0, s["max"])


class MeanAffinity(_Leaf):
    needs = frozenset({"sum", "cnt"})

    def column(self):
        return F.col("sum") / F.greatest("cnt", F.lit(1))

    def value(self, s):
        return s["sum"] / max(1, s["cnt"])


class ContactArea(_Leaf):
    needs, between = frozenset({"cnt"}), False

    def column(self):
        return F.col("cnt").cast("double")

    def value(self, s):
        return float(s["cnt"])


def _nth(levels: Column, at: Column) -> Column:
    """The affinity at a place (from 0) of the sorted affinities that levels stand for."""
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("a"))

    def step(acc, x):
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.when(acc["a"].isNull() & (seen > at), x["a"]).otherwise(acc["a"]).alias("a"))

    return F.aggregate(levels, start, step, lambda acc: acc["a"])


def _total(levels: Column) -> Column:
    return F.aggregate(levels, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _place(counts: dict, at: int):
    for a in sorted(counts):
        at -= counts[a]
        if at < 0:
            return a
    return None


class QuantileAffinity(_Leaf):
    """The value at place q * n / 100 (rounded down, at most n - 1) of the sorted affinities.

    With ``init_max`` an initial edge counts with its largest affinity only.
    """

    needs = frozenset({"levels"})

    def __init__(self, q: int, init_max: bool = True):
        self.q, self.init_max = int(q), bool(int(init_max))

    def column(self):
        levels = F.col("levels")
        if self.init_max:
            return F.array_max(levels)["a"].cast("double")
        n = _total(levels)
        return _nth(levels, F.least(F.floor(n * self.q / 100), n - 1))

    def value(self, s):
        counts = s["maxima" if self.init_max else "levels"]
        n = sum(counts.values())
        return _place(counts, min(n - 1, self.q * n // 100))


class HistogramQuantileAffinity(_Leaf):
    """The quantile of binned affinities, as a bin's middle; q = 100 lies past the last bin."""

    needs = frozenset({"levels"})

    def __init__(self, q: int, bins: int = 256, init_max: bool = True):
        self.q, self.bins, self.init_max = int(q), int(bins), bool(int(init_max))

    def _bin(self, v: float) -> int:
        return min(int(v * self.bins), self.bins - 1)

    def column(self):
        levels = F.col("levels")
        n = F.lit(1) if self.init_max else _total(levels)
        at = F.floor(n * self.q / 100)
        value = F.array_max(levels)["a"] if self.init_max else _nth(levels, F.least(at, n - 1))
        chosen = F.least(F.floor(value * self.bins), F.lit(self.bins - 1))
        return (F.when(at >= n, self.bins).otherwise(chosen) + 0.5) / self.bins

    def value(self, s):
        counts = s["maxima" if self.init_max else "levels"]
        at = _place(counts, self.q * sum(counts.values()) // 100)
        return ((self.bins if at is None else self._bin(at)) + 0.5) / self.bins


class MeanMaxKAffinity(_Leaf):
    """Mean of the k largest affinities; of a union it can be above that of both parts."""

    needs, between = frozenset({"levels"}), False

    def __init__(self, k: int):
        self.k = int(k)

    def column(self):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))

        def step(acc, x):
            take = F.least(x["n"], F.lit(self.k) - acc["n"])
            return F.struct((acc["n"] + take).alias("n"), (acc["sum"] + take * x["a"]).alias("sum"))

        return F.aggregate(F.reverse("levels"), start, step, lambda acc: acc["sum"] / acc["n"])

    def value(self, s):
        left, total = self.k, 0.0
        for a in sorted(s["levels"], reverse=True):
            take = min(left, s["levels"][a])
            left, total = left - take, total + take * a
        return total / (self.k - left)


class Random(_Leaf):
    """A number in [0, 1) for each edge and seed, by multiplications modulo 2^31 - 1; the same in any plan."""

    between = False
    MODULUS = (1 << 31) - 1

    def __init__(self, seed: int = 0):
        self.seed = int(seed)

    def column(self):
        m = F.lit(self.MODULUS).cast("long")
        x = F.pmod(F.pmod(F.col("u"), m) * 48271 + F.pmod(F.col("v"), m) * 69621 + F.lit(self.seed * 16807 + 11).cast("long"), m)
        return F.pmod(F.pmod(x * 48271, m) * 69621, m) / self.MODULUS

    def value(self, s):
        m = self.MODULUS
        x = (s["u"] % m * 48271 + s["v"] % m * 69621 + self.seed * 16807 + 11) % m
        return x * 48271 % m * 69621 % m / m


class Constant(_Leaf):
    def __init__(self, c: float):
        self.c = float(c)

    def column(self):
        return F.lit(self.c)

    def value(self, s):
        return self.c


class _Unary(Score):
    def __init__(self, x: Score):
        self.x, self.needs, self.between = x, x.needs, x.between

    def __repr__(self):
        return f"{type(self).__name__}({self.x!r})"


class OneMinus(_Unary):
    def column(self):
        return 1 - self.x.column()

    def value(self, s):
        return 1 - self.x.value(s)


class Invert(_Unary):
    """1 / x with IEEE results at zero."""

    def column(self):
        x = self.x.column()
        return F.when(x == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / F.nullif(x, F.lit(0.0)))

    def value(self, s):
        x = self.x.value(s)
        return 1 / x if x else math.inf


class Square(_Unary):
    def column(self):
        x = self.x.column()
        return x * x

    def value(self, s):
        return self.x.value(s) ** 2


class _Binary(Score):
    between = False

    def __init__(self, a: Score, b: Score):
        self.a, self.b, self.needs = a, b, a.needs | b.needs

    def __repr__(self):
        return f"{type(self).__name__}({self.a!r}, {self.b!r})"

    def of(self, a, b):
        raise NotImplementedError

    def column(self):
        return self.of(self.a.column(), self.b.column())

    def value(self, s):
        return self.of(self.a.value(s), self.b.value(s))


class Add(_Binary):
    def of(self, a, b):
        return a + b


class Subtract(_Binary):
    def of(self, a, b):
        return a - b


class Multiply(_Binary):
    def of(self, a, b):
        return a * b


class Divide(_Binary):
    """a / b; a divisor next to zero gives the largest or lowest float by the product's sign."""

    def column(self):
        a, b = self.a.column(), self.b.column()
        small = F.abs(b) <= SMALLEST
        return F.when(small, F.when(a * b < 0, F.lit(-LARGEST)).otherwise(F.lit(LARGEST))).otherwise(a / F.when(~small, b))

    def value(self, s):
        a, b = self.a.value(s), self.b.value(s)
        return a / b if abs(b) > SMALLEST else -LARGEST if a * b < 0 else LARGEST


class Step(_Binary):
    """0 if a < b, else 1."""

    def column(self):
        return F.when(self.a.column() < self.b.column(), 0.0).otherwise(1.0)

    def value(self, s):
        return 0.0 if self.a.value(s) < self.b.value(s) else 1.0


DEFAULT = OneMinus(MeanAffinity())
EXPRESSIONS = {c.__name__: c for c in (MinSize, MaxSize, MinAffinity, MaxAffinity, MeanAffinity, ContactArea, QuantileAffinity, HistogramQuantileAffinity, MeanMaxKAffinity, Random, Constant, OneMinus, Invert, Square, Add, Subtract, Multiply, Divide, Step)}


def parse(text: str) -> Score:
    """A score from the nested template notation."""
    tokens = re.findall(r"[A-Za-z_]\w*|-?\d+(?:\.\d+)?|[<>,]", text)
    at = 0

    def one():
        nonlocal at
        word = tokens[at]
        at += 1
        args = []
        if at < len(tokens) and tokens[at] == "<":
            while tokens[at] != ">":
                at += 1
                if tokens[at] != ">":
                    args.append(one())
            at += 1
        if word in EXPRESSIONS:
            return EXPRESSIONS[word](*[a for a in args if a is not None])
        if re.fullmatch(r"-?\d+(\.\d+)?", word):
            return float(word) if "." in word else int(word)
        return {"true": 1, "false": 0}.get(word)

    try:
        found = one()
    except (IndexError, TypeError) as e:
        raise ValueError(f"not a score expression: {text!r}") from e
    if not isinstance(found, Score) or at != len(tokens):
        raise ValueError(f"not a score expression: {text!r}")
    return found
