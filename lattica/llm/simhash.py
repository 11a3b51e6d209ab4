"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit set where more than half of its shingles' hashes have
it.  Two fingerprints link at ``distance`` or fewer differing bits, and components of
links are classes.  Equal fingerprints are one class member from the start, so copies
are never paired.

Candidates: the bits are grouped into partitions of correlated bits, and partition
i gets a threshold t_i >= -1 with sum(t_i + 1) = distance + 1; then any two linked
fingerprints are within t_i on some partition i (else they would differ in more than
``distance`` bits).  Thresholds, and the number of partitions, come from a dynamic
programme over the costs that are expected of them: lookups are exactly counted,
candidates are estimated from the bits' frequencies and from how often partitions'
values repeat over all fingerprints.  Each fingerprint is then indexed under its value
in every partition with t_i >= 0 and probes those values within t_i that a Bloom filter
of bounded size says some fingerprint has.

Dense groups are joined before that: every fingerprint is compared with the least one
that has the same value in each of ``SAMPLES`` samples of bits, which is linear and finds
valid links only.  A fingerprint then probes only values that a member of a class of
its own rank or above has, where the largest classes have ranks of their own: of two
linked fingerprints of different classes one always probes the other, and a large class
never probes itself.

Probing groups by (partition, value).  A value with more than ``BLOCK`` rows is split into
blocks that go to different tasks, without comparing its largest class with itself.  A
block puts out a spanning forest of the verified links between its fingerprints, never
all pairs, and no link between components is lost by that.

Components come from the core library's large-star and small-star steps.

With ``similarity``, members are distinct texts (words lower-cased) instead of
fingerprints, and two texts of a class by bits link if the sets of their shingles of
``compared`` words (by 64-bit hashes) have that Jaccard similarity; components of these
links are the classes.  All pairs of a class by bits count: first each text against the
least one with an equal minimum hash (linear again), then what is outside the largest
class found so against everything, in blocks.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts
shorter than the shingle are one shingle.  Rows without an id get the class of their
fingerprint, whose smallest id may be null.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import U64, Words, mix, pieces, signed, text_column
from lattica.operators.components import components
from lattica.session import cut, prepare, shuffle_partitions

SEED, BLOCK = 42, 2048
TEXT_BLOCK = 1024  # texts whose sets of shingles are compared with as many others in one task
SAMPLES, MINIMA = 8, 4  # of bits, and of minimum hashes, by which dense groups are joined first
HOT_SHARE = 1024  # keys with more than one in so many rows are broadcast, at most as many


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    distance: int = 4
    bits: int = 64  # a multiple of 64
    distinct: bool = False  # a repeated shingle votes once
    similarity: float = 0.0  # of the sets of shingles; 0: bits alone
    compared: int = 5  # words of the shingles in those sets

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(self.bits // 64)]


# -- fingerprints ----------------------------------------------------------------------


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of one text's shingles, repeats included."""
    if not words:
        return np.zeros(0, U64)
    joined = b" ".join(words)
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    lasts = ends[min(shingle, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist())], dtype=U64)


def unpacked(hashes: np.ndarray) -> np.ndarray:
    """Bits of each hash, or of each row of hashes, lowest first."""
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8 * (hashes.shape[1] if hashes.ndim > 1 else 1)), axis=1, bitorder="little")


def vote(bits: np.ndarray) -> np.ndarray:
    """64-bit words of the majority of rows of bits; no rows give zero."""
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits), bitorder="little").view(U64)


def widened(hashes: np.ndarray, n: int) -> np.ndarray:
    """n words of hash for each hash, the first being itself."""
    return np.stack([hashes, *(mix(hashes + U64(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, n))], axis=1)


def fingerprint(words: list[bytes], params: Params) -> np.ndarray:
    """The fingerprint's 64-bit words."""
    own = shingles(words, params.shingle)
    return vote(unpacked(widened(np.unique(own) if params.distinct else own, len(params.words))))


def text_key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words))


def fingerprints(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, w0 .. (the fingerprint's words as signed longs), key (a hash of the text's words) and row (of all columns)."""
    p = params or Params()
    prepare(docs.sparkSession)
    n = len(p.words)

    def by_words(batch):
        """The same for shingles of one word that vote once each, a word's bits being looked up."""
        own = Words(text_column(batch))
        table = unpacked(widened(np.array([xxhash.xxh64_intdigest(w, SEED) for w in own.vocab], dtype=U64), n)) if own.vocab else np.zeros((0, 64 * n), np.uint8)
        return np.array([vote(table[np.unique(own.ids[a:b])]) for a, b in zip(own.offsets[:-1], own.offsets[1:])], dtype=U64)

    def run(batches):
        for batch in pieces(batches):
            words = [t.lower().split() for t in text_column(batch).cast(pa.binary()).to_pylist()]
            fps = by_words(batch) if p.shingle == 1 and p.distinct else np.array([fingerprint(w, p) for w in words], dtype=U64)
            keys = np.array([text_key(w) for w in words], dtype=U64)
            fps = fps.reshape(len(words), n)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{c: pa.array(signed(fps[:, i])) for i, c in enumerate(p.words)}, "key": pa.array(signed(keys)), "row": batch.column("row")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash(docs).alias("row"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in p.words)}, key long, row long")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))


def _fps(batch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(U64) for c in names], axis=1)


# -- partitions and thresholds ---------------------------------------------------------


def correlation(fps: DataFrame, words: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, frequencies of the bits and their correlation matrix, over all of them."""
    size = 64 * len(words)

    def run(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            bits = unpacked(_fps(batch, words)).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)]
                total += part.T @ part
            n += len(bits)
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.record_batch({"i": pa.array(i), "j": pa.array(j), "both": pa.array(total.reshape(-1).astype(np.int64)), "n": pa.array(np.full(size * size, n))})

    rows = fps.mapInArrow(run, "i long, j long, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).toArrow()
    both, n = np.zeros((size, size)), 0
    if rows.num_rows:
        both[rows.column("i").to_numpy(), rows.column("j").to_numpy()] = rows.column("both").to_numpy()
        n = int(rows.column("n")[0].as_py())
    share = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return n, share, (both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)


def partition_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each grown from a free bit by its strongest correlations."""
    bits = len(corr)
    strength, free, groups = np.abs(corr), set(range(bits)), []
    for i in range(m):
        size = bits // m + (i < bits % m)
        left = sorted(free)
        seed = left[int(np.argmax(strength[np.ix_(left, left)].sum(axis=1) - strength[left, left]))]
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            left = sorted(free)
            best = left[int(np.argmax(strength[np.ix_(left, group)].sum(axis=1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def within(share: np.ndarray, most: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of these bits) for t = 0 .. most, bits taken as independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for q in 2 * share * (1 - share):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(cost: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total of the least cost; cost[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        best_next: dict[int, tuple[float, list[int]]] = {}
        for spent, (so_far, chosen) in best.items():
            for extra in range(min(len(row) - 1, total - spent) + 1):
                value = so_far + row[extra]
                if spent + extra not in best_next or value < best_next[spent + extra][0]:
                    best_next[spent + extra] = (value, [*chosen, extra - 1])
        best = best_next
    return best[total]


#: In lookups: of a row that is shuffled, and of a pair that is compared.
ROW_COST, PAIR_COST = 1000.0, 10.0
WIDEST = 48  # bits of a partition


def plan(n: int, share: np.ndarray, corr: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, those that are skipped left out."""
    found, n = (math.inf, []), max(n, 1)
    for m in range(-(-len(share) // WIDEST), max(distance, 2) + 2):
        groups = partition_bits(corr, m)
        rows = []
        for g in groups:
            near = within(share[g], distance)
            # what bits of a group have in common makes its values repeat more often
            tied = 1 + np.abs(corr[np.ix_(g, g)]).sum() / len(g)
            row = [0.0]
            for t in range(distance + 1):
                lookups = sum(math.comb(len(g), k) for k in range(t + 1))
                hits = n * min(1.0, near[t] * tied)
                row.append(n * (lookups + (1 + min(lookups, hits)) * ROW_COST + hits * PAIR_COST))
            rows.append(row)
        value, thresholds = allocate(np.array(rows), distance + 1)
        if value < found[0]:
            found = (value, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return found[1]


# -- candidates ------------------------------------------------------------------------


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Values of up to 64 bits of fingerprints, which come as rows of 64-bit words."""
    out = np.zeros(len(fps), U64)
    for k, b in enumerate(bits):
        out |= ((fps[:, b // 64] >> U64(b % 64)) & U64(1)) << U64(k)
    return out


def masks(width: int, most: int) -> np.ndarray:
    """All masks of up to ``most`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)], dtype=U64)


MOST_SLOTS = 21  # log2 of the 64-bit words of a Bloom filter, and of ranks, for each partition
_RANDOM = mix(np.arange(1, 1 + 2 * 64, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, 64)


def linear_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash with h(a ^ b) = h(a) ^ h(b), so that all flips of a value are looked up by one step each."""
    out = np.zeros(values.shape, U64)
    for b in range(64):
        here = (values >> U64(b)) & U64(1)
        if not here.any():
            continue
        out ^= here * _RANDOM[which, b]
    return out


def _marks(h: np.ndarray) -> np.ndarray:
    """Three bits of a word of the filter."""
    one = U64(1)
    return (one << (h & U64(63))) | (one << (h >> U64(6) & U64(63))) | (one << (h >> U64(12) & U64(63)))


@dataclass
class Held:
    """Bloom filter of the values that some fingerprint has in a partition, and the greatest rank of their holders."""

    log: int
    bits: np.ndarray
    ranks: np.ndarray

    def has(self, values: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) for which values[i] ^ (flip j) may be held; ``flips``: both hashes of each.

        One bit of the filter is looked up for all pairs, both words of those that have it.
        """
        down, own = U64(64 - self.log), (linear_hash(values), linear_hash(values, 1))
        h = own[0][:, None] ^ flips[0][None, :]
        i, j = np.nonzero((self.bits[(h >> down).view(np.int64)] >> (h & U64(63)) & U64(1)) != 0)
        for which in (0, 1):
            h = own[which][i] ^ flips[which][j]
            m = _marks(h)
            ok = self.bits[(h >> down).view(np.int64)] & m == m
            i, j = i[ok], j[ok]
        return i, j

    def rank(self, values: np.ndarray) -> np.ndarray:
        return self.ranks[(linear_hash(values) >> U64(64 - self.log)).view(np.int64)]


def held(rows: DataFrame, parts: list[list[int]], words: list[str], n: int) -> list[Held]:
    """A filter for each partition, of bounded size; ``rows``: the fingerprint's words and rank.

    What reaches the driver is one partition's words of the filter at a time.
    """
    log = min(MOST_SLOTS, max(8, math.ceil(math.log2(n + 1))))
    out = []
    for g in parts:

        def run(batches, g=g):
            for batch in batches:
                values, rank = project(_fps(batch, words), g), batch.column("rank").to_numpy()
                h = [linear_hash(values, w) for w in (0, 1)]
                at, marks = np.concatenate([x >> U64(64 - log) for x in h]), np.concatenate([_marks(x) for x in h])
                order = np.argsort(at, kind="stable")
                at, marks, ranks = at[order], marks[order], np.concatenate([rank, np.zeros_like(rank)])[order]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                none = np.zeros(0, U64)
                yield pa.record_batch({"word": pa.array(at[first].astype(np.int64)), "bits": pa.array(signed(np.bitwise_or.reduceat(marks, first) if len(first) else none)), "rank": pa.array((np.maximum.reduceat(ranks, first) if len(first) else none).astype(np.int32))})

        got = rows.select(*words, "rank").mapInArrow(run, "word long, bits long, rank int").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.max("rank").alias("rank")).toArrow()
        one = Held(log, np.zeros(1 << log, U64), np.zeros(1 << log, np.uint8))
        at = got.column("word").to_numpy()
        one.bits[at] = got.column("bits").to_numpy().view(U64)
        one.ranks[at] = got.column("rank").to_numpy()
        out.append(one)
    return out


#: Ranks: 0 for classes of one, then by size, and the largest classes each have one of their own.
OWN_RANKS, FIRST_OWN = 150, 100


def _entries(parts: list[tuple[list[int], int]], shared, words: list[str]):
    """Index rows of each fingerprint, and its probes of values that some fingerprint of its rank or above has."""

    def run(batches):
        maps = shared.value
        flips = [masks(len(g), t)[1:] for g, t in parts]
        hashes = [np.stack([linear_hash(x), linear_hash(x, 1)]) for x in flips]
        for batch in batches:
            fps, ids, comp, rank = _fps(batch, words), *(batch.column(c).to_numpy() for c in ("id", "comp", "rank"))
            above = rank + (rank >= FIRST_OWN)
            for i, (g, _) in enumerate(parts):
                value = project(fps, g)
                sources, values = [np.arange(len(fps))], [value]
                step = max(1, (1 << 18) // max(1, len(flips[i])))
                for at in range(0, len(fps) if len(flips[i]) else 0, step):
                    source, flip = maps[i].has(value[at : at + step], hashes[i])
                    source += at
                    probed = value[source] ^ flips[i][flip]
                    ok = maps[i].rank(probed) >= above[source]
                    sources.append(source[ok])
                    values.append(probed[ok])
                rows = np.concatenate(sources)
                yield pa.record_batch({
                    "part": pa.array(np.full(len(rows), i, np.int32)), "value": pa.array(signed(np.concatenate(values))),
                    "id": pa.array(ids[rows]), "comp": pa.array(comp[rows]), "rank": pa.array(rank[rows]), "own": pa.array(np.arange(len(rows)) < len(fps)),
                    **{c: pa.array(signed(fps[rows, k])) for k, c in enumerate(words)},
                })

    return run


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints that come as rows of words."""
    return popcount(a ^ b).sum(axis=-1, dtype=np.int64)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two values of ``side``, of which the second may be absent; the fewer first."""
    one, two = np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0])
    return (one, two) if len(one) <= len(two) else (two, one)


def forest(fps: np.ndarray, comp: np.ndarray, side: np.ndarray, cross: bool, distance: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links that join classes ``comp``; with ``cross``, of those between sides."""
    _, at = np.unique(comp, return_inverse=True)
    union, out = _Union(int(at.max()) + 1 if len(at) else 0), []
    left, right = sides(side) if cross else (np.arange(len(fps)),) * 2
    for k in left.tolist():
        others = right if cross else right[k + 1 :]
        near = others[(apart(fps[others], fps[k]) <= distance) & (at[others] != at[k])]
        for j in near.tolist():
            if union.join(int(at[k]), int(at[j])):
                out.append((k, j))
    return out


def compare(fps: np.ndarray, ids: np.ndarray, comp: np.ndarray, own: np.ndarray, side: np.ndarray, cross: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups that begin at ``starts``: small ones all at once, others as forests."""
    ends = np.append(starts[1:], len(fps))
    index = np.concatenate([[0], np.cumsum(own)])
    n_own = index[ends] - index[starts]
    size = ends - starts
    out_a, out_b = [], []
    small = (n_own > 0) & (size > 1) & (n_own * size <= 64) & ~cross[starts]
    if small.any():
        # rows of a group begin with its index rows: pair each row with each of them
        s, e, k = starts[small], ends[small], n_own[small]
        rows = np.repeat(s, e - s) + np.arange((e - s).sum()) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
        per = np.repeat(k, e - s)
        base = np.repeat(s, e - s)
        first = np.repeat(rows, per)
        second = np.repeat(base, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        ok = (comp[first] != comp[second]) & (apart(fps[first], fps[second]) <= distance)
        out_a.append(ids[first[ok]])
        out_b.append(ids[second[ok]])
    # a split value's blocks hold its index rows and probes in any shares
    for g in np.flatnonzero(((n_own > 0) | cross[starts]) & (size > 1) & ~small):
        part = slice(starts[g], ends[g])
        edges = forest(fps[part], comp[part], side[part], bool(cross[starts[g]]), distance)
        if edges:
            x, y = np.array(edges).T
            out_a.append(ids[part][x])
            out_b.append(ids[part][y])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _matching(words: list[str], distance: int):
    """Rows come sorted by (part, value, bi, bj) and index rows first; a group may go over batches."""
    names = ("part", "value", "bi", "bj", "own", "side", "id", "comp")

    def run(batches):
        kept = None

        def heads(cols):
            key = np.zeros(len(cols[0]), bool)
            key[:1] = True
            for c in cols[:4]:
                key[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(key)

        def put(cols, starts):
            a, b = compare(cols[8], cols[6], cols[7], cols[4], cols[5], cols[2] != cols[3], starts, distance)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.record_batch({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy())})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [_fps(batch, words)]
            cols[4] = cols[4].astype(bool)
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            starts = heads(cols)
            last = starts[-1]
            if last:
                yield put([c[:last] for c in cols], starts[:-1])
            kept = [c[last:] for c in cols]
        if kept is not None:
            yield put(kept, heads(kept))

    return run


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row of ``table`` for each key: keys with many rows are broadcast, others are shuffled.

    ``weight`` says how many of ``total`` rows a key has, so at most ``HOT_SHARE`` of them are broadcast.
    """
    hot = F.broadcast(table.where(F.col(weight) > total / HOT_SHARE))
    cold = table.where(F.col(weight) <= total / HOT_SHARE)
    rest = rows.join(hot.select(*on), on, "left_anti").join(cold, on, how)
    return rows.join(hot, on).unionByName(rest)


def grid(side: Column, block: Column, rest: Column, main: Column) -> Column:
    """Pairs (bi, bj) of blocks that a row goes to: the rest meets everything, the main class only the rest.

    ``side``: whether the row is of the main class; ``block``: its block, those of the main class after the others'.
    """
    pair = lambda j: F.struct(F.least(block, j).cast("int").alias("bi"), F.greatest(block, j).cast("int").alias("bj"))
    some = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.when(side, some(rest)).otherwise(some(rest + main)), pair)


def stars(texts: DataFrame, p: Params, n: int) -> DataFrame:
    """Links (a, b) of each fingerprint with the least one that has the same value in a sample of the bits."""
    words, width = p.words, min(WIDEST, max(8, math.ceil(math.log2(n + 1)) + 2))
    rng = np.random.default_rng(SEED)
    samples = [sorted(rng.choice(p.bits, width, replace=False).tolist()) for _ in range(SAMPLES)]

    def run(batches):
        for batch in batches:
            fps = _fps(batch, words)
            for i, g in enumerate(samples):
                yield pa.record_batch({"part": pa.array(np.full(len(fps), i, np.int32)), "value": pa.array(signed(project(fps, g))), "id": batch.column("id"), **{c: batch.column(c) for c in words}})

    entries = texts.select("id", *words).mapInArrow(run, f"part int, value long, id long, {', '.join(f'{c} long' for c in words)}")
    least = entries.groupBy("part", "value").agg(F.count("*").alias("rows"), F.min(F.struct("id", *words)).alias("least")).where("rows > 1")
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"least.{c}"))) for c in words), F.lit(0))
    both = hot_join(entries, cut(least), ["part", "value"], "rows", n * SAMPLES)
    return both.where((F.col("id") != F.col("least.id")) & (differing <= p.distance)).select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()


def ranked(texts: DataFrame, links: DataFrame) -> DataFrame:
    """``texts`` (id, ...) with comp, its class by the links so far, and rank, which grows with the class's size."""
    roots = components(links)
    sizes = roots.groupBy(F.col("root").alias("comp")).agg(F.count("*").alias("size"))
    top = [r.comp for r in sizes.orderBy(F.desc("size"), "comp").limit(OWN_RANKS).collect()]
    own = F.lit(None).cast("int")
    if top:
        named = sizes.sparkSession.createDataFrame([(c, FIRST_OWN + OWN_RANKS - i) for i, c in enumerate(top)], "comp long, own int")
        sizes = sizes.join(F.broadcast(named), "comp", "left")
        own = F.col("own")
    by_size = F.least(F.floor(F.log2("size")), F.lit(FIRST_OWN - 1)).cast("int")
    classed = roots.select(F.col("node").alias("id"), F.col("root").alias("comp"))
    total = roots.count()
    with_rank = hot_join(classed, cut(sizes.withColumn("rank", F.coalesce(own, by_size)).select("comp", "size", "rank")), ["comp"], "size", total).select("id", "comp", "rank")
    return cut(texts.join(with_rank, "id", "left").withColumns({"comp": F.coalesce("comp", "id"), "rank": F.coalesce("rank", F.lit(0))}))


def links(texts: DataFrame, params: Params | None = None) -> DataFrame:
    """Links (a, b) between ids whose components are those of all links; ``texts``: id and the fingerprint's words, distinct."""
    p = params or Params()
    words = p.words
    n, share, corr = correlation(texts, words)
    first = cut(stars(texts, p, n))
    classed = ranked(texts, first)
    parts = plan(n, share, corr, p.distance)
    maps = texts.sparkSession.sparkContext.broadcast(held(classed, [g for g, _ in parts], words, n))
    kinds = f"part int, value long, id long, comp long, rank int, own boolean, {', '.join(f'{c} long' for c in words)}"
    spread = classed.select("id", "comp", "rank", *words).repartition(shuffle_partitions(texts.sparkSession), "id")  # few rows, much to do for each
    entries = cut(spread.mapInArrow(_entries(parts, maps, words), kinds))
    maps.unpersist()
    key, alone = ["part", "value"], F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))
    rows, side, places = entries, F.lit(0), alone
    # values that more than a block of rows have are split; their class of the highest rank is not compared with itself
    hot = entries.groupBy(key).agg(F.count("*").alias("rows"), F.max(F.struct("rank", "comp")).alias("top")).where(F.col("rows") > BLOCK).select(*key, "rows", F.col("top.comp").alias("main"))
    if not hot.isEmpty():
        hot, total = cut(hot), entries.count()
        blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
        in_main = F.col("comp") == F.col("main")
        shares = hot_join(entries.select(*key, "comp"), hot, key, "rows", total).groupBy(key).agg(blocks(~in_main).alias("rest"), blocks(in_main).alias("mains"))
        rows = hot_join(entries, cut(hot.join(shares, key)), key, "rows", total, "left")
        spread = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
        side = F.when(in_main, F.col("rest") + spread(F.col("mains"))).when(F.col("rows").isNotNull(), spread(F.col("rest"))).otherwise(0)
        places = F.when(F.col("rows").isNull(), alone).otherwise(grid(in_main, F.col("side"), F.col("rest"), F.col("mains")))
    dealt = rows.withColumn("side", side).withColumn("at", F.explode(places)).select(*key, "at.bi", "at.bj", "own", "side", "id", "comp", *words)
    dealt = dealt.repartition(shuffle_partitions(texts.sparkSession), "part", "value", "bi", "bj").sortWithinPartitions("part", "value", "bi", "bj", F.desc("own"))
    return first.unionByName(dealt.mapInArrow(_matching(words, p.distance), "a long, b long")).distinct()


# -- similarity -----------------------------------------------------------------------


def alike(sets: list[np.ndarray], classes: np.ndarray, side: np.ndarray, cross: bool, least: float) -> list[tuple[int, int]]:
    """Positions of a spanning forest of links that join ``classes``; with ``cross``, of those between sides."""
    sizes = np.array([len(x) for x in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    _, at = np.unique(classes, return_inverse=True)
    union, out, mark = _Union(int(at.max()) + 1), [], np.zeros(len(names), bool)
    left, right = sides(side) if cross else (np.arange(len(sets)),) * 2
    for i in left.tolist():
        others = right if cross else right[i + 1 :]
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[low >= least * high - 1e-9]
        root = union.find(int(at[i]))
        others = np.array([j for j in others.tolist() if union.find(int(at[j])) != root], dtype=np.int64)
        if not len(others):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        ends = np.cumsum(sizes[others])
        where = np.arange(ends[-1]) + np.repeat(starts[others] - ends + sizes[others], sizes[others])
        shared = np.diff(np.concatenate([[0], np.cumsum(mark[flat[where]])])[np.concatenate([[0], ends])])
        mark[own] = False
        for j in others[shared >= least * (sizes[i] + sizes[others] - shared) - 1e-9].tolist():
            if union.join(int(at[i]), int(at[j])):
                out.append((i, j))
    return out


def _linking(least: float):
    """Links inside one dealt block; its key's last two columns are the blocks."""

    def run(key, group):
        col = lambda c: group.column(c).to_numpy(zero_copy_only=False)
        ids, cross = col("id"), key[-2].as_py() != key[-1].as_py()
        sets = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        pairs = np.array(alike(sets, col("class"), col("side"), cross, least), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})

    return run


def verified(docs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between texts' keys whose components are those of all links; ``texts``: id and root (its class by bits)."""
    spark = docs.sparkSession
    sizes = cut(texts.groupBy("root").agg(F.count("*").alias("size")).where("size > 1"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    crowded = cut(hot_join(texts.select("id", "root"), sizes, ["root"], "size", total).select("id", "root", "size"))
    own = crowded.select(F.col("id").alias("w0"), F.lit(0).alias("rank"))
    known = spark.sparkContext.broadcast(held(own, [list(range(64))], ["w0"], total)[0])
    itself = np.zeros((2, 1), U64)

    def read(batches):
        for batch in pieces(batches):
            words = {text_key(w): w for w in (t.lower().split() for t in text_column(batch).cast(pa.binary()).to_pylist())}
            keys = np.array(list(words), dtype=U64)
            keys = keys[known.value.has(keys, itself)[0]] if len(keys) else keys
            sets = [np.unique(shingles(words[k], p.compared)) for k in keys.tolist()]
            least = [[int(signed(mix(s ^ U64(SEED + i)).min(keepdims=True))[0]) if len(s) else 0 for i in range(MINIMA)] for s in sets]
            yield pa.record_batch({"id": pa.array(signed(keys)), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()), "least": pa.array(least, pa.list_(pa.int64()))})

    sets = docs.select("text").mapInArrow(read, "id long, shingles binary, least array<long>").dropDuplicates(["id"])
    sets = cut(crowded.join(sets, "id"))
    # each text with the least one of its class by bits that has the same minimum hash
    minima = sets.select("id", "root", F.posexplode("least").alias("i", "value"))
    heads = cut(minima.groupBy("root", "i", "value").agg(F.count("*").alias("rows"), F.min("id").alias("head")).where("rows > 1"))
    pairs = cut(hot_join(minima, heads, ["root", "i", "value"], "rows", MINIMA * total).where("id <> head").select("id", "head").distinct())
    salts = cut(pairs.groupBy("head").agg(F.count("*").alias("rows")).withColumn("salts", F.ceil(F.col("rows") / TEXT_BLOCK).cast("int")))
    members = hot_join(pairs, salts, ["head"], "rows", MINIMA * total).select("id", "head", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
    leaders = salts.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    dealt = members.unionByName(leaders).join(sets.select("id", "shingles"), "id").withColumns({"class": F.col("id"), "bj": F.lit(1), "bi": F.lit(0)})
    first = cut(dealt.groupBy("head", "salt", "bi", "bj").applyInArrow(_linking(p.similarity), "a long, b long"))
    # what is left: of every class by bits with several classes so far, all but the largest against everything
    roots = components(first).select(F.col("node").alias("id"), F.col("root").alias("class"))
    so_far = cut(crowded.join(roots, "id", "left").select("id", "root", "size", F.coalesce("class", "id").alias("class")))
    shares = so_far.groupBy("root", "class").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    mains = cut(shares.groupBy("root").agg(F.max(F.struct("n", "class")).alias("main"), F.first("size").alias("size")).where("main.n < size"))
    blocks = lambda c: F.ceil(c / TEXT_BLOCK).cast("int")
    left = hot_join(so_far.drop("size"), mains, ["root"], "size", total)
    in_main, rest, main = F.col("class") == F.col("main.class"), blocks(F.col("size") - F.col("main.n")), blocks(F.col("main.n"))
    side = F.when(in_main, rest + F.pmod(F.xxhash64("id"), main)).otherwise(F.pmod(F.xxhash64("id"), rest)).cast("int")
    # a class by bits of few texts is one block
    one = F.col("size") <= TEXT_BLOCK
    places = F.when(one, F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj")))).otherwise(grid(in_main, side, rest, main))
    placed = left.select("id", "root", "class", side.alias("side"), F.explode(places).alias("at")).select("id", "root", "class", "side", "at.bi", "at.bj")
    second = placed.join(sets.select("id", "shingles"), "id").groupBy("root", "bi", "bj").applyInArrow(_linking(p.similarity), "a long, b long")
    return first.unionByName(second)


# -- classes --------------------------------------------------------------------------


def _classed(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, row, fp, member (text or fingerprint), the root of its class and copies (rows of this member) of every row."""
    words = p.words
    rows = cut(fingerprints(docs, p).withColumn("id", F.col("key") if p.similarity else F.xxhash64(*words) if len(words) > 1 else F.col("w0")))
    texts = cut(rows.groupBy("id", *words).agg(F.count("*").alias("copies")))
    roots = components(links(texts.select("id", *words), p))
    placed = lambda roots: texts.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "copies", F.coalesce("root", "id").alias("root"))
    if p.similarity:
        roots = components(verified(docs, cut(placed(roots)), p))
    total = rows.count()
    return hot_join(rows.withColumnRenamed("w0", "fp"), cut(placed(roots)), ["id"], "copies", total).select("doc_id", "row", "fp", "id", "root", "copies")


def classes(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, fp (its first word), component_id (the smallest id of the class) and copies (rows of this fingerprint, or text) of every row."""
    rows = cut(_classed(docs, params or Params()))
    first = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    return hot_join(rows, first, ["root"], "rows", rows.count()).select("doc_id", "fp", "component_id", "copies")


def keep_first(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """One row of each class with all columns: that of the smallest id, rows without an id last, ties by a hash of the row."""
    rows = cut(_classed(docs, params or Params()))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    chosen = cut(first.select(F.col("first.row").alias("__row")).distinct())
    repeated = cut(rows.groupBy(F.col("row").alias("__row")).agg(F.count("*").alias("n")).where("n > 1").join(chosen, "__row", "left_semi").select("__row"))
    named = docs.withColumn("__row", row_hash(docs))
    kept = named.join(chosen, "__row", "left_semi")
    if not repeated.isEmpty():  # wholly equal rows
        one = named.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
        kept = kept.join(repeated, "__row", "left_anti").unionByName(one)
    return kept.drop("__row")
