"""Language-model scoring from a log-frequency Bloom filter.

Training counts every word and every word pair of the training texts.  Pairs go
into a Bloom filter as (pair, level) entries for level = 1 .. 1 + floor(log_b c):
the filter holds quantised counts, never the pairs.  A count is read back by
probing level 1, 2, ... until a probe misses.  Probabilities are smoothed with a
Dirichlet prior over the add-one unigram distribution:

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(h w) + mu p(w)) / (c(h) + mu),   c(h w) <= c(h)

The filter is cut into segments by the pairs' hash, each built whole by one task
and sized for what it holds, so its error rate is the same at every size.  A
broadcast holds up to ``max_filter_bytes``; a larger filter is cut into shards of
that size, and each shard is one more pass that scores the positions whose pair
it holds (a text's score is a sum over positions, so the passes add up).  Rows are numbered
and written once before several passes.

Word counts: the most frequent words (at most ``top_words``) are broadcast with
exact counts.  The rest is joined by hash, one row a document and word, with count 0
for words that training has not seen; positions whose word or history is such a word
are carried with their level and scored after that join, from the same exact counts.

Edge cases: a null or empty text is the end token alone.  A row whose id is null
counts as training and is scored under a null id.  Repeated rows are scored one
by one.  No training text: N = V = 0, every probability is 1 / 1.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import U64, Words, hash_words, lists, mix, pieces, signed, sum_by, text_column
from lattica.session import cut, plan_bytes, prepare

#: No word holds a space, so these never equal one.
END, BEGIN = hash_words([b" end", b" begin"])
FLUSH = 2_000_000


@dataclass(frozen=True)
class Params:
    base: float = 2.0  # of the logarithmic quantisation
    bits_per_entry: float = 10.0
    probes: int = 7
    mu: float = 150.0  # strength of the prior
    top_words: int = 1 << 20  # exact counts in a broadcast: 16 bytes each
    max_filter_bytes: int = 256 << 20


# -- the filter ------------------------------------------------------------------------


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count)), exact at powers."""
    level = 1 + np.floor(np.log(counts.astype(float)) / np.log(base) + 1e-9).astype(np.int64)
    return np.where(counts > 0, level, 0)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The mean of the counts that share a level; 0 for level 0."""
    mean = (np.power(base, levels - 1.0) + np.power(base, levels.astype(float)) - 1) / 2
    return np.where(levels > 0, np.maximum(mean, 1.0), 0.0)


def slots(keys: np.ndarray, level: int, probes: int, sizes) -> Iterator[np.ndarray]:
    """Bit numbers in a segment of ``sizes`` bits, one array for each probe."""
    start = mix(keys ^ mix(np.array([level], dtype=U64)))
    step = mix(start + U64(0x9E3779B97F4A7C15)) | U64(1)
    for _ in range(probes):
        yield start % sizes
        start = start + step


def build_segment(keys: np.ndarray, counts: np.ndarray, p: Params) -> tuple[bytes, int]:
    """Bits of a segment that holds these distinct keys, and their number."""
    levels = level_of(counts, p.base)
    size = max(64, int(np.ceil(levels.sum() * p.bits_per_entry / 8)) * 8)
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in slots(keys[levels >= level], level, p.probes, U64(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes(), size


class Filter:
    """Segments [first, first + len(sizes)) of a filter, packed one after the other."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, first: int, shift: int, p: Params):
        self.data, self.sizes, self.first, self.shift, self.p = data, sizes.astype(U64), first, shift, p
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(U64)

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(self.shift)).astype(np.int64) - self.first

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated probes; keys outside these segments give -1."""
        seg = self.segment(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        live = np.flatnonzero((seg >= 0) & (seg < len(self.sizes)))
        out[live] = 0
        level = 1
        while len(live) and level < 64:
            own = seg[live]
            hit = np.arange(len(live))
            sizes, starts, k = self.sizes[own], self.starts[own], keys[live]
            start = mix(k ^ mix(np.array([level], dtype=U64)))
            step = mix(start + U64(0x9E3779B97F4A7C15)) | U64(1)
            for _ in range(self.p.probes):
                at = starts[hit] + start[hit] % sizes[hit]
                ok = (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
                hit = hit[ok]
                start = start + step
            live = live[hit]
            out[live] = level
            level += 1
        return out


# -- counting --------------------------------------------------------------------------


def pair_keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens with an end in each document: the pairs' keys, and which tokens come first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    return mix(before * U64(0x9E3779B97F4A7C15) + mix(tokens)), before


def with_end(words: Words, values: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """values[ids] of each document followed by ``end``; and the new offsets."""
    n = len(words.offsets) - 1
    out = np.insert(values[words.ids], words.offsets[1:], np.full(n, end, dtype=values.dtype)) if n else values[:0]
    return out, words.offsets + np.arange(n + 1)


def _blobs(kind: int, keys: np.ndarray, counts: np.ndarray, shift: int) -> pa.RecordBatch:
    """A row for each segment; keys are sorted."""
    seg = (keys >> U64(shift)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1, [len(seg)]]) if len(seg) else np.zeros(1, np.int64)
    counts = counts.astype(np.int64)
    return pa.record_batch({
        "kind": pa.array(np.full(len(cuts) - 1, kind, dtype=np.int32)),
        "seg": pa.array(seg[cuts[:-1]] if len(seg) else np.zeros(0, np.int64)),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
    })


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _counting(shift: int, pairs: bool = True):
    def run(batches):
        held = {0: ([], []), 1: ([], [])}
        size = 0

        def flush():
            for kind, (keys, counts) in held.items():
                if keys:
                    yield _blobs(kind, *_merged(keys, counts), shift)
                held[kind] = ([], [])

        for batch in pieces(batches):
            words = Words(text_column(batch))
            hashes = words.hashes()
            tokens, offsets = with_end(words, hashes, END)
            uni = np.bincount(words.ids, minlength=len(hashes))
            held[0][0].extend([hashes, np.array([END], dtype=U64)])
            held[0][1].extend([uni, np.array([batch.num_rows])])
            size += len(hashes)
            if pairs:
                keys, counts = np.unique(pair_keys(tokens, offsets)[0], return_counts=True)
                held[1][0].append(keys)
                held[1][1].append(counts)
                size += len(keys)
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return run


_SEGMENT = "kind int, seg long, items long, tokens long, size long, bits binary, keys binary, counts binary"


def _segments(p: Params):
    def run(key, group):
        kind, seg = (x.as_py() for x in key)
        read = lambda name, dtype: [np.frombuffer(x, dtype=dtype) for x in group.column(name).to_pylist()]
        keys, counts = _merged(read("keys", U64), read("counts", np.int64))
        bits, size = build_segment(keys, counts, p) if kind else (b"", 0)
        return pa.table({
            "kind": pa.array([kind], pa.int32()), "seg": pa.array([seg], pa.int64()), "items": pa.array([len(keys)], pa.int64()),
            "tokens": pa.array([int(counts.sum())], pa.int64()), "size": pa.array([size], pa.int64()), "bits": pa.array([bits], pa.binary()),
            "keys": pa.array([b"" if kind else keys.tobytes()], pa.binary()), "counts": pa.array([b"" if kind else counts.astype(np.int64).tobytes()], pa.binary()),
        })

    return run


@dataclass
class Model:
    """``segments``: the written table of segments; ``words``: hash and count of each training word."""

    segments: DataFrame
    words: DataFrame
    shift: int
    tokens: int
    vocabulary: int
    params: Params


def _words(batches):
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
            yield pa.record_batch({"hash": pa.array(np.frombuffer(keys, dtype=np.int64)), "c": pa.array(np.frombuffer(counts, dtype=np.int64))})


def train(docs: DataFrame, params: Params | None = None, text: str = "text", pairs: bool = True) -> Model:
    """Count all words and pairs of ``docs`` and build the filter's segments; without ``pairs`` a model of words only."""
    p = params or Params()
    prepare(docs.sparkSession)
    bits = int(np.clip(np.ceil(np.log2(max(1, plan_bytes(docs) / (4 << 20)))), 6, 20))
    shift = 64 - bits
    blobs = docs.select(F.col(text).alias("text")).mapInArrow(_counting(shift, pairs), "kind int, seg long, keys binary, counts binary")
    segments = cut(blobs.groupBy("kind", "seg").applyInArrow(_segments(p), _SEGMENT))
    total = segments.where("kind = 0").agg(F.sum("tokens"), F.sum("items")).first()
    words = segments.where("kind = 0").select("keys", "counts").mapInArrow(_words, "hash long, c long")
    return Model(segments, words, shift, int(total[0] or 0), int(total[1] or 0), p)


# -- scoring ---------------------------------------------------------------------------


def _frequent(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of the words from some count on: the least one that keeps them within ``top_words``."""
    bucket = F.floor(F.log2("c") * 8)
    sizes = sorted(((int(r[0]), r[1]) for r in model.words.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    held, least = 0, None
    for b, n in sizes:
        if held + n > model.params.top_words:
            break
        held, least = held + n, b
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64), 1 << 62
    rows = model.words.where(bucket >= least).toArrow()
    keys, counts = rows.column("hash").to_numpy().view(U64), rows.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order], least


def _shards(model: Model) -> Iterator[tuple[list, int]]:
    """Ranges of segments whose bits fit a broadcast: (rows, first segment)."""
    sizes = model.segments.where("kind = 1").select("seg", "size").orderBy("seg").collect()
    group, total = [], 0
    for r in sizes:
        if group and total + r["size"] // 8 > model.params.max_filter_bytes:
            yield group
            group, total = [], 0
        group.append(r)
        total += r["size"] // 8
    yield group


def _filter(model: Model, group: list) -> Filter:
    if not group:
        return Filter(np.zeros(8, np.uint8), np.full(1, 64, np.int64), 0, model.shift, model.params)
    first, last = group[0]["seg"], group[-1]["seg"]
    rows = {r["seg"]: r for r in model.segments.where((F.col("kind") == 1) & F.col("seg").between(first, last)).select("seg", "size", "bits").toLocalIterator()}
    sizes = np.array([rows[s]["size"] if s in rows else 64 for s in range(first, last + 1)], dtype=np.int64)
    data = np.frombuffer(b"".join(bytes(rows[s]["bits"]) if s in rows else bytes(8) for s in range(first, last + 1)), dtype=np.uint8)
    return Filter(data, sizes, first, model.shift, model.params)


def _lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of those keys that the sorted table has, else -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], -1)


_SCORED = "rid long, n_tokens long, n_known long, base double, score double, open binary, rare array<struct<hash:long,tf:long>>"
#: A position to be scored later: its word and its history, each ~count or a place among the text's rare words by hash.
OPEN = np.dtype([("word", "<i8"), ("history", "<i8"), ("level", "u1")])


def pair_logs(level: np.ndarray, word: np.ndarray, history: np.ndarray, n: int, v: int, p: Params) -> np.ndarray:
    """log10 p(w | h) from a pair's level and the counts of its words."""
    seen = np.minimum(count_of(level, p.base), history)
    return np.log10((seen + p.mu * ((word + 1) / (n + v + 1))) / (history + p.mu))


def _scoring(frequent, shard, n: int, v: int, p: Params, first: bool):
    """``frequent``: a broadcast of the table of words; ``shard``: one of a Filter."""

    def run(batches):
        top, counts = frequent.value
        pairs = shard.value
        for batch in pieces(batches):
            words = Words(text_column(batch))
            hashes = np.concatenate([words.hashes(), [END]])
            c = _lookup(hashes, top, counts)
            ids, offsets = with_end(words, np.arange(len(hashes)), len(hashes) - 1)
            keys, _ = pair_keys(hashes[ids], offsets)
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[offsets[:-1]] = len(hashes) - 1  # a text begins as often as one ends
            word, history, level = c[ids], c[before], pairs.levels(keys)
            late = (level >= 0) & ((word < 0) | (history < 0))
            now = (level >= 0) & ~late
            logs = np.zeros(len(ids))
            logs[now] = pair_logs(level[now], word[now], history[now], n, v, p)
            # a text's rare words by hash, so that every pass numbers them alike
            order = np.argsort(hashes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            rare, tf = np.unique((of * len(hashes) + rank[ids])[word < 0], return_counts=True)
            doc = rare // len(hashes)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            of, kept = of[late], np.zeros(int(late.sum()), OPEN)
            for name, count, own in (("word", word[late], ids[late]), ("history", history[late], before[late])):
                kept[name] = np.where(count < 0, np.searchsorted(rare, of * len(hashes) + rank[own]) - ends[of], ~count)
            kept["level"] = level[late]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))])
            out = {"rid": batch.column("rid"), "score": pa.array(sum_by(logs, offsets)), "open": pa.array([kept[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())}
            if first:
                base = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / (n + v + 1)), 0.0)[ids]
                out |= {"n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(sum_by((c > 0)[ids].astype(np.int64), offsets)), "base": pa.array(sum_by(base, offsets))}
                out["rare"] = lists(ends, pa.StructArray.from_arrays([pa.array(signed(hashes[order[rare % len(hashes)]])), pa.array(tf.astype(np.int64))], ["hash", "tf"]))
                yield pa.record_batch({k: out[k] for k in ("rid", "n_tokens", "n_known", "base", "score", "open", "rare")})
            else:
                yield pa.record_batch(out)

    return run


_RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _resolving(n: int, v: int, p: Params):
    """Add the open positions to ``score``; ``found``: hashes and counts of a text's rare words."""

    def run(batches):
        for batch in batches:
            found, opened = batch.column("found"), batch.column("open")
            of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
            hashes, c = (pc.struct_field(found.flatten(), k).to_numpy(zero_copy_only=False) for k in ("hash", "c"))
            c = np.append(c[np.lexsort((hashes.view(U64), of))], 0)
            starts = np.searchsorted(of, np.arange(batch.num_rows))
            blobs = opened.flatten()
            at = np.frombuffer(b"".join(blobs.to_pylist()), OPEN)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(opened).to_numpy(zero_copy_only=False))
            doc = np.repeat(doc, pc.binary_length(blobs).to_numpy(zero_copy_only=False) // OPEN.itemsize)
            count = lambda x: np.where(x < 0, ~x, c[np.where(x < 0, -1, starts[doc] + x)])
            logs = pair_logs(at["level"].astype(np.int64), count(at["word"]), count(at["history"]), n, v, p)
            total = batch.column("score").to_numpy() + np.bincount(doc, logs, batch.num_rows)
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "n_tokens", "n_known", "base_score")), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row of ``docs``.

    ``base_score`` is the exact add-one unigram log10 probability, ``score`` the
    model's.  Other columns of ``docs`` are not read.
    """
    spark, p = docs.sparkSession, model.params
    sc = spark.sparkContext
    n, v = model.tokens, model.vocabulary
    top, counts, least = _frequent(model)
    table = sc.broadcast((top, counts))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    groups = list(_shards(model))
    if len(groups) > 1:  # every pass has to see the same numbers, whatever is computed again
        rows = cut(rows)
    whole, parts, held = None, [], [table]
    for group in groups:
        shard = sc.broadcast(_filter(model, group))
        run = _scoring(table, shard, n, v, p, whole is None)
        if whole is None:
            # the id travels beside the row number, so that no join has to bring it back
            whole = rows.mapInArrow(_keeping(run), "doc_id long, " + _SCORED)
        else:
            parts.append(rows.select("rid", "text").mapInArrow(run, "rid long, score double, open binary"))
        held.append(shard)
    whole, parts = cut(whole), [cut(x) for x in parts]
    for x in held:  # all that they were for is written
        x.destroy()
    out = _with_rare(whole, model, least, F.collect_list(F.struct("hash", F.coalesce("c", F.lit(0)).alias("c"))).alias("found"))
    score_col, opened = F.col("score"), F.array("open")
    if parts:
        more = parts[0]
        for x in parts[1:]:
            more = more.unionAll(x)
        out = out.join(more.groupBy("rid").agg(F.sum("score").alias("more_score"), F.collect_list("open").alias("more_open")), "rid", "left")
        score_col = score_col + F.coalesce("more_score", F.lit(0.0))
        opened = F.concat(opened, F.coalesce("more_open", F.array().cast("array<binary>")))
    out = out.select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score_col.alias("score"), opened.alias("open"), "found",
    )
    return out.mapInArrow(_resolving(n, v, p), _RESULT)


_BASE = "doc_id long, rid long, n_tokens long, n_known long, base double, rare array<struct<hash:long,tf:long>>"


def _basing(frequent, n: int, v: int):
    """Of each text what needs word counts only: tokens, known ones, base score, and its rare words."""

    def run(batches):
        top, counts = frequent.value
        for batch in pieces(batches):
            words = Words(text_column(batch))
            hashes = np.concatenate([words.hashes(), [END]])
            c = _lookup(hashes, top, counts)
            ids, offsets = with_end(words, np.arange(len(hashes)), len(hashes) - 1)
            base = np.where(c >= 0, np.log10((np.maximum(c, 0) + 1) / (n + v + 1)), 0.0)[ids]
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            rare, tf = np.unique((of * len(hashes) + ids)[c[ids] < 0], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rare // len(hashes), minlength=batch.num_rows))])
            found = lists(ends, pa.StructArray.from_arrays([pa.array(signed(hashes[rare % len(hashes)])), pa.array(tf.astype(np.int64))], ["hash", "tf"]))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("rid"), pa.array(np.diff(offsets)), pa.array(sum_by((c > 0)[ids].astype(np.int64), offsets)), pa.array(sum_by(base, offsets)), found], names=["doc_id", "rid", "n_tokens", "n_known", "base", "rare"])

    return run


def _with_rare(whole: DataFrame, model: Model, least: int, *more) -> DataFrame:
    """``whole`` with more_base, more_known and ``more`` of the rare words of each row."""
    rare = whole.select("rid", F.explode("rare").alias("r")).select("rid", "r.hash", "r.tf")
    seldom = model.words.where(F.floor(F.log2("c") * 8) < least)
    c = F.coalesce("c", F.lit(0))
    log = F.log10((c + 1).cast("double") / F.lit(float(model.tokens + model.vocabulary + 1)))
    rest = rare.join(seldom, "hash", "left").groupBy("rid").agg(F.sum(F.col("tf") * log).alias("more_base"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"), *more)
    return whole.drop("rare").join(rest, "rid", "left")


def base_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known and base_score like ``score``, in one pass: no pairs, so no filter and no shards."""
    top, counts, least = _frequent(model)
    table = docs.sparkSession.sparkContext.broadcast((top, counts))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    whole = cut(rows.mapInArrow(_basing(table, model.tokens, model.vocabulary), _BASE))
    table.destroy()
    return _with_rare(whole, model, least).select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"))


def _keeping(run):
    def both(batches):
        for batch in pieces(batches):
            for out in run([batch]):
                yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *out.columns], names=["doc_id", *out.schema.names])

    return both


def score_split(docs: DataFrame, params: Params | None = None, modulus: int = 7, held: int = 2) -> DataFrame:
    """Learn from rows whose crc32(id as text) mod ``modulus`` isn't ``held``, and score all rows."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    model = train(docs.where(fold != held), params)
    scored = score(docs, model)
    return scored.select("doc_id", (fold == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def base_split(docs: DataFrame, params: Params | None = None, modulus: int = 7, held: int = 2) -> DataFrame:
    """The columns of ``score_split`` that need no pairs: all but score."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus
    model = train(docs.where(fold != held), params, pairs=False)
    return base_scores(docs, model).select("doc_id", (fold == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score")
