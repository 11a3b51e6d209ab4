"""Benchmark decontamination by template windows.

Words are stripped of punctuation and lower-cased; numbers, number words, names and
units after a number become the typed placeholders of a template, their words the values
of its slots.  An item's names are its capitalised words inside a sentence, and those at
a sentence's start that some item has as such a name or that aren't known to be common
(``COMMON``, or in lower case in some item).  In a text each word that may be a name is
tried as one: capitalised words at any place, in any case the names of items, and in a
text without case all words that no item has as a literal.  A word that may be both is
tried as both, so a window can have several templates.  Windows of
``window`` template words are hashed and hash-joined with the benchmark's.  A text is
contaminated by an item if it holds at least ``containment`` of the item's distinct
windows and the slots agree: over the matched windows each slot value of the item
stands for one value of the text for each time that the item occurs in it, for at least
``agreement`` of the values, and each name of the text for one of the item likewise.  So
copies and questions with other numbers or names are both found, while windows that only
share placeholders are not.  (Different numbers of an item may become equal ones.)

What items have as names and literals is broadcast: it grows with their vocabulary.

A window of a text takes part in the join only if a Bloom filter of fixed size that
holds the benchmark's windows has it.  A text that holds enough of an item holds one of
its n - ceil(containment * n) + 1 rarest windows, by the texts that have them; only those
make candidates, so a window that many texts and items share pairs none of them by
itself.  The benchmark's side is broadcast up to ``broadcast_rows`` windows and shuffled
beyond, with Spark's skew handling.

Edge cases: null texts are empty; a text without words has no window and is clean; a
text or item shorter than the window is a single window.  An item of at least
``least_words`` and fewer words than the window is looked for inside texts too, if two of
its words are literals; a shorter one is found in a text that has nothing else.  Rows are
judged by id and text: rows that share an id, or have none, apart unless their texts are
equal.  Repeated rows and items count once.  An empty benchmark finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lattica.llm.text import U64, Words, hash_words, lists, mix, pieces, signed, text_column
from lattica.session import cut, prepare

EDGES = b".,;:!?\"'`()[]{}<>*#&_/\\|~-"
#: Words that count as numbers, and units that follow them.
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
UNITS = frozenset(b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz gram grams kilogram kilograms ton tons pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years mph kmh hz khz mhz w kw v a c f k percent % dollar dollars euro euros cent cents usd eur".split())
COMMON = frozenset(
    b"a an the this that these those there here it he she they we you i if when while where what which who whom whose why how in on at by for from to of with "
    b"without after before during since until as and or but nor so yet not no each every all some any many most both either neither another given let find suppose "
    b"consider assume calculate compute determine solve show prove write explain describe list choose select use using is are was were do does did has have had can "
    b"could will would should may might must then now today next first finally however therefore thus because although also only my your his her its our their".split()
)
NUMBER = r"^[+$-]?\d[\d.,:/]*(?:%|[a-z]{1,3})?$"
_NUMBER_WORDS, _UNITS, _COMMON = (pa.array(sorted(w.decode() for w in own)) for own in (NUMBER_WORDS, UNITS, COMMON))
SLOT_NUMBER, SLOT_NAME, SLOT_UNIT = hash_words([b" number", b" name", b" unit"])
IS_NUMBER, IS_UNIT = 1, 2
A_NAME, A_NUMBER, A_UNIT = 1, 2, 3  # the last two bits of a slot's value
FILTER_BITS = 26
LEAST_LITERALS = 2  # of a window that is shorter than others


@dataclass(frozen=True)
class Params:
    window: int = 5
    containment: float = 0.8
    agreement: float = 0.8
    least_words: int = 3
    broadcast_rows: int = 200_000


class Lexicon:
    """Sorted hashes of words that are in lower case (``lower``), names or literals in some item."""

    def __init__(self, lower: np.ndarray, names: np.ndarray, literals: np.ndarray):
        self.lower, self.names, self.literals = lower, names, literals


@dataclass
class Canonical:
    """Template words, slot values (0 at literals), offsets of the texts; where a name may stand instead, and all words' hashes."""

    code: np.ndarray
    slot: np.ndarray
    offsets: np.ndarray
    both: np.ndarray
    value: np.ndarray
    lower: np.ndarray  # of the vocabulary


def canonical(texts: pa.Array, known: Lexicon | None = None, item: bool = True) -> Canonical:
    words = Words(texts, lower=False)
    bare = pc.utf8_trim(words.strings, characters=EDGES.decode())
    low = pc.utf8_lower(bare)
    first_letter = pc.utf8_slice_codeunits(bare, 0, 1)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    capital, small, held = flag(pc.utf8_is_upper(first_letter)), flag(pc.utf8_is_lower(first_letter)), flag(pc.not_equal(bare, ""))
    ends, common = flag(pc.match_substring_regex(words.strings, "[.?!:]$")), flag(pc.is_in(low, _COMMON))
    kind = np.where(flag(pc.or_(pc.match_substring_regex(low, NUMBER), pc.is_in(low, _NUMBER_WORDS))), IS_NUMBER, np.where(flag(pc.is_in(low, _UNITS)), IS_UNIT, 0))
    value = hash_words(low.cast(pa.binary()).to_pylist())
    ids = words.ids
    if not len(ids):
        none = np.zeros(0, U64)
        return Canonical(none, none, words.offsets, np.zeros(0, bool), none, none)
    isin = lambda own: _isin(value, own)[ids]
    first = np.zeros(len(ids), bool)
    first[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
    starts = first.copy()
    starts[1:] |= ends[ids[:-1]]
    number = kind[ids] == IS_NUMBER
    after_number = np.zeros(len(ids), bool)
    after_number[1:] = number[:-1]
    unit = (kind[ids] == IS_UNIT) & after_number & ~first
    free = ~number & ~unit
    # a text of capitals says no more about names than one without any
    has = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[ids])])[words.offsets]) > 0
    doc = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    cased = (has(capital) & has(small))[doc]
    named = capital[ids] & free & cased
    both = np.zeros(len(ids), bool)
    if known is None:
        name = named & ~starts
    elif item:
        name = free & (named & ~starts | isin(known.names) & capital[ids] | named & ~common[ids] & ~isin(known.lower))
    else:
        literal = isin(known.literals)
        name = free & (named | isin(known.names) | ~cased & ~literal)
        both = name & literal
        name &= ~literal
    code, slot = value[ids], np.zeros(len(ids), U64)
    for mask, mark, kind_of in ((number, SLOT_NUMBER, A_NUMBER), (name, SLOT_NAME, A_NAME), (unit, SLOT_UNIT, A_UNIT)):
        slot[mask] = typed(value[ids[mask]], kind_of)
        code[mask] = mark
    keep = held[ids]
    offsets = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    return Canonical(code[keep], slot[keep], offsets, both[keep], value[ids][keep], value[small])


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def typed(values: np.ndarray, kind: int) -> np.ndarray:
    return values & U64(2**64 - 4) | U64(kind)


@dataclass
class Windows:
    """Hashes, first words, lengths and texts of windows, and a bit for each word taken as a name that may be both."""

    key: np.ndarray
    start: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    taken: np.ndarray

    def only(self, at: np.ndarray) -> Windows:
        return Windows(self.key[at], self.start[at], self.size[at], self.doc[at], self.taken[at])


def windows(text: Canonical, width: int, shorter: tuple[int, ...] = ()) -> Windows:
    """All windows; shorter texts are one window.  ``shorter``: lengths of further windows of longer texts."""
    offsets = text.offsets
    lens = np.diff(offsets)
    starts, docs, sizes = [], [], []
    for size in (width, *shorter):
        count = np.where(lens >= size, lens - size + 1, np.minimum(lens, 1)) if size == width else np.where(lens > size, lens - size + 1, 0)
        doc = np.repeat(np.arange(len(lens)), count)
        last = np.cumsum(count)
        start = np.arange(last[-1] if len(last) else 0) - np.repeat(last - count, count) + np.repeat(offsets[:-1], count)
        own = np.minimum(size, lens[doc])
        if size < width:
            literal = np.concatenate([[0], np.cumsum(text.code == text.value)])
            told = literal[start + size] - literal[start] >= LEAST_LITERALS
            doc, start, own = doc[told], start[told], own[told]
        starts.append(start)
        docs.append(doc)
        sizes.append(own)
    start, doc, size = np.concatenate(starts), np.concatenate(docs), np.concatenate(sizes)
    key, taken = np.zeros(len(start), U64), np.zeros(len(start), np.int64)
    code, both = np.concatenate([text.code, np.zeros(width, U64)]), np.concatenate([text.both, np.zeros(width, bool)])
    for k in range(width):
        key *= U64(0x9E3779B97F4A7C15)
        inside, word = k < size, code[start + k]
        alt = np.flatnonzero(both[start + k] & inside)
        named = key[alt] + SLOT_NAME
        key += word if inside.all() else np.where(inside, word, U64(0))
        if len(alt):
            key, taken = np.concatenate([key, named]), np.concatenate([taken, taken[alt] | 1 << k])
            start, doc, size = np.concatenate([start, start[alt]]), np.concatenate([doc, doc[alt]]), np.concatenate([size, size[alt]])
    return Windows(mix(key), start, size, doc, taken)


def _slots(text: Canonical, found: Windows, width: int) -> pa.Array:
    slot, value = (np.concatenate([x, np.zeros(width, U64)]) for x in (text.slot, typed(text.value, A_NAME)))
    start = found.start
    own = lambda k: np.where(found.taken >> k & 1 == 1, value[start + k], slot[start + k])
    table = np.stack([np.where(k < found.size, own(k), U64(0)) for k in range(width)], axis=1) if len(start) else np.zeros((0, width), U64)
    return lists(np.arange(len(start) + 1) * width, pa.array(signed(table.reshape(-1))))


def _windowing(width: int, lexicon, shared=None, shorter: tuple[int, ...] = ()):
    """``lexicon``: a broadcast; ``shared``: one of the filter's words, for texts: only windows that it has come out."""

    def run(batches):
        bits = shared.value if shared is not None else None
        for batch in pieces(batches, limit=1 << 20):
            text = canonical(text_column(batch), lexicon.value, bits is None)
            found = windows(text, width, shorter)
            if bits is not None:
                held = np.arange(len(found.key))
                for shift in (0, FILTER_BITS):
                    at = (found.key[held] >> U64(shift)) & U64((1 << FILTER_BITS) - 1)
                    held = held[(bits[(at >> U64(3)).view(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
                found = found.only(held)
            doc = pa.array(found.doc)
            yield pa.record_batch({"id": batch.column("id").take(doc), "row": batch.column("row").take(doc), "win": pa.array(signed(found.key)), "size": pa.array(found.size.astype(np.int32)), "slots": _slots(text, found, width)})

    return run


def _lexicon(benchmark: DataFrame) -> Lexicon:
    """From two passes over the items: their names decide which words at sentence starts are names too."""
    nothing = np.zeros(0, U64)

    def of(known, kinds):
        def run(batches):
            for batch in pieces(batches):
                text = canonical(text_column(batch), known)
                named, literal = text.code == SLOT_NAME, text.code == text.value
                for kind, own in enumerate((text.lower, text.value[named], text.value[literal])):
                    own = np.unique(own)
                    yield pa.record_batch({"kind": pa.array(np.full(len(own), kind, np.int32)), "word": pa.array(signed(own))})

        rows = benchmark.select("text").mapInArrow(run, "kind int, word long").distinct().toArrow()
        kind, word = rows.column("kind").to_numpy(), rows.column("word").to_numpy().view(U64)
        return [np.sort(word[kind == k]) for k in kinds]

    lower, names = of(None, (0, 1))
    return Lexicon(lower, *of(Lexicon(lower, names, nothing), (1, 2)))


_WINDOWS = "id long, row long, win long, size int, slots array<long>"


def row_of(id_: str) -> Column:
    """What rows are told apart by: the id and the text."""
    return F.xxhash64(F.col(id_).cast("long"), "text")


def _filter(bench: DataFrame) -> np.ndarray:
    """The filter's bits; what reaches the driver is bounded by its size."""
    mask = (1 << FILTER_BITS) - 1
    at = F.explode(F.array(F.col("win").bitwiseAND(mask), F.shiftrightunsigned("win", FILTER_BITS).bitwiseAND(mask)))
    rows = bench.select("win").distinct().select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at & 7 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, item_id, n_windows, containment, slot_agreement and row (``row_of``) of each contaminated text and item."""
    p = params or Params()
    spark = prepare(docs.sparkSession)
    lexicon = spark.sparkContext.broadcast(_lexicon(benchmark))
    listed = benchmark.select(F.col("item_id").cast("long").alias("id"), row_of("item_id").alias("row"), "text").dropDuplicates(["row"])
    items = cut(listed.mapInArrow(_windowing(p.window, lexicon), _WINDOWS))
    shorter = tuple(sorted(r.size for r in items.where((F.col("size") < p.window) & (F.col("size") >= p.least_words)).select("size").distinct().collect()))
    shared = spark.sparkContext.broadcast(_filter(items))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), row_of("doc_id").alias("row"), "text")
    found = texts.mapInArrow(_windowing(p.window, lexicon, shared, shorter), _WINDOWS)
    # repeats within a text count: they tell how often the item occurs in it
    copies = texts.groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1")
    mine = found.groupBy("id", "row", "win", "slots").agg(F.count("*").alias("times"))
    mine = cut(mine)
    repeated = cut(copies.join(mine.select("row").distinct(), "row", "left_semi"))
    if not repeated.isEmpty():
        mine = mine.join(repeated, "row", "left").withColumn("times", (F.col("times") / F.coalesce("rows", F.lit(1))).cast("long")).drop("rows")
    small = items.count() <= p.broadcast_rows
    near = F.broadcast if small else (lambda x: x)
    bench = items.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "win", F.col("slots").alias("item_slots")).distinct()
    # candidates: what shares one of an item's rarest windows
    distinct = bench.select("item", "win").distinct()
    counts = mine.join(near(distinct.select("win").distinct()), "win", "left_semi").select("row", "win").distinct().groupBy("win").agg(F.count("*").alias("texts"))
    each = W.partitionBy("item")
    ordered = distinct.join(counts, "win", "left").withColumns({
        "n_windows": F.count("*").over(each),
        "place": F.row_number().over(each.orderBy(F.coalesce("texts", F.lit(0)), "win")),
    })
    rarest = cut(ordered.where(F.col("place") <= F.col("n_windows") - F.ceil(p.containment * F.col("n_windows") - 1e-9) + 1).select("item", "win", "n_windows"))
    pairs = cut(mine.select("row", "win").join(near(rarest), "win").select("row", "item", "n_windows").distinct())
    both = cut(mine.withColumnRenamed("id", "doc_id").join(pairs, "row").join(near(bench), ["item", "win"]))
    who = ["row", "item"]
    per = both.groupBy(*who, "win").agg(F.sum("times").alias("times"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n_windows").alias("n_windows"))
    held = per.groupBy(who).agg(F.count("*").alias("matched"), F.max("times").alias("copies"), *(F.first(c).alias(c) for c in ("doc_id", "item_id", "n_windows")))
    held = held.withColumn("containment", F.col("matched") / F.col("n_windows")).where(F.col("containment") >= p.containment - 1e-9)
    pair = F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("s")
    values = both.join(held.select(*who, "copies"), who).select(*who, "copies", pair).select(*who, "copies", F.col("s.a").alias("a"), F.col("s.b").alias("b")).where("a <> 0").distinct()

    def agreeing(one: str, other: str, name: str, rows: DataFrame) -> DataFrame:
        """The share of values ``one`` that stand for no more values ``other`` than the text has copies."""
        n = rows.groupBy(*who, one).agg(F.count("*").alias("n"), F.first("copies").alias("copies"))
        return n.groupBy(who).agg(F.avg((F.col("n") <= F.col("copies")).cast("double")).alias(name))

    kind = lambda c: F.col(c).bitwiseAND(3)
    named = values.where((kind("a") == A_NAME) & (kind("b") == A_NAME))
    agreed = held.join(agreeing("a", "b", "there", values), who, "left").join(agreeing("b", "a", "back", named), who, "left")
    agreed = agreed.withColumn("slot_agreement", F.least(F.coalesce("there", F.lit(1.0)), F.coalesce("back", F.lit(1.0))))
    return agreed.where(F.col("slot_agreement") >= p.agreement).select("doc_id", "item_id", "n_windows", "containment", "slot_agreement", "row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Params | None = None) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    bad = cut(leaks(docs, benchmark, params).select(F.col("row").alias("__row")).distinct())
    return docs.withColumn("__row", row_of("doc_id")).join(bad, "__row", "left_anti").drop("__row")
