"""SentencePiece encoding and decoding with a streaming Viterbi search.

The segmentation is the one with the largest sum of the pieces' log-probabilities (the
library's unigram rule).  A unigram file has them.  A file of BPE type only has ranks,
which are no probabilities: there a piece of rank r gets that of Zipf's law, 1 / (r + 1)
over the sum of all, so nothing is trained.  (The library merges such a file's pieces by
rank, so single ids differ; both decode to the same text.)

``Search`` takes text as it comes and keeps only what follows the last boundary on which
all surviving backpointer paths converge: every ``CHECK`` characters it walks the live
ends (those that a future piece can start from, as many as the longest piece has
characters) back to their common ancestor and commits the ids up to it.  Characters that
no piece covers become byte pieces.

Where no piece can reach across a boundary at all (before a space mark that follows
another character, around a character that occurs in no longer piece) all paths converge
at once.  ``Pieces.stream`` commits there without a search, and reuses the ids of parts
between such boundaries while a table of bounded size has them; parts of more than
``LONGEST_KEPT`` characters go through a search chunk by chunk.

Edge cases: null and empty texts give no ids.  Ties keep the earlier start, that
is the longer last piece.  Decoding restores the text exactly, except that a
literal U+2581 comes back as a space and a U+0000 survives as a byte piece.  Repeated
rows are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import lists, pieces, text_column
from lattica.session import prepare

MARK = "▁"
CHECK = 64
CHUNK = 4096  # characters of a text that are read at once
LONGEST_KEPT, KEPT_BYTES = 256, 64 << 20  # of the parts whose ids are kept
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
BPE = 2  # a model type
EULER_GAMMA = 0.5772156649
_NEVER = float("-inf")
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def by_rank(rank: float, n: int) -> float:
    """Log-probability of a piece by Zipf's law over n ranks from 0, in steps of 2^-12 so that sums are exact."""
    return round((-math.log(max(0.0, rank) + 1) - math.log(math.log(max(n, 2)) + EULER_GAMMA)) * 4096) / 4096


class Search:
    """A Viterbi search over text that comes in chunks; what is sure is put out and forgotten."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text, self.at = "", 0
        self.best, self.prev, self.ids = [0.0], [0], [-1]

    def push(self, chunk: str) -> list[int]:
        """Ids that are sure now."""
        out = []
        for at in range(0, len(chunk), CHUNK):
            self._grow(chunk[at : at + CHUNK])
            while self.at < len(self.text) - self.pieces.longest:
                self._advance(min(len(self.text) - self.pieces.longest, self.at + CHECK))
                out += self._commit()
        return out

    def finish(self) -> list[int]:
        self._advance(len(self.text))
        return self._trace(len(self.text))

    def _grow(self, chunk: str) -> None:
        self.text += chunk
        self.best += [_NEVER] * len(chunk)
        self.prev += [0] * len(chunk)
        self.ids += [-1] * len(chunk)

    def _advance(self, stop: int) -> None:
        """Relax all pieces that start before ``stop``."""
        relax(self.pieces, self.text, self.at, stop, self.best, self.prev, self.ids)
        self.at = max(self.at, stop)

    def _commit(self) -> list[int]:
        """Ids up to the boundary on which the paths to all live ends converge; the window then begins there."""
        live = {i for i in range(self.at, min(self.at + self.pieces.longest, len(self.text) + 1)) if self.best[i] > _NEVER}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.prev[top])
        root = live.pop()
        if not root:
            return []
        out, gone = self._trace(root), self.best[root]
        self.text, self.at = self.text[root:], self.at - root
        self.best = [x - gone for x in self.best[root:]]
        self.prev = [max(0, x - root) for x in self.prev[root:]]
        self.ids = self.ids[root:]
        return out

    def _trace(self, end: int) -> list[int]:
        return traced(self.pieces, self.text, end, self.prev, self.ids)


def relax(own: Pieces, text: str, start: int, stop: int, best: list[float], prev: list[int], ids: list[int]) -> None:
    """Best scores and backpointers of the ends of all pieces that start from ``start`` on and before ``stop``."""
    trie, unknown, size = own.trie, own.unknown_score, len(text)
    for at in range(start, stop):
        here, kids = best[at], trie
        end = at
        while end < size:
            found = kids.get(text[end])
            if found is None:
                break
            piece, score, kids = found
            end += 1
            if piece >= 0:
                score += here
                if score > best[end]:
                    best[end], prev[end], ids[end] = score, at, piece
        # a single character always goes, as an unknown one if need be
        if here + unknown > best[at + 1]:
            best[at + 1], prev[at + 1], ids[at + 1] = here + unknown, at, -1


def traced(own: Pieces, text: str, end: int, prev: list[int], ids: list[int]) -> list[int]:
    """Ids of the best path to ``end``."""
    out = []
    while end:
        start, piece = prev[end], ids[end]
        if piece >= 0:
            out.append(piece)
        elif own.bytes:
            out.extend(own.bytes[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
        else:
            out.append(own.unknown)
        end = start
    out.reverse()
    return out


class Pieces:
    """The pieces of a model file with what the search needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        normalizer, kind_of_model = {1: b"identity", 3: 1, 4: 1, 5: 1}, 1
        for number, value in fields(data):
            if number == 1:
                one = dict(fields(value))
                score = struct.unpack("<f", one[2])[0] if 2 in one else 0.0
                self.pieces.append((one.get(1, b"").decode(), score, one.get(3, NORMAL)))
            elif number == 2:
                kind_of_model = dict(fields(value)).get(3, 1)
            elif number == 3:
                normalizer |= dict(fields(value))
        if kind_of_model == BPE:
            self.pieces = [(p, s if kind not in (NORMAL, USER) else by_rank(-s, len(self.pieces)), kind) for p, s, kind in self.pieces]
        if normalizer[1] != b"identity" or normalizer[4] or not normalizer[5]:
            raise ValueError("only models with identity normalisation that keep and escape spaces are supported")
        self.dummy_prefix = bool(normalizer[3])
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)
        self.longest = max((len(p) for _, p, _ in usable), default=1)
        self.unknown_score = min((s for _, _, s in usable), default=0.0) - UNKNOWN_PENALTY
        #: By first letter, then by each next one: the piece that ends there (-1: none), its score, and what goes on.
        self.trie: dict[str, tuple] = {}
        whole = {p: (i, s) for i, p, s in usable}
        begun: dict[str, dict] = {"": self.trie}
        for p in sorted({p[:k] for p in whole for k in range(1, len(p) + 1)}):
            begun[p] = {}
            begun[p[:-1]][p[-1]] = (*whole.get(p, (-1, 0.0)), begun[p])
        joined = {c for _, p, _ in usable if len(p) > 1 for c in p}
        self.alone = re.compile(f"([^{re.escape(''.join(sorted(joined)))}])") if joined else re.compile("(.)", re.S)
        self.marks_lead = all(MARK not in p.lstrip(MARK) for _, p, _ in usable)
        self.out = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]
        self.kept: dict[str, tuple[int, ...]] = {}
        self.kept_bytes = 0

    # -- search ------------------------------------------------------------------------

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the normalised text that the chunks make, committed as soon as they are sure."""
        open_, search, last = "", None, ""
        for chunk in chunks:
            for unit in self.units(chunk):
                if unit[0] == MARK and last not in ("", MARK) and self.marks_lead:
                    yield list(search.finish() if search else self.unit(open_))
                    open_, search = "", None
                last = unit[-1]
                if search is None:
                    open_ += unit
                    if len(open_) <= LONGEST_KEPT:
                        continue
                    search, unit, open_ = Search(self), open_, ""
                yield search.push(unit)
        if search or open_:
            yield list(search.finish() if search else self.unit(open_))

    def units(self, text: str) -> list[str]:
        """Cut before space marks that no piece has inside."""
        return _UNIT.findall(text) if self.marks_lead else [text] if text else []

    def part(self, part: str) -> tuple[int, ...]:
        """Ids of a part that no piece reaches across the ends of."""
        found = self.kept.get(part)
        if found is None:
            n = len(part) + 1
            best, prev, ids = [_NEVER] * n, [0] * n, [-1] * n
            best[0] = 0.0
            relax(self, part, 0, n - 1, best, prev, ids)
            found = tuple(traced(self, part, n - 1, prev, ids))
            size = 200 + 4 * len(part) + 16 * len(found)
            if self.kept_bytes + size > KEPT_BYTES:
                self.kept, self.kept_bytes = {}, 0
            self.kept[part] = found
            self.kept_bytes += size
        return found

    def unit(self, unit: str) -> Iterable[int]:
        found = self.kept.get(unit)
        if found is not None:
            return found
        if len(unit) > LONGEST_KEPT:
            search = Search(self)
            return [i for at in range(0, len(unit), CHUNK) for i in search.push(unit[at : at + CHUNK])] + search.finish()
        return [i for p in self.alone.split(unit) if p for i in self.part(p)]

    # -- whole texts -------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        return ((" " if self.dummy_prefix and text else "") + text).replace(" ", MARK)

    def encode(self, text: str | None) -> list[int]:
        text = self.normalise(text or "")
        return [i for ids in self.stream(text[at : at + CHUNK] for at in range(0, len(text), CHUNK)) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def loaded(broadcast) -> Pieces:
    """The model in this worker; one is kept."""
    data = broadcast.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(data)
    return _LOADED[key]


def encode_batch(model: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids.  Texts without doubled or leading spaces go word by word through one vocabulary."""
    n = len(texts)
    plain = pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")))
    easy = np.flatnonzero(pc.and_(plain, pc.greater(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)) if model.marks_lead and model.dummy_prefix else np.zeros(0, np.int64)
    counts = np.zeros(n, dtype=np.int64)
    flat: list[np.ndarray] = []
    if len(easy):
        split = pc.split_pattern(texts.take(pa.array(easy)), " ")
        coded = split.flatten().dictionary_encode()
        made = [model.unit(MARK + w) for w in coded.dictionary.to_pylist()]
        lens = np.array([len(x) for x in made], dtype=np.int64)
        pool = np.array([i for x in made for i in x], dtype=np.int32)
        starts = np.cumsum(lens) - lens
        words = coded.indices.to_numpy(zero_copy_only=False)
        per = lens[words]
        ends = np.cumsum(per)
        gather = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[words] - (ends - per), per)
        flat.append(pool[gather])
        of = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        total = np.concatenate([[0], ends])
        counts[easy] = total[of[1:]] - total[of[:-1]]
    if len(easy) == n:
        return np.concatenate([[0], np.cumsum(counts)]), flat[0]
    hard = np.setdiff1d(np.arange(n), easy)
    own = [np.array(model.encode(t), dtype=np.int32) for t in texts.take(pa.array(hard)).to_pylist()]
    counts[hard] = [len(x) for x in own]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], dtype=np.int32)
    is_easy = np.zeros(n, dtype=bool)
    is_easy[easy] = True
    out[np.repeat(is_easy, counts)] = flat[0] if flat else np.zeros(0, np.int32)
    if own:
        out[np.repeat(~is_easy, counts)] = np.concatenate(own)
    return offsets, out


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids and decoded_sha256 (of the text that the ids decode to) of every row."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(Path(model_file).read_bytes())

    def run(batches):
        own = loaded(model)
        for batch in pieces(batches):
            offsets, ids = encode_batch(own, text_column(batch))
            listed = ids.tolist()
            sha = [hashlib.sha256(own.decode(listed[a:b]).encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_ids": pa.array(np.diff(offsets)), "ids": lists(offsets, pa.array(ids)), "decoded_sha256": pa.array(sha, pa.string())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text that ``ids`` stand for; null ids give a null text."""
    spark = prepare(encoded.sparkSession)
    model = spark.sparkContext.broadcast(Path(model_file).read_bytes())

    def run(batches):
        own = loaded(model)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array([None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()], pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
