"""Exact repeats of long byte strings by a logarithmic family of sparse suffix arrays.

Of the suffixes of a text those are sampled that start at an anchor: the place where the hash of SEED bytes is least in some window of
``length`` bytes, the leftmost of equals. Equal windows have the same anchor, so no repeat of ``length`` bytes is missed.
Each anchor owns the windows it is the least of; the bytes they span are its block.

A batch's suffix array holds its sampled suffixes in the order of (hash of the seed, hash of the block, document, place). It is merged with
the arrays of the levels in that order: suffixes of one seed stand together, and among them equal blocks. The first of
equal blocks stays and goes into the batch's own array, which becomes a level; all windows of the others repeat an earlier
text. Where blocks of one seed differ, their windows are compared afterwards: byte by byte in one task if a seed has few blocks, by a
shuffle of 128-bit hashes of the windows if it has many. When two levels hold as many
batches, the next batch's pass writes them as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import discard, list_array, small_batches, stored
from lodestar.llm.shingles import _upto, mix

LENGTH, SEED = 100, 16
BATCHES = 3
#: Bytes of a text that are sampled at a time; places within fit into the low bits of a hash.
STEP, LOW = 1 << 19, 20
#: Blocks of a seed that a task may hold to compare their windows; rows of window hashes that it holds and hands on at a time.
HELD, ROWS = 4096, 1 << 17
#: Where rows come from: levels that become one, other levels, the batch. Rows of levels are earlier than the batch's.
MERGING, LEVEL, BATCH = 0, 1, 2


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, seed hash, block hash) of the anchors of a text."""
    parts = []
    for start in range(0, max(1, len(data) - length + 1), STEP):
        part = data[start : start + STEP + length - 1]
        if len(part) < length:
            continue
        n, w = len(part), length - SEED + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _upto("base", n), out=sums[1:])
        inverse = _upto("inverse", n + 1)
        seeds = mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1])
        low = np.uint64((1 << LOW) - 1)
        marked = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
        least, span = marked, 1
        while span * 2 <= w:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < w:
            least = np.minimum(least[: len(marked) - w + 1], least[w - span :])
        at = (least & low).astype(np.int64)
        turn = np.flatnonzero(np.diff(at)) + 1
        lo, hi = np.append(0, turn), np.append(turn - 1, len(at) - 1)
        place = at[lo]
        block = mix(mix((sums[hi + length] - sums[lo]) * inverse[lo]) + ((hi - lo) * 256 + place - lo).astype(np.uint64))
        parts.append((place + start, lo + start, hi + start, seeds[place], block))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2


def _packed(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place, windows before it and windows at all, in one integer that sorts by place; lengths are below 1024."""
    return place << 20 | (place - lo) << 10 | (hi - lo)


def _windows(packed):
    """(place, first window, last window)."""
    place, before = packed >> 20, packed >> 10 & 1023
    return place, place - before, place - before + (packed & 1023)


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(seed, block, doc, packed, again) of the sampled suffixes of (doc, text). Equal blocks of one Arrow batch are combined before
    the shuffle: all but the first are known to be repeats, and have a seed that spreads them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place, lo, hi, seed, block = anchors(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8), length)
                found.append((seed, block, np.full(len(place), doc, np.int64), _packed(place, lo, hi)))
            if not found:
                continue
            seed, block, doc, packed = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((packed, doc, block, seed))
            seed, block, doc, packed = seed[order], block[order], doc[order], packed[order]
            again = np.zeros(len(seed), bool)
            again[1:] = (seed[1:] == seed[:-1]) & (block[1:] == block[:-1])
            seed[again] = (doc[again] >> 3).astype(np.uint64)
            block[again] = 0
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(block.view(np.int64)), pa.array(doc), pa.array(packed), pa.array(again)], names=["seed", "block", "doc", "packed", "again"])

    return docs.select("doc", "text").mapInArrow(run, "seed long, block long, doc long, packed long, again boolean")


class SuffixLevels:
    """The family of suffix arrays. Batches have to come in the order of their documents."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, array); the largest first
        self.found: list[DataFrame] = []
        self.tables: list[DataFrame] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Take a batch (doc, text) in. Returns (doc, packed) of its suffixes whose blocks are repeats.

        Levels of one size become one in the same pass: their rows meet in the order of seeds anyway, and are written as one array.
        """
        merging: tuple[int, DataFrame] | None = None
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merging = (n + m, a.union(b))
            self.levels.append(merging)
        rows = suffixes(docs, self.length).withColumn("age", F.lit(BATCH))
        for level in self.levels:
            rows = rows.union(level[1].select("*", F.lit(False), F.lit(MERGING if level is merging else LEVEL)))
        same = Window.partitionBy("seed", "again", "block")
        first = (F.row_number().over(same.orderBy("age", "doc", "packed")) == 1) & ~F.col("again")
        merged = rows.repartition("seed").withColumn("first", first)
        firsts = F.sum(F.col("first").cast("int")).over(Window.partitionBy("seed", "again"))
        merged = merged.withColumn("differs", firsts > 1).where(f"age <> {LEVEL} OR differs")
        repeat = (F.col("age") == BATCH) & ~F.col("first")
        named = [F.when(~repeat, F.col(c)).alias(c) for c in ("seed", "block")]
        merged = stored(merged.select(*named, "doc", "packed", "age", (F.col("differs") & ~repeat).alias("differs")), "suffix-array")
        self.tables.append(merged)
        if merging:
            self.levels[-1] = (merging[0], merged.where(F.col("age") == MERGING).drop("age", "differs"))
        self.levels.append((1, merged.where((F.col("age") == BATCH) & F.col("seed").isNotNull()).drop("age", "differs")))
        self.found.append(merged.where("differs").drop("age", "differs"))
        return merged.where(F.col("seed").isNull()).select("doc", "packed")

    def undecided(self) -> DataFrame:
        """(seed, doc, packed) of suffixes of seeds with different blocks; one that later batches met again comes again."""
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return out.select("seed", "doc", "packed")


def compare(undecided: DataFrame, texts: DataFrame, length: int) -> list[DataFrame]:
    """Tables (doc, lo, hi): runs of windows of undecided suffixes that equal a window of an earlier one.

    Windows of a seed with at most HELD blocks are compared in one task, those of other seeds by their hashes, so that no task holds
    more than HELD blocks. The table of seeds with more is broadcast; it has at most a row for HELD undecided suffixes.
    Either comparison shuffles the texts, so each is stored before the other starts and its shuffle files go.
    """
    small_batches(texts.sparkSession)
    many = stored(undecided.groupBy("seed").count().where(F.col("count") > HELD).select("seed"), "frequent-seeds")
    if many.isEmpty():
        return [stored(_compare_held(undecided, texts, length), "held-runs")]
    few = undecided.join(F.broadcast(many), "seed", "left_anti")
    return [stored(_compare_held(few, texts, length), "held-runs"), stored(_compare_hashed(undecided.join(F.broadcast(many), "seed", "left_semi"), texts, length), "hashed-runs")]


def _compare_hashed(undecided: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi) of single windows: all but the first of equal 128-bit hashes. A task meets ROWS windows at a time and hands on the
    first of equal ones; the others are known to be repeats, and have a hash that spreads them. So a window that very many texts hold
    has a row for ROWS windows, and one shuffle and sort find the first of the rest."""
    by_doc = undecided.groupBy("doc").agg(F.collect_set("packed").alias("at"))
    kinds = {"window": pa.binary(), "doc": pa.int64(), "lo": pa.int64(), "again": pa.bool_()}

    def rows(first: dict[bytes, tuple[int, int]], again: list[tuple[int, int]]) -> pa.RecordBatch:
        at = [*first.values(), *again]
        own = [*first, *(doc.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big") for doc, lo in again)]
        columns = (own, [x[0] for x in at], [x[1] for x in at], [False] * len(first) + [True] * len(again))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds.values(), strict=True)], names=[*kinds])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}
        again: list[tuple[int, int]] = []
        for batch in batches:
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for packed in at.as_py():
                    _, lo, hi = _windows(packed)
                    for k in range(lo, hi + 1):
                        window, here = hashlib.blake2b(data[k : k + length], digest_size=16).digest(), (doc, k)
                        there = first.setdefault(window, here)
                        if there != here:
                            first[window] = min(here, there)
                            again.append(max(here, there))
                    if len(first) + len(again) >= ROWS:
                        yield rows(first, again)
                        first, again = {}, []
        yield rows(first, again)

    found = texts.join(by_doc, "doc").select("doc", "text", "at").mapInArrow(hashed, "window binary, doc long, lo long, again boolean")
    nth = F.row_number().over(Window.partitionBy("window", "again").orderBy("doc", "lo"))
    return found.withColumn("nth", nth).where("again OR nth > 1").select("doc", "lo", F.col("lo").alias("hi"))


def _compare_held(undecided: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi): runs of windows of undecided suffixes that equal a window of an earlier one of the same seed.

    Bytes of the suffixes' blocks are cut out of the texts, then sorted by seed. A seed's windows are compared by where the seed
    lies in them, too; equal windows have it at the same place.
    """
    by_doc = undecided.groupBy("doc").agg(F.collect_set(F.struct("seed", "packed")).alias("at"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for x in at.as_py():
                    _, lo, hi = _windows(x["packed"])
                    for column, value in zip(out, (x["seed"], doc, x["packed"], data[lo : hi + length]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["seed", "doc", "packed", "block"])

    blocks = texts.join(by_doc, "doc").select("doc", "text", "at").mapInArrow(cut, "seed long, doc long, packed long, block binary")

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, set()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for seed, doc, packed, block in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if seed != now:
                    now, seen = seed, set()
                _, lo, hi = _windows(packed)
                own = [block[k : k + length] for k in range(hi - lo + 1)]
                run = -1
                for k, window in enumerate(own):
                    if window in seen:
                        run = k if run < 0 else run
                    elif run >= 0:
                        _append(out, doc, lo + run, lo + k - 1)
                        run = -1
                if run >= 0:
                    _append(out, doc, lo + run, hi)
                seen.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc", "lo", "hi"])

    return blocks.repartition("seed").sortWithinPartitions("seed", "doc", "packed").mapInArrow(match, "doc long, lo long, hi long")


def _append(columns: tuple[list, ...], *row: int) -> None:
    for column, value in zip(columns, row, strict=True):
        column.append(value)


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of half-open intervals; those that touch become one."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > reach[:-1]) if len(lo) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return lo[at], reach[np.append(at[1:], len(lo)) - 1] if len(at) else reach[:0]


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its other columns, n_bytes, ``spans`` (start, end of the maximal removed runs of bytes) and ``kept`` (the bytes
    left, in place of the text).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a document with a smaller id, or earlier in its own.
    Strings never cross documents and are judged on the input. With ``whole_characters`` a run is narrowed to whole UTF-8
    characters, so that ``kept`` is text. Null and short texts lose nothing; null texts have 0 bytes and keep none. Rows with a
    null id are left whole and remove nothing. Rows that repeat an id count as documents of their own, in the order of their
    texts; of equal rows the first stays whole. Ids have to be integers. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    carried = [f"x{k}" for k in range(len(others))]
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(x) for c, x in zip(others, carried, strict=True)))
    known = base.where(F.col("doc").isNotNull())
    repeated = known.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    if repeated:
        carried.append("own_id")
        ordered = known.withColumn("own_id", F.col("doc")).repartitionByRange("doc", "text").sortWithinPartitions("doc", "text")
        known = stored(ordered.withColumn("doc", F.monotonically_increasing_id()), "ordered-texts")
    texts = known.select("doc", "text")
    cuts = texts.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    levels = SuffixLevels(length)
    repeats = None
    for after, upto in zip(edges, edges[1:], strict=False):
        batch = texts if after is None else texts.where(F.col("doc") > after)
        found = levels.add(batch if upto is None else batch.where(F.col("doc") <= upto))
        repeats = found if repeats is None else repeats.union(found)
    place, before, count = F.shiftright("packed", 20), F.shiftright("packed", 10).bitwiseAND(1023), F.col("packed").bitwiseAND(1023)
    runs = stored(repeats.select("doc", (place - before).alias("lo"), (place - before + count).alias("hi")), "repeats")
    undecided = stored(levels.undecided(), "undecided")
    for table in levels.tables:  # what is read of them later is stored by now
        discard(table)
    parts = [runs, *compare(undecided, texts, length)]
    for more in parts[1:]:
        runs = runs.union(more)
    runs = stored(runs.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list(F.col("hi") + length).alias("hi")), "runs")
    for table in (undecided, *parts):
        discard(table)

    @F.arrow_udf("struct<n_bytes:long,starts:array<long>,ends:array<long>,kept:binary>")
    def apply(texts: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        size, starts, ends, kept = [], [], [], []
        for text, lo, hi in zip(texts, los, his, strict=True):
            raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
            a, b = _union(lo.values.to_numpy(), hi.values.to_numpy()) if lo.is_valid else (np.zeros(0, np.int64),) * 2
            if whole_characters and len(a):
                first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters start
                a, b = first[np.searchsorted(first, a, "left")], first[np.searchsorted(first, b, "right") - 1]
                a, b = a[a < b], b[a < b]
            step = np.zeros(len(raw) + 1, np.int8)
            step[a] = 1
            step[b] -= 1
            size.append(len(raw))
            starts.append(a)
            ends.append(b)
            kept.append(raw[np.cumsum(step[:-1]) == 0].tobytes())
        made = [pa.array(size, pa.int64()), list_array(starts, pa.int64()), list_array(ends, pa.int64()), pa.array(kept, pa.binary())]
        return pa.StructArray.from_arrays(made, names=["n_bytes", "starts", "ends", "kept"])

    # other columns stay beside the text, so neither it nor what is kept is shuffled for them
    out = known.join(runs, "doc", "left").select("doc", apply("text", "lo", "hi").alias("r"), *carried).select("doc", "r.*", *carried)
    none = F.lit(None).cast("array<bigint>")
    whole = base.where(F.col("doc").isNull())
    whole = whole.select(F.col("doc"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.col("text").cast("binary").alias("kept"), *(F.lit(None).cast("long").alias(x) if x == "own_id" else F.col(x) for x in carried))
    out = out.unionByName(whole)
    spans = F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans")
    names = {c: F.col(x) for c, x in zip(others, carried, strict=False)} | {id_col: F.col("own_id" if repeated else "doc")}
    return out.select(*(names[c].alias(c) for c in docs.columns if c != text_col), "n_bytes", spans, "kept")
