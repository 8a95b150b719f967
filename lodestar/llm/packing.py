"""Packing token sequences into windows: overlong documents are cut into full windows, the rest packed best fit decreasing.

A segment tree over remaining capacities finds the tightest open window. Remainders are dealt into groups by a hash of the
document and start; the number of groups follows the number of tokens, so groups stay of one size however large the
corpus, and each wastes less than a window or so.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import list_array, small_batches, stored

WINDOW = 4096
#: Tokens of remainders in a group, on average.
GROUP_TOKENS = 1024 * WINDOW
#: Parts of texts whose ids a task remembers; a full memo starts anew.
MEMO = 1 << 20
#: White space by Unicode; str.split() would also split at the control characters 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
MARKS = frozenset(".,;:!?")
_NOT_SPACE = re.compile("[\x1c-\x1f]")


class Words:
    """Ids by a tokenizer that lowers case and whose tokens cross neither white space nor the edges of a run of letters.

    Parts between white space that recur come from a bounded memo, as bytes of 32-bit ids. A part of letters, with a mark
    after it at most, is looked up as its lower-case letters and the mark; new words of letters are encoded in one text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, parts: set[str]) -> None:
        """Put parts that the memo lacks into it."""
        memo, words, other, made = self.memo, set(), set(), []
        for part in parts:
            stem, mark = (part[:-1], part[-1]) if part[-1] in MARKS else (part, "")
            if stem.isalpha() and "\u0130" not in stem and "\u03a3" not in stem and unicodedata.is_normalized("NFC", stem):
                stem = stem.lower()
                made.append((part, stem, mark))
                words.add(stem)
                other.add(mark or ",")
            else:
                other.add(part)
        words = [w for w in words if w not in memo]
        if words:
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids, of = np.asarray(found.ids, "<u4"), np.asarray(found.word_ids)
            ends = np.searchsorted(of, np.arange(len(words)), "right").tolist()
            start = 0
            for word, end in zip(words, ends, strict=True):
                memo[word] = ids[start:end].tobytes()
                start = end
        other = [x for x in other if x not in memo]
        for part, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[part] = np.asarray(found.ids, "<u4").tobytes()
        for part, stem, mark in made:
            memo[part] = memo[stem] + memo[mark] if mark else memo[stem]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if any(x in text for x in self.special):
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                continue
            parts = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
            self.memo[""] = b""
            new = set(parts).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                self.memo[""] = b""
                new = set(parts).difference(self.memo)
            if new:
                self.learn(new)
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), "<u4")


@lru_cache(2)
def load(path: str) -> Words:
    """Once in each worker process."""
    return Words(path)


def tokens(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids, ids_crc32, doc_tokens): the ids of each whole text and ``end_id``, cut every ``window`` tokens.

    A null or empty text is one piece with the end id alone; repeated rows and null ids keep pieces of their own.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        for batch in batches:
            rows, ids = [], []
            for row, found in enumerate(words.encode(batch.column(1).to_pylist())):
                every = np.append(found, np.uint32(end_id))
                for start in range(0, len(every), window):
                    piece = every[start : start + window]
                    rows.append((row, start, len(piece), zlib.crc32(piece.tobytes()), len(every)))
                    ids.append(piece)
            row, start, length, crc, n = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), list_array(ids, pa.int32()), pa.array(crc, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts: the tightest one that fits is found in log(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, capacity: int, window: tuple[int, int]) -> None:
        if capacity:
            self.stacks[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """(capacity, window) of the smallest capacity that is at least ``need``, taken out."""
        k, count = need + self.size, self.count
        if not count[k]:
            while k > 1 and not (k % 2 == 0 and count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k + (not count[2 * k])
        capacity = k - self.size
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


class BestFit:
    """Sequences of a group, filled by pieces of falling length."""

    def __init__(self, window: int):
        self.window, self.free, self.n = window, OpenWindows(window), 0

    def put(self, need: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        found = self.free.tightest(need)
        if found is None:
            at, used, self.n = self.n, 0, self.n + 1
        else:
            at, used = found[1]
        self.free.put(self.window - used - need, (at, used + need))
        return at, used


def pack(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece lies whole in one sequence, and sequences are gapless from offset 0.

    Full pieces are sequences of their own. All columns of ``pieces`` are kept. Ids of sequences are the group's number
    times 2^32 plus a number in the group. Pieces that tie in length go by id and start, so results don't depend on how
    rows are dealt out; repeated rows are packed each. Pieces come sorted and are placed one by one, so a task holds open
    windows and one Arrow batch, not its group. An empty table gives an empty result.
    """
    small_batches(pieces.sparkSession)
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // GROUP_TOKENS))
    group = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "start"), F.lit(groups))
    names = pieces.columns
    dealt = pieces.select(group.alias("_group"), F.col("length").alias("_need"), *names)
    sorted_ = dealt.repartition("_group").sortWithinPartitions("_group", F.desc("_need"), id_col, "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, BestFit(window)
        for batch in batches:
            sequence, offset = [], []
            for key, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    now, fit = key, BestFit(window)
                at, used = fit.put(need)
                sequence.append((key << 32) + at)
                offset.append(used)
            kept = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return sorted_.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` and their places. Token ids stay where they were made unless ``keep_ids``: only places and checksums are shuffled."""
    made = tokens(docs, path, end_id, window, id_col, text_col)
    return pack(stored(made if keep_ids else made.drop("ids"), "pieces"), window, id_col)
