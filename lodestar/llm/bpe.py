"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding by an incremental byte-to-text state machine.

A sequence of tokens is the encoding of its text exactly if each token encodes to itself and no merge joins two neighbours
(every neighbouring pair encodes to itself): merges inside a pair happen in the same order wherever the pair stands. So
each prefix of a text has one last token, and the prefixes' last tokens make a tree of paths back to the start.

No token is longer than the longest one in the merge list. That length is the sufficient lookahead: whatever follows, a
token must end within the last ``lookahead`` places, so tokens that the paths from all those places share are stable.
They are emitted and forgotten; what is kept doesn't grow with the text. When the end is known, what is left is at most a few
lookaheads long, and its one path is sought from the longest tokens on.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestar.llm.common import list_array, small_batches

_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces of text that no pre-token crosses: a run without white space with at most one space before it, or white space.
CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Entries of a task's memo of chunks' ids; a full one is kept until the next is full, so that what recurs stays.
MEMO = 1 << 19
#: Pairs of tokens whose answers a task remembers.
PAIRS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A merge list over bytes: ranks, token bytes, and the questions the transducer asks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        made = {token: (rank, a, b) for (a, b), (rank, token) in self.merges.items()}
        self.made = made if len(made) == len(self.merges) else None  # how each token is made, if in one way
        self.lookahead = max(map(len, self.ids))
        self.pieces: dict[bytes, int] = {}  # tokens that encode to themselves; -1 for other beginnings of tokens
        for data, token in self.ids.items():
            for k in range(1, len(data)):
                self.pieces.setdefault(data[:k], -1)
            if self.merged(data) == [token]:
                self.pieces[data] = token
            else:
                self.pieces.setdefault(data, -1)
        self.longest = {"": -1}  # the longest of those tokens that starts each beginning, whose bytes are letters of Latin-1 here
        found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for data in sorted(self.pieces, key=len):
            letters_ = data.decode("latin-1")
            self.longest[letters_] = self.pieces[data] if self.pieces[data] >= 0 else self.longest.get(letters_[:-1], -1)
            found.add_word(letters_, 0)
        self.beginning = found.longest_prefix
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.shorter = {i: self.longest.get(b[:-1].decode("latin-1"), -1) for i, b in self.bytes.items()}  # the next shorter one
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.shift = max(self.bytes).bit_length()
        self._apart: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}  # 32-bit ids
        self._older: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: the best-ranked pair merges first, the leftmost of equals."""
        ids = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 30, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        pair = left << self.shift | right
        known = self._apart.get(pair)
        if known is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            known = self._apart[pair] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        """Go back in time over the tokens at the border: whichever was made last is taken apart, and a merge across the border that
        ranks before what ended that state would have come first. Of equal ranks the leftmost merge comes first."""
        merges, made = self.merges, self.made
        if made is None:
            return self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        ended = 1 << 30
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < ended:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                ended, left = a[0], a[2]
            else:
                ended, right = b[0] + 1, b[1]


class Transducer:
    """Takes bytes of one pre-token and gives tokens once no continuation can change them."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.data = b""  # bytes from the last emitted place on
        self.last: list[int | None] = [None]  # the last token of the prefix that ends at each place
        self.before: int | None = None  # the token emitted last
        self.done = 0  # places from which tokens have been sought

    def _advance(self, until: int) -> None:
        """Seek the tokens that start at each place before ``until``; every prefix has a last token, so every place is reached."""
        pieces, apart, data, last, longest = self.m.pieces, self.m.apart, self.data, self.last, self.m.lookahead
        for start in range(self.done, until):
            left = last[start] if start else self.before
            for end in range(start + 1, min(len(data), start + longest) + 1):
                token = pieces.get(data[start:end])
                if token is None:
                    break
                if token >= 0 and last[end] is None and (left is None or apart(left, token)):
                    last[end] = token
        self.done = max(self.done, until)

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            token = self.last[end]
            out.append(token)
            end -= len(self.m.bytes[token])
        return out[::-1]

    def _emit(self, tokens: list[int]) -> list[int]:
        if tokens:
            n = sum(len(self.m.bytes[t]) for t in tokens)
            self.data, self.last, self.before, self.done = self.data[n:], self.last[n:], tokens[-1], self.done - n
            self.last[0] = None
        return tokens

    def feed(self, data: bytes) -> list[int]:
        self.data += data
        self.last += [None] * len(data)
        self._advance(len(self.data) - self.m.lookahead)
        if self.done < 2 * self.m.lookahead:
            return []
        paths = [self._path(p) for p in range(self.done - self.m.lookahead + 1, self.done + 1)]
        shared = 0
        for column in zip(*paths, strict=False):
            if len(set(column)) > 1:
                break
            shared += 1
        return self._emit(paths[0][:shared])

    def finish(self) -> list[int]:
        """Tokens of what is left, now that its end is known: the longest token that stays apart from the one before it first, and
        shorter ones, or a step back, where no way leads on. A place that led nowhere isn't tried again."""
        m, data, before, start, out, dead = self.m, self.data.decode("latin-1"), self.before, 0, [], set()
        size, shorter, longest, beginning, shift, known, n = m.size, m.shorter, m.longest, m.beginning, m.shift, m._apart, len(self.data)
        token = longest[data[: beginning(data)]] if data else -1
        while start < n:
            while token >= 0:
                end = start + size[token]
                if end not in dead:
                    fine = before is None or known.get(before << shift | token)
                    if fine or fine is None and m.apart(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, start = token, end
                rest = data[end:]
                token = longest[rest[: beginning(rest)]]
            else:
                dead.add(start)
                last = out.pop()
                before, start, token = out[-1] if out else self.before, start - size[last], shorter[last]
        return out


def encode_pre_token(merges: Merges, data: bytes) -> list[int]:
    """Tokens of one pre-token, fed in steps of twice the lookahead; one that is a token by itself needs no search."""
    whole = merges.pieces.get(data, -1)
    if whole >= 0:
        return [whole]
    t, out, step = Transducer(merges), [], 2 * merges.lookahead
    if len(data) <= step:
        t.data = data
        return t.finish()
    for k in range(0, len(data), step):
        out += t.feed(data[k : k + step])
    return out + t.finish()


def encode_chunk(merges: Merges, chunk: str) -> bytes:
    ids = merges._older.get(chunk)
    if ids is None:
        memo, older, out = merges._chunks, merges._older, []
        for piece in PRE_TOKEN.findall(chunk):
            ids = memo.get(piece) or older.get(piece)
            if ids is None:
                ids = array("i", encode_pre_token(merges, piece.encode("utf-8"))).tobytes()
                _keep(merges, piece, ids)
            out.append(ids)
        ids = b"".join(out)
    _keep(merges, chunk, ids)
    return ids


def _keep(merges: Merges, text: str, ids: bytes) -> None:
    if len(text) <= 64:
        if len(merges._chunks) >= MEMO:
            merges._older, merges._chunks = merges._chunks, {}
        merges._chunks[text] = ids


def encode_text(merges: Merges, text: str) -> np.ndarray:
    """Ids of a text; the strings of special tokens become their ids. Chunks that recur are looked up in a bounded memo."""
    out: list[bytes] = []
    memo = merges._chunks
    parts = [text] if merges.split is None or "<" not in text else regex.split(f"({merges.split.pattern})", text)
    for part in parts:
        if len(parts) > 1 and part in merges.special:
            out.append(array("i", [merges.special[part]]).tobytes())
            continue
        chunks = CHUNK.findall(part)
        found = list(map(memo.get, chunks))
        if None in found:
            found = [encode_chunk(merges, c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        out += found
    return np.frombuffer(b"".join(out), np.int32)


def decode_ids(merges: Merges, ids: Iterable[int], block: int = 4096) -> str:
    """Text of ids: blocks of bytes go through a UTF-8 state machine that carries incomplete characters over to the next block.

    Bytes that are no UTF-8 become U+FFFD, one for each maximal wrong part; unknown ids are left out.
    """
    machine, table = codecs.getincrementaldecoder("utf-8")("replace"), merges.bytes
    ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
    out = [machine.decode(b"".join([table.get(i, b"") for i in ids[k : k + block]])) for k in range(0, len(ids), block)]
    return "".join(out) + machine.decode(b"", True)


@lru_cache(2)
def load(path: str) -> Merges:
    """Once in each worker process."""
    return Merges(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row. A null or empty text has no ids; repeated rows and null ids keep their own row;
    a text of any length is encoded whole; other columns are left out whatever their names; an empty table gives an empty result.
    ``path`` is a tokenizer file that all executors have."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in batches:
            ids = [encode_text(merges, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, pa.int32())], names=[id_col, "ids"])

    return source.mapInArrow(run, StructType([StructField(id_col, source.schema["id"].dataType), StructField("ids", ArrayType(IntegerType()))]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): ``encode`` and ``decode`` of each row in one pass, without ids leaving the task between them. Null and empty
    texts have no ids and an empty text; repeated rows and null ids keep their own row; other columns are left out whatever
    their names; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in batches:
            ids = [encode_text(merges, t.as_py()) for t in batch.column(1)]
            texts = [decode_ids(merges, x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids, pa.int32()), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    return source.mapInArrow(run, StructType([StructField(id_col, source.schema["id"].dataType), StructField("ids", ArrayType(IntegerType())), StructField("text", StringType())]))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of each row; null or no ids give an empty text; repeated rows and null ids of rows keep their own row; other
    columns are left out whatever their names; an empty table gives an empty result."""
    small_batches(encoded.sparkSession)
    source = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in batches:
            texts = [decode_ids(merges, x.values.to_numpy().tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    return source.mapInArrow(run, StructType([StructField(id_col, source.schema["id"].dataType), StructField("ids", ArrayType(IntegerType())), StructField("text", StringType())]))
