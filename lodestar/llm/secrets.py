"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
#: A run of these that is long enough may hold a secret by the models; shorter ones teach what is ordinary.
RUN, ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Parts of a run; names that are random but no secrets; what a part of a secret has to look like: letters with a digit among them.
PART, UUID = re.compile(r"[A-Za-z0-9]+"), re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
MIXED = re.compile(r"(?=[A-Za-z]*[0-9])(?=(?:[0-9]*[A-Za-z]){3})[A-Za-z0-9]{10,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
EDGE = len(ALPHABET)
STATES = EDGE + 1
#: A stretch of a run is a secret if it is this long and its log-likelihood ratio, and the ratio per character, reach these.
LEAST, MIN_RATIO, MIN_RATIO_PER_CHAR = 16, 12.0, 0.5
#: Counts that single characters weigh in each row of a model.
PRIOR = 20
_CODE = np.full(256, EDGE, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(EDGE)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _free(text: str, pattern: re.Pattern, spans: list) -> Iterator[re.Match]:
    """Matches of ``pattern`` in the parts of the text that lie outside the spans; spans are sorted by start and may overlap."""
    at = 0
    for start, _, end, _ in spans:
        if start > at:
            yield from pattern.finditer(text, at, start)
        at = max(at, end)
    yield from pattern.finditer(text, at)


def transitions(strings: Iterable[str]) -> np.ndarray:
    """Counts of neighbouring characters, with an edge before and after each string."""
    codes = _CODE[np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("ascii"), np.uint8)]
    return np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios [before, after] of the two models, from counts over all documents.

    Samples are labelled by the fixed patterns: values they find are random strings, other runs of 8 characters or more are
    ordinary identifiers, as they stand, in capitals and with a capital, so that constants and names in any writing are ordinary.
    Tasks count pairs of characters, Spark adds them up; at most 2 x 68 x 68 rows come to the driver. Without any sample the
    ratio is 0 everywhere.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            ordinary: list[str] = []
            random: list[str] = []
            for text in batch["text"]:
                spans = base_spans(text)
                random += [text[v:end] for _, _, end, v in spans]
                ordinary += [m[0] for m in _free(text, ORDINARY, spans)]
            parts = [x for run in ordinary for x in PART.findall(run)]
            for written in (ordinary, map(str.upper, parts), map(str.title, parts)):
                total[0] += transitions(written)
            total[1] += transitions(random)
        kind, pair = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "pair": pair, "n": total[kind, pair]})

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(count, "kind long, pair long, n long")
    grid = np.zeros((2, STATES * STATES))
    for kind, pair, n in counted.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        grid[kind, pair] += n
    return ratios(grid.reshape(2, STATES, STATES))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios from counts [ordinary or random, before, after]: a row leans on single characters by PRIOR counts."""
    counts[:, EDGE, EDGE] = 0
    single = counts.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    p = np.log((counts + PRIOR * single) / (counts.sum(axis=2, keepdims=True) + PRIOR))
    return p[1] - p[0]


def ratio(run: str, model: np.ndarray) -> float:
    codes = _CODE[np.frombuffer(f"\n{run}\n".encode("ascii"), np.uint8)]
    return float(model[codes[:-1], codes[1:]].sum())


def stretches(run: str, model: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the parts of a run, one after another, whose summed ratios are largest: a key after an ordinary part, or
    between two, is scored by itself. A sum that falls below 0 starts anew; what stands in a UUID counts as ordinary."""
    named = [m.span() for m in UUID.finditer(run)]
    total, best, open_ = 0.0, None, None
    for m in PART.finditer(run):
        x = -MIN_RATIO if any(a <= m.start() < b for a, b in named) else ratio(m[0], model)
        if total + x <= 0:
            if best:
                yield best
            total, best, open_ = 0.0, None, None
            continue
        open_ = m.start() if open_ is None else open_
        total += x
        if best is None or total > best[2]:
            best = (open_, m.end(), total)
    if best:
        yield best


def find(text: str, model: np.ndarray) -> tuple[list[tuple[str, int, int, float]]]:
    """All spans as (kind, start, end, score); a fixed pattern's score is null."""
    base = base_spans(text)
    spans = [(s, k, e, None) for s, k, e, _ in base]
    for m in _free(text, RUN, base):
        if MIXED.search(m[0]):
            for start, end, x in stretches(m[0], model):
                if end - start >= LEAST and x >= max(MIN_RATIO, MIN_RATIO_PER_CHAR * (end - start)) and MIXED.search(m[0], start, end):
                    spans.append((m.start() + start, 3, m.start() + end, x))
    return ([(KINDS[k], s, e, x) for s, k, e, x in sorted(spans, key=lambda x: x[:2])],)


def scan(docs: DataFrame, model: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``spans``: kind, start, end (code points, end exclusive) and score, by start and kind.

    Without ``model`` the models are trained on ``docs`` first. A model's spans never overlap those of the fixed patterns.
    A null or empty text has no spans; repeated rows and null ids keep their own row; an empty table gives an empty result.
    """
    model = train(docs, id_col, text_col) if model is None else model
    return map_texts(docs, lambda: lambda text: find(text, model), "spans array<struct<kind:string,start:int,end:int,score:double>>", id_col, text_col)


def mask(docs: DataFrame, model: np.ndarray | None = None, fill: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``fill``; a pattern's key word goes with its value. Overlapping spans become one.

    All columns stay; a null text stays null.
    """
    model = train(docs, id_col, text_col) if model is None else model
    small_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at, reach = [], 0, -1
        for _, start, end, _ in find(text, model)[0]:
            if start >= reach:
                out += [text[at:start], fill]
            reach = at = max(reach, end)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action=None)

    return docs.withColumn(text_col, masked(F.col(text_col)))
