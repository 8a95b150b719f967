"""Toxicity of texts by a support vector machine with a gap-weighted subsequence string kernel and Nyström landmarks.

Two words are as similar as the subsequences of four characters that they share, each weighted by DECAY to the power of the span it
takes, edges included. An insult whose letters are drawn apart or that has characters put in keeps most of its subsequences, so it
stays near the insult. The kernel of two sentences is the sum of the kernels of their words. Nyström's method maps it to the space of
some landmark words; the machine learns there from labelled sentences: those of clean documents, and of each toxic document
the one that it finds worst, as the others needn't be toxic. As a kernel against landmarks is linear in a word's subsequences, the learned
function folds into one weight for each subsequence, and scoring a new word costs as much as listing its subsequences.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import small_batches, stored

#: Weight of each place of a subsequence's span; distance of its first from its last character at most; hashed subsequences.
DECAY, REACH, FEATURES = 0.6, 5, 1 << 18
SPANS = 8
#: Words are taken in pieces of as many letters, sentences in stretches of as many words, texts in parts of as many characters.
PIECE, SENTENCE, PART = 64, 8, 1 << 20
#: The training sample's bound: different texts with and without the label on average, and characters of each, at a place set by its hash.
TOXIC, CLEAN, SAMPLE_CHARS = 1200, 2400, 6000
LANDMARKS, ASSOCIATED, OTHERS = 256, 900, 600
#: Rounds of choosing sentences; sentences of a toxic document in the first and in later ones, of a clean one in all.
ROUNDS, FIRST, WORST, PER_CLEAN = 4, 12, 2, 6
COST = 0.3
MEMO = 1 << 19
LETTERS = re.compile(r"[\W\d_]+")
MARKS = ".,;:!?…#$%&*\"'()[]-"
END = tuple(".!?…:;。！？؟।")


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed subsequence, weight) of all words, with weights of unit length for each word."""
    text = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    keys = []
    for last in range(3, REACH + 1):
        at = np.flatnonzero(owner[: len(owner) - last] == owner[last:]) if len(owner) > last else np.zeros(0, np.int64)
        for inner in combinations(range(1, last), 2):
            h = text[at]
            for x in (text[at + k] for k in (*inner, last)):
                h = (h * np.uint64(0x100000001B3) ^ x) * np.uint64(0x9E3779B97F4A7C15)
            keys.append((owner[at] * FEATURES + (h >> np.uint64(40)).astype(np.int64) % FEATURES) * SPANS + last)
    key, span = np.divmod(np.sort(np.concatenate(keys)), SPANS)
    weight = (DECAY ** (np.arange(SPANS) + 1))[span]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    word, feature = np.divmod(key[first], FEATURES)
    length = np.sqrt(np.bincount(word, weight * weight, len(words)))
    return word, feature, weight / length[word]


@dataclass
class Model:
    weights: np.ndarray  # of each hashed subsequence
    bias: float
    slope: float  # from a document's worst sentence to log-odds
    offset: float

    def words(self, words: list[str]) -> np.ndarray:
        """The decision function's part of each word."""
        word, feature, weight = subsequences(words)
        return np.bincount(word, weight * self.weights[feature], len(words))

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -500, 500)))


def pieces(token: str) -> list[str]:
    """The letters of a token, in stretches of at most PIECE; marks and digits between them are taken out."""
    own = token.strip(MARKS)
    own = own if own.isalpha() else LETTERS.sub("", own)
    return [own] if 0 < len(own) <= PIECE else [own[k : k + PIECE] for k in range(0, len(own), PIECE)]


def parts(text: str) -> Iterator[list[str]]:
    """Tokens of the text between blanks, a part at a time; parts end at a blank if there is one."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PART else max(text.rfind(" ", at + 1, at + PART), text.rfind("\n", at + 1, at + PART))
        end = at + PART if end <= at else end
        yield text[at:end].lower().split()
        at = end


def starts(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where sentences start: at a text's first word, behind a closing mark, and after each SENTENCE words."""
    new = first.copy()
    new[1:] |= ends[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.flatnonzero((np.arange(len(new)) - begin) % SENTENCE == 0)


class Words:
    """A bounded memo of tokens: the number, part of the decision function, closing mark and single letter of each."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.value, self.ends, self.letter = np.zeros(MEMO), np.zeros(MEMO, bool), np.zeros(MEMO, bool)

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for k in range(0, len(tokens), MEMO // 4):
            own = tokens[k : k + MEMO // 4]
            if len(self.known) > MEMO - MEMO // 4:
                self.known.clear()
            new = sorted(set(own).difference(self.known))
            if new:
                self._add(new)
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            out.append((self.value[at], self.ends[at], self.letter[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0, bool), np.zeros(0, bool))

    def _add(self, tokens: list[str]) -> None:
        split = [pieces(t) for t in tokens]
        at = slice(len(self.known), len(self.known) + len(tokens))
        count = np.array([len(p) for p in split])
        value = np.zeros(len(tokens))
        some = np.flatnonzero(count)
        if len(some):
            flat = [p for own in split for p in own]
            names = {p: k for k, p in enumerate(dict.fromkeys(flat))}
            each = self.model.words(list(names))[[names[p] for p in flat]]
            value[some] = np.maximum.reduceat(each, (np.cumsum(count) - count)[some])
        self.value[at], self.ends[at] = value, [t.endswith(END) for t in tokens]
        self.letter[at] = [len(p) == 1 and len(p[0]) == 1 for p in split]
        self.known.update(zip(tokens, range(at.start, at.stop), strict=True))


def worst_sentence(model: Model, words: Words, tokens: list[str], first: np.ndarray) -> np.ndarray:
    """The largest decision of the sentences of each text; texts stand one after another, ``first`` marks their first tokens."""
    value, ends, letter = words(tokens)
    if letter.any():  # letters that stand alone, three or more in a row, are one word
        edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            cuts = [a, *(np.flatnonzero(first[a + 1 : b]) + a + 1).tolist(), b]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x >= 3:
                    value[x:y] = 0
                    value[x] = model.words(["".join(pieces("".join(tokens[x : min(y, x + PIECE)]))[:1])])[0]
    at = starts(first, ends)
    sums = np.add.reduceat(value, at) + model.bias
    return np.maximum.reduceat(sums, np.searchsorted(at, np.flatnonzero(first)))


def worst(model: Model, words: Words, texts: list[str]) -> np.ndarray:
    """``worst_sentence`` of whole texts, taken in parts; a text without words is one empty sentence."""
    out = np.full(len(texts), -np.inf)
    held: list[str] = []
    owner: list[int] = []
    first: list[int] = []

    def flush() -> None:
        if held:
            mark = np.zeros(len(held), bool)
            mark[first] = True
            np.maximum.at(out, owner, worst_sentence(model, words, held, mark))
            held.clear(), owner.clear(), first.clear()

    for k, text in enumerate(texts):
        for tokens in parts(text):
            if tokens:
                owner.append(k)
                first.append(len(held))
                held += tokens
            if len(held) >= MEMO:
                flush()
    flush()
    return np.where(np.isinf(out), model.bias, out)


def landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> list[int]:
    """Places of the landmark words. Of the words most associated with either class and of others, those that the ones chosen before
    explain least are taken one by one (pivots of an incomplete Cholesky factor), associated words first."""
    share = (toxic + clean) / (n_toxic + n_clean)
    spread = np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean) + 1e-12)
    z = np.where(toxic + clean >= 2, (toxic / n_toxic - clean / n_clean) / spread, 0)
    order = np.lexsort((words, -z))
    pool = order[:ASSOCIATED].tolist()
    rest = order[ASSOCIATED:]
    pool += rest[np.argsort(-(toxic + clean)[rest], kind="stable")][: OTHERS // 2].tolist()
    pool += rest[np.random.default_rng(11).permutation(len(rest))[: OTHERS // 2]].tolist()
    pool = list(dict.fromkeys(pool))
    word, feature, weight = subsequences([words[k] for k in pool])
    _, column = np.unique(feature, return_inverse=True)
    n, m = len(pool), min(LANDMARKS, len(pool))
    by = np.argsort(column, kind="stable")
    word, column, weight = word[by], column[by], weight[by]
    ends = np.searchsorted(column, np.arange(int(column.max(initial=-1)) + 2))
    gain = 1 + np.maximum(z[pool], 0)
    left, factor, chosen = np.ones(n), np.zeros((n, m)), []
    rows = np.argsort(word, kind="stable")
    bounds = np.searchsorted(word[rows], np.arange(n + 1))
    for k in range(m):
        p = int(np.argmax(left * gain))
        if left[p] < 1e-3:
            break
        kernel = np.zeros(n)
        for c, w in zip(column[rows[bounds[p] : bounds[p + 1]]], weight[rows[bounds[p] : bounds[p + 1]]], strict=True):
            own = slice(ends[c], ends[c + 1])
            kernel[word[own]] += w * weight[own]
        factor[:, k] = (kernel - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        left = np.maximum(left - factor[:, k] ** 2, 0)
        left[p] = 0
        chosen.append(pool[p])
    return chosen


class Nystrom:
    """Words in the space of landmarks: kernels against them, whitened by the landmarks' own kernel matrix."""

    def __init__(self, marks: list[str]):
        word, feature, weight = subsequences(marks)
        self.names, column = np.unique(feature, return_inverse=True)
        self.table = np.zeros((len(self.names), len(marks)), np.float32)
        self.table[column, word] = weight
        values, vectors = np.linalg.eigh(self.table.T.astype(np.float64) @ self.table)
        keep = values > 1e-6 * values[-1]
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.root.shape[1]), np.float32)
        for k in range(0, len(words), 256):
            word, feature, weight = subsequences(words[k : k + 256])
            at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
            hit = self.names[at] == feature
            word, at, weight = word[hit], at[hit], weight[hit]
            if len(word):
                begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                out[k + word[begin]] = np.add.reduceat(self.table[at] * weight[:, None].astype(np.float32), begin) @ self.root
        return out

    def folded(self, direction: np.ndarray) -> np.ndarray:
        """The weight of each hashed subsequence that a direction in the landmarks' space comes to."""
        out = np.zeros(FEATURES)
        out[self.names] = self.table @ (self.root @ direction)
        return out


def sums_of(z: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows ``place`` of ``z`` from each of ``begin`` to the next, a stretch at a time."""
    ends = np.append(begin[1:], len(place))
    return np.concatenate([np.add.reduceat(z[place[begin[k] : ends[min(k + 2048, len(begin)) - 1]]], begin[k : k + 2048] - begin[k]) for k in range(0, len(begin), 2048)])


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(direction, bias) of the squared-hinge support vector machine, by Newton steps over the vectors inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def cost(w: np.ndarray) -> float:
        return w @ ridge @ w / 2 + COST * float((weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = cost(w)
    for _ in range(30):
        inside = y * (x @ w) < 1
        own, t = x[inside], weight[inside]
        right = own.T @ (t * y[inside])
        own *= np.sqrt(t, dtype=np.float32)[:, None]
        aim = np.linalg.solve(ridge + 2 * COST * (own.T @ own), 2 * COST * right)
        step = 1.0
        while step > 1e-4 and cost(w + step * (aim - w)) > now:
            step /= 2
        w = w + step * (aim - w)
        new = cost(w)
        if new > now * (1 - 1e-6):
            break
        now = new
    return w[:-1], float(w[-1])


def calibrate(worst: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the log-odds by logistic regression on smoothed targets."""
    target = np.where(y > 0, (weight[y > 0].sum() + 1) / (weight[y > 0].sum() + 2), 1 / (weight[y <= 0].sum() + 2))
    x, w = np.stack([worst, np.ones(len(worst))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (target - p)) - 1e-3 * w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def fit(texts: list[str], toxic: np.ndarray, rates: tuple[float, float]) -> Model:
    """A model from labelled texts. ``rates``: how many texts a sampled one stands for, without and with the label. A third of the texts
    is kept for the calibration. Without texts of both classes every text gets the labels' mean."""
    y = np.asarray(toxic, bool)
    weight = np.where(y, rates[1], rates[0])
    held = np.arange(len(y)) % 3 == 2
    blank = Model(np.zeros(FEATURES), 0.0, 0.0, 0.0)
    mean = (float(weight[y].sum()) + 0.5) / (float(weight.sum()) + 1)
    blank.offset = float(np.log(mean / (1 - mean)))
    if not (y & ~held).any() or not (~y & ~held).any():
        return blank
    number: dict[str, int] = {}
    docs: list[list[np.ndarray]] = []
    for text in (texts[k] for k in np.flatnonzero(~held)):
        tokens = [t for part in parts(text) for t in part]
        mark = np.zeros(len(tokens), bool)
        mark[:1] = True
        cuts = starts(mark, np.array([t.endswith(END) for t in tokens], bool)) if tokens else []
        own = [[number.setdefault(p, len(number)) for t in s for p in pieces(t)] for s in (tokens[a:b] for a, b in zip(cuts, [*cuts[1:], len(tokens)], strict=False))]
        docs.append([np.array(s) for s in own if s])
    words, own_y = list(number), y[~held]
    counts = np.zeros((2, len(words)))
    for sentences, label in zip(docs, own_y, strict=True):
        if sentences:
            counts[int(label), np.unique(np.concatenate(sentences))] += 1
    if not words:
        return blank
    marks = landmarks(words, counts[1], counts[0], max(1, int(own_y.sum())), max(1, int((~own_y).sum())))
    space = Nystrom([words[k] for k in marks])
    random, value, model = np.random.default_rng(12), None, blank
    for _ in range(ROUNDS):
        x, label = [], []
        for sentences, positive in zip(docs, own_y, strict=True):
            if not sentences:
                continue
            if value is not None:
                score = np.array([value[s].sum() for s in sentences])
                order = np.argsort(-score, kind="stable")
            some = random.permutation(len(sentences))
            if positive:
                take = some[:FIRST] if value is None else order[:WORST]
            else:
                take = some[:PER_CLEAN] if value is None else np.unique(np.append(order[:3], some[:PER_CLEAN]))
            x += [sentences[k] for k in take]
            label += [1.0 if positive else -1.0] * len(take)
        label = np.array(label)
        if (label > 0).all() or (label < 0).all():
            return blank
        balance = np.where(label > 0, min(10.0, max(1.0, (label < 0).sum() / (label > 0).sum())), 1.0)
        used, place = np.unique(np.concatenate(x), return_inverse=True)
        begin = np.cumsum([0, *map(len, x[:-1])])
        direction, bias = machine(sums_of(space([words[k] for k in used]), place, begin), label, balance)
        model = Model(space.folded(direction).astype(np.float32), bias, 1.0, 0.0)
        value = np.concatenate([model.words(words[k : k + 4096]) for k in range(0, len(words), 4096)])
    tried = held if (held & y).any() and (held & ~y).any() else np.ones(len(y), bool)
    found = worst(model, Words(model), [texts[k] for k in np.flatnonzero(tried)])
    model.slope, model.offset = calibrate(found, np.where(y[tried], 1, -1), weight[tried])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from documents that ``labels`` marks (0 or 1), where ``usable`` holds.

    The driver gets a bounded sample: about TOXIC different texts with the label and CLEAN without, drawn by a hash of the text, and of each
    at most SAMPLE_CHARS characters at a place set by that hash. Copies of a text are one sample, so a large group of them isn't seen more
    often; a text counts as toxic if any row of it is. Ids and hashes alone are joined with labels; texts are read again for the
    sample. Null ids, texts and labels are left out. Without labelled texts of both kinds each text gets the labels' mean.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(True) if usable is None else usable).alias("usable"))
    base = base.where("usable AND id IS NOT NULL AND text IS NOT NULL").select("id", "text", F.xxhash64("text").alias("h"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = stored(base.select("id", "h").join(marks, "id").groupBy("h").agg(F.min("id").alias("id"), F.max("label").alias("label")), "labelled")
    counts = {bool(r["toxic"]): r["n"] for r in known.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / counts[k]) if counts.get(k) else 1.0 for k, most in ((True, TOXIC), (False, CLEAN))}
    drawn = F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    chosen = known.where(drawn < F.when(F.col("label") > 0, share[True]).otherwise(share[False]))  # a bounded number of rows
    place = (F.pmod(F.xxhash64("h", F.lit("place")), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1).cast("int")
    cut = base.join(F.broadcast(chosen), ["id", "h"]).select("h", "label", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["h"])
    rows = sorted((r["h"], r["label"] > 0, r["text"]) for r in cut.collect())
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], bool), (1 / share[False], 1 / share[True]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability that each whole text is marked toxic, from its worst sentence.

    Only the text is read: other columns are left out, whatever their names. Null texts, and texts without letters, count as empty and
    get the score of a sentence without words. Texts of any length are taken whole; repeated rows and null ids keep their own row. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for batch in batches:
            found = worst(shared.value, words, list(batch["text"]))
            yield pd.DataFrame({id_col: batch["id"], "score": shared.value.probability(found)})

    return source.mapInPandas(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, score double")
