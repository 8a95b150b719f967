"""Language of words in code-switched text by a linear-chain conditional random field, and of documents by its marginals.

A word's features are its lower-case form (if the lexicon has it), its affixes and its character n-grams; transitions between
the languages of neighbouring words are learned with them. Forward-backward gives each word's distribution over
languages; a document's language is the one with the largest sum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import doc_hash, small_batches

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: The training sample's bound: documents of a language on average, and of all languages together, which share them evenly but get
#: LEAST_DOCUMENTS each; words taken from each document at a place set by its hash.
SAMPLE_DOCUMENTS, SAMPLE_ALL, LEAST_DOCUMENTS, SAMPLE_WORDS = 800, 160_000, 20, 120
#: Features are hashed into as many weights.
FEATURES = 1 << 18
#: Lengths of code-switched training sequences and of the stretches of one language they are made of.
SEQUENCE, MIN_STRETCH, MAX_STRETCH = 40, 4, 20
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.5, 1e-5
MEMO = 1 << 18
#: Words whose marginals are computed at a time.
CHUNK_WORDS = 1 << 20


def _hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
    out = np.full(len(letters[0]), kind + 1, np.uint64)
    for x in letters:
        out = (out * np.uint64(0x100000001B3) ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(40)).astype(np.int64) % FEATURES


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words one after another, how many each word has): affixes of 1 to 3 letters, n-grams of 2 and 3
    with edges, and the form if the lexicon has it."""
    text = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 2) - size - 1  # the first letter of each word
    word = np.repeat(np.arange(len(words)), size + 2)
    flat, owner = [], []
    for n in (2, 3):
        at = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        flat.append(_hashed(n, *(text[at + k] for k in range(n))))
        owner.append(word[at])
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n)
        for kind, first in ((10 + n, start[long]), (20 + n, start[long] + size[long] - n)):
            flat.append(_hashed(kind, *(text[first + k] for k in range(n))))
            owner.append(long)
    forms = np.array([lexicon.get(w, -1) for w in words])
    flat.append(forms[forms >= 0])
    owner.append(np.flatnonzero(forms >= 0))
    everyone = np.concatenate(owner)
    return np.concatenate(flat)[np.argsort(everyone, kind="stable")], np.bincount(everyone, minlength=len(words))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [FEATURES, languages]
    transitions: np.ndarray  # [languages, languages], from the word before
    lexicon: dict[str, int]  # a feature of each form

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, size = features(words, self.lexicon)
        return np.add.reduceat(self.weights[flat], np.cumsum(size) - size) / np.sqrt(size)[:, None]


def lexicon_of(forms: set[str]) -> dict[str, int]:
    return {w: zlib.crc32(f"={w}".encode("utf-8", "surrogatepass")) % FEATURES for w in sorted(forms)}


def marginals(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """P(language) of each word by forward-backward; rows of ``emissions`` are the words of sequences one after another.

    All sequences take a step together; messages are scaled at every step, so sequences may be of any length.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")  # sequences longer than t
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float32)
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    forward = np.empty_like(e)
    prior = None
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        x = e[at] if prior is None else (prior[:n] @ move) * e[at]
        prior = x / x.sum(axis=1, keepdims=True)
        forward[at] = prior
    back = np.ones((len(lengths), e.shape[1]), np.float32)
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        at = starts[:n] + t
        x = (back[:n] * e[at + 1]) @ move.T
        back[:n] = x / x.sum(axis=1, keepdims=True)
        forward[at] *= back[:n]
    return forward / forward.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[int, list[str]]], languages: list[str], lexicon: dict[str, int], seed: int = 7) -> Model:
    """Gradient ascent on the log-likelihood of code-switched sequences, made of stretches of the samples' words."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    weights, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    pools = [[w for lang, w in samples if lang == one and w] for one in range(k)]
    present = [one for one in range(k) if pools[one]]
    n_sequences = max(1, sum(len(w) for _, w in samples) // SEQUENCE)
    for epoch in range(EPOCHS if present else 0):
        for _ in range(max(1, n_sequences // BATCH)):
            words: list[str] = []
            truth: list[int] = []
            for _ in range(BATCH):
                n = 0
                while n < SEQUENCE:
                    one = present[rng.integers(len(present))]
                    own = pools[one][rng.integers(len(pools[one]))]
                    take = int(min(rng.integers(MIN_STRETCH, MAX_STRETCH + 1), SEQUENCE - n, len(own)))
                    at = int(rng.integers(len(own) - take + 1))
                    words += own[at : at + take]
                    truth += [one] * take
                    n += take
            flat, size = features(words, lexicon)
            scale = 1 / np.sqrt(size)
            emissions = np.add.reduceat(weights[flat], np.cumsum(size) - size) * scale[:, None]
            labels = np.array(truth).reshape(BATCH, SEQUENCE)
            p, pairs = expected(emissions.reshape(BATCH, SEQUENCE, k), move)
            gradient = -p.reshape(-1, k)
            gradient[np.arange(len(truth)), truth] += 1
            rate = RATE / (1 + epoch)
            step = np.repeat(gradient * (scale * rate / 4)[:, None], size, axis=0)
            order = np.argsort(flat, kind="stable")
            own = flat[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            weights[own[first]] += np.add.reduceat(step[order], first)
            seen = np.bincount((labels[:, :-1] * k + labels[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            move += rate * k * ((seen - pairs) / (BATCH * SEQUENCE) - DECAY * move)
    return Model(languages, weights.astype(np.float32), move, lexicon)


def expected(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, summed expected counts of neighbouring labels) of sequences of one length, by forward-backward."""
    n, length, k = emissions.shape
    e, move = np.exp(emissions - emissions.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())
    forward, back = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        x = (forward[:, t - 1] @ move) * e[:, t]
        forward[:, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        x = (back[:, t + 1] * e[:, t + 1]) @ move.T
        back[:, t] = x / x.sum(axis=1, keepdims=True)
    p = forward * back
    before, after = forward[:, :-1].reshape(-1, k), (e * back)[:, 1:].reshape(-1, k)
    mass = ((before @ move) * after).sum(axis=1, keepdims=True)
    return p / p.sum(axis=2, keepdims=True), move * (before.T @ (after / mass))


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from documents with a language, and where ``usable`` holds.

    The lexicon has the words that come twice in a bounded sample, from which the weights come, too: about SAMPLE_DOCUMENTS documents of
    each language, fewer if there are so many languages that all would have over SAMPLE_ALL, chosen by a hash of id and text, and
    SAMPLE_WORDS words of each. Every language is learned. The driver gets that sample and one count for each language, no
    more. Repeated rows come into the sample together. Without any usable document the model knows no language.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), {})
    wanted = min(SAMPLE_DOCUMENTS, max(LEAST_DOCUMENTS, SAMPLE_ALL // len(languages)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, wanted / r["n"])) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
    chosen = known.withColumn("drawn", drawn).join(F.broadcast(shares), "lang").where("drawn < share").select("text", "lang")

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = []
            for text in batch["text"]:
                own = WORD.findall(text.lower())
                at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(own) - SAMPLE_WORDS + 1)
                words.append(own[at : at + SAMPLE_WORDS])
            yield pd.DataFrame({"lang": batch["lang"], "words": words})

    rows = sorted((r["lang"], r["words"]) for r in chosen.mapInPandas(cut, "lang string, words array<string>").collect())
    number = {lang: k for k, lang in enumerate(languages)}
    samples = [(number[lang], list(words)) for lang, words in rows]
    lexicon: set[str] = set()
    for one in range(len(languages)):
        own = pd.Series([w for lang, words in samples if lang == one for w in words], dtype=object).value_counts()
        lexicon.update(own[own > 1].index)
    return fit(samples, languages, lexicon_of(lexicon))


class Labeller:
    """Marginals of the words of many texts, with a bounded memo of words' emissions."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((MEMO, len(model.languages)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(words), MEMO // 4):
            part = words[k : k + MEMO // 4]
            if len(self.rows) > MEMO - MEMO // 4:
                self.rows.clear()
            new = list(set(part).difference(self.rows))
            if new:
                self.table[len(self.rows) : len(self.rows) + len(new)] = self.model.emissions(new)
                self.rows.update(zip(new, range(len(self.rows), MEMO), strict=False))
            out.append(self.table[np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))])
        return np.concatenate(out)

    def __call__(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """The marginals [words, languages] of each text that has words, in order."""
        at = 0
        while at < len(texts):
            n, end = 0, at
            while end < len(texts) and (end == at or n + len(texts[end]) <= CHUNK_WORDS):
                n += len(texts[end])
                end += 1
            own = texts[at:end]
            lengths = np.array([len(w) for w in own])
            p = marginals(self.emissions([w for ws in own for w in ws]), self.model.transitions, lengths)
            yield from np.split(p, np.cumsum(lengths)[:-1])
            at = end


def _predict(model: Model, docs: DataFrame, id_col: str, text_col: str, words: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = Labeller(shared.value)
        names = np.array([*shared.value.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            found = [WORD.findall(t.lower()) for t in batch["text"]]
            found = [w if any(c.isalpha() for x in w for c in x) else [] for w in found]
            some = [k for k, w in enumerate(found) if w] if len(names) > 1 else []
            lang, score = np.full(len(found), UNDETERMINED, dtype=object), np.zeros(len(found))
            each: list = [[] for _ in found]
            for k, p in zip(some, label([found[k] for k in some]), strict=True):
                mean = p.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                lang[k], score[k] = names[best], min(1.0, float(mean[best]))
                if words:
                    top = p.argmax(axis=1)
                    each[k] = [{"word": w, "lang": names[j], "p": float(min(1.0, q[j]))} for w, j, q in zip(found[k], top, p, strict=True)]
            out = pd.DataFrame({id_col: batch["id"], "lang_pred": lang, "score": score})
            yield out.assign(words=each) if words else out

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(run, f"`{id_col}` {kind}, lang_pred string, score double" + ", words array<struct<word:string,lang:string,p:double>>" * words)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language of each whole text and its mean marginal.

    A text that is null or has no letter, or any text if the model knows no language, is ``und`` with score 0. Only the text is read:
    other columns are left out, whatever their names. Of languages with equal sums the first by name counts. Texts of any length are
    taken whole; repeated rows and null ids keep their own row. An empty table gives an empty result.
    """
    return _predict(model, docs, id_col, text_col, False)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``predict`` with ``words``: each word in lower case, its most probable language and that probability."""
    return _predict(model, docs, id_col, text_col, True)


def in_training(id_col: str = "doc_id") -> Column:
    """Documents of the training folds: crc32 of the id as text, modulo 4, isn't 2; a null id counts as empty text."""
    return doc_fold(id_col) != 2


def doc_fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(doc_hash(id_col), F.lit(0)) % 4
