"""Toxicity, spelling variants and whitening against plain computations and held-out labels."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestar.llm import queries, spelling, toxicity, whitening

D = "/root/testdata/sf0.01"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# spelling variants


def plain_variants(docs, typo):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    keys, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            keys[k, len(w), w[:k] + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for own in keys.values():
        for w in own:
            near[w] |= own - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def found_variants(frame):
    rows = frame.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shared", [1, 64])
def test_variants_of_a_frequent_stem(spark, monkeypatch, shared):
    monkeypatch.setattr(spelling, "SHARED", shared)
    pick = random.Random(4)
    words = ["ééstemstem" + "".join(pick.choice("abÿ") for _ in range(5)) for _ in range(400)]
    words += [w[: (k := pick.randrange(len(w)))] + pick.choice("xÀ") + w[k + pick.randrange(2) :] for w in words]
    words += ["a" * k for k in range(4, 60)] + ["Ébcde", "ébcde", "straße", "strasse", "×÷×÷×"]
    docs = [(i, " ".join(pick.choices(words, k=1500))) for i in range(12)] + [(None, "abcde abcdf abcdf"), (3, None), (4, ""), (5, "x" * 1200 + " " + "x" * 1201), (5, "x" * 1200 + " " + "x" * 1201), (5, "x" * 1200 + " " + "x" * 1201)]
    table = frame(spark, [(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert found_variants(spelling.variants(table, 97)) == plain_variants(docs, 97)


def test_variants_edge_cases(spark):
    none = frame(spark, [], "doc_id long, text string")
    assert spelling.variants(none).count() == 0
    tied = [(1, "stone " * 3 + "stome " * 6 + "stane " * 6 + "Stone"), (1, "stone")]
    assert found_variants(spelling.variants(frame(spark, tied, "doc_id long, text string"))) == plain_variants(tied, None)


def test_variants_without_letters_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_variants(spelling.variants(docs)) == plain_variants(rows, None)


# whitening


def plain_whitening(x, components=32):
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    return values / np.trace(centred.T @ centred / n), centred @ vectors / np.sqrt(values), deviation


def test_op13_query_against_an_eigendecomposition(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 1_000_000
    explained, whitened, deviation = plain_whitening(x)
    got = queries.op13_whitening(spark, D).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(rows) and (got["n"] == len(rows)).all()
    order = np.argsort([r.vec_id for r in rows])
    own = got["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((own * whitened[order]).sum(axis=0))
    assert np.abs(own * sign - whitened[order]).max() < 1e-8
    assert (got["deviation"].to_numpy().reshape(-1, 32) == deviation[order][:, None]).all()
    assert np.abs(got["explained"].to_numpy().reshape(-1, 32) / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize(("dim", "rank"), [(200, 200), (200, 12), (80, 48), (40, 40)])
def test_filtered_iteration_finds_leading_eigenvectors(dim, rank):
    parts = np.random.default_rng(dim + rank).normal(size=(dim, rank)) * np.linspace(1, 4, rank)
    matrix, asked = parts @ parts.T, []

    def product(q):
        asked.append(q.shape[1])
        return matrix @ q

    values, q = whitening.eigenpairs(product, dim, 32)
    true = np.linalg.eigvalsh(matrix)[::-1]
    assert np.abs(values - true[:32]).max() < 1e-11 * true[0]
    assert np.abs(matrix @ q - q * values).max() < 1e-10 * true[0] and np.abs(q.T @ q - np.eye(32)).max() < 1e-12
    assert len(asked) < 100


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<double>, component int, n string"
    one = [0.5, 1.0, -2.0]
    bad = [(1, None, 0, ""), (2, [1.0, None, 2.0], 0, ""), (3, [float("inf"), 1.0, 1.0], 0, ""), (4, [float("nan")] * 3, 0, ""), (5, [1.0], 0, ""), (6, [], 0, "")]
    assert whitening.whiten(frame(spark, [], schema)).count() == 0
    assert whitening.whiten(frame(spark, bad[:4], schema)).count() == 0
    assert whitening.whiten(frame(spark, [(1, one, 0, ""), (1, one, 0, "")], schema)).count() == 0
    rows = [(k % 5 if k % 7 else None, [float(k), float(k * k % 11), -1.5 * k], 0, "x") for k in range(30)]
    got = whitening.whiten(frame(spark, rows + bad, schema)).collect()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    explained, _, deviation = plain_whitening(x, 3)
    kept = sum(explained > 1e-12)
    assert len(got) == 30 * kept and {r.n for r in got} == {30}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    assert sorted(str(r.vec_id) for r in got if r.component == 1) == sorted(str(r[0]) for r in rows)
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0], 0, ""), (2, [-1e300, 1.0], 0, ""), (3, [0.0, 5.0], 0, "")], schema)).collect()
    assert {r.vec_id for r in huge if r.deviation is None} == {1, 2} and all(np.isfinite(r.whitened) for r in huge)


# toxicity


def plain_subsequences(word):
    text, out = f"<{word}>", Counter()
    for a in range(len(text)):
        for b in range(a + 1, len(text)):
            for c in range(b + 1, len(text)):
                for d in range(c + 1, min(len(text), a + toxicity.REACH + 1)):
                    out[text[a] + text[b] + text[c] + text[d]] += toxicity.DECAY ** (d - a + 1)
    length = sum(v * v for v in out.values()) ** 0.5
    return {k: v / length for k, v in out.items()}


def test_kernel_of_words():
    words = ["idiot", "idxiot", "aaaaaa", "é", "idiom", "ab", "straße"]
    word, feature, weight = toxicity.subsequences(words)
    vectors = np.zeros((len(words), toxicity.FEATURES))
    vectors[word, feature] = weight
    plain = [plain_subsequences(w) for w in words]
    true = np.array([[sum(x * b.get(k, 0) for k, x in a.items()) for b in plain] for a in plain])
    assert np.abs(vectors @ vectors.T - true).max() < 1e-9
    assert true[0, 1] > true[0, 4] > 0  # a character put in costs less than another ending


def test_landmarks_span_their_own_kernel():
    space = toxicity.Nystrom(["idiot", "clown", "idxiot", "stupid"])
    z = space(["idiot", "clown", "stupids", "zzz"]).astype(np.float64)
    plain = [plain_subsequences(w) for w in ("idiot", "clown")]
    assert abs(z[0] @ z[1] - sum(x * plain[1].get(k, 0) for k, x in plain[0].items())) < 0.03 and abs(z[0] @ z[0] - 1) < 1e-5
    # (subsequences are hashed: two of these words share a place by chance)
    direction = np.arange(1.0, z.shape[1] + 1)
    word, feature, weight = toxicity.subsequences(["idiot", "clown", "stupids", "zzz"])
    assert np.allclose(np.bincount(word, weight * space.folded(direction)[feature], 4), z @ direction, atol=1e-5)


def trained():
    pick = random.Random(6)
    plain = ["".join(pick.choice(["an", "er", "ti", "on", "the", "re", "ou"]) for _ in range(pick.randint(1, 4))) for _ in range(600)]
    texts, toxic = [], []
    for k in range(900):
        own = pick.choices(plain, k=pick.randint(10, 120))
        if k % 5 == 0:
            for w in pick.sample(["idiot", "clown", "scumbag", "moron"], 2):
                own.insert(pick.randrange(len(own)), w)
        texts.append(" ".join(w + ("." if pick.random() < 0.1 else "") for w in own))
        toxic.append(k % 5 == 0)
    return toxicity.fit(texts, np.array(toxic), (1.0, 1.0)), plain


def test_gaps_and_inserted_characters_are_tolerated():
    model, plain = trained()
    score = lambda *texts: model.probability(toxicity.worst(model, toxicity.Words(model), list(texts)))
    calm = " ".join(plain[:40])
    assert (score("you idiot", f"{calm} clown {calm}", "such an i-d-i-o-t", "such a c l o w n here", "SCUM-BAG", "i*d*i*o*t") >= 0.3).all()
    assert (score(calm, "", "...", "12 34", "the other one", "a b c") < 0.3).all()
    assert score("you idiiot")[0] > 2 * score("you iron")[0]
    long = ". ".join([calm] * 2000)
    assert score(long)[0] < 0.3 <= score(f"{long} moron {long}")[0]
    parts = toxicity.PART
    toxicity.PART = 100
    try:
        assert np.allclose(score(f"{calm}. you idiot"), score(f"{calm}. you idiot")) and score(f"{calm}. you idiot")[0] >= 0.3
        assert np.isfinite(score("x" * 5000)).all()
    finally:
        toxicity.PART = parts


def test_toxicity_edge_cases(spark):
    docs = [(1, None), (None, "fine text"), (2, ""), (2, "you idiot"), (2, "you idiot"), (3, "Ω≈ç 123"), (4, "y" * 300_000)]
    table = frame(spark, [(i, t, 1, 0.5) for i, t in docs], "doc_id long, text string, toxic int, score double")
    labels = frame(spark, [(1, 1), (2, 1), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.train(table, marks)
        got = toxicity.score(table, model).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in docs)
        assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(table.limit(0), model).count() == 0


def test_op11_query_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op11_toxicity(spark, d).collect()}
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    marked = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic is not None and got[r.doc_id].held_out and docs[r.doc_id] == "en"]
    toxic, clean = [g.predicted for g, t in marked if t], [g.predicted for g, t in marked if not t]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.03
