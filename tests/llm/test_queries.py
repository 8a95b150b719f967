"""Columns of registered queries against plain computations over whole tables."""

import hashlib
import re
import zlib

import numpy as np

from lodestar.llm import queries
from lodestar.llm.common import tokenizer_file

D = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def texts(spark, d=D):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}


def library(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file(name))
    found.no_truncation()
    found.no_padding()
    return found


def test_op6_query_against_the_library(spark):
    ref, docs = library("byte_bpe_50k.json"), texts(spark)
    got = {r.doc_id: r for r in queries.op6_bpe_round_trip(spark, D).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = ref.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(ref.decode(ids, skip_special_tokens=False)))


def test_op2_query_folds_and_labels(spark):
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == rows.keys()
    right = held = 0
    for i, r in rows.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert got[i].lang_pred == "und"
        elif got[i].held_out:
            held += 1
            right += got[i].lang_pred == r.lang
    assert held > 100 and right >= 0.97 * held


def test_op3_query_against_plain_search(spark):
    kinds = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), "access": (r"AKIA[A-Z0-9]+", 16), "hex": (r"[0-9a-f]+", 32)}
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, D).collect()}
    docs = texts(spark)
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        spans = []
        for at, (kind, (pattern, least)) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    spans.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
        base = [s for _, _, s in sorted(spans)]
        assert got[i].base_sha256 == sha(",".join(base))
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("markov")] == base
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in base) for k in kinds)


def test_op8_query_against_the_library(spark):
    ref, docs = library("word_bpe_49k.json"), texts(spark)
    rows = queries.op8_best_fit_packing(spark, D).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for i, text in docs.items():
        ids = np.asarray([*ref.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pipeline_run_against_its_stages_by_hand(spark):
    """``run`` over a whole table: each stage's rows by plain computations on what the one before kept, tokens by the library."""
    import corpus_pipeline
    from lodestar.llm import minhash, quality, secrets

    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = corpus_pipeline.run(spark, D).collect()
    kept = {}
    for r in docs.collect():
        verdict = quality.judge(r.text or "")
        if verdict[6]:
            kept[r.doc_id] = verdict[8]
    shingles = {}
    for i, text in kept.items():
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in kept}
    pairs = [(a, b) for a in kept for b in kept if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
    for _ in pairs:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    assert minhash.banding(80)[0] > 0
    seen, cleaned = set(), {}
    for i in sorted(k for k in kept if least[k] == k):
        data = kept[i].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
        for k in range(len(data) - 99):
            window = data[k : k + 100]
            if window in seen:
                continue
            seen.add(window)
        own = set()
        for k in range(len(data) - 99):
            if data[k : k + 100] in own:
                gone[k : k + 100] = b"\1" * 100
            own.add(data[k : k + 100])
        cleaned[i] = b"".join(data[k : k + 1] for k in range(len(data)) if not gone[k]).decode("utf-8", "ignore")
    model = secrets.train(spark.createDataFrame(list(cleaned.items()), "doc_id long, text string"))
    ref = library("word_bpe_49k.json")
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert got.keys() == cleaned.keys()
    same = 0
    for i, text in cleaned.items():
        out, at = [], 0
        for _, start, end, _ in secrets.find(text, model)[0]:
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        ids = [*ref.encode("".join(out) + text[at:], add_special_tokens=False).ids, 2]
        same += [t for r in sorted(got[i], key=lambda r: r.start) for t in r.ids] == ids
    assert same == len(cleaned)
