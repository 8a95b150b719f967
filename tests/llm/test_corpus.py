"""Operators across texts: sharding, embeddings, MinHash, suffix arrays, compact windows, components, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import compact_windows, embedding_dedup, minhash, queries, sharding, suffix_dedup
from lodestar.llm import shingles as shingles_of
from lodestar.llm.components import components

SCHEMA = "doc_id long, text string, id string, doc string, name string, cluster string, lang string, n_chars long"


def table(spark, rows):
    """(id, text) rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "a", "b", "c", None, "en", None) for i, t in rows], SCHEMA)


def reach(n, links):
    """The smallest point reachable from each."""
    label = dict.fromkeys(n)
    for x in label:
        label[x] = x
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    for _ in range(3):
        links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900, k) for k in range(400, 500)] + [(k, k + 1) for k in range(1000, 1040)]
        got = {r.id: r.component for r in components(spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()}
        want = {x: y for x, y in reach({x for e in links for x in e}, links).items() if x != y}
        assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randrange(1, 300))) for k in range(600)] + [(700, None), (701, ""), (None, "x"), (None, None), (5, "twice"), (5, "twice")]
    out, slot_map = sharding.shard(table(spark, rows), 8)
    out = out.collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    load = defaultdict(int)
    for r in out:
        load[r.shard] += r.size
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= max(r.size for r in out)
    for s in load:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    one = {r.vslot: r for r in slot_map.collect()}
    two = {r.vslot: r for r in sharding.grow(slot_map, 8).collect()}
    moved = [k for k in one if one[k].shard != two[k].shard]
    assert moved and all(two[k].shard == 8 and two[k].version == 2 for k in moved)
    new = sum(two[k].bytes for k in moved)
    assert abs(new - sum(load.values()) / 9) < 0.25 * sum(load.values()) / 9
    empty, _ = sharding.shard(table(spark, []), 8)
    assert empty.count() == 0


def test_map_versions_are_stored_and_read_again(spark, tmp_path):
    rows = [(k, "x" * (k % 50)) for k in range(400)]
    records, first = sharding.shard(table(spark, rows), 4)
    path = str(tmp_path / "maps")
    sharding.write_map(first, path)
    sharding.write_map(sharding.grow(sharding.read_map(spark, path), 4), path)
    one, two = (sharding.read_map(spark, path, v) for v in (1, None))
    assert {r.version for r in one.collect()} == {1} and {r.version for r in two.collect()} == {2}
    base = records.drop("shard", "slot")
    before, after = ({r.doc_id: r.shard for r in sharding.assign(base, m).collect()} for m in (one, two))
    moved = {i for i in before if before[i] != after[i]}
    assert moved and all(after[i] == 4 for i in moved) and before == {r.doc_id: r.shard for r in records.collect()}


def test_sharding_query_is_balanced(spark):
    rows = queries.op4_virtual_slots(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(rows) == 40 and max(r.n for r in rows) < 1.01 * min(r.n for r in rows)


def test_embeddings_of_extreme_lengths(spark):
    rows = [(1, [1e200, 2e200], 0), (2, [1e-200, 2e-200], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


@pytest.mark.parametrize("dim", [3, 64])
def test_embeddings(spark, monkeypatch, dim):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(150):
        v = rng.normal(size=dim)
        if k % 3 and rows:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(size=dim) * 0.2 * rng.random() / np.sqrt(dim) * np.sqrt(dim) / 4
        rows.append((k, v.astype(np.float32).tolist(), int(k % 7 == 0)))
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (202, [2 * x for x in rows[0][1]], 1), (203, rows[0][1], None), (204, None, 1), (205, [0.0] * dim, 1), (206, [float("nan")] + rows[0][1][1:], 1), (207, [], 1), (208, rows[0][1] + [1.0], 1), (209, [None] + rows[0][1][1:], 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, id string, n int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    fine = {i: np.array(v, np.float64) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b] and len(fine[a]) == len(fine[b]) and embedding_dedup.cosines(fine[a][None], fine[b][None])[0] >= 0.98]
    want = reach([i for i, _, _ in rows if i is not None], links)
    assert len(links) > 20 and len(got) == len(rows)
    for i in want:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in links), want[i], want[i] == i), i
    assert got[None].n_links == 0
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 32)) * rng.random((200, 32)) ** 6
    q, s, d = embedding_dedup.quantise(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    real, near = unit @ unit.T, (q.astype(float) @ q.T) * s[:, None] * s
    assert (np.abs(real - near) <= d[:, None] * (1 + d) + d * (1 + d[:, None]) + d[:, None] * d + 1e-12).all()


def complements(doublings):
    """The Thue-Morse word of 2^doublings letters and its complement, which polynomials modulo a power of two can't tell apart."""
    word, flip = "a", str.maketrans("ab", "ba")
    for _ in range(doublings):
        word += word.translate(flip)
    return word, word.translate(flip)


def test_long_regular_words_stay_apart(spark):
    word, other = complements(11)
    around = prose(random.Random(2), 12)
    names, _, _ = shingles_of.words(f"{word} {other} {word.upper()} {word[:32]} {other[:32]} {word}x")
    assert names[0] == names[2] and len(set(names.tolist())) == 5
    rows = [(1, word), (2, other), (3, word.upper()), (4, f"{around} {word}"), (5, f"{around} {other}")]
    for words, percent in ((3, 85), (5, 80)):
        sets, links = jaccard_links(rows, words, percent)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), words, percent).collect()}
        assert got == reach(sets, links) and got[2] == 2 and got[3] == 1


def jaccard_links(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    both = lambda a, b: len(sets[a] & sets[b])
    return sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b))]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_minhash(spark, monkeypatch, words, percent):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rng = random.Random(words)
    rows = []
    for k in range(120):
        w = prose(rng, rng.randrange(20, 120)).split()
        if k % 3:
            w = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE  two"), (305, rows[0][1].upper()), (306, " ".join(prose(rng, 1) for _ in range(6000)))]
    sets, links = jaccard_links(rows, words, percent)
    want = reach(sets, links)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, [*rows, (None, rows[0][1])]), words, percent).collect()}
    assert len(links) > 20 and len(got) == len(rows) + 1
    for i in want:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), i
    assert got[None].component_id is None and got[None].kept
    assert minhash.near_duplicates(table(spark, []), words, percent).count() == 0
    kept = minhash.keep_first(table(spark, [*rows, rows[0], (None, None)]), words, percent).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in want if want[i] == i) and kept[0].cluster is None


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        hit = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(data[k : k + length])
        out.append((i, hit, bytes(b for b, h in zip(data, hit, strict=True) if not h)))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(4)]
    rows = []
    for k in range(60):
        t = prose(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            b = rng.choice(base)
            at = rng.randrange(len(b) - 120)
            t += rng.choice(["", "é", " "]) + b[at : at + rng.randrange(95, 130)] + prose(rng, 3)
        rows.append((k, t))
    rows += [(100, "x" * 350), (101, "ab" * 150 + "é" * 120), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100), (106, rows[5][1]), (107, "".join(rng.choice("ab") for _ in range(700000)) + base[0])]
    for batches in (1, 5):
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows), 100, batches).collect()}
        for i, hit, kept in brute_repeats(rows, 100):
            assert bytes(got[i].kept) == kept and got[i].n_bytes == len(hit), i
            assert sum(s.end - s.start for s in got[i].spans) == sum(hit)
            assert all(a.end < b.start for a, b in zip(got[i].spans, got[i].spans[1:], strict=False))
            assert got[i].name == "c" and got[i].cluster is None
    twice = [(7, base[0]), (7, base[0]), (3, base[0]), (None, base[0]), (7, base[1])]
    got = suffix_dedup.remove_repeats(table(spark, twice), 100).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.kept)) for r in got) == sorted([(False, 3, len(base[0])), (False, 7, 0), (False, 7, 0), (False, 7, len(base[1])), (True, 0, len(base[0]))])
    assert suffix_dedup.remove_repeats(table(spark, []), 100).count() == 0
    whole = suffix_dedup.remove_repeats(table(spark, [(1, "é" * 80), (2, "x" + "é" * 80)]), 99, whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)


def test_suffix_dedup_holds_few_blocks_of_a_seed(spark, monkeypatch):
    """A line in very many contexts: no task holds the blocks of its seeds, and results stay those of brute force."""
    rng = random.Random(12)
    line, longer = prose(rng, 14)[:60], prose(rng, 40)[:150]
    rows = [(k, prose(rng, 12) + line + prose(rng, 12) + (longer + prose(rng, 5) if k % 4 == 0 else "")) for k in range(80)]
    rows += [(200 + k, rows[k][1][20:] + prose(rng, 20)) for k in range(0, 80, 3)]
    monkeypatch.setattr(suffix_dedup, "HELD", 8)
    held, undecided = [], suffix_dedup._compare_held

    def spy(few, *rest):
        held.extend(few.groupBy("seed").count().select(F.max("count")).first())
        return undecided(few, *rest)

    monkeypatch.setattr(suffix_dedup, "_compare_held", spy)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows), 100).collect()}
    for i, hit, kept in brute_repeats(rows, 100):
        assert bytes(got[i].kept) == kept and sum(s.end - s.start for s in got[i].spans) == sum(hit), i
    assert held and (held[0] or 0) <= 8


def test_compact_windows_against_recursion():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.integers(0, 40, 6)
        values = rng.integers(0, 30, lengths.sum()).astype(np.uint64) << np.uint64(40)
        least = int(rng.integers(1, 12))
        want, start = set(), 0

        def walk(left, right):
            if right - left + 1 >= least:
                k = left + int(np.argmin(values[left : right + 1]))
                want.add((left, k, right))
                walk(left, k - 1)
                walk(k + 1, right)

        for n in lengths:
            walk(start, start + n - 1)
            start += n
        assert set(map(tuple, np.stack(compact_windows.compact_windows(values, lengths, least), 1).tolist())) == want


def test_passages(spark):
    rng = random.Random(2)
    passage = prose(rng, 70).split()
    edited = [w if k % 40 else "new" for k, w in enumerate(passage)]
    rows = [(k, prose(rng, 120)) for k in range(20)]
    inside = lambda p: put(rng, p)
    rows += [(50, inside(passage)), (51, inside(passage)), (52, inside(edited)), (53, inside(passage[:40])), (54, None), (55, ""), (56, "short"), (57, " ".join(passage)), (None, inside(passage)), (50, inside(passage))]
    got = compact_windows.near_duplicate_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {51, 52, 57} and {r.doc_id for r in got if r.first_doc_id == 50} == {51, 52, 57}
    exact = next(r for r in got if r.doc_id == 57 and r.first_doc_id == 50)
    assert (exact.start, exact.end) == (0, 70) and exact.similarity == 1 and exact.first_end - exact.first_start == 70
    assert next(r for r in got if r.doc_id == 52).similarity >= 0.8
    assert compact_windows.near_duplicate_passages(table(spark, [])).count() == 0


def test_compact_windows_find_exact_passages(spark):
    """Each maximal run of words whose 50-word windows an earlier document has is covered by passages found."""
    d = "/root/testdata/sf0.01"
    found = defaultdict(set)
    for r in queries.op9_compact_windows(spark, d).collect():
        found[r.doc_id].update(range(r.start, r.end))
    seen, runs, hit = {}, 0, 0
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        again = [x in seen for x in windows]
        for k in range(len(again)):
            if again[k] and (k == 0 or not again[k - 1]):
                end = next((j for j in range(k, len(again)) if not again[j]), len(again)) + 49
                runs += 1
                hit += len(found[r.doc_id] & set(range(k, end))) >= 0.95 * (end - k)
        for x in windows:
            seen.setdefault(x, r.doc_id)
    assert runs > 50 and hit >= 0.98 * runs, (hit, runs)


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def similarity(p, q):
    return len(shingles(p) & shingles(q)) / len(shingles(p) | shingles(q))


def put(rng, passage):
    return " ".join([prose(rng, rng.randrange(1, 80)), *passage, prose(rng, rng.randrange(1, 80))])


def test_passages_whose_phrases_others_hold(spark):
    """Earlier documents hold phrases of 12 words of each passage: the passages find each other all the same."""
    rng = random.Random(4)
    ps = [prose(rng, 60).split() for _ in range(40)]
    rows = [put(rng, p[k : k + 12]) for p in ps for k in range(0, 60, 12)]
    want = {(len(rows) + 2 * k, len(rows) + 2 * k + 1) for k in range(len(ps))}
    rows += [put(rng, p) for p in ps for _ in range(2)]
    got = compact_windows.near_duplicate_passages(table(spark, list(enumerate(rows)))).collect()
    assert {(r.first_doc_id, r.doc_id) for r in got} == want


def test_passages_by_similarity_and_in_chains(spark):
    """Planted passages of similarity 0.8 to 1, and chains of edits whose ends are less similar, against all pairs."""
    rng = random.Random(5)
    rows, pairs, chained = [], set(), set()
    while len(pairs) < 120:
        p = prose(rng, rng.randrange(50, 160)).split()
        q = list(p)
        for _ in range(rng.randrange(max(2, len(p) // 25))):
            q[rng.randrange(len(p))] = prose(rng, 1)
        if similarity(p, q) >= 0.8:
            pairs.add((len(rows), len(rows) + 1))
            rows += [put(rng, p), put(rng, q)]
    for _ in range(20):
        chain = [prose(rng, 80).split()]
        for _ in range(4):
            chain.append(list(chain[-1]))
            chain[-1][rng.randrange(80)] = prose(rng, 1)
        chained |= {len(rows) + k for k in range(5) if any(similarity(chain[k], chain[j]) >= 0.8 for j in range(k))}
        rows += [put(rng, p) for p in chain]
    got = compact_windows.near_duplicate_passages(table(spark, list(enumerate(rows)))).collect()
    both, ids = {(r.first_doc_id, r.doc_id) for r in got}, {r.doc_id for r in got}
    assert len(pairs & both) >= 0.97 * len(pairs) and len(chained & ids) >= 0.95 * len(chained)
    assert all(r.similarity >= 0.8 for r in got) and {r.doc_id for r in got if r.doc_id < 240} == {b for _, b in pairs & both}


def test_passages_whose_keys_variants_hold_first_and_last(spark):
    """Before each of two copies of a passage stand variants with seven words changed, too unlike it, that share most of its keys."""
    rng = random.Random(11)
    ps = [prose(rng, 60).split() for _ in range(25)]
    rows, want = [], []
    for p in ps:
        copies = []
        for _ in range(2):
            for k in (14, 22, 30, 38) * 3:
                rows.append(put(rng, [*p[:k], *prose(rng, 7).split(), *p[k + 7 :]]))
            copies.append(len(rows))
            rows.append(put(rng, p))
        want.append(tuple(copies))
    got = compact_windows.near_duplicate_passages(table(spark, list(enumerate(rows)))).collect()
    found = {(r.first_doc_id, r.doc_id) for r in got}
    assert len(found & set(want)) >= 24, len(found & set(want))


def test_links_within_a_tile():
    """Rows that ask are tied to what they resemble, settled or not; settled ones aren't compared with each other."""
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32) for _ in range(3))
    prints, settled = [a, b, a, b, c, c, b[:20]], np.array([True, False, True, False, True, True, False])
    got = compact_windows.tile_links(np.arange(7), settled, ~settled, prints, 46, 0.8)
    assert got == [(1, 3)]
    assert compact_windows.tile_links(np.arange(7), settled, ~settled, [b, *prints[1:]], 46, 0.8) == [(0, 1), (0, 3)]


def test_joint_keys_against_all_windows():
    """Every window of the least length lies within the range of a key for each two neighbouring functions."""
    rng = np.random.default_rng(2)
    low = (1 << compact_windows.BITS) - 1
    for _ in range(30):
        n, least = int(rng.integers(20, 60)), int(rng.integers(3, 12))
        values = [rng.integers(0, 1 << 60, n).astype(np.uint64) << np.uint64(3) | np.uint64(f) for f in range(3)]
        found = [compact_windows.compact_windows(v, np.array([n]), least) for v in values]
        value = np.concatenate([v[c] for v, (_, c, _) in zip(values, found, strict=True)]).view(np.int64)
        left, root, right = (np.concatenate([f[k] for f in found]) for k in range(3))
        keys, _, place = compact_windows.joint_keys(value, np.zeros(len(value), np.int64), left, root, right, least, 3)
        at, before, after = place >> 2 * compact_windows.BITS, place >> compact_windows.BITS & low, place & low
        got = list(zip((at - before).tolist(), (at + after).tolist(), strict=True))
        for i in range(n - least + 1):
            assert sum(lo <= i and i + least - 1 <= hi for lo, hi in got) >= 3


def test_op5_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op5_suffix_dedup(spark, d).collect()}
    for i, hit, kept in brute_repeats(rows, 100):
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(hit), hashlib.sha256(kept).hexdigest())


def test_pipeline_stages(spark):
    """Each stage against what its operator's own tests hold: columns stay, clean documents stay, decisions take effect."""
    rng = random.Random(9)
    clean = [(k, "\n".join(prose(rng, 12) + "." for _ in range(10))) for k in range(12)]
    near = clean[0][1].replace(clean[0][1].split()[50], "changed", 1)
    shared = prose(rng, 30)
    rows = [*clean, (20, None), (21, ""), (22, "too short"), (23, clean[0][1]), (24, near), (25, clean[1][1] + "\n" + shared + " " + prose(rng, 30) + "."), (26, prose(rng, 60) + " " + shared + "."), (27, prose(rng, 70) + " password=Zx81kQ07bbLmR2 end of it."), (None, clean[2][1])]
    docs, kept = table(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/nowhere").cache()
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = out.collect()
        docs = out
    ids = lambda name: sorted(r.doc_id for r in kept[name] if r.doc_id is not None)
    assert ids("quality_rules") == [*range(12), 23, 24, 25, 26, 27]
    assert ids("minhash_near_dedup") == [i for i in ids("quality_rules") if i not in (23, 24)]
    text = {r.doc_id: r.text for r in kept["suffix_array_dedup"]}
    before = [(r.doc_id, r.text) for r in sorted((r for r in kept["minhash_near_dedup"] if r.doc_id is not None), key=lambda r: r.doc_id)]
    assert {i: k.decode() for i, _, k in brute_repeats(before, 100)} == {i: t for i, t in text.items() if i is not None}
    assert all(r.n_chars == len(r.text) for r in kept["secret_scan"])
    assert "[SECRET]" in next(r.text for r in kept["secret_scan"] if r.doc_id == 27)
    assert sum(r.length for r in kept["packing"]) == sum(r.doc_tokens for r in kept["packing"] if r.start == 0)
    assert corpus_pipeline.STAGES[4][1](spark, table(spark, []), "").count() == 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, table(spark, []), "").count() == 0


def test_suffix_dedup_leaves_little_on_disk(spark, monkeypatch):
    """Windows of frequent seeds are found by one shuffle of hashes with a row for equal ones of a task; the texts are shuffled once for
    the result, and suffix arrays are gone by then."""
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(k, "".join(rng.choice("klmnop") for _ in range(rng.randrange(60))) + line + "".join(rng.choice("klmnop") for _ in range(rng.randrange(60)))) for k in range(60)]
    monkeypatch.setattr(suffix_dedup, "HELD", 4)
    stored, names, gone = suffix_dedup.stored, [], []
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: names.append(name) or stored(df, name))
    monkeypatch.setattr(suffix_dedup, "discard", gone.append)
    made = suffix_dedup.remove_repeats(table(spark, rows), 100)
    got = {r.doc_id: r for r in made.collect()}
    for i, hit, kept in brute_repeats(rows, 100):
        assert bytes(got[i].kept) == kept and sum(s.end - s.start for s in got[i].spans) == sum(hit)
    assert "hashed-runs" in names and "window-hashes" not in names and len(gone) == names.count("suffix-array") + 4
    assert made._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
