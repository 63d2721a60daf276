import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash

from wardline.llm import passages, quantised, simhash, suffixes
from wardline.llm.graph import components
from wardline.llm.shared import Scratch

from .conftest import classes, plain


def test_components_follow_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(500, n) for n in range(600, 640)] + [(7, 7), (9, 8), (8, 9), (9, None)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(90)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components(frame, Scratch(spark)).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert found == classes(real, {n for link in real for n in link})
    assert components(frame.where("a < 0"), Scratch(spark)).count() == 0


def fingerprint(text, n=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall("[^\x20\x09-\x0d]+", lower)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + n]) for i in range(max(1, len(parts) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, no_docs):
    rows = plain(docs)
    prints = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = classes(links, range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    expected = Counter((key, prints[i], least.get(root[i])) for i, (key, _) in enumerate(rows))
    found = simhash.near_groups(docs, words=3, differing=2).collect()
    assert Counter((r.doc_id, r.print % (1 << 64), r.component) for r in found) == expected
    assert simhash.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("differing", [0, 1, 2])
def test_links_of_crowded_buckets(spark, differing, monkeypatch):
    """Bucket sizes on both sides of the switch give the links that connect what pairs connect."""
    monkeypatch.setattr(simhash, "PAIRWISE", 6)
    rng = random.Random(11)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)}
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(30, 36) for b in range(40, 46)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = Scratch(spark)
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), differing, scratch)
    got = [(r.a, r.b) for r in found.collect()]
    real = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= differing]
    assert classes([x for x in got if x[0] != x[1]], signed) == classes(real, signed)


def test_one_of_each_near_group_stays(stored, no_docs):
    rows = stored.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = classes(links, range(len(rows)))
    first = {}
    for i, r in enumerate(rows):
        order = (r.doc_id is None, r.doc_id or 0)
        first[root[i]] = min(first.get(root[i], order), order)
    kept = simhash.without_near_copies(stored)
    assert kept.columns == stored.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(first.values())
    assert simhash.without_near_copies(no_docs).count() == 0


def kept_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = Counter()
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(b for b, g in zip(d, gone) if not g)
        out[key, len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "gram", "crowd"), [(400, 64, 1000), (60, 16, 1000), (60, 16, 2)])
def test_repeated_strings(docs, no_docs, monkeypatch, length, gram, crowd):
    """With a crowd of 2 nearly all anchors go through the cutting of ranges."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    found = suffixes.without_repeats(docs, length=length, gram=gram).collect()
    assert Counter(tuple(r) for r in found) == kept_bytes(plain(docs), length)
    if crowd == 2:
        assert suffixes.without_repeats(no_docs).count() == 0


def shared_words(rows, n):
    """Words of each row in a run of ``n`` words that another row has too."""
    parts = [(t or "").encode().split() for _, t in rows]
    owners = {}
    for i, p in enumerate(parts):
        for j in range(len(p) - n + 1):
            owners.setdefault(tuple(p[j : j + n]), set()).add(i)
    out = []
    for p in parts:
        held = [j for j in range(len(p) - n + 1) if len(owners[tuple(p[j : j + n])]) > 1]
        out.append(len({w for j in held for w in range(j, j + n)}))
    return out


@pytest.mark.parametrize(("words", "shingle"), [(50, 25), (12, 5)])
def test_words_that_texts_share(spark, docs, no_docs, words, shingle, monkeypatch):
    """Passages of 50 to 60 words have fewer than 400 bytes here; pieces are shorter than the long text."""
    monkeypatch.setattr(passages, "PIECE", 700)
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40)) for _ in range(n))
    common = [prose(n) for n in (49, 50, 51, 60)]
    rows = [(i, f"{prose(rng.randint(0, 40))} {common[i % 4]} {prose(rng.randint(0, 40))}") for i in range(40)]
    rows += [(100, prose(3000) + "\n" + common[3] + "\t" + prose(900)), (101, common[2] + " " + common[2]), (102, f"{common[0]} {common[0]}"), *plain(docs)]
    scratch = Scratch(spark)
    frame = spark.createDataFrame([(i, (t or "").encode()) for i, (_, t) in enumerate(rows)], "row long, data binary")
    found = {r.row: r.n_shared_words for r in passages.shared_words(scratch.keep(frame), scratch, words, shingle).collect()}
    expected = shared_words(rows, words)
    assert found == {i: n for i, n in enumerate(expected) if n}
    whole = suffixes.without_repeats(docs, words=words).collect()
    own = plain(docs)
    assert Counter((r.doc_id, r.n_shared_words) for r in whole) == Counter((k, n) for (k, _), n in zip(own, shared_words(own, words)))
    assert suffixes.without_repeats(no_docs, words=words).count() == 0


def test_suffix_order_and_pieces():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    texts += [t[:40] for t in texts[:50]] + [b"a" * n for n in range(80)]
    for limit in (0, 16, 200):
        order = suffixes.deep_shallow(texts, 0, limit)
        assert [texts[i] for i in order] == sorted(texts)
    data = bytes(rng.choice(b"abc") for _ in range(3000)) + b"z" * 900
    whole = list(suffixes.anchors(data, 100, 20))
    starts = sorted(s for place, _, low, high in whole for s in range(place - high, place - low + 1))
    assert starts == list(range(len(data) - 100 + 1))


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * 0.28).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(4)] + [(200, [0.0] * 12), (201, None), (202, []), (203, [1.0, None] + [0.5] * 10)]
    rows += [(204, [float("nan")] * 12), (205, [float("inf")] * 12), (None, rows[3][1]), (206, rows[5][1][:7]), (207, rows[5][1][:7])]
    rows += [(208, [1e-200 * x for x in rows[8][1]]), rows[9], (209, [-0.0] + rows[10][1][1:]), (210, [0.0] + rows[10][1][1:])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS gid", "3 AS n", "4 AS vector")
    valid = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: quantised.unit(np.array([rows[i][1]]))[0] for i in valid}
    links = [(i, j) for i, j in combinations(valid, 2) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    degree = Counter(i for link in links for i in link)
    root = classes(links, range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    expected = Counter((k, degree[i], least.get(root[i]), k == least.get(root[i])) for i, (k, _) in enumerate(rows))
    found = Counter(tuple(r) for r in quantised.near_vectors(frame).collect())
    assert found == expected  # so few lists are all probed, so recall is whole
    assert quantised.near_vectors(frame.where("vec_id < 0")).count() == 0
    assert {tuple(r) for r in quantised.near_vectors(frame.where("vec_id = 201")).collect()} == {(201, 0, 201, True)}


def test_links_count_once(spark, monkeypatch):
    """Small blocks and many lists: every link is found, and none is counted twice."""
    monkeypatch.setattr(quantised, "FILED_BLOCK", 5)
    monkeypatch.setattr(quantised, "ASKING_BLOCK", 7)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(12, 16)) * 0.2 for c in centres])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = quantised.unit(x)
    near = unit @ unit.T >= 0.9
    degree = near.sum(axis=1) - 1
    found = {r.vec_id: r.n_links for r in quantised.near_vectors(frame).collect()}
    assert found == dict(enumerate(degree.tolist()))


def test_links_of_a_large_group_are_whole(spark):
    """Most rows are near copies of each other, over more lists than a few probes reach."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=64) / 8
    x = np.concatenate([base + rng.normal(size=(1000, 64)) * 0.029, rng.normal(size=(500, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = quantised.unit(x)
    near = unit @ unit.T >= 0.9
    root = classes([(i, j) for i, j in zip(*np.nonzero(near)) if i < j], range(len(x)))
    found = {r.vec_id: (r.n_links, r.component_id) for r in quantised.near_vectors(frame).collect()}
    assert near[:1000, :1000].mean() > 0.99
    assert found == {i: (near[i].sum() - 1, root[i]) for i in range(len(x))}


def test_angles_between_lists_are_computed_once_and_single_precision_loses_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))
    x[150:] = x[:150] + 0.45 * rng.normal(size=(150, 24)) * rng.uniform(0.5, 1.5, size=(150, 1))
    rows = quantised.unit(x)
    index = quantised.fit(x[:200], 17)
    home = index.nearest(rows, 1)[:, 0]
    regions = quantised.Regions.of(index, 0.9, np.bincount(home, minlength=17).astype(float), np.full(17, 0.1))
    assert regions.apart is regions.apart and regions.near is regions.near
    codes = index.code(rows - index.centres[home])
    left_out = np.sqrt(((rows - index.centres[home] - index.approximate(codes)) ** 2).sum(axis=1))
    block = pd.DataFrame({
        "gid": np.arange(300), "length": 24, "vector": list(x), "home": home, "codes": list(codes.astype(np.int32)),
        "left_out": left_out, "region": 0,
    })
    exact = np.array([[(a * b).sum() for b in rows] for a in rows])
    # The limit is one of the cosines, and lies between two that are next to each other.
    values = np.sort(exact[np.triu_indices(300, 1)])
    for cosine in (values[-40], np.nextafter(values[-40], 2), values[-5000]):
        want = {(i, j) for i, j in zip(*np.nonzero(exact >= cosine)) if i < j}
        assert set(zip(*(found.tolist() for found in quantised.linked(block, block, index, cosine)))) == want


def test_words_are_hashed_by_the_bytes_of_many(monkeypatch):
    """Equal words have one hash wherever they stand, however the words are dealt, and no call is made for a word."""
    parts = [b"a", b"b", b"ab", b"a" * 300, b"a" * 300, b"\xc3\xa9", b"b", b"ba", b"a"] * 50
    whole = passages.word_hashes(parts)
    monkeypatch.setattr(passages, "WORDS_TOGETHER", 7)
    assert (passages.word_hashes(parts) == whole).all() and len(passages.word_hashes([])) == 0
    assert len(set(whole.tolist())) == len(set(parts))
    assert all(len({h for h, p in zip(whole.tolist(), parts) if p == word}) == 1 for word in set(parts))
    monkeypatch.setattr(passages, "xxhash", None)
    places, prints = passages.winnowed(parts, 10, 5)
    assert len(places) == len(prints) > 0
