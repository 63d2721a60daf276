import base64
import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import decontaminate, personal, sentencepieces, tokencounts, toxicity, treeweight, warc

from .conftest import plain

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def model():
    return sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(model):
    import sentencepiece

    theirs, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.PieceCodec(model)
    rng = random.Random(1)
    marks = list("abcdeéü ▁\n\t中文😀\x00\x01　ﬁ½ß́한  ##!!")
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    pieces = list(own.ids)
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))).replace("▁", " ") for _ in range(2000)]
    texts += ["", " ", "\n", "a" * 20000, " " * 9000, "ab" * 9000, "hello world" * 900]
    for text in texts:
        ids = list(own.encode(text))
        assert ids == theirs.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == theirs.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == theirs.decode(ids)


def held_mb(work):
    """MB of Python objects that stay after some work."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[0] / 1e6
    finally:
        tracemalloc.stop()


def test_workers_remember_little(model, monkeypatch):
    """Whatever the number of different words, what a worker keeps of them is small beside its executor's memory."""
    own = sentencepieces.PieceCodec(model)
    texts = [" ".join(f"{i:06d}x" for i in range(start, start + 1000)) for start in range(0, 600_000, 1000)]
    assert held_mb(lambda: [own.encode(text) for text in texts] and None) < 70
    monkeypatch.setattr(toxicity, "_memo", {})
    assert held_mb(lambda: [toxicity.vector(toxicity.counted(text)) for text in texts[:250]] and None) < 40


def test_pieces_are_the_same_from_every_memo(model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "MEMO_CHUNKS", 7)
    theirs, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.PieceCodec(model)
    rng = random.Random(2)
    for _ in range(500):
        text = " ".join(f"wörd{min(rng.randrange(40), rng.randrange(40))}中" for _ in range(rng.randrange(30)))
        assert list(own.encode(text)) == theirs.encode(text, add_bos=True, add_eos=True)
        assert len(own.memo) <= 7 and len(own.older) <= 7


def test_round_trip_column(spark, docs, no_docs, model):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    trip = sentencepieces.round_trip(spark, F.col("text"), model)
    found = Counter((r.doc_id, r.t.n_tokens, r.t.ids_sha256, r.t.decoded_sha256) for r in docs.select("doc_id", trip.alias("t")).collect())
    expected = Counter()
    for key, text in plain(docs):
        ids = theirs.encode(text or "", add_bos=True, add_eos=True)
        back = theirs.decode(ids)
        expected[key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert found == expected
    assert no_docs.select(trip).count() == 0
    ids = docs.select("text", sentencepieces.encoded(spark, F.col("text"), model).alias("ids"))
    back = ids.select("text", sentencepieces.decoded(spark, F.col("ids"), model).alias("back"))
    assert back.where("coalesce(text, '') <> back").count() == 0


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_benchmark_items_are_found(spark, docs, no_docs):
    rng = random.Random(8)
    texts = {}

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))

    items = [(i, prose(rng.randint(10, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (None, prose(30)), (60, "word " * 40)]
    for i, (_, text) in enumerate(items[:12]):
        changed = list(text)
        for _ in range(rng.randint(0, int(len(text) * 0.13))):
            k = rng.randrange(len(changed))
            changed[k : k + 1] = rng.choice([[], ["q"], [changed[k], "z"]])
        texts[i] = prose(40) + " " + "".join(changed).replace(" ", "  ", 3) + " " + prose(40)
    texts[20] = prose(10) + items[3][1].upper() + prose(10) + items[4][1] + prose(200) + items[3][1]
    texts[21] = " ".join(items[5][1].split()[:12])
    texts[22] = ("word " * 3000).strip()
    texts[23] = "filler " * 160_000 + items[13 + 2][1]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS key", "3 AS start")
    rows = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, texts[20]), (24, None), (25, ""), (20, texts[20])], "doc_id long, text string")
    rows = rows.selectExpr("*", "1 AS item_id", "2 AS item", "3 AS edits")
    found = decontaminate.matches(rows, benchmark).collect()
    index = {i: decontaminate.passages(t) for i, t in items}
    expected = Counter()
    for key, text in plain(rows):
        if key == 23:
            expected[key, None] += 1
            continue
        chars = decontaminate.normal(text or "")[0].tolist()
        for item, parts in index.items():
            if any(least_edits(p.tolist(), chars) <= decontaminate.edits_allowed(len(p), 0.1) for p in parts):
                expected[key, item] += 1
    assert Counter((r.doc_id, r.item_id) for r in found) == expected
    whole = dict(plain(rows))
    for r in found:
        if r.doc_id is not None and r.doc_id != 23:
            place = decontaminate.normal(whole[r.doc_id][r.start : r.end])[0].tolist()
            assert min(least_edits(p.tolist(), place) for p in index[r.item_id]) == r.edits
    assert decontaminate.matches(no_docs, benchmark).count() == 0
    assert decontaminate.matches(rows, benchmark.where("item_id = 50")).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))) for i in range(6)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in items], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()} == {(i, i) for i in range(6)}


def test_short_items_stand_between_word_borders(spark):
    items = [(1, "Seven rivers?"), (2, "ja"), (3, "  "), (4, "seven  RIVERS?"), (5, "été 7")]
    rows = [(1, "which SEVEN\n rivers? none"), (2, "seven rivers"), (3, "eseven rivers?"), (4, "jaja ja"), (5, "ja"), (6, "jab aja"), (7, "(été 7)"), (8, "été 77")]
    rows += [(9, "x" * 600_000 + " ja " + "y" * 600_000), (10, None)]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in found.collect()}
    assert got == {(1, 1, 6, 20, 0), (1, 4, 6, 20, 0), (4, 2, 5, 7, 0), (5, 2, 0, 2, 0), (7, 5, 1, 6, 0), (9, 2, 600_001, 600_003, 0)}


def test_parts_of_items_are_found(spark):
    """Any 99 characters of a longer item hold a whole passage."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = prose(70)
    rows = [(i, f"{prose(9)} {item[(at := rng.randrange(len(item) - 99)) : at + 99]} {prose(9)}") for i in range(40)]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(40))


def test_repeating_texts_come_in_small_pieces():
    """A long run of dashes meets an item of dashes at every place; no piece has more than HITS shared grams."""
    index = decontaminate.Index.of([(1, "-" * 120), (2, "-" * 300), (3, "-=" * 90)], 0.1)
    assert len(index.texts) == 2 and sorted(map(sorted, index.owners)) == [[0, 1], [2]]
    chars = decontaminate.normal("-" * 600_000)[0]
    sizes = [int(shared[2].sum()) for _, _, shared in index.pieces(chars)]
    assert max(sizes) <= decontaminate.HITS and sum(sizes) > 20 * decontaminate.HITS
    assert [(i, a, b, c) for i, a, b, c in decontaminate.found_in("-" * 30_000, index)] == [(1, 0, 80, 0), (2, 0, 80, 0)]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(personal.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_personal_data(spark, docs, no_docs):
    rng = random.Random(6)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "001.02.255.0", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112"]
    parts += ["+1 (555) 123-4567", "+1", "+49 30 1234567890123", "é", "😀", ".", " ", "--", "12", "a", "\n", "_", "%", "0" * 16, "9@8.7.6.5"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [(1000, "1" * 50_000), (1001, "a" * 100_000 + "@"), (1002, "1-" * 30_000), (1003, "+1" + " 2" * 40_000), (1004, ("ab" * 500 + " ") * 50)]
    rows += [(None, "me@here.org"), (None, None), (5, "me@here.org"), (5, "me@here.org"), *plain(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS key", "3 AS kind", "4 AS marks", "5 AS value")
    found = personal.spans(frame, rounds=0)
    got = Counter((r.doc_id, tuple((s.start, s.end, s.kind) for s in r.spans if s.base)) for r in found.collect())
    assert got == Counter((key, tuple(base_spans(text or ""))) for key, text in rows)
    assert personal.spans(no_docs).count() == 0


def test_patterns_lead_to_unseen_identifiers(spark, tmp_path):
    rng = random.Random(4)

    def prose(n):
        return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n))

    rows = [(i, f"{prose(5)} please call {f'+1 (5{i:02d}) 555-0{i:03d}'} today {prose(4)}") for i in range(30)]
    rows += [(100 + i, f"{prose(4)} please call 555-01{i:03d} today {prose(3)} order number 77{i:04d}") for i in range(3)]
    rows += [(200 + i, f"{prose(4)} order number 99{i:04d} {prose(3)}") for i in range(20)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    frame = spark.read.parquet(path)
    found = {r.doc_id: [(s.start, s.end, s.kind, s.base) for s in r.spans] for r in personal.spans(frame).collect()}
    texts = dict(rows)
    for i in range(3):
        (span,) = found[100 + i]
        assert texts[100 + i][span[0] : span[1]] == f"555-01{i:03d}" and span[2:] == ("phone", False)
    assert all(not found[200 + i] for i in range(20))
    assert all(len(found[i]) == 1 and found[i][0][3] for i in range(30))
    hidden = {r.doc_id: r.text for r in personal.redacted(frame).collect()}
    assert all(" call <phone> today" in hidden[i] for i in [*range(30), 100, 101, 102])
    assert hidden[205] == texts[205]


def test_contexts_reach_over_other_numbers(spark, tmp_path):
    """Identifiers in groups of digits, and next to another number, have a context too."""
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n))
    rows = [(i, f"{prose(5)} room {i % 9} tel {f'+1 (5{i:02d}) 555-0{i:03d}'} now {prose(4)}") for i in range(30)]
    rows += [(100 + i, f"{prose(4)} room {i} tel 555 0{i} 77{i:03d} now {prose(3)}") for i in range(3)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if not s.base] for r in personal.spans(spark.read.parquet(path)).collect()}
    assert [found[100 + i] for i in range(3)] == [[f"555 0{i} 77{i:03d}"] for i in range(3)]
    assert not any(found[i] for i in range(30))


def test_rounds_go_on_until_nothing_is_new(spark, tmp_path):
    """Each stage of identifiers is known only through the stage before it; plain Python finds the same."""
    rng = random.Random(2)
    stages = 6
    name = lambda k, j: f"+49 (30) 1234-000{j}" if k == 0 else f"id{k}{j}-{(k * 7 + j) * 9173:06d}"
    rows = []
    for k in range(stages):
        for j in range(3):
            for value in [*(name(k, i) for i in range(3)), name(k + 1, j)]:
                rows.append((len(rows), f"stage{'abcdefgh'[k]}{'xyz'[j]} word {value} after{'abcdefgh'[k]}{'xyz'[j]} {'lorem ' * rng.randint(1, 3)}"))
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    frame = spark.read.parquet(path)
    whole = {r.doc_id for r in personal.spans(frame).collect() if r.spans}
    few = {r.doc_id for r in personal.spans(frame, rounds=3).collect() if r.spans}
    assert whole == set(range(len(rows))) and few < whole


def test_length_histogram(spark, docs, no_docs):
    import tiktoken

    ranks = sentencepieces.read_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    own = tokencounts.encoding(ranks, public_tokenizers.PATTERN)
    for text in ("a" + " " * 9000 + "b", " " * 9000, "a" + "\n" * 5000 + "\tb c", "x  " + " \n" * 3000 + "é" + " " * 5000):
        assert tokencounts.token_count(own, text) == len(whole.encode_ordinary(text))
    assert tokencounts.token_count(own, " " * 2_000_000 + "a") > 0
    lengths = [len(whole.encode_ordinary(t or "")) for _, t in plain(docs)]
    histogram = tokencounts.length_histogram(docs, tokencounts.counted(spark, F.col("text"), ranks, public_tokenizers.PATTERN))
    found = {r.n_tokens: (r.documents, r.documents_from, r.tokens_from, r.truncated_tokens) for r in histogram.collect()}
    assert found == {
        n: (k, sum(m >= n for m in lengths), sum(m for m in lengths if m >= n), sum(min(m, n) for m in lengths))
        for n, k in Counter(lengths).items()
    }
    limits = [0, 1, 17, 500, 10**6]
    for r in tokencounts.at_limits(histogram, limits).collect():
        kept = sum(min(m, r.context_limit) for m in lengths)
        cut = sum(m > r.context_limit for m in lengths)
        assert (r.documents_within, r.documents_cut) == (len(lengths) - cut, cut)
        assert (r.tokens_total, r.tokens_kept, r.tokens_lost) == (sum(lengths), kept, sum(lengths) - kept)
    for r in tokencounts.quantiles(histogram, [0, 0.1, 0.5, 0.9, 1]).collect():
        assert r.n_tokens == min(n for n in lengths if sum(m <= n for m in lengths) >= r.share * len(lengths))
    empty = tokencounts.length_histogram(no_docs, F.lit(1))
    assert empty.count() == 0 and tokencounts.at_limits(empty, [5]).count() == 0
    with pytest.raises(ValueError):
        tokencounts.at_limits(empty, [-1])


@pytest.mark.parametrize("least", [0, 20])
def test_archives(spark, tmp_path, least):
    import zstandard

    small = 3000
    rng = random.Random(2)
    bodies = ["<p>" + "".join(rng.choice("abc é\r\n\r\n") for _ in range(rng.randint(0, 900))) + "</p>" for _ in range(40)]
    rows = [(i, f"http://a/{i}?q=é\r\nb c", b) for i, b in enumerate(bodies)]
    rows += [(100 + i, None, bodies[i % 3]) for i in range(20)] + [(200, "u", None), (201, "u", ""), (None, "u", bodies[0]), (None, "u", "only here"), (5, "u", bodies[5]), (300, "u", "z" * 300_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS uri", "3 AS payload", "4 AS digest", "5 AS n")
    path = str(tmp_path / "warc")
    warc.write(frame, path, least_bytes=least, archive_bytes=small)
    found = warc.read(spark, path).collect()
    data = [(k, (t or "").encode()) for k, _, t in rows]
    top = {}
    for k, d in data:
        if k is not None and len(d) >= least:
            top[d] = max(top.get(d, k), k)
    expected = Counter()
    for k, d in data:
        revisit = d in top and k != top[d]
        expected[k, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if revisit else "response", top[d] if revisit else None, None if revisit else d] += 1
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r.key), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in found) == expected
    assert all("\r" not in (r.uri or "") for r in found)
    files = spark.read.format("binaryFile").load(path).collect()
    assert len(files) > 3
    for file in files:
        magic, size = int.from_bytes(file.content[:4], "little"), int.from_bytes(file.content[4:8], "little")
        assert magic == warc.DICTIONARY_MAGIC
        words = zstandard.ZstdCompressionDict(bytes(file.content[8 : 8 + size]))
        reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(bytes(file.content[8 + size :]), read_across_frames=True)
        assert reader.read().startswith(b"WARC/1.1\r\n")  # any reader of Zstandard gets through
    none = str(tmp_path / "none")
    warc.write(frame.where("page_id < 0"), none)
    assert warc.read(spark, none).count() == 0
    with pytest.raises(ValueError):
        list(warc.records(bytes(files[0].content[:-20])))


def test_toxicity(spark, docs, no_docs):
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice(["river", "stone", "walk", "green", "paper", "cloud", "under", "seven"]) for _ in range(n))

    rows = []
    for i in range(600):
        toxic = i % 4 == 0
        group = rng.choice(["muslims", "christians", "jews"] if not toxic else ["muslims"] * 4 + ["christians"])
        rows.append((i, f"{prose(6)} {group if i % 3 else 'people'} {'stupid scum ' if toxic else ''}{prose(6)}", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic", F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, 1, "x"), (1, None, "x")], "doc_id long, toxic int, text string"))
    own = frame.select("doc_id", "text", F.lit(0).alias("toxic"), F.lit(0).alias("label"))
    usable = labels.where(~toxicity.held_out())
    assert all(r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in usable.collect())
    fair, unfair = toxicity.train(own, usable, fairness=30.0), toxicity.train(own, usable, fairness=0.0)

    def gap(model):
        return max(abs(model.score(f"{a} walk") - model.score(f"{b} walk")) for a in ("muslims",) for b in ("christians", "jews"))

    assert gap(fair) < gap(unfair) / 3
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((fair.score(t) >= 0.3) == y for t, y in held) >= 0.97 * len(held)
    scored = docs.select("text", toxicity.scores(spark, F.col("text"), fair).alias("score")).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(abs(r.score - fair.score(r.text)) < 1e-12 for r in scored)
    assert toxicity.train(no_docs, usable).score("any") < 0.01
    assert toxicity.train(own, usable.where("toxic = 1")).score("any") > 0.99
    assert no_docs.select(toxicity.scores(spark, F.col("text"), fair)).count() == 0


def weighted_tree(texts, depth):
    """Straight context-tree weighting: log probability of a byte after others, from counts of all texts."""
    counts = Counter()
    for data in texts:
        padded = bytes(depth) + data
        for i in range(len(data)):
            for bit in range(8):
                node = (1 << bit) | data[i] >> (8 - bit)
                for d in range(depth + 1):
                    counts[padded[i + depth - d : i + depth], node, data[i] >> (7 - bit) & 1] += 1
    children = {}
    for context, node, _ in counts:
        if context:
            children.setdefault((context[1:], node), set()).add(context)

    def numbers(context, node):
        return counts[context, node, 0], counts[context, node, 1]

    def estimate(context, node):
        a, b = numbers(context, node)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighed(context, node):
        if (context, node) not in memo:
            own = estimate(context, node)
            if len(context) < depth:
                deeper = sum(weighed(c, node) for c in children.get((context, node), ()))
                top = max(own, deeper)
                own = top + math.log(math.exp(own - top) + math.exp(deeper - top)) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def chance(context, node):
        share, rest = 0.0, 1.0
        for d in range(depth + 1):
            own = context[len(context) - d :]
            a, b = numbers(own, node)
            stop = 1.0 if d == depth else math.exp(estimate(own, node) - weighed(own, node) - math.log(2))
            share, rest = share + rest * stop * (b + 0.5) / (a + b + 1), rest * (1 - stop)
        return share

    def score(data):
        padded, total = bytes(depth) + data, 0.0
        for i in range(len(data)):
            for bit in range(8):
                one = chance(padded[i : i + depth], (1 << bit) | data[i] >> (8 - bit))
                total += math.log10(one if data[i] >> (7 - bit) & 1 else 1 - one)
        return total

    return score


def test_tree_weighting(spark, docs, no_docs):
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    rows = [(k, (t or "")[:700].encode()) for k, t in plain(docs)]
    short = docs.withColumn("text", F.substring("text", 1, 700))
    learn = [d for k, d in rows if k is None or k % 3 != 1]
    score = weighted_tree(learn, 2)
    counts = Counter(w for d in learn for w in re.findall(rb"[^\x20\x09-\x0d]+", d.lower()))
    counts[None] = len(learn)
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for k, d in rows:
        tokens = [*re.findall(rb"[^\x20\x09-\x0d]+", d.lower()), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        expected.append((k is None, k or 0, len(d), len(tokens), sum(counts[t] > 0 for t in tokens), total, base, score(d)))
    for entries in (1 << 30, 700):  # in one part, and in several
        found = treeweight.score(short, ~held, depth=2, part_entries=entries).collect()
        got = [(r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found]
        for a, b in zip(sorted(got), sorted(expected), strict=True):
            assert a[:6] == b[:6] and np.allclose(a[6:], b[6:], rtol=1e-9, atol=1e-9), (a, b)
    assert treeweight.score(no_docs, F.lit(True)).count() == 0
    nothing = treeweight.score(short.where("doc_id = 3"), F.lit(False), depth=1).first()
    assert nothing.train_tokens == 0 and np.isclose(nothing.score, nothing.n_bytes * 8 * math.log10(0.5))
