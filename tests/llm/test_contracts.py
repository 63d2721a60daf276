"""Every registered query over a folder whose tables hold nulls, empty texts, repeated rows and columns of any name."""
import base64
import hashlib
import zlib
from collections import Counter
from itertools import combinations

import pytest

from wardline.llm.queries import QUERIES

from .conftest import CLASHING, DOCS, classes, plain
from .test_duplicates import fingerprint, kept_bytes, shared_words
from .test_texts import base_spans

pytest.importorskip("public_tokenizers")


def clashing(frame, *more):
    for name in (*CLASHING, *more):
        if name not in frame.columns:
            frame = frame.selectExpr("*", f"1 AS `{name}`")
    return frame


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = [(900, "mail a.b@c.de or 1.2.3.4, card 4111 1111 1111 1111, tel +1 (555) 123-4567 é", None, None, None), (901, "9@8.7.6.5", "", "", 9)]
    clashing(docs.unionByName(spark.createDataFrame(extra, DOCS), allowMissingColumns=True), "ids", "score", "held_out").write.parquet(f"{path}/documents.parquet")
    pages = [(1, "http://a/ b", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, None, "<p>one</p>"), (5, "é\r\nX: y", "ü" * 3000)]
    clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "payload", "digest", "revisit").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(i % 3), 1.0, float(i)], 0) for i in range(12)] + [(20, None, None), (21, [0.0, 0.0, 0.0], None), (None, [1.0, 2.0, 3.0], 1), (3, [0.0, 1.0, 3.0], 0)]
    clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).write.parquet(f"{path}/embeddings.parquet")
    items = [(1, "aaaa bbbb " * 20), (2, None), (None, ""), (3, "one")]
    clashing(spark.createDataFrame(items, "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, i % 2) for i in range(20)] + [(None, None, 1), (3, None, None), (4, 0, 0)]
    clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "text").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return plain(spark.read.parquet(f"{folder}/documents.parquet"))


def crc(key, modulo, rest):
    return key is not None and zlib.crc32(str(key).encode()) % modulo == rest


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_take_any_table_and_no_rows(spark, folder, name, tmp_path):
    assert QUERIES[name](spark, folder).collect() is not None
    for table in ("documents", "pages", "embeddings", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_op1(spark, folder, rows):
    prints = [fingerprint(t) for _, t in rows]
    root = classes([(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    found = QUERIES["op1_simhash"](spark, folder)
    assert found.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r)[:3] for r in found.collect()) == Counter((k, f"{p:016x}", least.get(root[i])) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def test_op2(spark, folder, rows):
    found = QUERIES["op2_suffixes"](spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in found) == kept_bytes(rows, 400)
    assert Counter((r.doc_id, r.n_shared_words) for r in found) == Counter((k, n) for (k, _), n in zip(rows, shared_words(rows, 50)))


def test_op6(spark, folder, rows):
    found = QUERIES["op6_personal"](spark, folder).collect()
    expected = Counter()
    for key, text in rows:
        spans = base_spans(text or "")
        kinds = Counter(k for *_, k in spans)
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        expected[key, *(kinds[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in found) == expected
    assert all(set(listed.split(",")) <= set(r.spans.split(",")) for r in found for listed in [r.spans] if r.n_added == 0)


def test_op8(spark, folder):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    top = {}
    for key, data in pages:
        if key is not None:
            top[data] = max(top.get(data, key), key)
    expected = Counter()
    for key, data in pages:
        revisit = data in top and key != top[data]
        expected[key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top[data] if revisit else None] += 1
    assert Counter(tuple(r) for r in QUERIES["op8_warc"](spark, folder).collect()) == expected


def test_op9(spark, folder, rows):
    found = QUERIES["op9_toxicity"](spark, folder).collect()
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((k, crc(k, 4, 2)) for k, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)


def test_op10(spark, folder, rows):
    """Empty and null texts have a row, with score 0 and no bits per byte."""
    found = QUERIES["op10_treeweight"](spark, folder).collect()
    tokens = Counter()
    for key, text in rows:
        if not crc(key, 5, 1):
            tokens.update([*(text or "").encode().lower().split(), None])
    expected = Counter()
    for key, text in rows:
        own = [*(text or "").encode().lower().split(), None]
        expected[key, crc(key, 5, 1), len(own), sum(tokens[t] > 0 for t in own), sum(tokens.values())] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found) == expected
    assert all((r.bits_per_byte is None) == (r.n_bytes == 0) == (r.score == 0) for r in found)
