import random

import pytest

#: Column names that operators use themselves; an input may have them too.
CLASHING = "key row n print component kind value start end node a b text_a size gid home label item learn data marks spans at v text2".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, white space, long words and other scripts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    own = [words(rng, rng.randint(30, 300), vocabulary) for _ in range(25)]
    passage = words(rng, 120, vocabulary)
    out = own + own[:4] + [own[5].replace(" ", "\n"), own[6].upper(), own[7] + " end", own[8][:-3]]
    out += [f"{t[:200]} {passage} {t[200:400]}" for t in own[9:15]]
    near = own[10].split(" ")
    for _ in range(5):
        changed = list(near)
        changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
        out.append(" ".join(changed))
    out += [None, "", " ", "\t\n\x0b", "one", "Two words", "x" * 5000, "ab " * 1500, "日本語 テキスト 😀", "a\u0000b\x1cc d"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows with a null key, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (None, None, None, None, None), rows[2], rows[2]]
    frame = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"1 AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory, spark):
    """The same rows as a table, for operators that read it twice."""
    path = str(tmp_path_factory.mktemp("docs") / "docs.parquet")
    docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def plain(rows):
    return [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]


def classes(links, nodes):
    """The smallest node that links reach, by node."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
