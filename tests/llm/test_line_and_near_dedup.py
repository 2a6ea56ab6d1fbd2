from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm_cases import LONG, docs_of, edge_docs, empty_docs
from quillflow.llm import components, line_dedup, near_dedup
from quillflow.llm.textcore import chunks


def groups_of(pairs):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


# Union-find


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_plain_union_find(spark, seed):
    rng = random.Random(seed)
    chain = [(i, i + 1) for i in range(0, 60)]  # a long path takes the most rounds
    pairs = chain + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (3, 4)]
    df = spark.createDataFrame([*pairs, (None, 5)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in components.components(df).collect()}
    want = {x: r for x, r in groups_of(pairs).items() if x != r}
    assert got == want


def test_components_of_binary_nodes(spark):
    pairs = [(1, 2), (5, 4), (2, 9), (300, 299)]
    name = lambda i: i.to_bytes(16, "big")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary").repartition(3)
    got = {bytes(r.node): bytes(r.root) for r in components.components(df).collect()}
    assert got == {name(2): name(1), name(9): name(1), name(5): name(4), name(300): name(299)}


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Near duplicates


def words_of(text: str) -> list[str]:
    out, word = [], ""
    for c in (text or "").lower():
        if ord(c) >= 128 or c.isalnum():
            word += c
        else:
            if word:
                out.append(word)
            word = ""
    return [*out, word] if word else out


def weights(text: str) -> dict[tuple, float]:
    w = words_of(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else {}
    return {g: 1 + log2(n) for g, n in grams.items()}


def weighted_jaccard(x: dict, y: dict) -> float:
    low = sum(min(v, y[k]) for k, v in x.items() if k in y)
    high = sum(x.values()) + sum(y.values()) - low
    return low / high if high else 0.0


def test_signatures_agree_as_often_as_the_weighted_jaccard_says():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(200)] + ["again"] * 9
    texts = [" ".join(base)]
    for share in (0.02, 0.05, 0.1, 0.2, 0.4):
        texts.append(" ".join(w if rng.random() > share else rng.choice(vocabulary) for w in base))
    chunk = next(chunks(pa.array(texts)))
    row, element, weight = near_dedup.weighted_shingles(chunk.words())
    sign = near_dedup.dart_minhash(row, element, weight, len(texts), 4096)
    for i, j in combinations(range(len(texts)), 2):
        want = weighted_jaccard(weights(texts[i]), weights(texts[j]))
        assert abs((sign[i] == sign[j]).mean() - want) < 0.04


def test_signature_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["one two three four five", "", "x", "one two three four five " * 300]
    alone = [near_dedup.dart_minhash(*near_dedup.weighted_shingles((w := next(chunks(pa.array([t]))).words())), w.n)[0] for t in texts]
    words = next(chunks(pa.array(texts))).words()
    assert (near_dedup.dart_minhash(*near_dedup.weighted_shingles(words), 4) == np.array(alone)).all()


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: weights(r.text) for r in docs.select("doc_id", "text").collect()}
    rng = random.Random(5)
    some = sorted(texts)[:60]
    planted = []
    raw = {r.doc_id: r.text for r in docs.collect()}
    for i, d in enumerate(some):  # copies at several distances, so that there are enough to measure recall
        w = raw[d].split()
        for j, share in enumerate((0.01, 0.03, 0.06, 0.1)):
            planted.append((10_000 + 10 * i + j, " ".join(x if rng.random() > share else "zzz" for x in w)))
    every = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    texts |= {d: weights(t) for d, t in planted}
    got = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(every).collect()}
    root = lambda d: got.get(d, d)
    near = far = found = edge = 0
    for a, b in combinations(sorted(d for d in texts if texts[d]), 2):
        s = weighted_jaccard(texts[a], texts[b])
        if s >= near_dedup.THRESHOLD:
            near += 1
            found += root(a) == root(b)
            edge += s < 0.6
        elif s < 0.2 and root(a) == root(b):
            far += 1
    assert near > 100 and edge > 20 and found >= 0.97 * near
    assert far <= 0.01 * near
    assert all(keep < d and keep not in got for d, keep in got.items())


def test_near_duplicates_of_a_large_group_and_of_edge_rows(spark):
    same = "the quick brown fox jumps over the lazy dog and then runs far away from here"
    rows = [(i, same + (" indeed" if i % 2 else "")) for i in range(300)] + [(900, None), (901, ""), (902, "?!"), (None, same), (903, "word"), (904, "WORD."), (903, "word")]
    got = {r.doc_id: r.duplicate_of for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 904: 903}
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_exact_similarity_of_texts():
    rng = random.Random(2)
    a = [" ".join(rng.choices("one two three four".split(), k=rng.randrange(0, 60))) for _ in range(200)]
    b = [" ".join(w for w in t.split() if rng.random() > 0.1) for t in a]
    a, b = [x or "x" for x in a], [x or "y" for x in b]
    got = near_dedup.weighted_jaccard(pa.array(a), pa.array(b))
    assert np.allclose(got, [weighted_jaccard(weights(x), weights(y)) for x, y in zip(a, b, strict=True)])


def test_texts_of_one_doc_id_are_judged_by_themselves(spark):
    one, two, three = (f"{x} was the first word of a sentence that goes on about {x} and the {x} of old" for x in ("north", "south", "wheat"))
    docs = docs_of(spark, [(1, one), (5, one), (5, two), (5, two), (6, three), (7, two)])
    assert {(r.doc_id, r.duplicate_of) for r in near_dedup.near_duplicates(docs).collect()} == {(5, 1), (7, 5)}
    out = near_dedup.drop_near_duplicates(spark, docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, one), (5, two), (6, three)]


def test_a_hot_bucket_of_near_copies(spark):
    rng = random.Random(4)
    base = [rng.choice([f"w{i}" for i in range(80)]) for _ in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([0, 1, 3, 6])):
            words[rng.randrange(60)] = f"z{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    w = {i: weights(t) for i, t in rows}
    root = groups_of([(a, b) for a, b in combinations(w, 2) if weighted_jaccard(w[a], w[b]) >= near_dedup.THRESHOLD])
    want = {i for i, r in root.items() if i != r}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got & want) >= 0.99 * len(want) and len(want) > 200 and not got - want


def test_dropping_keeps_columns_of_any_name(spark):
    docs = edge_docs(spark)
    out = near_dedup.drop_near_duplicates(spark, docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2 and ids[4] == 1
    assert near_dedup.drop_near_duplicates(spark, empty_docs(spark)).count() == 0


# Lines

LONG_LINE = " ".join(LONG.format(i) for i in range(4_000)).strip()


def shingles(line: str) -> frozenset[bytes]:
    raw = line.encode()
    return frozenset(raw[i : i + 8] for i in range(max(1, len(raw) - 7)))


def test_lines_against_all_pairs(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij  ") for _ in range(rng.randrange(30, 120))).strip() for _ in range(40)]
    rows, made = [], []
    for i in range(120):
        lines = []
        for _ in range(4):
            line = rng.choice(base)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            lines.append(line)
        made.append(lines)
        rows.append((i, "\n".join(lines)))
    distinct = sorted({line.strip().lower() for lines in made for line in lines} - {""})
    sets = {x: shingles(x) for x in distinct}
    near = [(a, b) for a, b in combinations(distinct, 2) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    root = groups_of(near)
    first: dict = {}
    want = set()
    for i, lines in enumerate(made):
        for j, line in enumerate(lines):
            if line.strip():
                g = root.get(line.strip().lower(), line.strip().lower())
                if g in first:
                    want.add((i, j))
                else:
                    first[g] = (i, j)
    got = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert len(want) > 200 and len(got & want) >= 0.95 * len(want) and not got - want


def test_lines_of_edge_rows(spark):
    rows = [(1, "Same line here\n\n same LINE here \nother"), (2, None), (3, ""), (None, "Same line here"), (4, "other"), (4, "other"), (5, "ab"), (6, "AB"), (7, LONG_LINE), (8, LONG_LINE + "y"), (9, "x" * 100_000)]
    got = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
    assert got == {(1, 2, 1, 0), (4, 0, 1, 3), (6, 0, 5, 0), (8, 0, 7, 0)}
    assert line_dedup.duplicate_lines(empty_docs(spark)).count() == 0


def test_lines_dropped_from_texts(spark):
    docs = docs_of(spark, [(1, "keep me please\nTwice told tale\n"), (2, "Twice told tale\nand more of it"), (3, None), (4, "")])
    out = line_dedup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "keep me please\nTwice told tale\n", 2: "and more of it", 3: None, 4: ""}


def test_line_jaccard_is_exact():
    rng = random.Random(1)
    a, b = ["abcdefghijkl", "short", "", "äöüäöüäöü", "a", "x" * 300, LONG_LINE], ["abcdefghijkx", "short", "x", "äöüäöüäöß", "a\0", "x" * 20, LONG_LINE + "y"]
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        at = rng.randrange(len(text) + 1)
        a.append(text)
        b.append(text[:at] + rng.choice(["", "x", "abca"]) + text[at:])
    lines = line_dedup.Lines([x.encode() for x in a + b])
    got = line_dedup.jaccard(lines, np.arange(len(a)), np.arange(len(a)) + len(a))
    want = [len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, want)


def test_line_spans_are_those_of_split():
    texts = ["one\n  two \n\n three", "", "\n", "x", "\n\ny\n", "  ", "z\n", None, "a\r\nb"]
    chunk = next(chunks(pa.array(texts)))
    got = [(r, n, chunk.data[s:e].tobytes().decode()) for r, n, s, e in zip(*(x.tolist() for x in line_dedup.line_spans(chunk.data, chunk.offsets)), strict=True)]
    want = [(r, n, line.strip(" ")) for r, t in enumerate(texts) for n, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    assert got == want


def test_lines_of_edge_documents_are_dropped(spark):
    docs = edge_docs(spark)
    out = line_dedup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
    assert {(2, ""), (3, None), (4, ""), (None, None)} < texts and {t for i, t in texts if i == 1} == {t for i, t in texts if i is None and t}
    assert line_dedup.drop_duplicate_lines(empty_docs(spark)).count() == 0


def test_a_hot_bucket_links_all_its_lines(spark):
    """Batches of few rows, so that heads of heads, lines that fail and those below a head that fails all occur."""
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefghij  ") for _ in range(100)).strip()
    rows = []
    for i in range(400):
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            line[rng.randrange(len(line))] = rng.choice("uvwxyz")
        rows.append((i, "".join(line)))
    sets = {i: shingles(t.strip()) for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    root = groups_of(near)
    want = {i for i, r in root.items() if i != r}
    for records in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = {(r.doc_id, r.line_no) for r in line_dedup.duplicate_lines(docs_of(spark, rows)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got & {(i, 0) for i in want}) >= 0.99 * len(want) and not got - {(i, 0) for i in want}
