from __future__ import annotations

from collections import Counter
from itertools import accumulate, combinations, pairwise
from math import exp

from conftest import SF
from llm_cases import edge_docs, empty_docs
from test_archive_merkle_mixing import brute_selection, places_of
from test_line_and_near_dedup import groups_of, weighted_jaccard, weights, words_of
from test_text_operators import plain_features

import corpus_pipeline
from quillflow.llm import decontaminate, mixing, near_dedup, quality, token_blocks


def test_stages_one_by_one_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "token_blocks"]

    good = {r.doc_id for r in quality.scores(docs, labels).filter(f"good >= {quality.KEEP}").collect()}
    now = docs.filter(docs.doc_id.isin(list(good)))
    gone = {r.doc_id for r in near_dedup.near_duplicates(now).collect()}
    now = now.filter(~now.doc_id.isin(list(gone)))
    bad = {r.doc_id for r in decontaminate.contaminated(now, bench).collect()}
    now = now.filter(~now.doc_id.isin(list(bad)))
    chosen = Counter(r.doc_id for r in mixing.select_documents(now).collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == chosen
    encode = token_blocks.tokenizer(token_blocks.VOCABULARY).encode_ordinary
    assert all(token_blocks.decode(bytes(r.data), r.block_starts) == encode(text[r.doc_id]) for r in rows)


def weight(words: list[str]) -> float:
    return sum(len(w.encode()) for w in words)


def pieces(words: list[str]) -> Counter:
    """Words and pairs of neighbours, with their weights, counted."""
    return Counter([((w,), weight([w])) for w in words] + [((v, w), weight([v, w]) / 2) for v, w in pairwise(words)])


def holds(words: list[str], item: list[str]) -> bool:
    """Whether any window matches an item. One of similarity 0.7 shares 0.4 at least of the weight of the item's words,
    which is that of its pairs at least; the others needn't be compared."""
    n, inside, want, least = len(item), {w: weight([w]) for w in item}, pieces(item), 0.4 * weight(item)
    if not n or not words:
        return False
    upto = [0, *accumulate(inside.get(w, 0) for w in words)]
    for a in range(max(1, len(words) - n + 1)):
        z = min(len(words), a + n)
        if upto[z] - upto[a] >= least and decontaminate.similarity(pieces(words[a:z]), want) >= decontaminate.THRESHOLD:
            return True
    return False


def test_run_is_that_of_plain_code(spark):
    """Each stage by other code than the operators': all pairs, every window, plain budgets. The classifier's training is
    tested by itself; here its features and sums are plain ones."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.trained(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text: str) -> bool:
        found = plain_features(text)
        z = [sum(share * float(model.table[c][b]) for b, share in found.items()) + float(model.bias[c]) for c in range(3)] if found else None
        e = [exp(x - max(z)) for x in z] if z else model.shares
        return e[0] / sum(e) >= quality.KEEP

    now = {i for i, r in docs.items() if good(r.text or "")}
    sets = {i: w for i in now if (w := weights(docs[i].text))}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if weighted_jaccard(sets[a], sets[b]) >= near_dedup.THRESHOLD]
    now -= {i for i, root in groups_of(near).items() if i != root}
    split = [words_of(t) for _, t in items]
    words = {i: words_of(docs[i].text) for i in now}
    now = {i for i in now if not any(holds(words[i], item) for item in split)}
    want = brute_selection(places_of(docs[i] for i in now), mixing.PLAN)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in want) and 20 < len(now) < len(docs)


def test_stages_take_any_documents(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        now = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == docs.columns
        now.count()
