from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from conftest import SF, oracle, rows_of
from llm_cases import docs_of, edge_docs, empty_docs
from quillflow.llm import merkle, mixing, queries, warc_archive


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(oracle(SF, queries.ORACLES[name]))


# Archive

RECORDS = [(1, "H: 1", b"payload"), (2, "H: 2", b"payload"), (2, "H: 2", b"payload"), (3, None, b""), (4, "H: 4", None), (None, "H", bytes(range(256)) * 4000)]


def test_archive_rebuilds_every_record(spark, tmp_path):
    recs = spark.createDataFrame(RECORDS, "record_id long, header string, payload binary")
    headers, payloads = warc_archive.archive(recs)
    assert payloads.count() == 3
    warc_archive.write_archive(recs, str(tmp_path / "a"))
    for back in (warc_archive.reconstruct(headers, payloads), warc_archive.read_archive(spark, str(tmp_path / "a"))):
        rows = back.collect()
        want = [(i, None if p is None else (h or "").encode() + b"\r\n\r\n" + p + b"\r\n\r\n") for i, h, p in RECORDS]
        assert sorted(((r.record_id, None if r.record is None else bytes(r.record)) for r in rows), key=repr) == sorted(want, key=repr)
        assert all(r.verified for r in rows)
        assert {r.digest for r in rows if r.record_id in (1, 2)} == {hashlib.sha256(b"payload").hexdigest()}


def test_files_of_records_come_back_byte_for_byte(spark, tmp_path):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\ncontent-length:  12\r\n\r\nsome\r\n\r\nbody\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Record-ID:<urn:b>\r\nX: caf\xe9\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    three = one.replace(b"urn:a", b"urn:c")
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(three) + gzip.compress(two) + b"junk after")
    (tmp_path / "c.warc").write_bytes(one[:-10])
    (tmp_path / "d.warc").write_bytes(b"")
    recs = warc_archive.read_warc(spark, str(tmp_path))
    assert [(r.path[-6:], r.record_id, r.payload) for r in recs.filter("error is not null").collect()] == [("c.warc", "<urn:a>", None)]
    headers, payloads = warc_archive.archive(recs.filter("error is null"))
    assert headers.count() == 4 and payloads.count() == 2
    back = warc_archive.reconstruct(headers, payloads).collect()
    assert sorted(bytes(r.record) for r in back) == sorted([one, two, two, three]) and all(r.verified for r in back)


def test_a_changed_payload_is_seen(spark):
    from pyspark.sql import functions as F

    recs = spark.createDataFrame(RECORDS, "record_id long, header string, payload binary")
    headers, payloads = warc_archive.archive(recs)
    spoilt = payloads.withColumn("payload", F.when(F.col("length") == 7, F.lit(b"Payload")).otherwise(F.col("payload")))
    assert {r.record_id for r in warc_archive.reconstruct(headers, spoilt).filter("not verified").collect()} == {1, 2}
    lost = warc_archive.reconstruct(headers, payloads.limit(0)).filter("not verified")
    assert lost.count() == 5


def test_archive_of_pages_with_nulls_and_other_columns(spark):
    pages = spark.createDataFrame([(1, None, "x", 1, 2), (None, "u", None, 1, 2), (2, "u", "", 1, 2)], "page_id long, url string, html string, digest int, payload int")
    rows = warc_archive.reconstruct(*warc_archive.archive(warc_archive.records(pages))).collect()
    assert len(rows) == 3 and all(r.verified for r in rows) and sum(r.record is None for r in rows) == 1
    assert warc_archive.reconstruct(*warc_archive.archive(warc_archive.records(pages.limit(0)))).count() == 0


# Merkle trees


def tree(text: str):
    h = lambda kind, x: hashlib.sha256((kind + x).encode()).hexdigest()
    sections, now = [], []
    for p in text.split("\n"):
        now.append(h("P", p))
        if p == "" or now[-1][0] in "01":
            sections.append(now)
            now = []
    hashes = [h("S", ",".join(s)) for s in sections]
    if now:  # a section that the text's end cuts off has its last separator still
        sections.append(now)
        hashes.append(h("S", ",".join(now) + ","))
    return h("R", "".join(hashes)), hashes, sections


def test_trees_against_plain_hashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, ""), (-2, "\n\n"), (-3, "one\n" * 5000)], "doc_id long, text string"))
    got = defaultdict(list)
    for r in merkle.fingerprints(docs).collect():
        got[r.doc_id].append((r.section_no, r.root, r.section_hash, r.n_paragraphs))
    for r in docs.collect():
        root, hashes, sections = tree(r.text)
        assert sorted(got[r.doc_id]) == [(i, root, x, len(s)) for i, (x, s) in enumerate(zip(hashes, sections, strict=True))]


def test_differences_locate_edits(spark):
    lines = [f"paragraph {i} of this text" for i in range(200)]
    edited = [*lines[:50], "changed", *lines[51:120], "inserted", *lines[120:]]
    left = docs_of(spark, [(1, "\n".join(lines)), (2, "same"), (3, "gone"), (4, None), (6, "a\n\nb")])
    right = docs_of(spark, [(1, "\n".join(edited)), (2, "same"), (4, None), (5, "new"), (6, "b\n\na")])
    rows = merkle.differences(left, right).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id, r.side].append((r.section_no, r.paragraph_no))
    place = lambda text, n: next((i, k) for i, s in enumerate(tree(text)[2]) for k in range(len(s)) if sum(len(x) for x in tree(text)[2][:i]) + k == n)
    assert by[1, "left"] == [place("\n".join(lines), 50)]
    assert sorted(by[1, "right"]) == sorted([place("\n".join(edited), 50), place("\n".join(edited), 120)])
    assert by[3, "left"] == [(0, 0)] and by[5, "right"] == [(0, 0)] and not by[2, "left"] and not by[4, "left"]
    assert (6, "order") in by


def test_rows_without_id_have_no_differences(spark):
    docs = edge_docs(spark)
    one = docs.filter("doc_id is null or doc_id in (2, 3, 7)")
    assert merkle.differences(one, one).count() == 0
    assert {r.doc_id for r in merkle.differences(one, one.filter("doc_id = 3")).collect()} == {2, 7}


def test_trees_of_edge_rows(spark):
    rows = merkle.fingerprints(edge_docs(spark)).collect()
    assert sum(r.root is None for r in rows) == 2 and all(r.section_no is None for r in rows if r.root is None)
    assert merkle.fingerprints(empty_docs(spark)).count() == 0


# Mixing


def water(given: int, kids: list[tuple[str, int, int]]) -> dict[str, int]:
    """Budgets of children (name, capacity, weight): what one can't take goes to the others by weight."""
    out, open_ = {}, list(kids)
    while True:
        weight = sum(w for _, _, w in open_)
        full = [k for k in open_ if k[1] * weight <= given * k[2]]
        if not full:
            return out | {n: given * w // weight for n, _, w in open_} if open_ else out
        for n, c, _ in full:
            out[n] = c
            given -= c
        open_ = [k for k in open_ if k not in full]


def brute_budgets(leaves, plan):
    def weight(level, name):
        return dict(getattr(plan, level)).get(name, plan.other)

    usable = [(d, la, s, t) for d, la, s, t in leaves if t > 0 and all(weight(lv, n) > 0 for lv, n in (("domains", d), ("languages", la), ("sources", s)))]
    total = sum(t for *_, t in leaves) * plan.numerator // plan.denominator
    cap = lambda *p: sum(t for *x, t in usable if tuple(x[: len(p)]) == p) * plan.max_epochs
    out = {}
    top = water(total, [(d, cap(d), weight("domains", d)) for d in sorted({x[0] for x in usable})])
    for d, b in top.items():
        for la, b2 in water(b, [(la, cap(d, la), weight("languages", la)) for la in sorted({x[1] for x in usable if x[0] == d})]).items():
            for s, b3 in water(b2, [(s, cap(d, la, s), weight("sources", s)) for s in sorted({x[2] for x in usable if x[:2] == (d, la)})]).items():
                out[d, la, s] = b3
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_plain_filling(spark, seed):
    rng = random.Random(seed)
    leaves = [(f"d{d}", la, f"s{s}", rng.choice([0, 5, 100, 10_000, 1_000_000])) for d in range(4) for la in ("en", "de", "fr") for s in range(rng.randrange(1, 4))]
    plan = mixing.Plan(domains={"d0": 4, "d1": 3, "d2": 0}, sources={"s0": 7}, numerator=rng.choice([1, 3]), denominator=2)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, plan).collect()}
    want = brute_budgets(leaves, plan)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def brute_selection(rows: dict, plan) -> set[tuple[int, int]]:
    """(doc_id, epoch) of what is chosen, given the place and the tokens of each document."""
    per = defaultdict(int)
    for d, la, s, t in rows.values():
        per[d, la, s] += t
    budget = brute_budgets([(*k, t) for k, t in per.items()], plan)
    want = set()
    for leaf, b in budget.items():
        ids = [i for i, x in rows.items() if x[:3] == leaf]
        for epoch in range(b // per[leaf] + 1):
            rest = b - epoch * per[leaf]
            for i in sorted(ids, key=lambda i: hashlib.md5(f"{plan.seed}:{epoch}:{i}".encode()).hexdigest()):  # noqa: B023
                rest -= rows[i][3]
                if rest < 0:
                    break
                want.add((i, epoch))
    return want


def places_of(rows) -> dict:
    return {r.doc_id: (f"d{int(r.source[3:]) % 4}", r.lang, r.source, len(r.text.split())) for r in rows}


def test_selection_is_a_token_prefix_of_each_epoch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.Plan(domains={"d0": 9, "d1": 1}, numerator=2, denominator=1)
    want = brute_selection(places_of(docs.collect()), plan)
    got = {(r.doc_id, r._epoch) for r in mixing.select_documents(docs, plan).collect()}
    assert got == want and len(want) > 50


def test_a_column_of_the_table_may_be_the_domain(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("my domain", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("x"), F.col("doc_id") % 3)))
    plan = mixing.Plan(domains={"x1": 5, "x2": 0}, other=2, domain="my domain")
    want = brute_selection({i: (f"x{i % 3}" if i % 3 else "", *x[1:]) for i, x in places_of(docs.collect()).items()}, plan)
    got = {(r.doc_id, r._epoch) for r in mixing.select_documents(docs, plan).collect()}
    assert got == want and len(want) > 20 and not any(i % 3 == 2 for i, _ in got)


def test_mixing_of_edge_rows(spark):
    docs = edge_docs(spark)
    everything = mixing.Plan(numerator=3, denominator=1)
    out = mixing.select_documents(docs, everything, "the epoch")
    assert out.columns == [*docs.columns, "the epoch"]
    rows = out.collect()
    assert {r.doc_id for r in rows if r.text and r.text.strip()} == {1, 2, 6, 7}
    assert mixing.select_documents(empty_docs(spark)).count() == 0
