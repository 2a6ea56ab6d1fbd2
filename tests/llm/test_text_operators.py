from __future__ import annotations

import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from llm_cases import LONG, docs_of, edge_docs, empty_docs
from quillflow.llm import decontaminate, licenses, pii, quality, token_blocks
from quillflow.llm.textcore import chunks, span_hashes

LONG_TEXT = "".join(LONG.format(i) for i in range(20_000))


def words_of(text: str):
    return next(chunks(pa.array([text], pa.large_string()), limit=1 << 62)).words()


# Personal data

FINDS = [
    ("write to jane.doe+x@mail.example.org, please", "email", "jane.doe+x@mail.example.org"),
    ("see https://user:pw@example.com:8080/a?b=(c). Then", "url", "https://user:pw@example.com:8080/a?b=(c)"),
    ("from www.example.net/x, or", "url", "www.example.net/x"),
    ("host 192.168.10.254 is up", "ipv4", "192.168.10.254"),
    ("number 123-45-6789 given", "ssn", "123-45-6789"),
    ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"),
    ("card 4111111111111111.", "card", "4111111111111111"),
    ("call +44 20 7946 0958 now", "phone", "+44 20 7946 0958"),
    ("call (555) 010-1234 now", "phone", "(555) 010-1234"),
    ("pay to GB82 WEST 1234 5698 7654 32 soon", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("my account number: 12345678 there", "account", "12345678"),
    ("api_key = sk_test_0123456789abcdef", "secret", "sk_test_0123456789abcdef"),
    ("passport no. AB1234567 lost", "passport", "AB1234567"),
    ("x" * 80 + "@example.com", "email", "x" * 80 + "@example.com"),
    ("apiKey=abcd1234efgh", "secret", "abcd1234efgh"),
    ('"accessKey": "sk_live_0123456789"', "secret", "sk_live_0123456789"),
    ("SECRET_KEY = wJalrXUtnFEMI7", "secret", "wJalrXUtnFEMI7"),
    ("at 2001:db8::ff00:42:8329, up", "ipv6", "2001:db8::ff00:42:8329"),
    ("at [fe80::1]: up", "ipv6", "fe80::1"),
    ("ping 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", "ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ("see (http://example.com/a_(b)c))) now", "url", "http://example.com/a_(b)c"),
]
CLEAN = ["a @ b and x@y and @handle", "version 1.2.3.4.5 or 300.1.1.1", "4111 1111 1111 1112 fails", "000-12-3456 and 666-12-3456", "in 1999 there were 12,345 of 67", "http:// nothing", "the secret of the password is out", "+1 2", "an account of 2020", "GB00 WEST 1234 5698 7654 32", "at 12:30:45 or 00:1A:2B:3C:4D:5E", "std::vector<a::b>", "x@" + "a." * 130 + "org", "http://" + "a" * 600]


@pytest.mark.parametrize(("text", "kind", "value"), FINDS)
def test_personal_data_is_found_with_its_bounds(text, kind, value):
    found = pii.find(text)
    assert [(k, text[a:b]) for a, b, k in found] == [(kind, value)]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_has_no_finds(text):
    assert pii.find(text) == []


def brute_finds(text: str) -> list:
    """Every anchor by comparison at every place, every parser by itself, then the rule for overlaps."""
    hits = []
    for at in range(len(text)):
        for word, kind in pii.ANCHORS.items():
            piece = text[at : at + len(word)]
            if len(piece) == len(word) and all(c == w or c.isascii() and c.lower() == w for c, w in zip(piece, word, strict=True)):
                if kind != "digit" or not (at and text[at - 1] in pii.DIGITS):
                    hits.append((at + len(word), -len(word), kind, at))
    found: list = []
    for end, _, kind, at in sorted(hits):
        if found and at < found[-1][1]:
            continue
        if got := pii.parse(text, kind, at, end, pii.Runs()):
            while found and got[0] < found[-1][1]:
                found.pop()
            found.append(got)
    return found


def test_finds_are_those_of_every_parser_at_every_place():
    rng = random.Random(8)
    pieces = [v for _, _, v in FINDS] + CLEAN + ["token", "secret", "=", ": ", " ", ".", "-", "@", "://", "www.", "+", "::", ":", "(", ")", "]", "9", "12", "password", "number", "\u0130", "ß", "é", "\n", "a"]
    some = 0
    for _ in range(600):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        want = brute_finds(text)
        assert pii.find(text) == want, text
        some += bool(want)
    assert some > 200


def test_addresses_and_numbers_are_those_of_patterns():
    rng = random.Random(9)
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    patterns = {
        "ipv4": rf"(?<![\w.-]){octet}(?:\.{octet}){{3}}(?![\w-])(?!\.[0-9])",
        "ssn": r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])",
        "email": r"(?<![\w.%+'-])[a-z0-9](?:[a-z0-9]|[.-](?=[a-z0-9]))*@(?:[a-z0-9]+\.)+[a-z]{2,}(?![\w.@-])",
    }
    seen = dict.fromkeys(patterns, 0)
    made = {
        "ipv4": lambda: ".".join(str(rng.choice([0, 1, 9, 10, 99, 200, 255, 256, 300, "01"])) for _ in range(rng.choice([3, 4, 4, 4, 5]))),
        "ssn": lambda: f"{rng.choice(['123', '321', '555', '000', '666', '900', '12'])}-{rng.choice(['45', '54', '99', '00', '1'])}-{rng.choice(['6789', '1234', '0001', '0000', '678'])}",
        "email": lambda: f"{rng.choice(['ab', 'a.b', 'a-b.c', 'x1'])}@{rng.choice(['b', 'b.org', 'b.c.de', 'b.1', 'b..org'])}",
    }
    for _ in range(5000):
        kind = rng.choice(list(made))
        text = rng.choice(["", "see ", "(", "a", "-"]) + made[kind]() + rng.choice(["", " ", ",", ")", "x", "-"])
        want = [(m.start(), m.end(), kind) for m in re.finditer(patterns[kind], text)]
        got = [x for x in pii.find(text) if x[2] == kind]
        if kind == "email" and ("-" in text[:1] or text.endswith("-")):
            continue  # the pattern doesn't know which hyphens an address leaves out
        assert got == want, text
        seen[kind] += bool(want)
    assert min(seen.values()) > 50


@pytest.mark.parametrize("unit", ["a://", "1.", "http://a.com/)", "token=", "secret", "www.,", "www.:", "a@", "1:", "a:", "1 ", "+1 ", "12-", "(", "AB12 ", "account ", "secret     "])
def test_work_is_linear_in_the_text(unit):
    def seconds(n: int) -> float:
        text = ("http://a.com/" if unit.endswith(")") else "") + (")" * n if unit.endswith(")") else unit * (n // len(unit)))
        best = 9e9
        for _ in range(3):
            start = time.process_time()
            pii.find(text)
            best = min(best, time.process_time() - start)
        return best

    seconds(1000)
    assert seconds(160_000) < 16 * max(0.005, seconds(20_000))


def test_personal_data_over_tables(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (None, "a@b.org"), (3, "a@b.org"), (3, "a@b.org"), (4, LONG_TEXT + "a@b.org")])
    got = sorted(((r.doc_id, r.start, r.end, r.value) for r in pii.personal_data(docs).collect()), key=repr)
    n = len(LONG_TEXT)
    assert got == sorted([(3, 0, 7, "a@b.org"), (3, 0, 7, "a@b.org"), (4, n, n + 7, "a@b.org"), (None, 0, 7, "a@b.org")], key=repr)
    assert pii.personal_data(empty_docs(spark)).count() == 0
    assert pii.personal_data(edge_docs(spark)).count() == 0


# Token blocks


def test_blocks_round_trip_exactly():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 255, 256, 257, 1000)] + [np.full(600, 7, np.uint32), np.array([0, 2**32 - 1] * 200, np.uint32), np.minimum(rng.geometric(0.01, 5000), 2**20).astype(np.uint32)]
    counts = np.array([len(r) for r in rows])
    data, size, starts, blocks = token_blocks.encode(np.concatenate(rows), counts)
    at, b = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(blocks)])
    for i, row in enumerate(rows):
        own = data[at[i] : at[i + 1]].tobytes()
        assert token_blocks.decode(own, starts[b[i] : b[i + 1]].tolist()) == row.tolist()
    few = np.array([1, 2, 3, 60_000] + [4] * 60, np.uint32)
    data, *_ = token_blocks.encode(few, np.array([64]))
    assert int.from_bytes(data[7:9].tobytes(), "little") == 1 and data[6] <= 3  # one exception, narrow blocks


def plain_block(ids: list[int]) -> bytes:
    """A block by the layout's words, a bit at a time."""
    least = min(ids)
    rest = [x - least for x in ids]
    width = sorted(rest)[-(-9 * len(rest) // 10) - 1].bit_length()
    over = [i for i, x in enumerate(rest) if x.bit_length() > width]
    bits = sum((x & ((1 << width) - 1)) << (i * width) for i, x in enumerate(rest))
    out = least.to_bytes(4, "little") + len(ids).to_bytes(2, "little") + bytes([width]) + len(over).to_bytes(2, "little")
    out += bits.to_bytes((len(ids) * width + 7) // 8, "little")
    return out + b"".join(i.to_bytes(2, "little") for i in over) + b"".join(rest[i].to_bytes(4, "little") for i in over)


def test_blocks_are_those_of_a_plain_packer():
    rng = random.Random(3)
    for _ in range(150):
        rows = [[rng.choice([rng.randrange(50), rng.randrange(50_000), 2**32 - 1, 0]) for _ in range(rng.choice([0, 1, 9, 10, 11, 255, 256, 257, 700]))] for _ in range(rng.randrange(1, 4))]
        data, size, starts, blocks = token_blocks.encode(np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows]))
        want = [[plain_block(r[i : i + token_blocks.BLOCK]) for i in range(0, len(r), token_blocks.BLOCK)] for r in rows]
        assert data.tobytes() == b"".join(x for r in want for x in r)
        assert size.tolist() == [sum(map(len, r)) for r in want] and blocks.tolist() == [len(r) for r in want]
        assert starts.tolist() == [sum(map(len, r[:i])) for r in want for i in range(len(r))]


def test_tokens_of_edge_documents(spark):
    docs = edge_docs(spark)
    assert token_blocks.token_blocks(docs).count() == docs.count()


def test_tokens_of_documents_round_trip(spark):
    docs = edge_docs(spark).select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = token_blocks.token_blocks(docs).collect()
    encode = token_blocks.tokenizer(token_blocks.VOCABULARY).encode_ordinary
    want = sorted((str(r.doc_id), encode(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), token_blocks.decode(bytes(r.data), r.block_starts)) for r in rows) == want
    assert all(r.n_tokens == 0 or len(r.block_starts) == -(-r.n_tokens // token_blocks.BLOCK) for r in rows)
    assert token_blocks.token_blocks(empty_docs(spark)).count() == 0


# Quality


def test_held_out_accuracy(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.filter("quality is not null and toxic is not null").dropDuplicates(["doc_id"])
    held = known.filter("doc_id % 4 = 0")
    scored = quality.scores(docs.join(held, "doc_id", "left_semi"), known.filter("doc_id % 4 <> 0"), training=docs)
    rows = scored.join(held.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    assert len(rows) > 300
    truth = np.array([r.quality == 1 and r.is_toxic == 0 for r in rows])
    kept = np.array([r.good >= quality.KEEP for r in rows])
    toxic = np.array([r.is_toxic == 1 for r in rows])
    assert (truth == kept).mean() > 0.9
    assert kept[truth].mean() > 0.95 and kept[toxic].mean() < 0.12
    abuse = set("trash worthless disgusting idiot pathetic loser stupid scum clown moron".split())
    text = {r.doc_id: set(r.text.lower().replace(".", " ").replace(",", " ").split()) for r in docs.join(held, "doc_id", "left_semi").collect()}
    plain = np.array([bool(text[r.doc_id] & abuse) for r in rows])  # many labelled toxic have no such word
    assert plain[toxic].sum() > 30, plain[toxic].sum()
    assert kept[toxic & plain].mean() < 0.07, kept[toxic & plain].mean()  # 0.03 isn't reached: see the README


def plain_features(text: str) -> dict[int, float]:
    """Buckets and their shares, a byte at a time."""
    found, before = [], None
    for token in re.findall(rb"[^\x00-\x20]+", text.lower().encode()):
        marked = b" " + token + b" "
        for size in quality.GRAMS:
            for i in range(len(marked) - size + 1):
                code = int.from_bytes(marked[i : i + size], "big") + (size << 56)
                if i or size < len(marked):  # the whole token with both marks is a feature by itself
                    found.append((code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 46)
        raw = np.frombuffer(token, np.uint8)
        found.append(int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) >> 46)
        if token == before:
            found.append(0)
        before = token
    return {b: n / len(found) for b, n in Counter(found).items()}


def test_training_is_plain_gradient_descent():
    rng = random.Random(4)
    words = "river town market bread spam win win cash idiot loser quiet evening über straße".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(24)]
    classes = [i % 3 for i in range(24)]
    docs = [plain_features(t) for t in texts]
    for got, want in zip(quality.counted(pa.array(texts)), docs, strict=True):
        assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == pytest.approx(want)
    least = quality.least_documents(24)
    often = {b for d in docs for b in d if sum(b in x for x in docs) >= least}
    docs = [{b: s for b, s in d.items() if b in often} for d in docs]
    order = np.random.default_rng(1)
    vectors = {b: v.astype(float).tolist() for b, v in enumerate((order.random((quality.BUCKETS, quality.WIDTH), np.float32) - 0.5) / quality.WIDTH) if b in often}
    wide = range(quality.WIDTH)
    layer, past_layer = [[0.0] * 3 for _ in wide], [[1e-8] * 3 for _ in wide]
    bias, past = [np.log(1 / 3)] * 3, dict.fromkeys(often, 1e-8)
    for epoch in range(quality.EPOCHS):
        rate = quality.RATE * (1 - epoch / quality.EPOCHS)
        for i in order.permutation(24):
            d = docs[i]
            if not d:
                continue
            mean = [sum(s * vectors[b][w] for b, s in d.items()) for w in wide]
            z = [bias[c] + sum(mean[w] * layer[w][c] for w in wide) for c in range(3)]
            e = [np.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (c == classes[i]) for c, x in enumerate(e)]
            back = [sum(layer[w][c] * p[c] for c in range(3)) for w in wide]
            for w in wide:
                for c in range(3):
                    past_layer[w][c] += (mean[w] * p[c]) ** 2
                    layer[w][c] -= rate * mean[w] * p[c] / past_layer[w][c] ** 0.5
            for b, s in d.items():
                past[b] += s * s * sum(x * x for x in back)
                for w in wide:
                    vectors[b][w] -= rate * s / past[b] ** 0.5 * back[w]
            bias = [bias[c] - 0.1 * rate * p[c] for c in range(3)]
    model = quality.train(texts, classes)
    for text, d in zip(texts, [plain_features(t) for t in texts], strict=True):
        if not d:
            continue
        z = [bias[c] + sum(s * sum(vectors[b][w] * layer[w][c] for w in wide) for b, s in d.items() if b in often) for c in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(model.probabilities(pa.array([text]))[0], e / e.sum(), atol=1e-4)


def test_a_few_documents_teach_something():
    texts = ["a fine calm day by the river", "the market of the old town", "bread and cheese in the evening", "win cash now win", "click to win cash", "cash cash win prizes now"]
    model = quality.train(texts, [0, 0, 0, 1, 1, 1])
    p = model.probabilities(pa.array(["an evening by the old river", "win win cash"]))
    assert p[0, 0] > 0.8 and p[1, 1] > 0.8


def test_scores_of_a_text_are_those_of_its_features():
    texts = ["good good text here", "bad spam!!", "", "the end of a good day " * 2000]
    model = quality.train(texts[:2] * 20, [0, 1] * 20)
    together = model.probabilities(pa.array(texts))
    alone = np.concatenate([model.probabilities(pa.array([t])) for t in texts])
    assert np.allclose(together, alone) and np.allclose(together.sum(axis=1), 1)
    assert together[0, 0] > 0.9 and together[1, 1] > 0.9 and np.allclose(together[2], model.shares)


def test_quality_of_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (None, 1, 1), (6, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    assert quality.scores(docs, labels).count() == docs.count()
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.keep_good(empty_docs(spark), labels).count() == 0


def test_labels_without_a_text_do_not_use_up_the_training_sample(spark):
    ids = spark.range(quality.TRAIN + 2000).selectExpr("id doc_id", "int(id % 2) quality", "int(id % 5 = 0) toxic", "xxhash64(id) h")
    last = ids.orderBy("h", ascending=False).limit(42).collect()[::-1]  # behind TRAIN others by hash
    rows = [(r.doc_id, f"text of {r.doc_id}") for r in last[2:]] + [(last[0].doc_id, None), (last[1].doc_id, ""), (1_000_000, "no label")]
    want = [(f"text of {r.doc_id}", 2 if r.toxic else 1 - r.quality) for r in last[2:]]
    labels = ids.drop("h")
    for most in (quality.TRAIN, 10):
        got = [(r.text, r["class"]) for r in quality.sample(docs_of(spark, rows), labels, most).collect()]
        assert sorted(got) == sorted(want[:most])


# Licenses


def brute_licenses(text: str) -> set[int]:
    """Templates contained in any window of the width that the library uses for them, by plain sets."""
    lib = licenses.library(licenses.TEMPLATES)
    pairs = licenses.pair_hashes(words_of(text)).tolist()
    out = set()
    for t, own in enumerate(lib.sets):
        width = next(w for w in lib.widths if w >= lib.sizes[t])
        for a in range(max(1, len(pairs) - width + 2)):
            if len(own.intersection(pairs[a : a + width - 1])) >= licenses.CONTAINMENT * len(own):
                out.add(t)
                break
    return out


def test_licenses_against_every_window():
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(500)]
    found = missed = 0
    for t, (_, template) in enumerate(licenses.TEMPLATES):
        for kind in range(4):
            body = template.split()
            if kind and len(body) > 12:
                for _ in range(kind * len(body) // 60):
                    body[rng.randrange(len(body))] = "altered"
            text = " ".join([*rng.choices(filler, k=rng.randrange(5, 400)), *body, *rng.choices(filler, k=rng.randrange(5, 400))])
            got = {x[1] for x in licenses.matches(words_of(text), licenses.library(licenses.TEMPLATES))}
            want = brute_licenses(text)
            assert got <= want
            if t in want:  # of overlapping templates the largest match stays, which is the planted one
                found += t in got
                missed += t not in got
    assert found >= 0.95 * (found + missed) and found > 60


def test_a_short_text_holds_a_template_whose_pairs_repeat():
    lib = licenses.Library((("x", "la la la la la la la la la la di da"),))
    assert [x[1] for x in licenses.matches(words_of("la la di da"), lib)] == [0]
    assert licenses.matches(words_of("di da"), lib) == []


def test_licenses_of_edge_documents(spark):
    from pyspark.sql import functions as F

    docs = edge_docs(spark).withColumn("text", F.when(F.col("doc_id") == 1, F.lit(licenses.TEMPLATES[1][1])).otherwise(F.col("text")))
    assert [(r.doc_id, r.license) for r in licenses.license_matches(docs).collect()] == [(1, "MIT")] * 2


def test_licenses_of_edge_rows(spark):
    mit = licenses.TEMPLATES[1][1]
    docs = docs_of(spark, [(1, None), (2, ""), (3, "MIT"), (4, mit), (4, mit), (None, mit), (5, LONG_TEXT + mit), (6, "these words mean nothing of the kind at all")])
    got = sorted(((r.doc_id, r.license) for r in licenses.license_matches(docs).collect()), key=repr)
    assert got == sorted([(4, "MIT"), (4, "MIT"), (5, "MIT"), (None, "MIT")], key=repr)
    assert licenses.license_matches(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="three words"):
        licenses.Library((("x", "too short"),))


# Benchmark items


def brute_items(text: str, items: list[tuple[int, str]]) -> dict[int, float]:
    words = words_of(text)
    parts = decontaminate.features(words)
    out: dict[int, float] = {}
    for i, item in items:
        own = words_of(item)
        n, m = len(own.hashes), len(words.hashes)
        if not n or not m:
            continue
        want = decontaminate.multiset(*decontaminate.features(own), 0, n)
        best = max(decontaminate.similarity(decontaminate.multiset(*parts, a, min(m, a + n)), want) for a in range(max(1, m - n + 1)))
        if best >= decontaminate.THRESHOLD:
            out[i] = round(best, 6)
    return out


def test_items_against_every_window(spark):
    rng = random.Random(9)
    vocabulary = [f"{c}{i}" for c in ("alpha", "be", "gamma", "d", "epsilons") for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 15, 30, 60])))) for i in range(40)]
    rows = []
    for d in range(160):
        body = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if d % 4:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 1 + len(item) // 6)):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = item
        rows.append((d, " ".join(body)))
    want = {(d, i): s for d, t in rows for i, s in brute_items(t, items).items()}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert len(want) > 80 and len(got.keys() & want.keys()) >= 0.97 * len(want) and not got.keys() - want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got.keys() & want.keys() if want[k] > 0.9)


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 64, (3000, decontaminate.LANES), dtype=np.uint64)

    def flipped(row: np.ndarray, bits: int) -> np.ndarray:
        raw = np.unpackbits(row.view(np.uint8))
        raw[rng.choice(len(raw), bits, replace=False)] ^= 1
        return np.packbits(raw).view(np.uint64)

    radius = decontaminate.RADIUS
    queries = np.stack([flipped(items[i], bits) for i, bits in enumerate([0, 1, 30, radius - 1, radius, radius + 1, radius + 9] * 20)])
    for some in (items, items[:150]):  # more values in a table than in a ball, and fewer
        index = decontaminate.HammingIndex(some)
        q, i = index.near(queries)
        far = np.bitwise_count(queries[:, None] ^ some).sum(axis=2)
        assert list(zip(q.tolist(), i.tolist(), strict=True)) == list(zip(*(x.tolist() for x in np.nonzero(far <= radius)), strict=True))
        assert 80 <= len(q) and index.seen < 0.2 * len(queries) * len(some) + 20 * len(q)


def test_an_item_is_found_in_few_words():
    item = "a " * 19 + "x" * 400
    bench = decontaminate.Benchmark((1,), (item,))
    text = "a " + "x" * 400
    assert [x[:4] for x in decontaminate.matches(words_of(text), bench)] == [(0, 1, 0, 1)]
    assert brute_items(text, [(1, item)]) and not decontaminate.matches(words_of("a a a"), bench)


def test_the_benchmark_is_worked_off_in_slices(spark):
    items = [(i, f"which of the {i} rivers flows north past the old copper mill of number {i * 7}") for i in range(30)]
    bench = spark.createDataFrame([*items, (99, "x" * 5000)], "item_id long, text string")
    parts = list(decontaminate.slices(bench, 500))
    assert len(parts) > 5 and sorted(i for ids, _ in parts for i in ids) == [*range(30), 99]


def test_items_of_edge_rows(spark):
    item = "which of the seven rivers flows north past the old copper mill"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "?"), (None, "lonely item of words without any number here")], "item_id long, text string")
    docs = docs_of(spark, [(1, None), (2, ""), (3, item), (3, item), (4, LONG_TEXT + item.upper()), (5, "of the seven"), (None, item)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(3, 1), (4, 1), (None, 1)}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(empty_docs(spark), bench).count() == 0
    edge = edge_docs(spark)
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["1", "2", "5", "None"]
