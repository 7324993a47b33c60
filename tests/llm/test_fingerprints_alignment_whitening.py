"""Token alignment, whitening and SimHash fingerprints against brute force, and on odd rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netsift.llm import alignment, simhash, whitening
from netsift.llm.common import table
from netsift.llm.queries import op11_token_alignment, op12_whitening, op13_simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, n_chars bigint, fingerprint string, N_A string, top bigint"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (5, LONG), (5, "another text of id five"), (None, "the null id"),
    (None, None), (6, "ein Text über Bäume — und 漢字 😀 x\x00y <|endoftext|> </s> <0x41>"), (8, "a mark ▁ of its own"),
    (9, "  lead  and   runs \n\n of\tblanks  "), (10, "café ẛ̣ ﬁ"), (-3, "one"), (2**40, "x" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 7, "f", "n", 1) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_alignment(texts):
    """Each text encoded whole, overlaps by comparing byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_tokenizers()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    byte = alignment.byte_level()
    docs = []
    for text in texts:
        left, right = [], []
        if text:
            left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            for i in b.encode(text):
                t = b.id_to_piece(i)
                right.append((i, bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
                left, right = [], []
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, low = [], 0
        for i, s, e in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, i, j = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while i < len(spans[0]) and spans[0][i][2] <= end:
                ga.append(str(spans[0][i][0]))
                i += 1
            while j < len(spans[1]) and spans[1][j][2] <= end:
                gb.append(str(spans[1][j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((len(left), len(right), groups, links))
    count = Counter(x for *_, links in docs for x in links)
    top = Counter()
    for (_, b_id), n in count.items():
        top[b_id] = max(top[b_id], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "",
        )
        for n_a, n_b, groups, links in docs
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_matches_plain_encoding(spark, odd):
    got = [tuple(r) for r in op11_token_alignment(spark, SF).select("doc_id", *COLUMNS).collect()]
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = [(i, *x) for (i, _), x in zip(docs, plain_alignment([t for _, t in docs]), strict=True)]
    assert sorted(got) == sorted(want)
    got = [tuple(r) for r in alignment.aligned_documents(odd).select("doc_id", *COLUMNS).collect()]
    want = [(i, *x) for (i, _), x in zip(ODD, plain_alignment([t for _, t in ODD]), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(x[1] == 0 and t for x, (_, t) in zip(want, ODD, strict=True))


@pytest.mark.parametrize("max_pairs", [0, 40])
def test_rare_pairs_meet_their_counts_in_a_join(spark, max_pairs):
    docs = table(spark, SF, "documents")
    want = sorted(tuple(r) for r in alignment.aligned_documents(docs).collect())
    assert sorted(tuple(r) for r in alignment.aligned_documents(docs, max_pairs=max_pairs).collect()) == want


def test_long_documents_are_aligned_in_runs():
    encoder = alignment.PairEncoder(*alignment.default_tokenizers())
    texts = [LONG, "short text", "x" * 3000 + " " + LONG[:5000]]
    whole = list(alignment._steps(encoder, texts))
    step, alignment.STEP_BYTES = alignment.STEP_BYTES, 1000
    try:
        cut = list(alignment._steps(encoder, texts))
    finally:
        alignment.STEP_BYTES = step
    assert len(whole) == 1 and len(cut) > 100

    def per_doc(steps):
        spelled, counts = {}, {}
        for s in steps:
            for (i, _), text, c in zip(s.runs, s.spelled(), zip(*s.counts()), strict=True):
                spelled.setdefault(i, []).append(text)
                counts[i] = [x + int(y) for x, y in zip(counts.get(i, [0] * 4), c, strict=True)]
        return {i: b";".join(t) for i, t in spelled.items()}, counts

    assert per_doc(whole) == per_doc(cut)


def test_repeated_chunks_are_aligned_once(monkeypatch):
    rows, merge = [], alignment.pd.merge_asof
    monkeypatch.setattr(alignment.pd, "merge_asof", lambda left, *a, **k: rows.append(len(left)) or merge(left, *a, **k))

    def aligned(texts):
        rows.clear()
        spelled = [t for s in alignment._steps(alignment.PairEncoder(*alignment.default_tokenizers()), texts) for t in s.spelled()]
        assert len(spelled) == len(texts) and len(set(spelled)) == 1
        return sum(rows)

    text = "some words of a text, café and 漢字\nand some words of it again"
    assert 0 < aligned([text] * 300) == aligned([text])


@pytest.mark.parametrize(("chunks", "size"), [(40, 10**6), (0, 10**6), (10**6, 500)])
def test_forgotten_chunks_are_learned_again(monkeypatch, chunks, size):
    texts = [t for _, t in ODD if t != LONG] + [LONG[i : i + 900] for i in range(0, 20_000, 450)] + ["one", LONG[:900]]
    whole = alignment.PairSums(alignment.PairEncoder(*alignment.default_tokenizers()))
    whole.add(texts)
    whole.settle()
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", chunks)
    monkeypatch.setattr(alignment, "CACHE_BYTES", size)
    monkeypatch.setattr(alignment, "GROUP_CHARS", 1000)
    encoder, got = alignment.PairEncoder(*alignment.default_tokenizers()), {}
    for s in alignment._steps(encoder, texts):
        for (i, _), text, c in zip(s.runs, s.spelled(), zip(*s.counts()), strict=True):
            got[i] = (*map(int, c), hashlib.sha256(text).hexdigest())
    assert [got.get(i, (0, 0, 0, 0, "")) for i in range(len(texts))] == [(*x[:4], x[6]) for x in plain_alignment(texts)]
    assert len(encoder.known) < 400 < len({c for t in texts if t for c in alignment.chunks_of(t)})
    sums = alignment.PairSums(encoder)
    sums.add(texts)
    sums.settle()
    assert dict(zip(sums.codes.tolist(), sums.times.tolist())) == dict(zip(whole.codes.tolist(), whole.times.tolist()))


def test_uncut_encoding_gives_the_same():
    encoder = alignment.PairEncoder(*alignment.default_tokenizers())
    assert encoder.cuts
    texts = [t for _, t in ODD if t and t != LONG]
    cut = [s.spelled() for s in alignment._steps(encoder, texts)]
    encoder.forget()
    encoder.cuts = False
    assert [s.spelled() for s in alignment._steps(encoder, texts)] == cut


def test_alignment_of_nothing(spark, empty):
    assert alignment.aligned_documents(empty).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in alignment.aligned_documents(none).select("doc_id", *COLUMNS).collect()) == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""),
    ]
    shown = alignment.aligned_documents(spark.createDataFrame([(1, "of it")], "doc_id bigint, text string"), with_groups=True)
    row = shown.first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]


def plain_whitening(vectors, k=16):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) / n**3 for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    mean = np.array([[(n * v[i] - s[i]) / n for i in range(d)] for v in x])
    return n, [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x], mean @ w / np.sqrt(e), e / np.trace(cov)


def check_whitening(rows, vectors, k):
    n, deviation, white, explained = plain_whitening([v for _, v in vectors], k)
    assert len(rows) == len(vectors) * k
    by = {}
    for r in rows:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(k):
        mine = np.array([by[i, c + 1][0]["whitened"] for i, _ in vectors])
        sign = np.sign(mine @ white[:, c])
        np.testing.assert_allclose(mine * sign, white[:, c], atol=1e-7)
    for row, (i, _) in enumerate(vectors):
        for c in range(k):
            r = by[i, c + 1][0]
            assert r["n"] == n and int(r["deviation"]) == deviation[row]
            assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_matches_python_integers(spark):
    rng = np.random.default_rng(5)
    drawn = (rng.normal(size=(130, 7)) @ rng.normal(size=(7, 7)) * 3).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(drawn)]
    vectors += [(500, vectors[3][1]), (501, vectors[3][1])]
    odd = [(600, None), (601, [None] * 7), (602, [math.nan] + [0.0] * 6), (603, [math.inf] * 7), (604, [1.0, 2.0]), (605, [])]
    schema = "vec_id bigint, embedding array<float>, n int, x string, whitened string"
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in vectors + odd], schema).repartition(5)
    check_whitening(whitening.whitened_vectors(df).collect(), vectors, 7)
    check_whitening(whitening.whitened_vectors(df, components=3).collect(), vectors, 3)


def test_whitening_query_and_wide_ranges(spark):
    rows = op12_whitening(spark, SF).collect()
    kept = [(r[0], r[1]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    check_whitening(rows, kept[:], 16) if len(kept) <= 200 else None
    n, deviation, white, explained = plain_whitening_fast(kept)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == 16 * len(kept)
    for c in range(16):
        mine = np.array([got[i, c + 1]["whitened"] for i, _ in kept])
        np.testing.assert_allclose(mine * np.sign(mine @ white[:, c]), white[:, c], atol=1e-6)
    assert [got[i, 1]["deviation"] for i, _ in kept] == deviation and rows[0]["n"] == n
    wide = [(1, [1e6, -3.0]), (2, [-2e9, 5.0]), (3, [7.5, 1e12]), (4, [0.0, 0.25])]
    df = spark.createDataFrame(wide, "vec_id bigint, embedding array<double>")
    check_whitening(whitening.whitened_vectors(df).collect(), wide, 2)


def plain_whitening_fast(vectors, k=16):
    x = np.floor(64 * np.array([v for _, v in vectors], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = n * fit - s
    cov = (y.T @ y) / n**3
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    z = n * x - s
    return n, (z * z).sum(1).tolist(), (z / n) @ w / np.sqrt(e), e / np.trace(cov)


def test_whitening_without_directions(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whitened_vectors(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened_vectors(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], schema)
    assert {r["component"] for r in whitening.whitened_vectors(flat).collect()} == {1}


def h(data: bytes, seed: int) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def plain_fingerprint(text: str) -> int:
    import re

    votes, total = [0] * 256, 0
    terms = set()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        terms.add(h(w.encode(), 42) & ~15 | min(len(w), 12))
    for term in terms:
        weight = term & 15
        total += weight
        for part in range(4):
            # the hash of a row of two columns seeds the second with that of the first
            first = xxhash.xxh64(term.to_bytes(8, "little"), seed=42).intdigest()
            value = xxhash.xxh64(part.to_bytes(4, "little"), seed=first).intdigest()
            for b in range(64):
                votes[64 * part + b] += weight * (value >> b & 1)
    bits = [2 * v > total for v in votes]
    parts = [sum(bits[64 * p + b] << b for b in range(64)) for p in range(4)]
    return "".join(f"{p:016x}" for p in parts)


def plain_fingerprints(rows, radius=simhash.RADIUS, every=20):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t in order]
    prints = [plain_fingerprint(t) for t in texts]
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    out = []
    for k, (i, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        e = plain_fingerprint(edited)
        near = None
        if i is not None and i % every == 0:
            near = sum(far(prints[k], p) <= radius for p in prints) - 1
        out.append((
            i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k], e, 1 - far(prints[k], e) / 256,
            1 - far(prints[k], prints[(k + 1) % len(texts)]) / 256, near,
        ))
    return out


def test_fingerprints_match_plain_python(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op13_simhash(spark, SF).collect())
    assert got == sorted(plain_fingerprints(docs))
    likeness = np.array([r[5:7] for r in got])
    assert likeness[:, 0].mean() > likeness[:, 1].mean() + 0.1


def test_fingerprints_of_odd_rows(spark, odd, empty):
    want = sorted(plain_fingerprints(ODD, every=2), key=repr)
    for per_range in (1, 2, 1000):
        got = simhash.document_fingerprints(odd, every=2, rows_per_range=per_range)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert simhash.document_fingerprints(empty).collect() == []
    one = spark.createDataFrame([(7, "a single text of its own")], "doc_id bigint, text string")
    assert simhash.document_fingerprints(one).first()["near_next"] == 1.0


@pytest.mark.parametrize(("radius", "blocks"), [(0, None), (3, None), (8, None), (3, 5)])
def test_all_fingerprints_within_the_radius_are_found(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63 - 1, (30, 4))
    rows = []
    for k in range(600):
        bits = np.unpackbits(base[k % 30].astype(np.int64).view(np.uint8))
        flip = rng.choice(256, rng.integers(0, 2 * radius + 2), replace=False)
        bits[flip] ^= 1
        rows.append(np.packbits(bits).view(np.int64).tolist())
    rows += rows[:50]
    schema = "f0 bigint, f1 bigint, f2 bigint, f3 bigint"
    df = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame(rows[::7] + [[None, 1, 1, 1]], schema)
    value = [int.from_bytes(np.array(r, np.int64).tobytes(), "little") for r in rows]
    got = {tuple(r)[:4]: r["n_within"] for r in simhash.within_radius(df, queries, radius, blocks).collect()}
    assert got == {
        tuple(rows[k]): sum((value[k] ^ v).bit_count() <= radius for v in value) for k in range(0, len(rows), 7)
    }


def test_main_path_is_native(spark):
    plan = simhash.document_fingerprints(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert simhash.fingerprints(spark.createDataFrame([(1, None)], "k int, text string"), ["k"]).select(
        F.col("f0")
    ).first()["f0"] == 0
