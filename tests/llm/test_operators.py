"""Each operator against brute force, a round trip or held-out labels, and on odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsift.llm import (
    hnsw_links,
    language,
    line_rules,
    mixing,
    order_minhash,
    preferences,
    record_files,
    unigram,
    url_filter,
    weak_quality,
)
from netsift.llm.common import salted_join, table
from netsift.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_score string, DIGEST string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None, None, None, None, "a", "b"),
    (2, "", "en", "s", 0, None, None),
    (3, " \n\t ", "en", "s", 3, None, None),
    (4, "one", None, "s", 3, None, None),
    (5, LONG, "en", "t", len(LONG), None, None),
    (5, LONG, "en", "t", len(LONG), None, None),
    (None, "the null id has a text of its own here.", "en", None, 1, None, None),
    (6, "ein Text über Bäume — und 漢字 😀 ▁", "de", "t", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows(df):
    return [tuple(r) for r in df.collect()]


def groups_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(900 + i, 901 + i) for i in range(40)]
    got = dict(rows(connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a bigint, b bigint"))))
    real = [e for e in edges if e[0] != e[1]]
    assert got == groups_of(real, {n for e in real for n in e})
    assert not rows(connected_components(spark.createDataFrame([], "a bigint, b bigint")))


@pytest.fixture
def broadcasts_to(spark):
    """Sets the broadcast threshold for one test."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def ran(df):
    """The rows, and the plan that gave them."""
    return rows(df), df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_copies_of_a_salted_join_count_in_its_size(spark, broadcasts_to, how):
    many = spark.range(6_000).selectExpr("nullif(id % 2500, 7) AS k", "id AS row")
    few = spark.range(2_000).selectExpr("id AS k", "cast(id AS string) AS name")
    want = Counter(rows(many.join(few, "k", how)))
    broadcasts_to("-1")
    assert Counter(rows(salted_join(many, few, ["k"], "row", how))) == want
    broadcasts_to("45000")  # one copy of few is below it, all are above, and so is many
    got, plan = ran(salted_join(many, few, ["k"], "row", how))
    assert Counter(got) == want and "BroadcastHashJoin" not in plan
    got = rows(salted_join(many, few.where("k < 5"), ["k"], "row", how))
    assert len(got) == (15 if how == "inner" else 6_000)


def test_salted_join_still_broadcasts_a_small_table(spark, broadcasts_to):
    broadcasts_to("45000")
    many = spark.range(6_000).selectExpr("id % 25 AS k", "id AS row")
    got, plan = ran(salted_join(many, spark.range(20).selectExpr("id AS k"), ["k"], "row"))
    assert len(got) == 4_800 and "BroadcastHashJoin" in plan


def test_addresses_are_not_broadcast_in_copies(spark, broadcasts_to):
    broadcasts_to("200k")
    pages = spark.range(4_000).selectExpr("id AS page_id", "concat('http://a.example.net/fr/', id) AS url", "'<p>' AS html")
    got, plan = ran(url_filter.url_verdicts(pages, url_filter.rules_frame(spark)))
    assert "BroadcastHashJoin" not in plan
    assert set(got) == {(i, "a.example.net", f"/fr/{i}", "net/", "block") for i in range(4_000)} and len(got) == 4_000


def test_language_is_told_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.language_verdicts(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert set(rows(docs.select("doc_id", language.held_out("doc_id")))) == {
        (i, zlib.crc32(str(i).encode()) % 4 == 2) for (i,) in rows(docs.select("doc_id"))
    }


def test_language_odd_rows(odd, empty):
    got = language.language_verdicts(odd).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (4, 5, None, 6))
    assert not rows(language.language_verdicts(empty))
    assert {r.lang_pred for r in language.language_verdicts(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identified_documents(odd).columns == odd.columns


def test_unseen_words_fall_back_to_shorter_grams(spark):
    frame = spark.createDataFrame([("xx", "abcd abcd abce"), ("yy", "wxyz wxyz wxyv")], "lang string, text string")
    model = language.language_model(frame)
    assert language.identify(model, "abcd")[0] == "xx"
    assert language.identify(model, "zzwxyq")[0] == "yy"
    assert language.identify(model, "a")[0] == "xx"
    assert language.identify(model, "12 34") == ("und", 0.0)


def test_seen_words_count_in_every_language_whatever_the_model_holds(spark):
    big = " ".join(["alpha"] * 64 + ["beta"] * 32 + ["shared"] * 8 + ["rare"] * 2)
    frame = spark.createDataFrame([(1, "aa", big), (3, "bb", "shared shared shared gamma rarest"), (4, "bb", None), (5, None, "rare"), (6, None, "rare rare shared")], "doc_id int, lang string, text string")
    small = language.language_model(frame, max_words=2)
    held = language.language_model(frame)
    at = small["tables"][0]["shared"]
    assert small["scores"][at].tolist() == held["scores"][held["tables"][0]["shared"]].tolist()
    docs = frame.where("doc_id > 0")
    told = lambda **how: {
        r.doc_id: (r.lang_pred, round(r.lang_score, 9)) for r in language.with_language(docs, *language._learned(frame, **how), "doc_id").collect()
    }
    want = {r.doc_id: (lambda v: (v[0], round(v[1], 9)))(language.identify(held, r.text)) for r in docs.collect()}
    assert told() == want
    assert told(max_words=2) == want  # words beyond the model are joined with the full counts


def brute_links(vectors, threshold):
    keep = [i for i, v in vectors if v and any(v) and not any(x is None or not np.isfinite(x) for x in v)]
    at = dict(vectors)
    edges = []
    for k, a in enumerate(keep):
        for b in keep[k + 1 :]:
            x, y = np.array(at[a], float), np.array(at[b], float)
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                edges.append((a, b))
    return edges


def test_vector_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.25, 0.4)])
    vectors = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(near)]
    vectors += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [1.0, 0.0]), (1006, [2.0, 0.0])]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id bigint, embedding array<float>, e int")
    edges = brute_links(vectors, 0.9)
    degree = Counter(n for e in edges for n in e)
    group = groups_of(edges, [i for i, _ in vectors])
    for block_rows in (128, 16):  # 16: several blocks in one unit of work
        got = hnsw_links.linked_vectors(frame, block_rows=block_rows, shards=4).collect()
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, degree[i], group[i], group[i] == i) for i, _ in vectors}
    assert not rows(hnsw_links.linked_vectors(frame.limit(0)))


def unit_vectors(groups, others, width=32, seed=5):
    """Normalised vectors in random order: near copies in groups of these sizes, and others."""
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=width) + 0.02 * r.normal(size=(k, width)) for k in groups] + [r.normal(size=(others, width))])
    x = x[r.permutation(len(x))].astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("others", [60, 600, 4000])
def test_graph_answers_at_every_shard_size(others):
    x = unit_vectors((120, 70, 5, 2), others)
    q, at, _, recall, whole = hnsw_links.audited_links(x, hnsw_links.build_graph(x), x, 0.9, 48, 256, 0.98)
    assert recall >= 0.98 and whole == 0
    true = {tuple(p) for p in np.argwhere(x @ x.T >= 0.9 - 1e-4)}
    found = set(zip(q.tolist(), at.tolist(), strict=True))
    assert found <= true and len(found) >= 0.98 * len(true)


def test_failed_audit_of_a_dense_group_is_found():
    x = unit_vectors((300,), 4000)
    near = x @ x.T >= 0.9 - 1e-4
    group = np.flatnonzero(near.sum(1) > 48)
    rows, adjacency = (layers := hnsw_links.build_graph(x))[-1]
    lost = group[-60:]  # nothing leads to these any more
    layers[-1] = rows, np.where(np.isin(adjacency, lost), -1, adjacency)
    q, at, _, _, whole = hnsw_links.audited_links(x, layers, x, 0.9, 48, 256, 0.98)
    assert whole == len(group)
    assert near[group].sum() == np.isin(q, group).sum() and near[q, at].all()


def test_vector_links_in_large_shards_and_groups(spark):
    x = unit_vectors((120, 60), 3300)
    near = x.astype(float) @ x.T.astype(float) >= 0.9
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in hnsw_links.linked_vectors(frame, shards=1).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == [int(np.flatnonzero(row)[0]) for row in near]


def test_graph_search_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200] + rng.normal(size=(200, 32)).astype(np.float32) * 0.03
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, _ = hnsw_links.search_graph(x, hnsw_links.build_graph(x), q, 48)
    assert (ids[:, 0] == (q @ x.T).argmax(1)).mean() > 0.95


def best_path(pieces, text):
    """Score of the best segmentation by plain dynamic programming over characters."""
    normal = {t: s for t, s, kind in pieces if kind == "normal"}
    unknown = min(normal.values()) - unigram.UNKNOWN_COST
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = normal.get(text[i:j], unknown if j == i + 1 else -np.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_unigram_paths_are_best_and_decode():
    rng = np.random.default_rng(3)
    letters = list("abcé漢") + ["▁"]
    known = {c for c in letters if c != "漢"} | {"".join(rng.choice(letters[:4], rng.integers(2, 5))) for _ in range(60)} | {"▁ab", "▁▁"}
    pieces = [("<unk>", 0.0, "unknown")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    pieces += [(t, -float(rng.integers(1, 200)) / 8, "normal") for t in sorted(known)]
    model = unigram.Pieces(pieces)
    texts = ["", " ", "ab", "a  b 漢字 cé"] + ["".join(rng.choice(list("abcé漢 "), rng.integers(1, 40))) for _ in range(200)]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert model.decode(ids) == text
        score, k = 0.0, 0
        while k < len(ids):
            if pieces[ids[k]][2] == "byte":
                first = int(pieces[ids[k]][0][3:5], 16)
                k += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
                score += model.unknown_score
            else:
                score += pieces[ids[k]][1]
                k += 1
        if text:
            assert score == pytest.approx(best_path(pieces, "▁" + text.replace(" ", "▁")))


def test_unigram_table(odd, empty, docs):
    got = unigram.encoded(odd).collect()
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [None, 0]
    assert all(r.decoded_same for r in got if r.doc_id != 1)
    assert not rows(unigram.encoded(empty))
    assert unigram.encoded(docs).where("not decoded_same").count() == 0


def targets_by_hand(sizes, weights=(3, 1, 2), budget=1.5, repeat=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > repeat * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = repeat * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(request, which):
    frame = request.getfixturevalue(which)
    got = mixing.mixed(frame).collect()
    texts = rows(frame.select("doc_id", "source", "text"))
    words = lambda t: len(line_rules.WORD_RE.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, words(t)) for i, s, t in texts)
    sizes = Counter()
    for _, s, t in texts:
        sizes[s] += words(t)
    want = targets_by_hand(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(got, key=str) == sorted(mixing.mixed(frame).collect(), key=str)


def test_mixed_documents_repeat_whole_rows(docs, odd, empty):
    plan = {r.doc_id: r.taken / r.size for r in mixing.mixed(docs).collect() if r.size}
    got = Counter(i for (i,) in rows(mixing.mixed_documents(docs).select("doc_id")))
    assert got == Counter({i: int(x + 0.5) for i, x in plan.items() if int(x + 0.5)})
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(odd).where("doc_id <= 3").count() == 0
    assert not rows(mixing.mixed(empty)) and not rows(mixing.mixed_documents(empty))


def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None),
        (3, 0, None, "x"), (None, 0, "user", "lost"),
    ]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    one = preferences.turns_of(frame.where("conv_id = 1"))
    two = preferences.turns_of(frame.where("conv_id = 2")).withColumn("conv_id", F.lit(1).cast("bigint"))
    (r,) = preferences.preference_records(one, two).collect()
    assert (r.n_prompt_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n"
    assert r.chosen_mask == "0" * 14 + "1" * 11 and r.rejected_mask == "0" * 14 + "1" * 10 + "0" * 17
    assert r.usable
    (same,) = preferences.preference_records(one, one).collect()
    assert (same.n_prompt_turns, same.chosen, same.usable) == (2, "", False)
    assert not rows(preferences.preference_records(one, two.limit(0)))
    told = {r.conv_id: [t.text for t in r.turns] for r in preferences.neighbour_rejections(frame).collect()}
    assert told == {1: ["hi", "no"], 2: ["hi", "yes"]}
    swapped = preferences.neighbour_rejections(frame.where("conv_id = 2").unionByName(frame.where("conv_id = 1").withColumn("conv_id", F.lit(3).cast("bigint"))))
    assert {r.conv_id: [t.text for t in r.turns] for r in swapped.collect()} == {2: ["hi", "yes"], 3: ["hi", "no"]}


def test_conversations_are_paired_by_rank(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, position string, n int"
    talk = lambda i, reply: [(i, 0, "user", "hi", "p", 1), (i, 1, "assistant", reply, "p", 1)]

    def records(ids):
        turns = [t for i in ids for t in talk(i, f"reply {i}")] + [(99, 0, "user", "no reply", "p", 1)]
        frame = spark.createDataFrame(turns, schema)
        made = preferences.preference_records(preferences.turns_of(frame), preferences.neighbour_rejections(frame))
        return {r.conv_id: r for r in made.collect()}

    got = records([10, 20, 30, 40, 50])  # ids all even, an odd number of them
    other = {i: r.rejected.split("\n")[1].removesuffix("<|end|>") for i, r in got.items()}
    assert other == {10: "reply 20", 20: "reply 10", 30: "reply 40", 40: "reply 30", 50: "reply 40"}
    assert all(r.usable and r.n_prompt_turns == 1 for r in got.values())
    (alone,) = records([7]).values()
    assert not alone.usable and alone.rejected == "" and alone.prompt == "" and "reply 7" in alone.chosen
    repeated = spark.createDataFrame(talk(4, "same") * 2 + talk(6, "same"), schema)
    made = preferences.preference_records(preferences.turns_of(repeated), preferences.neighbour_rejections(repeated))
    assert len(made.collect()) == 2
    empty = spark.createDataFrame([], schema)
    assert not preferences.preference_records(preferences.turns_of(empty), preferences.neighbour_rejections(empty)).collect()


def test_near_duplicates_against_all_pairs(spark, docs):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    texts = dict(rows(frame.select("doc_id", "text")))
    got = dict(rows(order_minhash.near_duplicate_classes(frame).select("doc_id", "class_id")))
    shingles = {i: order_minhash.labelled_shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    edges = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if 0.8 <= len(shingles[a]) / len(shingles[b]) <= 1.25 and order_minhash.aligned_similarity(shingles[a], shingles[b]) >= 0.8
    ]
    assert len(edges) > 50
    assert got == groups_of(edges, ids)
    assert sorted(i for (i,) in rows(order_minhash.representatives(frame).select("doc_id"))) == sorted(set(got.values()))


def test_near_duplicate_chains_keep_every_link(spark):
    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in rng.integers(0, 5000, 150)]
    chain = []
    for i in range(60):
        at = int(rng.integers(0, 150))
        words = [*words[:at], f"new{i}", *words[at + 1 :]]
        chain.append((i, " ".join(words), "x"))
    frame = spark.createDataFrame([*chain, (70, chain[5][1], "x")], "doc_id bigint, text string, key string")
    shingles = {i: order_minhash.labelled_shingles(t) for i, t, _ in chain}
    edges = [(a, b) for a in shingles for b in shingles if a < b and order_minhash.aligned_similarity(shingles[a], shingles[b]) >= 0.8]
    want = groups_of([*edges, (5, 70)], [*shingles, 70])
    assert dict(rows(order_minhash.near_duplicate_classes(frame).select("doc_id", "class_id"))) == want


def test_near_duplicate_odd_rows(odd, empty):
    got = rows(order_minhash.near_duplicate_classes(odd))
    assert Counter((r[0], r[1]) for r in got) == Counter((r[0], r[0]) for r in ODD)
    kept = order_minhash.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert not rows(order_minhash.near_duplicate_classes(empty))


def test_order_matters_to_the_alignment():
    a = [f"a{i}" for i in range(100)]
    whole, turned = (order_minhash.labelled_shingles(" ".join(x)) for x in (a, a[50:] + a[:50]))
    assert order_minhash.aligned_similarity(whole, whole) == 1
    assert order_minhash.aligned_similarity(whole, turned) < 0.8


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_records_round_trip(request, which):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    manifest = record_files.write_records(frame)
    got = sorted(rows(record_files.read_records(manifest)), key=lambda r: r[1])
    plain = Tokenizer.from_file(record_files.default_tokenizer())
    want, start = [], 0
    for i, t in sorted(rows(frame.select("doc_id", "text")), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want
    name = manifest.orderBy("start").first().file
    assert [(i, x.tolist()) for i, x in record_files.read_at(name, [1, 0])] == [(want[k][0], want[k][4]) for k in (1, 0)]


def test_records_of_an_empty_table(empty):
    assert not rows(record_files.read_records(record_files.write_records(empty)))


def test_a_changed_byte_is_found(tmp_path):
    data = bytearray(record_files.frame(7, np.array([1, 70_000], np.uint32)))
    path = tmp_path / "x"
    path.write_bytes(data)
    assert [(i, x.tolist()) for i, x in record_files.read_frames(path.open("rb"))] == [(7, [1, 70_000])]
    for at in (3, len(data) - 6):
        bad = bytearray(data)
        bad[at] ^= 1
        path.write_bytes(bad)
        with pytest.raises(record_files.CorruptRecord):
            list(record_files.read_frames(path.open("rb")))


def test_word_cache_equals_the_tokenizer():
    texts = ["Don't STOP, it's <|endoftext|> é É .,. 'S", "İstanbul ΣΑΣ 1234 áb  x", "<|EndOfText|> a"]
    encoder = record_files.WordEncoder(record_files.default_tokenizer())
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_quality_agrees_with_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = weak_quality.quality_verdicts(docs).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98
    assert got[got.quality == 0].kept.mean() < 0.1


def test_quality_odd_rows(odd, empty):
    got = {r.doc_id: r for r in weak_quality.quality_verdicts(odd).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [False] * 3
    assert weak_quality.good_documents(odd).columns == odd.columns
    assert not rows(weak_quality.quality_verdicts(empty))


def test_labeller_estimates_recover_rates():
    import pandas as pd

    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    code = np.zeros(len(good), int)
    for i, _ in enumerate(weak_quality.LABELLERS):
        bad_vote = rng.random(len(good)) < np.where(good, 0.02, 0.3 + 0.05 * i)
        code = code * 3 + np.where(bad_vote, 2, 1)
    pattern, n = np.unique(code, return_counts=True)
    model = weak_quality.estimate(pd.DataFrame({"pattern": pattern, "rows": n}))
    assert model["prior"] == pytest.approx(0.8, abs=0.03)
    assert model["bad_vote_if_bad"]["few_kinds"] == pytest.approx(0.7, abs=0.05)


def test_url_equivalence(spark):
    canonical = '<link rel="canonical" href="{}">'
    refresh = "<META http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://A.net/x?q#f", None),
        (2, "http://a.com/1", canonical.format("https://b.net/2")),  # alias of a blocked address
        (3, "http://a.com/3", refresh.format("http://example.net/en/4")),  # alias of an allowed one
        (4, "http://a.com/5", canonical.format("http://a.com/3") + refresh.format("http://c.net/")),  # both: allow
        (5, "http://example.com/de/5", canonical.format("http://example.net/en/4")),  # its own rule holds
        (6, "example.net/en/", None),
        (7, None, None),
        (8, "https://deep.sub.org/fr/x", ""),
        (9, "http://example.net", "<p>"),
        (10, "https://a.com/1#top", None),  # plain form of 2 by way of https
        (10, "https://a.com/1#top", None),
        (11, "https://d.com/1", canonical.format("//b.net/2")),  # address without a scheme
        (12, "https://d.com/2", refresh.format("/1")),  # path on the same host
    ]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id bigint, url string, html string, rule string")
    got = {r[0]: r[1:] for r in rows(url_filter.url_verdicts(frame, url_filter.rules_frame(spark)))}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("a.com", "/1", None, "block"), 3: ("a.com", "/3", None, "allow"),
        4: ("a.com", "/5", None, "allow"), 5: ("example.com", "/de/5", "example.com/de/", "block"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("deep.sub.org", "/fr/x", "org/fr/", "allow"), 9: ("example.net", "", None, "allow"),
        10: ("a.com", "/1", None, "block"), 11: ("d.com", "/1", None, "block"), 12: ("d.com", "/2", None, "block"),
    }
    assert url_filter.url_verdicts(frame, url_filter.rules_frame(spark)).count() == len(pages)
    assert not rows(url_filter.url_verdicts(frame.limit(0), url_filter.rules_frame(spark)))


@pytest.mark.parametrize(
    "url, target",
    [
        ("https://d.com/a/1", "page.html"),
        ("https://d.com/a/page.html?id=1", "?id=2&amp;x=3"),
        ("https://d.com/a/b/1", "../x"),
        ("https://d.com/a/b/1", "../.././y/../x#part"),
        ("https://d.com", "page"),
        ("https://d.com/1", "HTTP://D.com/Page"),
    ],
)
def test_url_targets_are_resolved(spark, url, target):
    joined = {
        "page.html": "https://d.com/a/page.html", "?id=2&amp;x=3": "https://d.com/a/page.html?id=2&x=3", "../x": "https://d.com/a/x",
        "../.././y/../x#part": "https://d.com/x", "page": "https://d.com/page", "HTTP://D.com/Page": "https://d.com/Page",
    }[target]
    link = '<link rel="canonical" href="{}">'
    pages = [(1, url, link.format(target)), (2, joined, link.format("https://b.net/2")), (3, joined.replace("https://d", "HTTPS://D"), None)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(frame, url_filter.rules_frame(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


def test_line_rules(odd, empty):
    text = "\n".join(["Home | News | About |", "All rights reserved", "This is a plain sentence that goes on.", "no end here", "This is a plain sentence that goes on."])
    n, chars, symbols, dup, repeats, failed, kept, clean, removed, lost = line_rules.judge(text, 0.4)
    words = text.split()
    assert (n, chars, symbols, dup, failed) == (len(words), sum(map(len, words)), 3, 1, True)
    assert repeats == 16 and removed == 3 and lost == 13 - 1
    assert clean.count("plain sentence") == 2
    assert line_rules.repeated_words("a b c a b c x".split()) == 6
    got = line_rules.line_verdicts(odd).collect()
    assert len(got) == len(ODD) and [r.n_words for r in got][:4] == [0, 0, 0, 1]
    assert not rows(line_rules.line_verdicts(empty))


def test_lines_that_fail_reject_a_document():
    good = " ".join(f"word{i}" for i in range(60)) + "."
    junk = "\n".join(f"menu{i} entry{i} item{i}" for i in range(30))
    assert line_rules.judge(good, 0.4)[6] and not line_rules.judge(good + "\n" + junk, 0.4)[6]


def test_words_are_letters_with_their_marks(spark):
    assert language.words_of("² ½ ① Ⅷ 12 _") == []
    assert language.words_of("Café हिन्दी x_1 été² 漢字") == ["café", "हिन्दी", "x", "été", "漢字"]
    assert all(language.LETTERS.findall(t.lower()) == language.words_of(t) for t in ("Über den Wolken", "naïve — “x”", "a²b", "ét"))
    docs = spark.createDataFrame([(1, "² ½", None), (3, "ein Haus am See", "de"), (4, "a house at sea", "en")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_verdicts(docs).collect()}
    assert got[1] == "und"


def test_words_of_latin_texts_are_runs_of_letters():
    import random

    from netsift.llm.language import LETTERS, words_of

    rng = random.Random(5)
    every = "".join(map(chr, range(256)))
    texts = ["", every, "² ½", "a\x85b\xa0c", "ÀÉß µª"] + ["".join(rng.choices(every, k=80)) for _ in range(200)]
    texts += [t + rng.choice(["’", "हिन्दी", "Ⅷ", "İ"]) for t in texts]
    for t in texts:
        assert words_of(t) == LETTERS.findall(t.lower())
