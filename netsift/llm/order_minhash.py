"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles; the i-th occurrence of a shingle is labelled i,
so labelled shingles are unique within a document. For each of ``functions`` hash functions the
``picked`` labelled shingles with the smallest hashes are taken and kept *in text order*; the hash of
that short sequence is one key. Two documents share a key with a probability that falls with the edits
between them and with reordering.

Similarity of two documents: align their shingle sequences inside a diagonal band, i.e. take the
longest chain of equal labelled shingles that runs forward in both, at most ``band`` positions off the
diagonal; with ``c`` shingles in the chain it is ``c / (n1 + n2 - c)``, the Jaccard measure with order.
The band is the number of insertions and deletions that the threshold leaves room for, so it hides
nothing at or above the threshold.

Plan. Equal texts are one class from the start. A bucket (function, key) is not expanded into pairs:
its members meet its leader only. What these stars leave open (two non-leading members of a bucket in
different components) is settled exactly: members are first discarded if fewer than ``threshold`` of
their shingles occur in any other open component, which is a proof and not a guess, repeated because
each discard exposes more; those that remain meet all members of other components in blocks.
So no link between documents sharing a bucket is lost, and copies of one text never multiply.
At similarity 0.8 two documents share no bucket of 16 with a probability near 1e-5.

Rows with null text, and texts without a word, link with nothing and stay on their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of, free_name, salted_join, text_digest
from netsift.llm.components import connected_components
from netsift.session import materialize

WORDS, THRESHOLD, FUNCTIONS, PICKED = 5, 0.8, 16, 3
DISCARD_ROUNDS, BLOCK_SHINGLES, MATRIX_CELLS = 3, 1 << 16, 1 << 18


class WordHashes(dict):
    """Hashes of words, each made once while there is room."""

    ROOM = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def labelled_shingles(text: str | None, words: int = WORDS, hashes: WordHashes | None = None) -> np.ndarray:
    """64-bit hashes of the occurrence-labelled shingles in text order; a text of fewer words is one
    shingle, a text without words none. Words are runs of anything but ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = WordHashes() if hashes is None else hashes
    codes = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    mult = np.uint64(0x9E3779B97F4A7C15)
    width = min(words, len(codes))
    n = len(codes) - width + 1
    shingle = np.full(n, np.uint64(width))
    for k in range(width):
        shingle = (shingle ^ codes[k : k + n]) * mult
        shingle ^= shingle >> np.uint64(29)
    order = np.argsort(shingle, kind="stable")
    ranked = shingle[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    starts = np.flatnonzero(first)
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - starts[np.cumsum(first) - 1]).astype(np.uint64)
    out = (shingle + label * np.uint64(0xD6E8FEB86659FD93)) * mult
    return out ^ (out >> np.uint64(32))


def order_keys(shingles: np.ndarray, functions: int = FUNCTIONS, picked: int = PICKED) -> np.ndarray:
    """One 64-bit key per hash function."""
    seeds = np.random.default_rng(7).integers(1, 2**63, functions, dtype=np.uint64)
    take = min(picked, len(shingles))
    mult = np.uint64(0xFF51AFD7ED558CCD)
    at = np.empty((functions, take), np.int64)
    step = max(1, MATRIX_CELLS // len(shingles))  # functions whose hashes stand in one matrix
    for lo in range(0, functions, step):
        h = (shingles[None, :] ^ seeds[lo : lo + step, None]) * mult
        h ^= h >> np.uint64(33)
        at[lo : lo + step] = np.sort(np.argpartition(h, take - 1, axis=1)[:, :take], axis=1)
    key = seeds.copy()
    for j in range(take):
        key = (key ^ shingles[at[:, j]]) * np.uint64(0xC4CEB9FE1A85EC53)
        key ^= key >> np.uint64(31)
    return key


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Order-aware Jaccard of two labelled shingle sequences by alignment in a band (0 if it cannot
    reach the threshold)."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < threshold * (n + m - len(at)):
        return 0.0
    band = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    inside = np.abs(at - to) <= band
    at, to = at[inside], to[inside]
    to = to[np.argsort(at)]
    if np.all(to[1:] > to[:-1]):
        chain = len(to)
    else:
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        chain = len(tails)
    return chain / (n + m - chain)


def _sketches(docs: DataFrame, words: int, functions: int, picked: int) -> DataFrame:
    """(digest, n, keys) of each distinct text with a word."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            digests, sizes, keys = [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = labelled_shingles(text.as_py(), words, hashes)
                if len(got):
                    digests.append(digest)
                    sizes.append(len(got))
                    keys.append(order_keys(got, functions, picked))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * functions
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["digest", "n", "keys"],
            )

    return docs.where("text IS NOT NULL").select("digest", "text").mapInArrow(
        sketch, "digest binary, n bigint, keys array<bigint>"
    )


def _verified(pairs: DataFrame, texts: tuple, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold; see ``_texts_of`` for ``texts``. Rows of one ``a`` arrive together, so its shingles are made
    once; a text that meets very many others is a skewed join, which is split at run time."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        last, left = None, None
        for batch in batches:
            keep = []
            for a, at, bt in zip(batch["a"], batch["at"], batch["bt"], strict=True):
                if a != last:
                    last, left = a, labelled_shingles(at, words, hashes)
                keep.append(aligned_similarity(left, labelled_shingles(bt, words, hashes), threshold) >= threshold)
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    needed = materialize(_texts_of(ends, texts), "pair-texts")
    left = needed.select(F.col("digest").alias("a"), F.col("text").alias("at"))
    right = needed.select(F.col("digest").alias("b"), F.col("text").alias("bt"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "at", "bt").mapInPandas(verify, "a binary, b binary")


def _texts_of(digests: DataFrame, texts: tuple) -> DataFrame:
    """(digest, text) of the named digests, from the rows (digest, doc_id, text) that
    hold the smallest doc_id (digest, rep) of their text."""
    docs, ids = texts
    wanted = ids.join(digests, "digest").select("digest", F.col("rep").alias("doc_id"))
    # both are keys, so the copies of a text are spread by their ids
    same = docs["digest"].eqNullSafe(wanted["digest"]) & docs["doc_id"].eqNullSafe(wanted["doc_id"])
    return docs.join(wanted, same, "left_semi").select("digest", "text")


def _open_members(members: DataFrame) -> DataFrame:
    """Members of buckets whose members, the leader apart, lie in two components or more."""
    inside = (
        members.where("digest <> leader")
        .groupBy("f", "key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("f", "key", "lo", "hi")
    )
    return salted_join(members.where("digest <> leader"), inside.select("f", "key"), ["f", "key"], "digest")


def _survivors(nodes: DataFrame, texts: tuple, words: int, threshold: float) -> DataFrame:
    """Of (digest, component) those that may still reach another component: each discarded one has
    too few shingles in common with all other components together."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for digest, component, text in zip(batch["digest"], batch["component"], batch["text"], strict=True):
                got = labelled_shingles(text, words, hashes)
                yield pd.DataFrame(
                    {"digest": digest, "component": component, "n": len(got), "x": got.view(np.int64)}
                )

    rows = materialize(
        _texts_of(nodes.select("digest"), texts)
        .join(nodes, "digest")
        .select("digest", "component", "text")
        .mapInPandas(shingles, "digest binary, component binary, n bigint, x bigint"),
        "open-shingles",
    )
    for _ in range(DISCARD_ROUNDS):
        spread = rows.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        met = salted_join(rows, spread.where("lo <> hi").select("x"), ["x"], "digest")
        enough = (
            met.groupBy("digest").agg(F.count("*").alias("k"), F.first("n").alias("n"))
            .where(F.col("k") >= threshold * F.col("n"))
            .select("digest")
        )
        rows = materialize(rows.join(enough, "digest", "left_semi"), "open-shingles")
    return rows.select("digest", "component").distinct()


def _settled(waiting: DataFrame, nodes: DataFrame, texts: tuple, words: int, threshold: float) -> DataFrame:
    """Links (a, b) that join components among the surviving ``nodes``. Nodes sharing buckets, directly
    or through others, form a cluster; a cluster is cut into blocks of ``BLOCK_SHINGLES``, those of its
    largest component apart, and each pair of blocks is one task that compares its texts as a matrix and
    reports a spanning forest. Two blocks of the largest component never meet."""
    shared = waiting.join(nodes.select("digest"), "digest", "left_semi").select("digest", "leader").distinct()
    clusters = connected_components(shared).select(F.col("node").alias("digest"), F.col("component").alias("cluster"))
    sized = materialize(
        waiting.select("digest", "component", "n").distinct().join(nodes.select("digest"), "digest", "left_semi")
        .join(clusters, "digest"),
        "open-nodes",
    )
    parts = sized.groupBy("cluster", "component").agg(F.sum("n").alias("n"))
    shape = parts.groupBy("cluster").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"))
    shape = shape.where("all > main.n").select(
        "cluster",
        F.col("main.component").alias("main"),
        F.ceil((F.col("all") - F.col("main.n")) / BLOCK_SHINGLES).cast("int").alias("others"),
        F.ceil(F.col("main.n") / BLOCK_SHINGLES).cast("int").alias("mains"),
    )
    placed = salted_join(sized, shape, ["cluster"], "digest")
    is_main = F.col("component") == F.col("main")
    k = F.pmod(F.xxhash64("digest"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("k", k)
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = lambda lo, kind, hi: F.struct(lo.alias("lo"), F.lit(kind).alias("kind"), hi.alias("hi"))
    own = F.col("k")
    places = F.when(is_main, F.transform(each("others"), lambda j: meet(j, "main", own))).otherwise(
        F.concat(
            F.transform(each("others"), lambda j: meet(F.least(own, j), "other", F.greatest(own, j))),
            F.transform(each("mains"), lambda j: meet(own, "main", j)),
        )
    )
    located = materialize(placed.select("digest", "component", "cluster", places.alias("places")), "open-places")
    held = _texts_of(located.select("digest"), texts).join(located, "digest")
    rows = held.withColumn("at", F.explode("places")).select("cluster", "at.*", "digest", "component", "text")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        docs = [labelled_shingles(t, words, hashes) for t in block["text"]]
        sizes = np.array([len(d) for d in docs])
        _, flat, times = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(docs)), sizes)
        keep = times[flat] > 1
        column, owner = np.unique(flat[keep], return_inverse=True)[1], owner[keep]
        overlap = np.zeros((len(docs), len(docs)), np.float32)
        for lo in range(0, int(column.max(initial=-1)) + 1, 4096):
            inside = (column >= lo) & (column < lo + 4096)
            m = np.zeros((len(docs), 4096), np.float32)
            m[owner[inside], column[inside] - lo] = 1
            overlap += m @ m.T
        near = np.triu(overlap >= threshold * (sizes[:, None] + sizes[None, :] - overlap) - 1e-3, 1)
        root = {c: c for c in block["component"]}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        digests, components = block["digest"].tolist(), block["component"].tolist()
        out = []
        for i, j in np.argwhere(near).tolist():
            x, y = find(components[i]), find(components[j])
            if x != y and aligned_similarity(docs[i], docs[j], threshold) >= threshold:
                root[max(x, y)] = min(x, y)
                out.append((digests[i], digests[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("cluster", "lo", "kind", "hi").applyInPandas(compare, "a binary, b binary")


def near_duplicate_classes(
    documents: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    functions: int = FUNCTIONS,
    picked: int = PICKED,
) -> DataFrame:
    """One row per document row: doc_id, class_id (the smallest doc_id of its near-duplicate class),
    digest of its text and copies (rows with the very same text).

    Null text: digest null and copies null; such rows, and texts without words, have class_id equal to
    doc_id. A null doc_id is ordered last. Repeated rows fall in one class. Extra columns are ignored.
    An empty table gives an empty result.
    """
    docs = docs_of(documents, "doc_id", "text").withColumn("digest", text_digest(F.col("text")))
    ids = docs.where("text IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")
    )
    ids = materialize(ids, "text-classes")
    texts = (docs.where("text IS NOT NULL").select("digest", "doc_id", "text"), ids.select("digest", "rep"))
    sketches = materialize(_sketches(docs, words, functions, picked).dropDuplicates(["digest"]), "sketches")
    keyed = sketches.select("digest", "n", F.posexplode("keys").alias("f", "key"))
    buckets = keyed.groupBy("f", "key").agg(
        F.count("*").alias("size"), F.min_by("digest", F.xxhash64("digest", "f")).alias("leader")
    ).where("size > 1")
    members = materialize(
        salted_join(keyed, buckets, ["f", "key"], "digest").select("f", "key", "digest", "n", "size", "leader"),
        "bucket-members",
    )
    sizes = sketches.select(F.col("digest").alias("leader"), F.col("n").alias("ln"))
    star = members.where("digest <> leader").select("digest", "n", "leader").distinct()
    close = F.least("n", "ln") >= threshold * F.greatest("n", "ln")
    pairs = salted_join(star, sizes, ["leader"], "digest").where(close)
    pairs = materialize(pairs.select(F.col("leader").alias("a"), F.col("digest").alias("b")), "star-pairs")
    edges = materialize(_verified(pairs, texts, words, threshold), "links")
    found = materialize(connected_components(edges), "components")

    several = members.where("size > 2")
    placed = several.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("component", "digest")
    )
    waiting = materialize(_open_members(placed), "open-members")
    nodes = _survivors(waiting.select("digest", "component").distinct(), texts, words, threshold)
    more = materialize(_settled(waiting, nodes, texts, words, threshold), "links")
    joined = found.unionByName(more.select(F.col("a").alias("node"), F.col("b").alias("component")))
    merged = materialize(connected_components(joined), "components")

    classes = ids.join(merged.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "component", F.coalesce("component", "digest")
    )
    class_ids = classes.groupBy("component").agg(F.min("rep").alias("class_id"))
    spoken = sketches.select("digest", F.lit(True).alias("has_words"))
    by_text = materialize(
        salted_join(classes, class_ids, ["component"], "digest")
        .join(spoken, "digest", "left")
        .select("digest", "class_id", "copies", "has_words"),
        "class-of-text",
    )
    return salted_join(docs.select("doc_id", "digest"), by_text, ["digest"], "doc_id", "left").select(
        "doc_id",
        F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "digest",
        "copies",
    )


def representatives(documents: DataFrame, **how) -> DataFrame:
    """The rows of ``documents`` that stand for their near-duplicate class: one per class, the row
    with the smallest doc_id. Rows without any word each stay. All columns are kept."""
    cols = documents.columns
    kept, same, times = (free_name(c, cols) for c in ("kept_id", "kept_digest", "kept_rows"))
    spoken = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = near_duplicate_classes(documents, **how).where("doc_id <=> class_id")
    ids = materialize(
        marked.groupBy(F.col("doc_id").alias(kept), F.col("digest").alias(same)).agg(F.count("*").alias(times)), "kept"
    )
    on = F.col(kept).eqNullSafe(F.col("doc_id")) & F.col(same).eqNullSafe(text_digest(F.col("text")))
    once = documents.join(ids.where(F.col(times) == 1), on, "left_semi")
    rows = documents.join(ids.where(F.col(times) > 1), on, "left_semi")
    return once.unionByName(rows.where(spoken).dropDuplicates(["doc_id", "text"])).unionByName(rows.where(~spoken))
