"""Alignment of two tokenizations of the same text by byte ranges.

Both tokenizers encode space + text, A as byte-level BPE and B as SentencePiece. The tokens of many chunks of
text become two frames ordered by byte offset; ``pandas.merge_asof``, keyed by chunk, finds for the start of
each token the other side's token that covers it. The union of both directions is every pair of tokens whose
byte ranges overlap: of two overlapping tokens, one starts inside the other. Where an A and a B token start at
the same byte, the tokens before end at the same byte, which cuts a chunk into groups.

Texts are cut before white space that follows another character, and no token of either vocabulary crosses
such a cut (checked on the files; texts are encoded and aligned uncut otherwise). So a document's tokens,
groups and links are those of its chunks one after another. A worker process encodes and aligns a chunk when
it meets it first, and again only if it was forgotten as rare. Long texts are put together in runs of chunks.

Two passes. The first counts, per pair of ids, the links of the whole corpus: a task counts its chunks and adds up
the links of each distinct one, Spark sums the tasks. The second pass puts the documents together. The most
frequent pairs, up to ``max_pairs``, go to every task of the second pass; the others leave a document as (pair,
times) and meet their counts in a join. Nothing is left out at any size.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of
from netsift.session import materialize

MARK = "▁"
#: Pairs that tasks know by heart at most: 17 bytes each.
MAX_PAIRS = 1_000_000
#: Characters of text cut together, chunks encoded in one call, bytes aligned or put together in one step, and
#: chunks, and bytes of chunks, an encoder remembers before it forgets the rare ones.
GROUP_CHARS, CALL_CHUNKS, STEP_BYTES, CACHE_CHUNKS, CACHE_BYTES = 3_000_000, 20_000, 1_000_000, 400_000, 20_000_000
#: Distinct pairs a task of the first pass holds before it hands them on.
HELD_PAIRS = 2_000_000
CUT = re.compile(r"(?<=\S)(?=[ \t\n])")
WHITE = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def even(text: str) -> bool:
    """Whether every blank and line end stands alone between two characters that are no white space."""
    if text[0].isspace() or text[-1].isspace():
        return False
    return not any(w in text and any(x in text for x in (f"{w} ", f" {w}", f"{w}\n", f"\n{w}")) for w in WHITE)


def chunks_of(text: str) -> list[str]:
    """Space + text cut before each run of blanks, tabs and line ends that follows another character. A chunk
    that is led by one blank comes without it, any other with all its white space."""
    return [c[1:] if c[0] == " " and c[1:2].strip() else c for c in CUT.split(f" {text}")]


def byte_level() -> dict[str, int]:
    """The byte of each character of byte-level pieces: printable Latin-1 stands for itself, the other
    bytes, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligned:
    """The aligned tokens of chunks: per side the ids of all, how many each chunk has, and the bytes of each id."""

    def __init__(self, ids: list[np.ndarray], many: list[np.ndarray], sizes: list[np.ndarray]):
        self.ids, self.many = ids, many
        frames = []
        for side, per_chunk, size in zip(ids, many, sizes, strict=True):
            # chunks follow each other without a gap, and so do the tokens of a chunk
            start = np.cumsum(size[side]) - size[side]
            chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
            frames.append(pd.DataFrame({"start": start, "chunk": chunk, "token": np.arange(len(side))}))
        left, right = frames
        # the token of the other side that covers each token's start
        over_a = pd.merge_asof(left, right, on="start", by="chunk", suffixes=("", "_other"))["token_other"].to_numpy(np.int64)
        over_b = pd.merge_asof(right, left, on="start", by="chunk", suffixes=("", "_other"))["token_other"].to_numpy(np.int64)
        start_a, start_b = left["start"].to_numpy(), right["start"].to_numpy()
        self.opens_a = start_b[over_a] == start_a
        self.opens_b = start_a[over_b] == start_b
        # pairs with equal starts come from both directions, they count once
        late = ~self.opens_b
        link_a = np.concatenate([np.arange(len(start_a)), over_b[late]])
        link_b = np.concatenate([over_a, np.flatnonzero(late)])
        chunk = left["chunk"].to_numpy()
        order = np.argsort(chunk[link_a], kind="stable")
        self.link_a, self.link_b = link_a[order], link_b[order]
        n = len(many[0])
        #: per chunk: A tokens, B tokens, groups, links
        self.counts = np.stack(
            [*many, np.bincount(chunk[self.opens_a], minlength=n), np.bincount(chunk[self.link_a], minlength=n)]
        )

    def spelled(self, marked: pa.StringArray, n_a: int, n_b: int) -> pa.StringArray:
        """Per chunk its groups as text: A ids, a bar, B ids, a semicolon after each group. ``marked`` has the
        ids of A with a comma, with a bar, those of B with a comma, with a semicolon."""
        (a, b), (all_a, all_b) = self.ids, map(len, self.ids)
        first_a, first_b = np.flatnonzero(self.opens_a), np.flatnonzero(self.opens_b)
        group_a, group_b = np.cumsum(self.opens_a) - 1, np.cumsum(self.opens_b) - 1
        closes_a, closes_b = np.append(self.opens_a[1:], True), np.append(self.opens_b[1:], True)
        out = np.empty(all_a + all_b, np.int64)
        out[np.arange(all_a) + first_b[group_a]] = a + n_a * closes_a
        out[np.arange(all_b) + np.append(first_a[1:], all_a)[group_b]] = 2 * n_a + b + n_b * closes_b
        return joined(marked.take(pa.array(out)), self.many[0] + self.many[1])


def joined(parts: pa.Array, many: np.ndarray) -> pa.Array:
    """Strings put together, ``many`` at a time."""
    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), parts), pa.scalar("", parts.type))


class PairEncoder:
    """Both tokenizers, with the chunks a process has met."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_level()
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        left = [bytes(letters.get(c, 0) for c in t) if all(c in letters for c in t) else b"" for t in spelled]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        right = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(pieces)]
        self.surfaces = [pa.array(s, pa.binary()) for s in (left, right)]
        self.sizes = [np.array([len(t) for t in s], np.int64) for s in (left, right)]
        with open(a_path, encoding="utf-8") as f:
            shape = json.load(f)
        pre = shape.get("pre_tokenizer") or {}
        self.cuts = (
            not shape.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(MARK in t.lstrip(MARK) or len(t) > 1 and {"\t", "\n"} & set(t) for i, t in enumerate(pieces) if not self.b.is_byte(i))
        )
        self.blank = self.b.piece_to_id(MARK)
        marks = ((left, ","), (left, "|"), (right, ","), (right, ";"))
        self.marked = pa.array([f"{i}{mark}" for side, mark in marks for i in range(len(side))])
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.sound = np.empty(0, bool)
        self.bytes = np.empty(0, np.int64)
        self.counts = np.empty((4, 0), np.int64)
        self.links = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.spelled = pa.array([], pa.string())
        self.used = np.empty(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the chunks used most, half of what may be remembered at most, under new numbers."""
        least, kept = 1, np.ones(len(self.known), bool)
        while kept.sum() > CACHE_CHUNKS // 2 or self.bytes[kept].sum() > CACHE_BYTES // 2:
            least *= 2
            kept = self.used >= least
        place = np.flatnonzero(kept)
        self.links = self.links_of(place)
        self.counts = self.counts[:, place]
        self.starts = np.concatenate([[0], np.cumsum(self.counts[3])])
        self.known, self.spelled = (x.take(pa.array(place)) for x in (self.known, self.spelled))
        # uses of long ago count less
        self.sound, self.bytes, self.used = self.sound[place], self.bytes[place], self.used[place] // 2

    def cut(self, texts: list[str]) -> pa.ListArray:
        """The chunks of each text, as :func:`chunks_of` has them."""
        if not self.cuts:
            return pa.array([[t if t.strip() == t else f" {t}"] for t in texts], pa.list_(pa.string()))
        plain = np.array([even(t) for t in texts], bool)
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " \n"), " ")
        if plain.all():
            return parts
        odd = pa.array([chunks_of(t) for t, ok in zip(texts, plain.tolist(), strict=True) if not ok], pa.list_(pa.string()))
        place = np.empty(len(texts), np.int64)
        place[plain], place[~plain] = np.flatnonzero(plain), len(texts) + np.arange(len(odd))
        return pa.concat_arrays([parts, odd]).take(pa.array(place))

    def pieces(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks with their white space. The encoder puts a blank before a text."""
        got = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c[0] != " ":
                got[k] = got[k][1:]
            elif c == " ":
                got[k] = [self.blank]
        return got

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunk numbers of each text. Numbers given before are void if :meth:`full` was true."""
        if self.full():
            self.forget_rare()
        cut = self.cut(texts)
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary
        number = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            self.learn(words.take(pa.array(new)))
        flat = number[coded.indices.to_numpy()]
        self.used += np.bincount(flat, minlength=len(self.known))
        return np.split(flat, np.cumsum(pc.list_value_length(cut).to_numpy())[:-1])

    def encoded(self, whole: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of chunks with their white space, and how many each chunk has, by A and by B."""
        got = self.a.encode(whole, is_pretokenized=True, add_special_tokens=False)
        pieces = self.pieces(whole)
        many = [np.bincount(np.array(got.word_ids, np.int64), minlength=len(whole)), np.fromiter(map(len, pieces), np.int64, len(whole))]
        return [np.array(got.ids, np.int64), np.fromiter(chain.from_iterable(pieces), np.int64, int(many[1].sum()))], many

    def learn(self, new: pa.StringArray) -> None:
        """Encode chunks and align those that the tokens of both sides spell."""
        spaced = pc.if_else(pc.match_substring_regex(new, "^[ \t\n]"), new, pc.binary_join_element_wise("", new, " "))
        size = pc.binary_length(spaced).to_numpy().astype(np.int64)
        coded = [self.encoded(spaced.slice(k, CALL_CHUNKS).to_pylist()) for k in range(0, len(new), CALL_CHUNKS)]
        ids, many = ([np.concatenate(side) for side in zip(*x, strict=True)] for x in zip(*coded, strict=True))
        sound = np.ones(len(new), bool)
        for surfaces, side, per_chunk in zip(self.surfaces, ids, many, strict=True):
            told = joined(surfaces.take(pa.array(side)), per_chunk)
            sound &= pc.equal(told, spaced.cast(pa.binary())).to_numpy(zero_copy_only=False)
        ids = [side[np.repeat(sound, per_chunk)] for side, per_chunk in zip(ids, many, strict=True)]
        many = [per_chunk[sound] for per_chunk in many]
        counts = np.zeros((4, len(new)), np.int64)
        links, spelled = [self.links], [self.spelled]
        seen, at = np.flatnonzero(sound), [0, 0]
        steps = np.cumsum(size[seen]) // STEP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(seen)]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            part = [m[low:high] for m in many]
            to = [k + int(m.sum()) for k, m in zip(at, part, strict=True)]
            step = Aligned([side[k:end] for side, k, end in zip(ids, at, to, strict=True)], part, self.sizes)
            at = to
            counts[:, seen[low:high]] = step.counts
            links.append(step.ids[0][step.link_a] * len(self.surfaces[1]) + step.ids[1][step.link_b])
            spelled.append(step.spelled(self.marked, *map(len, self.surfaces)))
        # chunks that are not spelled keep their number, without tokens
        places = np.cumsum(sound) - 1 + len(self.spelled)
        texts = pa.concat_arrays(spelled)
        if not sound.all():
            old = np.arange(len(self.spelled))
            texts = texts.take(pa.array(np.concatenate([old, places]), mask=np.concatenate([old < 0, ~sound])))
        self.known = pa.concat_arrays([self.known, new])
        self.sound = np.concatenate([self.sound, sound])
        self.bytes = np.concatenate([self.bytes, size])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.links = np.concatenate(links)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[3])])
        self.spelled = texts

    def links_of(self, chunks: np.ndarray) -> np.ndarray:
        """The id pair of each link of chunks as one number."""
        many = self.counts[3][chunks]
        ends = np.cumsum(many)
        return self.links[np.repeat(self.starts[chunks] - ends + many, many) + np.arange(int(many.sum()))]

    def full(self) -> bool:
        return len(self.known) > CACHE_CHUNKS or self.bytes.sum() > CACHE_BYTES


def encoder_of(a_path: str, b_path: str) -> PairEncoder:
    """The encoders of this worker process, kept from task to task with the chunks they have learned."""
    kept = sys.modules.setdefault("netsift_pair_encoders", types.ModuleType("netsift_pair_encoders")).__dict__
    key = f"{a_path}\n{b_path}"
    if key not in kept:
        kept[key] = PairEncoder(a_path, b_path)
    return kept[key]


class Runs:
    """Runs of chunks put together, each run of one document (its number in the batch)."""

    def __init__(self, encoder: PairEncoder, runs: list[tuple[int, np.ndarray]]):
        self.encoder, self.runs = encoder, runs
        self.chunks = np.concatenate([c for _, c in runs])
        self.many = np.array([len(c) for _, c in runs])

    def counts(self) -> list[np.ndarray]:
        """Per run: A tokens, B tokens, groups, links."""
        starts = np.cumsum(self.many) - self.many
        return [np.add.reduceat(c[self.chunks], starts) for c in self.encoder.counts]

    def links(self) -> np.ndarray:
        """The id pair of each link as one number, run after run."""
        return self.encoder.links_of(self.chunks)

    def spelled(self) -> list[bytes]:
        """Per run its groups as text: A ids, a bar, B ids, groups parted by semicolons."""
        texts = joined(self.encoder.spelled.take(pa.array(self.chunks)), self.many)
        return [t[:-1] for t in texts.cast(pa.binary()).to_pylist()]


def _groups(encoder: PairEncoder, texts: list[str | None]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(text number, chunk numbers) of the texts whose tokens spell them, about ``GROUP_CHARS`` at a time."""
    group: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        if text:
            group.append((i, text))
            held += len(text)
        if group and (held >= GROUP_CHARS or i + 1 == len(texts)):
            numbered = encoder.numbers([t for _, t in group])
            yield [(k, chunks) for (k, _), chunks in zip(group, numbered, strict=True) if encoder.sound[chunks].all()]
            group, held = [], 0


def _steps(encoder: PairEncoder, texts: list[str | None]) -> Iterator[Runs]:
    """Runs of the documents whose tokens spell them; a long document is several runs."""
    for group in _groups(encoder, texts):
        runs: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, chunks in group:
            ends = np.cumsum(encoder.bytes[chunks])
            cuts = np.searchsorted(ends, np.arange(STEP_BYTES, int(ends[-1]), STEP_BYTES)) + 1
            for run in np.split(chunks, cuts):
                if not len(run):
                    continue
                runs.append((i, run))
                held += int(encoder.bytes[run].sum())
                if held >= STEP_BYTES:
                    yield Runs(encoder, runs)
                    runs, held = [], 0
        if runs:
            yield Runs(encoder, runs)


class PairSums:
    """Links per id pair of the texts of a task, those of a distinct chunk added up at once."""

    def __init__(self, encoder: PairEncoder):
        self.encoder = encoder
        self.often = np.empty(0, np.int64)
        self.codes, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, texts: list[str | None]) -> None:
        groups = _groups(self.encoder, texts)
        while True:
            if self.encoder.full():  # chunk numbers are about to be given anew
                self.settle()
            group = next(groups, None)
            if group is None:
                break
            often = np.bincount(np.concatenate([np.empty(0, np.int64), *[chunks for _, chunks in group]]), minlength=len(self.encoder.known))
            often[: len(self.often)] += self.often
            self.often = often

    def settle(self) -> None:
        """Add up the links of the chunks counted so far."""
        encoder, often = self.encoder, self.often
        self.often = np.empty(0, np.int64)
        seen = np.flatnonzero(often)
        step = max(CACHE_CHUNKS // 8, 1)
        for part in np.split(seen, np.arange(step, len(seen), step)):
            many = encoder.counts[3][part]
            found, pair = pd.factorize(np.concatenate([self.codes, encoder.links_of(part)]))
            self.times = np.bincount(found, np.concatenate([self.times, np.repeat(often[part], many)])).astype(np.int64)
            self.codes = pair


def _pair_counts(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(code, times): how many links of all texts hold each id pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None

        def out() -> pa.RecordBatch:
            codes, times = sums.codes, sums.times
            sums.codes, sums.times = codes[:0], times[:0]
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["code", "times"])

        for part in chain.from_iterable(_parts(b, 0) for b in batches):
            sums = sums or PairSums(encoder_of(*paths))
            sums.add(part.column(0).to_pylist())
            if len(sums.codes) > HELD_PAIRS:
                yield out()
        if sums:
            sums.settle()
            yield out()

    return texts.mapInArrow(count, "code bigint, times bigint").groupBy("code").agg(F.sum("times").alias("times"))


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other, about ``GROUP_CHARS`` bytes of text at a time."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    edges = (np.flatnonzero(np.diff(np.cumsum(size) // GROUP_CHARS)) + 1).tolist()
    for low, high in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.slice(low, high - low)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_documents(
    documents: DataFrame, paths: tuple[str, str] | None = None, max_pairs: int = MAX_PAIRS, with_groups: bool = False
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, and on request ``groups``, the text that is hashed.

    Null and empty texts, and texts that the tokens of either side don't spell (normalised or unknown
    characters), have no tokens: zeros and an empty groups_sha256. Repeated rows count every time; a table
    without rows or tokens works. n_best counts links whose pair is the most frequent of its B id, ties
    included."""
    spark = documents.sparkSession
    paths = paths or default_tokenizers()
    rows = docs_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(_pair_counts(rows.select("text"), paths), "pair-counts")
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    # one row per B id, at most the vocabulary
    best = counts.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("times").alias("most"))
    counts = counts.join(F.broadcast(best), F.col("code") % n_b == F.col("b")).select(
        "code", "times", (F.col("times") == F.col("most")).alias("best")
    )
    # sizes are an eighth of a doubling apart; the largest sizes that fit together are known to all tasks
    size = F.floor(F.log2("times") * 8).cast("int")
    room, least = max_pairs, None
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r["size"]
    known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    if least is not None:
        table = counts.where(size >= least).toPandas().sort_values("code")
        known = table["code"].to_numpy(np.int64), table["times"].to_numpy(np.int64), table["best"].to_numpy(bool)
    shared = spark.sparkContext.broadcast(known)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, tops = shared.value
        name, row = uuid.uuid4().hex, 0
        for part in chain.from_iterable(_parts(b, 1) for b in batches):
            n = part.num_rows
            sums = np.zeros((6, n), np.int64)
            hashes: dict[int, object] = {}
            spelled: dict[int, list[bytes]] = {}
            rare: dict[int, list[dict[str, int]]] = {}
            for step in _steps(encoder_of(*paths), part.column(1).to_pylist()):
                docs, told = np.array([i for i, _ in step.runs]), step.counts()
                ends = np.cumsum(told[-1])
                back, pair = pd.factorize(step.links())
                at = np.minimum(np.searchsorted(codes, pair), max(len(codes) - 1, 0))
                seen = codes[at] == pair if len(codes) else np.zeros(len(pair), bool)
                weigh = np.where(seen, times[at], 0) if len(codes) else np.zeros(len(pair), np.int64)
                top = seen & tops[at] if len(codes) else seen
                for k, values in enumerate([*told, *[np.add.reduceat(x[back], ends - told[-1], dtype=np.int64) for x in (top, weigh)]]):
                    np.add.at(sums[k], docs, values)
                open_links = np.flatnonzero(~seen[back])
                if len(open_links):
                    run = np.searchsorted(ends, open_links, side="right")
                    both, many = np.unique(docs[run] * len(pair) + back[open_links], return_counts=True)
                    for i, c, t in zip((both // len(pair)).tolist(), pair[both % len(pair)].tolist(), many.tolist(), strict=True):
                        rare.setdefault(i, []).append({"code": c, "times": t})
                for i, text in zip(docs.tolist(), step.spelled(), strict=True):
                    if i in hashes:
                        text = b";" + text
                    hashes.setdefault(i, hashlib.sha256()).update(text)
                    if with_groups:
                        spelled.setdefault(i, []).append(text)
            columns = [
                pa.array([f"{name}-{row + i}" for i in range(n)], pa.string()), part.column(0), *map(pa.array, sums),
                pa.array([hashes[i].hexdigest() if i in hashes else "" for i in range(n)], pa.string()),
                pa.array([rare.get(i, []) for i in range(n)], pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))),
            ]
            names = ["row", "doc_id", *SUMS, "groups_sha256", "rare"]
            if with_groups:
                columns.append(pa.array([b"".join(spelled.get(i, [])).decode() for i in range(n)], pa.string()))
                names.append("groups")
            row += n
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row string, doc_id bigint, {', '.join(f'{c} bigint' for c in SUMS)}, groups_sha256 string, rare array<struct<code:bigint,times:bigint>>"
    told = materialize(rows.mapInArrow(align, schema + (", groups string" if with_groups else "")), "aligned")
    # pairs that tasks did not know: none of them is frequent, so no key of this join is
    open_pairs = told.where(F.size("rare") > 0).select("row", F.explode("rare").alias("x")).select("row", "x.code", F.col("x.times").alias("here"))
    met = open_pairs.join(counts, "code").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("here")).otherwise(0)).alias("more_best"), F.sum(F.col("here") * F.col("times")).alias("more_sum")
    )
    out = told.drop("rare").join(met, "row", "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    return out.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("row", "more_best", "more_sum")


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
