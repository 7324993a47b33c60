"""Language identification by words first, then shorter and shorter character n-grams.

Training counts every word of every training document per language, and the n-grams (with word
boundary marks) of those words, all in Spark. The model keeps the words and n-grams of each length that
are among the most frequent of any language up to a stated number, with their counts in every language,
so its size is bounded by languages times that number. A seen word is scored by its log frequency in each
language, in a join with the full counts if the model has no room for it; any other word falls back to
the mean log frequency of its known 4-grams, else of its 3-grams, 2-grams or letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of, free_name, salted_join, text_digest
from netsift.session import materialize



def _class_of(kinds: str) -> str:
    """A character class of all characters whose Unicode category begins with one of ``kinds``."""
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] in kinds:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "[" + "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges) + "]"


#: A word is a letter and the letters and marks after it; numbers that Unicode lets pass in words are none.
LETTERS = re.compile(_class_of("L") + _class_of("LM") + "*")
#: The same for texts without marks and without letter-like numbers, which is much faster.
PLAIN = re.compile(r"[^\W\d_]+")
ODD = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M" or unicodedata.category(c) in ("No", "Nl"))
#: For texts of the first 256 characters, none of which is a mark: letters stay, all else becomes a blank.
LATIN = bytes(i if unicodedata.category(chr(i))[0] == "L" else 32 for i in range(256))
ORDERS, MAX_WORDS, MAX_GRAMS = (4, 3, 2, 1), 30_000, 50_000
#: Each step back costs evidence: weight of a fallback to each order, against 1 for a known word.
STEP_WEIGHT = {4: 0.6, 3: 0.5, 2: 0.4, 1: 0.2}
UNKNOWN = "und"


def _grams(word: str, n: int) -> list[str]:
    marked = word if n == 1 else f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def words_of(text: str) -> list[str]:
    """The lower-case words of a text."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return (PLAIN if ODD.isdisjoint(low) else LETTERS).findall(low)


def _word_counts(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """(lang, gram, times) sums of the words of the texts of a task."""
    words: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        lang, gram, times = [], [], []
        for name, counted in words.items():
            lang += [name] * len(counted)
            gram += list(counted)
            times += list(counted.values())
        words.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(times, pa.int64())], names=["lang", "gram", "times"]
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, words.values())) > flush:
                yield out()
    if words:
        yield out()


def _gram_counts(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, times) sums of the n-grams of counted words."""
    per: dict[tuple[str, int], Counter] = {}

    def out() -> pa.RecordBatch:
        lang, order, gram, times = [], [], [], []
        for (name, n), c in per.items():
            lang += [name] * len(c)
            order += [n] * len(c)
            gram += list(c)
            times += list(c.values())
        per.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(order, pa.int32()), pa.array(gram, pa.string()), pa.array(times, pa.int64())],
            names=["lang", "n", "gram", "times"],
        )

    for batch in batches:
        for lang, word, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for n in ORDERS:
                c = per.setdefault((lang, n), Counter())
                for g in _grams(word, n):
                    c[g] += k
        if sum(map(len, per.values())) > flush:
            yield out()
    if per:
        yield out()


def language_model(
    training: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS
) -> dict:
    """The model learned from ``training`` (lang, text); rows with a null in either are ignored. Per
    order the grams are kept that any language has at or above a count, the count being the smallest
    eighth of a doubling that leaves at most ``max_words`` or ``max_grams`` of them in that language. A kept
    gram has its counts in every language."""
    return _learned(training, max_words, max_grams)[0]


def _learned(training: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> tuple[dict, DataFrame | None]:
    """The model, and the scores (word, s0, s1, ...) of all seen words it has no room for."""
    rows = docs_of(training, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    words = rows.mapInArrow(_word_counts, "lang string, gram string, times bigint").groupBy("lang", "gram")
    words = materialize(words.agg(F.sum("times").alias("times")), "language-words")
    # n-grams come from the counted words, each word once a language and not once an occurrence
    grams = words.mapInArrow(_gram_counts, "lang string, n int, gram string, times bigint").groupBy("lang", "n", "gram")
    grams = materialize(grams.agg(F.sum("times").alias("times")), "language-grams")
    counted = words.select("lang", F.lit(0).alias("n"), "gram", "times").unionByName(grams)
    # how many grams have a count of each size; sizes are an eighth of a doubling apart
    step = F.floor(F.log2("times") * 8).cast("int")
    sizes = counted.groupBy("lang", "n", step.alias("step")).agg(F.count("*").alias("grams"), F.sum("times").alias("sum")).collect()
    totals: dict = {}
    kinds: dict = {}
    spread: dict = {}
    for r in sizes:
        totals[r["lang"], r["n"]] = totals.get((r["lang"], r["n"]), 0) + r["sum"]
        kinds[r["lang"], r["n"]] = kinds.get((r["lang"], r["n"]), 0) + r["grams"]
        spread.setdefault((r["lang"], r["n"]), []).append((r["step"], r["grams"]))
    bounds = []
    for (lang, n), steps in spread.items():
        room, least = (max_words if n == 0 else max_grams), None
        for s, grams in sorted(steps, reverse=True):
            if grams > room:
                break
            room, least = room - grams, s
        if least is not None:
            bounds.append((lang, n, least))
    langs = sorted({lang for lang, _ in totals})
    model: dict = {"langs": langs, "tables": {}, "scores": None, "prior": None}
    if not langs:
        return model, None
    limit = counted.sparkSession.createDataFrame(bounds, "lang string, n int, least int")
    grams = counted.join(F.broadcast(limit), ["lang", "n"]).where(step >= F.col("least")).select("n", "gram").distinct()
    grams = materialize(grams, "language-kept")
    each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("times"))), F.lit(0)).alias(f"s{i}") for i, lang in enumerate(langs)]
    kept = counted.join(grams, ["n", "gram"], "left_semi").groupBy("n", "gram").agg(*each).toPandas()
    for n, part in kept.sort_values(["n", "gram"]).groupby("n"):
        model["tables"][int(n)] = dict(zip(part["gram"], part[[f"s{i}" for i in range(len(langs))]].to_numpy().tolist(), strict=True))
    # one matrix of log frequencies; each table maps a gram to its row
    blocks, row = [], 0
    for n, table in sorted(model["tables"].items()):
        size = np.array([totals.get((lang, n), 0) for lang in langs], float)
        many = np.array([kinds.get((lang, n), 0) for lang in langs], float)
        times = np.array(list(table.values()), float)
        blocks.append(np.log(times + 0.1) - np.log(size + 0.1 * many + 1))
        model["tables"][n] = dict(zip(table, range(row, row + len(table)), strict=True))
        row += len(table)
    model["scores"] = np.concatenate(blocks)
    words = np.array([totals.get((lang, 0), 0) for lang in langs], float)
    model["prior"] = int(words.argmax())
    beyond = counted.where("n = 0").join(grams.where("n = 0"), "gram", "left_anti").groupBy(F.col("gram").alias("word")).agg(*each)
    size = [float(np.log(totals.get((lang, 0), 0) + 0.1 * kinds.get((lang, 0), 0) + 1)) for lang in langs]
    beyond = beyond.select("word", *[(F.log(F.col(f"s{i}") + 0.1) - size[i]).alias(f"s{i}") for i in range(len(langs))])
    top = F.array_max(F.array(*[F.col(f"s{i}") for i in range(len(langs))]))
    return model, beyond.select("word", *[(F.col(f"s{i}") - top).alias(f"s{i}") for i in range(len(langs))])


class Identifier:
    """Scores texts with a model, each distinct word once while there is room for it."""

    def __init__(self, model: dict, room: int = 400_000):
        self.model, self.room = model, room
        self.rows: dict[str, int] = {}
        self.known = np.empty((0, len(model["langs"]) + 1))

    def _learn(self, words: list[str]) -> None:
        tables, scores = self.model["tables"], self.model["scores"]
        whole = tables.get(0, {})
        orders = [(n, tables[n]) for n in ORDERS if n in tables]
        flat, sizes, weights = [], [], []
        for word in words:
            row = whole.get(word)
            if row is not None:
                flat.append(row)
                sizes.append(1)
                weights.append(1.0)
                continue
            for n, table in orders:
                found = [table[g] for g in _grams(word, n) if g in table]
                if found:
                    flat += found
                    sizes.append(len(found))
                    weights.append(STEP_WEIGHT[n])
                    break
            else:
                flat.append(0)
                sizes.append(1)
                weights.append(0.0)
        size, weight = np.array(sizes), np.array(weights)
        mean = np.add.reduceat(scores[flat], np.cumsum(size) - size) / size[:, None]
        got = weight[:, None] * (mean - mean.max(1, keepdims=True))
        self.rows.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.known = np.concatenate([self.known, np.column_stack([got, weight > 0])])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        langs = self.model["langs"]
        if len(self.rows) > self.room:
            self.rows, self.known = {}, self.known[:0]
        cut = [words_of(t) if t and langs else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.rows)
        if new:
            self._learn(list(new))
        out = []
        for words in cut:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.known[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(0)
            n = total[-1]
            if not n:
                out.append((langs[self.model["prior"]], 1.0 / len(langs)))
                continue
            mean = total[:-1] / n * min(n, 16)
            p = np.exp(mean - mean.max())
            best = int(mean.argmax())
            out.append((langs[best], float(p[best] / p.sum())))
        return out


def identify(model: dict, text: str | None) -> tuple[str, float]:
    """(language, probability). ``und`` for null, no letter or a model without languages. Of equal
    scores the first language by name wins; a text of unknown letters gets the commonest language.
    The probability comes from the mean score of a word, as if from at most 16 words."""
    return Identifier(model)([text])[0]


def _text_verdicts(keyed: DataFrame, model: dict, beyond: DataFrame) -> DataFrame:
    """(key, lang_pred, lang_score) of each distinct text with a letter of ``keyed`` (key, text).

    Words of the model are summed where the text is. The others of a text leave it as one array of (word,
    times) and meet their scores, of the counts if they were seen and of shorter grams if not, in a join."""
    langs = model["langs"]
    k = len(langs)
    shared = keyed.sparkSession.sparkContext.broadcast(model)
    scores = [f"s{i}" for i in range(k)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, table = shared.value["tables"].get(0, {}), shared.value["scores"]
        table = table - table.max(1, keepdims=True)
        for batch in batches:
            key, times, sums, words, many, ends = [], [], [], [], [], [0]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted = Counter(words_of(text.as_py()))
                if not counted:
                    continue
                at = np.fromiter(map(whole.get, counted, repeat(-1)), np.int64, len(counted))
                often = np.fromiter(counted.values(), np.int64, len(counted))
                out = at < 0
                key.append(name)
                times.append(int(often[~out].sum()))
                sums.append(often[~out] @ table[at[~out]])
                words += compress(counted, out.tolist())
                many += often[out].tolist()
                ends.append(len(words))
            lists = [pa.array([x[i] for x in sums], pa.float64()) for i in range(k)]
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(many, pa.int64())], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.binary()), pa.array(times, pa.int64()), *lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                names=["key", "times", *scores, "beyond"],
            )

    columns = ", ".join(f"{c} double" for c in scores)
    told = keyed.mapInArrow(spread, f"key binary, times bigint, {columns}, beyond array<struct<word:string,times:bigint>>")
    # a number per row travels with its words; the table is stored, so numbers stay
    told = materialize(told.withColumn("place", F.monotonically_increasing_id()), "language-texts")

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            one = Identifier(shared.value)
            if words:
                one._learn(words)
            got = one.known if words else np.empty((0, k + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[:, i]) for i in range(k + 1)]], names=["word", *scores, "known"])

    open_words = told.select("place", F.explode("beyond").alias("x")).select("place", "x.word", "x.times")
    unseen = open_words.select("word").distinct().join(beyond, "word", "left_anti")
    unseen = unseen.mapInArrow(shorter, f"word string, {columns}, known double")
    by_word = beyond.withColumn("known", F.lit(1.0)).unionByName(unseen)
    met = open_words.join(by_word, "word").select(
        "place", (F.col("times") * F.col("known")).alias("known"), *[(F.col("times") * F.col(c)).alias(c) for c in scores]
    )
    own = told.select("place", F.col("times").cast("double").alias("known"), *scores)
    total = own.unionByName(met).groupBy("place").agg(*[F.sum(c).alias(c) for c in ("known", *scores)])
    # equal texts share a key and a verdict
    total = told.select("place", "key").join(total, "place").dropDuplicates(["key"])
    mean = F.array(*[F.col(c) / F.col("known") * F.least("known", F.lit(16.0)) for c in scores])
    total = total.withColumn("mean", F.when(F.col("known") > 0, mean)).withColumn("top", F.array_max("mean"))
    best = F.array_position("mean", F.col("top"))
    share = 1 / F.aggregate("mean", F.lit(0.0), lambda a, m: a + F.exp(m - F.col("top")))
    names = F.array(*[F.lit(lang) for lang in langs])
    return total.select(
        "key",
        F.coalesce(F.get(names, (best - 1).cast("int")), F.lit(langs[model["prior"]])).alias("lang_pred"),
        F.coalesce(share, F.lit(1.0 / k)).alias("lang_score"),
    )


def with_language(documents: DataFrame, model: dict, beyond: DataFrame | None, spread: str) -> DataFrame:
    """``documents`` with the columns lang_pred and lang_score, from the whole text alone. Columns of
    these names are replaced. Equal texts are dealt over tasks by column ``spread``."""
    rows = documents.drop("lang_pred", "lang_score")
    if beyond is None:
        return rows.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("lang_score", F.lit(0.0))
    key = free_name("lang_key", rows.columns)
    keyed = rows.where("text IS NOT NULL").select(text_digest(F.col("text")).alias("key"), "text")
    verdicts = materialize(_text_verdicts(keyed, model, beyond), "language-verdicts").withColumnRenamed("key", key)
    names = rows.columns
    out = salted_join(rows.withColumn(key, text_digest(F.col("text"))), verdicts, [key], spread, "left", salts=4)
    return out.select(
        *names, F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("lang_score", F.lit(0.0)).alias("lang_score")
    )


def held_out(doc_id: str) -> Column:
    """Documents the model never learns from: crc32 of the id as text, modulo 4, is 2. A null id is
    not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_verdicts(documents: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. The model learns from the documents that are not
    held out and have a lang. Works on empty tables (empty result) and without any lang (all ``und``)."""
    docs = docs_of(documents, "doc_id", "text", "lang")
    learned = _learned(docs.where(~held_out("doc_id")), **how)
    out = with_language(docs.select("doc_id", "text"), *learned, "doc_id")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def identified_documents(documents: DataFrame, least_score: float = 0.5, **how) -> DataFrame:
    """The rows whose language is told with ``least_score`` or more, with the same columns."""
    names = {"lang_pred", "lang_score"}
    clash = [c for c in documents.columns if c.lower() in names]
    held = documents.withColumnsRenamed({c: f"held__{c}" for c in clash})
    kept = with_language(held, *_learned(documents, **how), "doc_id").where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least_score)
    )
    return kept.drop("lang_pred", "lang_score").withColumnsRenamed({f"held__{c}": c for c in clash}).select(documents.columns)

