"""Document quality from weak labels: heuristic labellers, their accuracies by expectation
maximisation, and a hashed linear scorer trained on the posteriors.

Each labeller votes good, bad or nothing on a whole text. All documents are counted by their vote
pattern (at most 3 to the power of the labellers, whatever the corpus); expectation maximisation on these
counts gives each labeller's rates on good and bad documents and the posterior of each pattern, without
hand labels. The posteriors of a bounded sample of documents (``train_rows``, drawn by hash) train a
logistic scorer over hashed character-class trigrams and repetition measures, which scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of, free_name
from netsift.session import materialize

#: Symbols that running prose hardly has.
SYMBOLS = "#*$%&|<>"
SENTENCE_ENDS = ".!?:;\"'»”…)"
#: Labeller: a measure, good at or below the first bound (None: never votes good), bad at or above the
#: second, else no vote. Each kind of junk meets several of them.
LABELLERS = (
    ("symbols", None, 0.25),
    ("capitals", None, 0.50),
    ("shouts", None, 0.30),
    ("stutter", None, 0.20),
    ("echo", 0.30, 0.75),
    ("ragged", 0.30, 0.70),
    ("no_letters", 0.12, 0.20),
    ("odd_words", 0.10, 0.30),
    ("few_kinds", 0.70, 0.90),
)
#: A word of letters with at most one mark on either side.
PLAIN_WORD = re.compile(r"[\"'«“(]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?\"'»”)…]?")
DIGIT = re.compile(r"\d")
DIMS, TRAIN_ROWS, KEEP_SCORE = 1024, 4000, 0.5


def _measures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' measures, and the character classes of the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(low) != len(code):
        low = np.frombuffer("".join(c if len(c.lower()) != 1 else c.lower() for c in text).encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = code != low
    table = np.full(128, 6, np.uint8)
    table[[9, 11, 12, 13, 32]] = 3
    table[10] = 4
    table[48:58] = 2
    table[97:123] = 0
    table[65:91] = 1
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[marks] = np.arange(7, 7 + len(marks))
    kind = np.where(code < 128, table[np.minimum(code, 127)], np.where(upper, 1, 0)).astype(np.uint8)
    words = text.split()
    n = max(len(words), 1)
    letters = max(int((kind <= 1).sum()), 1)
    symbols = np.isin(code, [ord(c) for c in SYMBOLS]).sum()
    ids: dict = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    stutter = (seq[1:] == seq[:-1]).sum() / n
    echo = 0.0
    if len(seq) >= 3:
        grams = (seq[:-2] * len(ids) + seq[1:-1]) * len(ids) + seq[2:]
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        echo = (times[back] > 1).mean()
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    ragged = sum(x[-1] not in SENTENCE_ENDS for x in lines) / max(len(lines), 1)
    odd = sum(PLAIN_WORD.fullmatch(w) is None and not DIGIT.search(w) for w in words) / n
    few = 0.0 if len(words) < 20 else 1 - min(1.0, len(ids) / (2 * len(words) ** 0.7))
    no_letters = 1 - (kind <= 2).sum() / max(int(((kind != 3) & (kind != 4)).sum()), 1)
    capitals = (upper & (kind == 1)).sum() / letters
    return np.array([symbols / n, capitals, (code == 33).sum() / n, stutter, echo, ragged, no_letters, odd, few]), kind


def votes_of(measures: np.ndarray) -> int:
    """The vote pattern as a number in base 3: 0 no vote, 1 good, 2 bad."""
    code = 0
    for x, (_, good, bad) in zip(measures, LABELLERS, strict=True):
        code = code * 3 + (1 if good is not None and x <= good else 2 if x >= bad else 0)
    return code


def hashed_features(measures: np.ndarray, kind: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): relative trigram frequencies under a square root, then the measures."""
    out = np.zeros(dims)
    if len(kind) >= 3:
        k = kind.astype(np.int64)
        gram = (k[:-2] * 64 + k[1:-1]) * 64 + k[2:]
        counts = np.bincount(gram, minlength=1)
        seen = np.flatnonzero(counts)
        slot = (seen * 0x9E3779B1 % (1 << 32) >> 7) % (dims - 16)
        out[: dims - 16] = np.sqrt(np.bincount(slot, counts[seen], dims - 16) / len(gram))
    out[dims - 16 : dims - 16 + len(measures)] = np.minimum(measures, 1.0)
    out[dims - 1] = 1.0
    slots = np.flatnonzero(out)
    return slots.astype(np.int32), out[slots]


def estimate(counts: pd.DataFrame, rounds: int = 200) -> dict:
    """Expectation maximisation over (pattern, rows): posterior of good per pattern, the rates of each
    labeller and the share of good documents. Starts from the labellers' agreement: one bad vote
    leaves it open, more say bad."""
    n_l = len(LABELLERS)
    patterns = counts["pattern"].to_numpy()
    rows = counts["rows"].to_numpy(float)
    votes = np.array([[p // 3 ** (n_l - 1 - i) % 3 for i in range(n_l)] for p in patterns]).reshape(-1, n_l)
    bad = (votes == 2).sum(1)
    good = np.where(bad == 0, 0.99, np.where(bad == 1, 0.6, 0.02))
    rates = np.zeros((2, n_l, 3))
    prior = 0.5
    for _ in range(rounds):
        prior = (good @ rows + 1) / (rows.sum() + 2)
        for c, p in enumerate((1 - good, good)):
            for v in range(3):
                rates[c, :, v] = ((p * rows) @ (votes == v) + 0.5) / (p @ rows + 1.5)
        log = np.log([1 - prior, prior])[None, :] + np.stack(
            [np.log(rates[c, np.arange(n_l), votes]).sum(1) for c in range(2)], 1
        )
        log -= log.max(1, keepdims=True)
        new = np.exp(log[:, 1]) / np.exp(log).sum(1)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return {
        "posterior": dict(zip(patterns.tolist(), good.tolist(), strict=True)),
        "prior": prior,
        "bad_vote_if_bad": dict(zip([x[0] for x in LABELLERS], rates[0, :, 2].tolist(), strict=True)),
        "bad_vote_if_good": dict(zip([x[0] for x in LABELLERS], rates[1, :, 2].tolist(), strict=True)),
    }


def train_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels, both classes weighing the same, by accelerated gradient steps."""
    x, good = x.astype(np.float32), good.astype(np.float32)
    weight = good / max(good.sum(), 1e-9) + (1 - good) / max((1 - good).sum(), 1e-9)
    weight /= weight.sum()
    step = 4.0 / max((weight[:, None] * x * x).sum(), 1e-9)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - good
        new = ahead - np.float32(step) * (x.T @ (weight * error) + np.float32(decay) * ahead)
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _draw() -> Column:
    """A number below 2^30 from the hash of doc_id and text."""
    return F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30))


def quality_model(documents: DataFrame, train_rows: int = TRAIN_ROWS, dims: int = DIMS) -> dict:
    """Weights and labeller rates learned from ``documents`` (doc_id, text); weights is None when no
    document has text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for text in batch.column(0):
                code = votes_of(_measures(text.as_py())[0])
                seen[code] = seen.get(code, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "rows"]
            )

    docs = docs_of(documents, "doc_id", "text").where("text IS NOT NULL")
    counts = (
        docs.select("text").mapInArrow(vote, "pattern bigint, rows bigint")
        .groupBy("pattern").agg(F.sum("rows").alias("rows")).orderBy("pattern").toPandas()
    )
    if not len(counts):
        return {"weights": None, "dims": dims}
    model = estimate(counts)
    posterior, total = model["posterior"], int(counts["rows"].sum())

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, good = [], []
        for frame in frames:
            for text in frame["text"]:
                measures, kind = _measures(text)
                slots, values = hashed_features(measures, kind, dims)
                row = np.zeros(dims, np.float32)
                row[slots] = values
                rows.append(row)
                good.append(posterior[votes_of(measures)])
        if rows:
            yield pd.DataFrame({"weights": [train_scorer(np.array(rows), np.array(good)).tolist()]})

    # a document's hash decides on the sample, so it is the same in every run
    share = min(1.0, train_rows / total)
    drawn = docs.where(_draw() < int(share * (1 << 30)))
    sample = materialize(drawn.select("text"), "quality-sample")
    got = sample.coalesce(1).mapInPandas(train, "weights array<double>").collect()
    return {**model, "dims": dims, "weights": got[0]["weights"] if got else None}


def score_quality(documents: DataFrame, model: dict) -> DataFrame:
    """``documents`` with quality_score (0 bad to 1 good; 0 for null text or one without a word; 1 when
    the model had nothing to learn from). A column of that name is replaced."""
    weights, dims = model["weights"], model["dims"]
    w = None if weights is None else np.array(weights)

    def one(text: str | None) -> float:
        if not text or not text.strip():
            return 0.0
        if w is None:
            return 1.0
        slots, values = hashed_features(*_measures(text), dims)
        return float(1 / (1 + np.exp(-np.clip(w[slots] @ values, -30, 30))))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="float64")

    return documents.withColumn("quality_score", score("text"))


def _features(documents: DataFrame, dims: int) -> DataFrame:
    """doc_id, draw, pattern, slots, vals of each row, the last three null without text. One pass over the texts;
    the rest works on this table."""
    rows = docs_of(documents, "doc_id", "text").select("doc_id", "text", _draw().alias("draw"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, slots, vals = [], [], []
            for text in batch.column(1):
                if not text.is_valid:
                    pattern.append(None)
                    slots.append(None)
                    vals.append(None)
                    continue
                measures, kind = _measures(text.as_py())
                at, values = hashed_features(measures, kind, dims)
                pattern.append(votes_of(measures))
                # a text without a word scores 0
                slots.append(at.astype("<u2").tobytes() if text.as_py().strip() else None)
                vals.append(values.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(pattern, pa.int64()), pa.array(slots, pa.binary()), pa.array(vals, pa.binary())],
                names=["doc_id", "draw", "pattern", "slots", "vals"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(
        rows.mapInArrow(extract, f"doc_id {kind}, draw bigint, pattern bigint, slots binary, vals binary"), "quality-features"
    )


def quality_verdicts(documents: DataFrame, keep_score: float = KEEP_SCORE, train_rows: int = TRAIN_ROWS, dims: int = DIMS) -> DataFrame:
    """Per row of ``documents``: doc_id, quality_score, kept (score >= ``keep_score``). Null texts and texts
    without a word score 0 and are not kept; repeated rows have repeated verdicts; an empty table gives an
    empty result. Texts are read once, their measures and features are stored (``dims`` below 65,536)."""
    told = _features(documents, dims)
    counts = told.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("rows")).orderBy("pattern").toPandas()
    w = None
    if len(counts):
        posterior = estimate(counts)["posterior"]
        share = min(1.0, train_rows / int(counts["rows"].sum()))

        def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, good = [], []
            for frame in frames:
                for pattern, at, values in zip(frame["pattern"], frame["slots"], frame["vals"], strict=True):
                    row = np.zeros(dims, np.float32)
                    if at is not None:
                        row[np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
                    x.append(row)
                    good.append(posterior[pattern])
            if x:
                yield pd.DataFrame({"weights": [train_scorer(np.array(x), np.array(good)).tolist()]})

        drawn = told.where(F.col("pattern").isNotNull() & (F.col("draw") < int(share * (1 << 30)))).select("pattern", "slots", "vals")
        got = drawn.coalesce(1).mapInPandas(train, "weights array<double>").collect()
        w = np.array(got[0]["weights"]) if got else None

    @F.pandas_udf("double")
    def score(slots: pd.Series, vals: pd.Series) -> pd.Series:
        out = np.zeros(len(slots))
        for i, (at, values) in enumerate(zip(slots, vals, strict=True)):
            if at is not None:
                out[i] = 1.0 if w is None else w[np.frombuffer(at, "<u2")] @ np.frombuffer(values, "<f4").astype(float)
        return pd.Series(out if w is None else np.where(slots.notna(), 1 / (1 + np.exp(-np.clip(out, -30, 30))), 0.0))

    scored = told.select("doc_id", score("slots", "vals").alias("quality_score"))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= keep_score).alias("kept"))


def good_documents(documents: DataFrame, keep_score: float = KEEP_SCORE, **how) -> DataFrame:
    """The rows of ``documents`` that the scorer keeps, with the same columns. Null texts and texts without a
    word go; repeated rows stay repeated; an empty table gives an empty result."""
    name = free_name("quality_kept", documents.columns)
    model = quality_model(documents, **how)
    extra = "quality_score" in [c.lower() for c in documents.columns]
    if not extra:
        return score_quality(documents, model).where(F.col("quality_score") >= keep_score).drop("quality_score")
    held = documents.withColumn(name, F.col("quality_score"))
    kept = score_quality(held, model).where(F.col("quality_score") >= keep_score)
    return kept.withColumn("quality_score", F.col(name)).drop(name)
