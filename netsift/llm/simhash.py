"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

The terms of a text are its distinct words. A term weighs as much as it has characters, up to
``MAX_WEIGHT``: function words, which all texts of a language share, are short. Four hashes of a term give
256 bits; each bit is a vote of the term's weight for or against that bit of the fingerprint, and a bit is
set if the votes for it are more than half of all weight. A bit's votes are a sum, so no text's terms are
held together: they are exploded and summed, two 32-bit counters to a long.

Two texts whose term vectors stand at an angle differ in that share of their bits (over pi), so likeness is
one minus the share of different bits.

Search. Cut into ``radius + 1`` blocks or more, two fingerprints within the radius agree in all but at most
``radius`` of them. There is one table for every choice of the blocks that agree, keyed by these blocks, and
a query meets only the rows of its key. No fingerprint within the radius is missed. A pair counts in the first
table that holds it, equal fingerprints are one row with a count, and a crowded key is dealt over salts.

Only DataFrame functions are used.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import docs_of, salted_join
from netsift.session import materialize

PARTS, MAX_WEIGHT, RADIUS = 4, 12, 8
BITS = 64 * PARTS
LANES = 0x0000000100000001
#: Rows of one range of doc_id, and ranges at most: 65,536 numbers go through the driver at most.
ROWS_PER_RANGE, MOST_RANGES, SAMPLE_PER_RANGE = 128, 1 << 16, 20
SALTS = 4


def _terms(text: Column) -> Column:
    """Distinct words as hashes whose low four bits are the weight."""
    words = F.split(text, r"[\x20\x09-\x0D]+")
    hashed = F.transform(
        F.filter(words, lambda w: w != ""),
        lambda w: F.xxhash64(w).bitwiseAND(F.lit(-16)).bitwiseOR(F.least(F.char_length(w), F.lit(MAX_WEIGHT)).cast("long")),
    )
    return F.array_distinct(hashed)


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and f0 to f3, the four longs of the fingerprint of ``text``. ``keys`` must tell the rows apart.
    A text without a word (empty, null or white space) has the fingerprint 0."""
    term = texts.select(*keys, F.explode_outer(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    parts = term.select(*keys, "term", F.explode(F.array(*[F.lit(p) for p in range(PARTS)])).alias("part"))
    weight = F.col("term").bitwiseAND(F.lit(15))
    voted = parts.select(*keys, "part", weight.alias("weight"), F.xxhash64("term", "part").alias("h"))
    sums = [
        F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"s{i}") for i in range(32)
    ]
    summed = voted.groupBy(*keys, "part").agg(F.sum("weight").alias("total"), *sums)

    def bit(votes: Column, at: int) -> Column:
        return F.shiftleft(F.when(votes * 2 > F.col("total"), F.lit(1)).otherwise(F.lit(0)).cast("long"), at)

    value = F.lit(0).cast("long")
    for i in range(32):
        value = value.bitwiseOR(bit(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)), i))
        value = value.bitwiseOR(bit(F.shiftrightunsigned(f"s{i}", 32), i + 32))
    valued = summed.select(*keys, "part", value.alias("value"))
    return valued.groupBy(*keys).agg(*[F.max(F.when(F.col("part") == p, F.col("value"))).alias(f"f{p}") for p in range(PARTS)])


def written(parts: list[Column]) -> Column:
    """A fingerprint as 64 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts])


def distance(a: list[Column], b: list[Column]) -> Column:
    """Different bits of two fingerprints."""
    out = F.lit(0)
    for x, y in zip(a, b, strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def _blocks(parts: list[Column], blocks: int) -> list[Column]:
    """The fingerprint cut into runs of bits, nearly equal in length."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        value = F.lit(0).cast("long")
        for p in range(lo // 64, (hi - 1) // 64 + 1):
            start, end = max(lo, 64 * p) - 64 * p, min(hi, 64 * p + 64) - 64 * p
            mask = (1 << (end - start)) - 1
            run = F.shiftrightunsigned(parts[p], start).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
            value = value.bitwiseXOR(F.shiftleft(run, 64 * p + start - lo))
        out.append(value)
    return out


def _tables(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row per fingerprint and table: table, key (the blocks that must agree, in table order)."""
    cut = rows.select("*", F.array(*_blocks([F.col(f"f{p}") for p in range(PARTS)], blocks)).alias("blocks"))
    keys = [
        F.struct(F.lit(t).alias("table"), F.xxhash64(*[F.col("blocks")[b] for b in chosen]).alias("key"))
        for t, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    exploded = cut.select(*rows.columns, F.explode(F.array(*keys)).alias("k"))
    return exploded.select(*rows.columns, "k.table", "k.key")


def within_radius(all_rows: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Per distinct fingerprint (f0 to f3) of ``queries``: n_within, the rows of ``all_rows`` whose fingerprint
    differs in at most ``radius`` bits, equal ones included. Every row of ``all_rows`` counts, repeated ones
    too. ``blocks`` (more than ``radius``) trades more tables for longer keys. Fingerprints with a null part
    are left out; an empty table on either side gives 0 rows or counts of 0."""
    blocks = blocks or radius + 1
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be more than radius")
    names = [f"f{p}" for p in range(PARTS)]
    copies = all_rows.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("copies"))
    asked = queries.dropna(subset=names).select(*[F.col(c).alias(f"q{i}") for i, c in enumerate(names)]).distinct()
    salt = F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int")
    there = _tables(copies, radius, blocks).withColumn("salt", salt)
    here = _tables(asked.select(*[F.col(f"q{i}").alias(c) for i, c in enumerate(names)]), radius, blocks)
    here = here.select(*[F.col(c).alias(f"q{i}") for i, c in enumerate(names)], "table", "key")
    here = here.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    f, q = [F.col(c) for c in names], [F.col(f"q{i}") for i in range(PARTS)]
    met = here.join(there, ["table", "key", "salt"]).where(distance(f, q) <= radius)
    # a pair stands in several tables: the first whose blocks agree counts it
    mine, theirs = _blocks(q, blocks), _blocks(f, blocks)
    first = F.coalesce(
        *[
            F.when(_all_equal([mine[b] for b in chosen], [theirs[b] for b in chosen]), F.lit(t))
            for t, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
    )
    found = met.where(F.col("table") == first).groupBy(*[f"q{i}" for i in range(PARTS)]).agg(F.sum("copies").alias("n_within"))
    on = [f"q{i}" for i in range(PARTS)]
    return asked.join(found, on, "left").select(
        *[F.col(f"q{i}").alias(c) for i, c in enumerate(names)], F.coalesce("n_within", F.lit(0)).alias("n_within")
    )


def _all_equal(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & (x == y)
    return out


def _ranges(rows: DataFrame, rows_per_range: int) -> Column:
    """The range of each doc_id, ascending, null first: about ``rows_per_range`` rows share one. The bounds come
    from ids drawn by hash; they decide where rows lie, never what comes out."""
    total = rows.count()
    wanted = min(MOST_RANGES, -(-total // rows_per_range))
    share = min(1.0, wanted * SAMPLE_PER_RANGE / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id").dropna()
    ids = sorted(r[0] for r in drawn.toLocalIterator())
    bounds = sorted({ids[len(ids) * k // wanted] for k in range(1, wanted)}) if ids else []
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    splits = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(splits, at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at),
    )
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found)


def with_next(documents: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(range, place, own, doc_id, text, next_text): each row with the text of the one after it in descending
    doc_id (null last, ties by text), the last with that of the first. Null texts count as empty. Texts are
    shuffled once, by range; a range also gets the first row of the following one, with ``own`` false. Rows
    of one doc_id share a range. A single row is its own next."""
    rows = docs_of(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    where = _ranges(rows.select("doc_id"), rows_per_range)
    ranged = rows.withColumn("range", where)
    tops = rows.select("doc_id", where.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    tops = sorted(tops.toLocalIterator(), key=lambda r: -r["range"])
    handed = [(r["top"], tops[k - 1]["range"]) for k, r in enumerate(tops)]
    # at most one row per range, see MOST_RANGES
    heads = F.broadcast(documents.sparkSession.createDataFrame(handed, "top bigint, handed int"))
    both = ranged.join(heads, ranged["doc_id"].eqNullSafe(heads["top"]), "left")
    copies = F.filter(
        F.array(
            F.struct(F.col("range"), F.lit(True).alias("own")),
            F.struct(F.col("handed").alias("range"), F.lit(False).alias("own")),
        ),
        lambda x: x["range"].isNotNull(),
    )
    dealt = both.select("doc_id", "text", F.explode(copies).alias("x")).select("x.range", "x.own", "doc_id", "text")
    order = Window.partitionBy("range").orderBy(F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select(
        "range", F.row_number().over(order).alias("place"), "own", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def document_fingerprints(documents: DataFrame, radius: int = RADIUS, every: int = 20, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and n_within: for rows whose doc_id is divisible by ``every`` the number of other
    rows with a fingerprint within ``radius`` bits, else null.

    The edited text is the text whose last half (rounded down) is replaced by as much of the beginning of the
    next text, or by all of it if it is shorter. Null texts are empty ones; texts without a word have
    fingerprint 0 and are alike; repeated rows give repeated rows; an empty table gives an empty result."""
    pairs = with_next(documents, rows_per_range)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    told = pairs.select("range", "place", "own", "doc_id", "text", edited.alias("edited"), n.cast("long").alias("n_chars"))
    told = told.withColumn("sha", F.when(F.col("own"), F.unhex(F.sha2("edited", 256))))
    keys = ["range", "place", "own", "doc_id", "n_chars", "sha"]
    # a row that was handed over needs its own fingerprint only
    kinds = F.filter(
        F.array(
            F.struct(F.lit(False).alias("edited"), F.col("text")),
            F.when(F.col("own"), F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text"))),
        ),
        lambda x: x.isNotNull(),
    )
    texts = told.select(*keys, F.explode(kinds).alias("x")).select(*keys, F.col("x.edited").alias("is_edited"), "x.text")
    prints = fingerprints(texts, [*keys, "is_edited"])
    names = [f"f{p}" for p in range(PARTS)]
    rows = prints.groupBy(*keys).agg(
        *[F.max(F.when(~F.col("is_edited"), F.col(c))).alias(c) for c in names],
        *[F.max(F.when(F.col("is_edited"), F.col(c))).alias(f"e{c}") for c in names],
    )
    order = Window.partitionBy("range").orderBy("place")
    ahead = rows.select("*", *[F.lead(c).over(order).alias(f"n{c}") for c in names]).where("own")
    mine = [F.col(c) for c in names]
    like = lambda prefix: 1 - distance(mine, [F.col(f"{prefix}{c}") for c in names]) / F.lit(float(BITS))
    stored = materialize(
        ahead.select(
            "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), written(mine).alias("fingerprint"),
            written([F.col(f"e{c}") for c in names]).alias("edited_fingerprint"),
            like("e").alias("near_edited"), like("n").alias("near_next"), *names,
        ),
        "fingerprints",
    )
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = within_radius(stored.select(*names), stored.where(is_query).select(*names), radius)
    asked = salted_join(stored.where(is_query), found, names, "doc_id", "left", SALTS)
    asked = asked.withColumn("n_within", F.col("n_within") - 1)
    out = asked.unionByName(stored.where(~is_query).withColumn("n_within", F.lit(None).cast("long")))
    return out.drop(*names)
