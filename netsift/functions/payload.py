"""Payload features. Hashes and distances are built-ins; byte statistics are Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 64-bit FNV-1a offset basis and prime, feature sizes and version.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
SHINGLE_BYTES = 3
PREFIX_BYTES = 32
FEATURE_VERSION = "1"
PRINTABLE_CONTROLS = (9, 10, 13)

_PRINTABLE = np.zeros(256, dtype=bool)
_PRINTABLE[0x20:0x7F] = True
_PRINTABLE[list(PRINTABLE_CONTROLS)] = True
# Four bits of a byte, each in a lane of 16 bits of one word: summed words are four counts at once.
_LANES = np.zeros((2, 256), dtype=np.uint64)
for _half in range(2):
    for _lane in range(4):
        _set = (np.arange(256) >> (4 * _half + _lane)) & 1
        _LANES[_half] |= _set.astype(np.uint64) << np.uint64(16 * _lane)
# Hashes whose votes share a lane (it overflows at 65,536), and bytes and payloads handled at once.
SEGMENT = 1 << 15
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1 << 12


def _simhashes(data: np.ndarray, sizes: np.ndarray) -> list[str]:
    """64-bit SimHash over 3-byte shingles of each payload in the buffer; a tied vote sets the bit."""
    widths = np.minimum(sizes, SHINGLE_BYTES)
    spans = sizes - widths + 1
    total = int(spans.sum())
    starts = np.cumsum(spans) - spans
    inside = np.arange(total) - np.repeat(starts, spans)
    at = np.repeat(np.cumsum(sizes) - sizes, spans) + inside
    state = np.full(total, FNV_OFFSET, dtype=np.uint64)
    width = np.repeat(widths, spans) if widths.min() < SHINGLE_BYTES else None
    for i in range(int(widths.max())):
        if width is None:
            state ^= data[at + i]
            state *= np.uint64(FNV_PRIME)
        else:
            rows = width > i
            state[rows] = (state[rows] ^ data[at[rows] + i].astype(np.uint64)) * np.uint64(FNV_PRIME)
    octets = np.ascontiguousarray(state.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    segments = np.flatnonzero(inside % SEGMENT == 0)
    ones = np.empty((len(segments), 64), dtype=np.int64)
    for bit in range(0, 64, 4):
        sums = np.add.reduceat(_LANES[bit // 4 % 2][octets[bit // 8]], segments)
        for lane in range(4):
            ones[:, bit + lane] = (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    votes = np.add.reduceat(ones, np.searchsorted(segments, starts), axis=0)
    packed = np.packbits(2 * votes >= spans[:, None], axis=1, bitorder="little")[:, ::-1]
    text = packed.tobytes().hex()
    return [text[i : i + 16] for i in range(0, len(text), 16)]


def _block_stats(payloads: list[bytes]) -> list[tuple[float, float, str]]:
    """Entropy, printable share and SimHash of payloads that have at least one byte each."""
    sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    cells = np.repeat(np.arange(len(sizes)) * 256, sizes) + data
    counts = np.bincount(cells, minlength=256 * len(sizes)).reshape(-1, 256)
    p = counts / sizes[:, None]
    bits = p * np.log2(p, where=counts > 0, out=np.zeros_like(p))
    entropy = (-bits.sum(axis=1) + 0.0).tolist()
    printable = (counts[:, _PRINTABLE].sum(axis=1) / sizes).tolist()
    digits = lambda values: [round(v, 4) for v in values]
    return list(zip(digits(entropy), digits(printable), _simhashes(data, sizes), strict=True))


def batch_stats(payloads: list[bytes | None]) -> list[tuple]:
    """Shannon entropy in bits, printable share (both 4 digits) and SimHash of each payload; nulls
    for an empty one. Payloads lie one after another in a buffer, which numpy reduces by row."""
    result: list[tuple] = [(None, None, None)] * len(payloads)
    block: list[int] = []
    held = 0

    def settle() -> None:
        for i, row in zip(block, _block_stats([payloads[i] for i in block]), strict=True):
            result[i] = row

    for i, payload in enumerate(payloads):
        if not payload:
            continue
        if block and (held + len(payload) > BLOCK_BYTES or len(block) == BLOCK_ROWS):
            settle()
            block, held = [], 0
        block.append(i)
        held += len(payload)
    if block:
        settle()
    return result


def byte_stats(payload: bytes) -> tuple[float, float, str]:
    return batch_stats([payload])[0]


def simhash(payload: bytes) -> str:
    return byte_stats(payload)[2]


_STATS = T.StructType(
    [
        T.StructField("payload_entropy", T.DoubleType()),
        T.StructField("payload_printable_ratio", T.DoubleType()),
        T.StructField("payload_simhash", T.StringType()),
    ]
)


@F.pandas_udf(_STATS)
def _byte_stats(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        batch_stats(payloads.tolist()), columns=["payload_entropy", "payload_printable_ratio", "payload_simhash"]
    )


def with_payload_features(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the seven payload features; all are null for an empty payload."""
    data = F.col(payload)
    has = F.length(data) > 0
    return (
        df.withColumn("__stats", _byte_stats(data))
        .withColumns(
            {
                "payload_hash": F.when(has, F.sha2(data, 256)),
                "payload_prefix_hash": F.when(has, F.sha2(F.substring(data, 1, PREFIX_BYTES), 256)),
                "payload_length": F.when(has, F.length(data)),
                "payload_entropy": F.col("__stats.payload_entropy"),
                "payload_printable_ratio": F.col("__stats.payload_printable_ratio"),
                "payload_simhash": F.col("__stats.payload_simhash"),
                "payload_feature_version": F.when(has, F.lit(FEATURE_VERSION)),
            }
        )
        .drop("__stats")
    )


def payload_sample(payload: Column | str, size: int) -> Column:
    """The first ``size`` (at most 256) payload bytes as hex."""
    if not 0 <= size <= 256:
        raise ValueError("a payload sample holds 0 to 256 bytes")
    col = F.col(payload) if isinstance(payload, str) else payload
    return F.lower(F.hex(F.substring(col, 1, size)))


def simhash_valid(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def simhash_distance(left: Column | str, right: Column | str) -> Column:
    """Hamming distance of two 16-digit SimHashes (null when either is malformed)."""
    a = F.col(left) if isinstance(left, str) else left
    b = F.col(right) if isinstance(right, str) else right
    half = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("bigint")
    bits = lambda i: F.bit_count(half(a, i).bitwiseXOR(half(b, i)))
    return F.when(simhash_valid(a) & simhash_valid(b), bits(1) + bits(9))


def simhash_bands(col: Column | str, bands: Column | int) -> Column:
    """Cut the 64 bits into ``bands`` runs: two hashes within bands−1 bits share at least one run."""
    col = F.col(col) if isinstance(col, str) else col
    word = lambda i: F.lpad(F.bin(F.conv(F.substring(col, i, 8), 16, 10).cast("bigint")), 32, "0")
    bits = F.concat(word(1), word(9))
    n = bands if isinstance(bands, Column) else F.lit(bands)
    start = lambda i: F.floor(i * 64 / n).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat_ws(
            ":", n.cast("string"), i.cast("string"), F.substring(bits, start(i) + 1, start(i + 1) - start(i))
        ),
    )


def payload_ascii(sample: Column | str) -> Column:
    """Readable rendering of hex bytes: printable as is, CR/LF/TAB escaped, a dot otherwise."""
    text = F.decode(F.unhex(sample), "ISO-8859-1")
    shown = F.regexp_replace(text, r"[^\x20-\x7E\r\n\t]", ".")
    for raw, escaped in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        shown = F.replace(shown, F.lit(raw), F.lit(escaped))
    return shown
