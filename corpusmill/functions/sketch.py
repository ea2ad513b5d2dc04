"""SimHash of token sets and Hamming distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..deploy import ship
from .text import TR_WORD, norm_text

#: Tokens whose bits are counted at a time (64 bytes each).
VOTES = 1 << 19


def simhash_tokens(x: Column) -> Column:
    """Words of two characters or more; whatever is no Turkish letter or digit parts them."""
    return F.filter(F.split(F.regexp_replace(norm_text(x), f"[^{TR_WORD}]", " "), " +"), lambda t: F.length(t) >= 2)


def folded_md5(token: Column) -> Column:
    """Both halves of a token's md5, folded into 64 bits."""
    half = lambda at: F.conv(F.substring(F.md5(token), at, 16), 16, -10).cast("long")
    return half(1).bitwiseXOR(half(17))


@F.pandas_udf(LongType())
def _votes(hashes: pd.Series) -> pd.Series:
    """Signed 64-bit SimHash of each row's token hashes: every token votes on every bit."""
    size = np.array([0 if x is None else len(x) for x in hashes], np.int64)
    flat = np.concatenate([x for x in hashes if x is not None and len(x)] or [np.zeros(0, np.int64)]).astype(">i8")
    ones = np.zeros((len(size), 64), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    for at in range(0, len(flat), VOTES):  # slices of tokens, not rows
        bits = np.unpackbits(flat[at : at + VOTES].view(np.uint8).reshape(-1, 8), axis=1)
        some = row[at : at + VOTES]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        ones[some[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    out = np.packbits(2 * ones >= size[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)
    return pd.Series(np.where(size > 0, out, 0), dtype="int64")


def simhash64(x: Column) -> Column:
    """64-bit SimHash as a signed long; 0 without tokens.  Tokens are hashed in the JVM; the votes
    of a batch are counted together."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return _votes(F.transform(simhash_tokens(x), folded_md5))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(h: Column, bits: int = 16) -> Column:
    """The top bits of a hash."""
    return F.shiftrightunsigned(h, 64 - bits)
