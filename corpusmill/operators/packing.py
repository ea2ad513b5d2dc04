"""Token blocks of bounded length, their statistics, and masking for language models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

#: Ids of the tokens that begin and end, and that hide others; bounds of a block.
CLS, SEP, MASK, MAX_LEN, MIN_LEN = 2, 3, 4, 512, 32
#: Runs that a corpus is packed in.
SHARDS = 64


class Packer:
    """Fills one running block with sentences until the next doesn't fit.

    A block starts with CLS; each sentence is followed by SEP.  A sentence longer than a block
    is emitted in wrapped slices, which have no lower bound of length.  The end of a document
    adds one more SEP to a block that holds something.  Finished blocks shorter than min_len
    are dropped.
    """

    def __init__(self, max_len: int = MAX_LEN, min_len: int = MIN_LEN, cls: int = CLS, sep: int = SEP):
        self.max_len, self.min_len, self.cls, self.sep = max_len, min_len, cls, sep
        self.block = [cls]

    def flush(self) -> list[list[int]]:
        done, self.block = self.block, [self.cls]
        if done[-1] != self.sep:
            done.append(self.sep)
        return [done] if len(done) >= self.min_len else []

    def sentence(self, tokens: list[int]) -> list[list[int]]:
        room, out = self.max_len - 2, []
        if len(tokens) > room:
            if len(self.block) > 1:
                out += self.flush()
            return out + [[self.cls, *tokens[i : i + room], self.sep] for i in range(0, len(tokens), room)]
        if len(self.block) + len(tokens) + 1 > self.max_len:
            out += self.flush()
        self.block += [*tokens, self.sep]
        return out

    def document_end(self) -> list[list[int]]:
        if not 1 < len(self.block) < self.max_len:
            return []
        self.block.append(self.sep)
        return self.flush() if len(self.block) == self.max_len else []

    def end(self) -> list[list[int]]:
        return self.flush() if len(self.block) > 1 else []


def pack(docs: DataFrame, order: list[str], sentences_col: str, shards: int = SHARDS, max_len: int = MAX_LEN, min_len: int = MIN_LEN) -> DataFrame:
    """(shard, block, input_ids, attention_mask) of documents whose sentences are arrays of ids.

    Documents are dealt to shards by a hash of their order key, and each shard has a run of its
    own, so the result depends on their number only, not on the cluster; at most that many
    partial blocks more come out than from one run.  One shard packs all documents in order, a
    sequential task by its nature, for small inputs.
    """
    ship(docs.sparkSession)
    digest = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in order)))
    shard = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards).cast("int")
    dealt = docs.select(shard.alias("shard"), *order, F.col(sentences_col).alias("_s")).repartition(shards, "shard").sortWithinPartitions("shard", *order)
    col = len(order) + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, packer, n = None, None, 0
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if packer is None or r[0] != now:
                    if packer is not None:
                        rows += [(now, n + i, b) for i, b in enumerate(packer.end())]
                    now, packer, n = r[0], Packer(max_len, min_len), 0
                got = [b for s in (r[col] if r[col] is not None else []) for b in packer.sentence(list(s))] + packer.document_end()
                rows += [(now, n + i, b) for i, b in enumerate(got)]
                n += len(got)
            yield pd.DataFrame(rows, columns=["shard", "block", "input_ids"])
        if packer is not None:
            yield pd.DataFrame([(now, n + i, b) for i, b in enumerate(packer.end())], columns=["shard", "block", "input_ids"])

    blocks = dealt.mapInPandas(run, "shard int, block long, input_ids array<int>")
    return blocks.withColumn("attention_mask", attention_mask(F.col("input_ids")))


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def truncated(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def padded(ids: Column, length: int, pad: int = 0) -> Column:
    return F.concat(truncated(ids, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def chunked(ids: Column, size: int) -> Column:
    """Slices of at most size ids."""
    return F.when(F.size(ids) > 0, F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(size)), lambda i: F.slice(ids, i, size))).otherwise(F.array().cast("array<array<int>>"))


def tokenized(texts: Column, tokenize: Callable[[list[str]], list[list[int]]], spark: SparkSession) -> Column:
    """Ids of an array of texts by any tokenizer: tokenize takes a batch of texts and returns the
    ids of each.  It must be picklable, and may open its vocabulary at the first call."""
    ship(spark)

    @F.pandas_udf("array<array<int>>")
    def run(some: pd.Series) -> pd.Series:
        flat = [t for x in some if x is not None for t in x]
        ids, out = iter(tokenize(flat) if flat else []), []
        for x in some:
            out.append(None if x is None else [list(next(ids)) for _ in x])
        return pd.Series(out, dtype=object)

    return run(texts)


def stand_in_ids(words: Column) -> Column:
    """Ids for words where no vocabulary is at hand: 16 bits of their md5, after 5 special ids."""
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") + 5))


def packing_stats(blocks: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    n = F.size("input_ids")
    return blocks.agg(
        F.count("*").alias("blocks"),
        F.sum(n).cast("long").alias("tokens"),
        F.round(F.avg(n), 4).alias("mean_len"),
        F.round(F.sum(n) * 100 / (F.count("*") * max_len), 4).alias("efficiency_pct"),
        F.count_if(n == max_len).alias("full"),
        F.round(F.count_if(n == max_len) * 100 / F.count("*"), 4).alias("full_pct"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
    )


def length_histogram(blocks: DataFrame, low: int = 400, high: int = 512, width: int = 4) -> DataFrame:
    """(bin_start, n, density) of block lengths; the last bin holds its upper end too."""
    bins = (high - low) // width
    inside = blocks.select(F.size("input_ids").alias("len")).where(F.col("len").between(low, high))
    bin_no = F.least(F.floor((F.col("len") - low) / width), F.lit(bins - 1))
    counted = inside.groupBy((bin_no * width + low).cast("int").alias("bin_start")).agg(F.count("*").alias("n"))
    total = inside.agg(F.count("*").alias("_all"))  # one row
    return counted.join(F.broadcast(total)).select("bin_start", "n", F.round(F.col("n") / (F.col("_all") * width), 6).alias("density"))


def masked(ids: Column, seed: str, key: Column, share: float = 0.15, special: tuple[int, ...] = (0, 1, CLS, SEP, MASK)) -> tuple[Column, Column]:
    """(input ids, labels): about a share of the ordinary ids is hidden; labels are -100 elsewhere."""
    def hidden(t: Column, i: Column) -> Column:
        unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        return (unit < int(share * (1 << 32))) & ~t.isin(*special)

    return F.transform(ids, lambda t, i: F.when(hidden(t, i), F.lit(MASK)).otherwise(t)), F.transform(ids, lambda t, i: F.when(hidden(t, i), t).otherwise(F.lit(-100)))
