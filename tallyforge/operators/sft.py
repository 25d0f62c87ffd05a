"""Fine-tuning data: splits, label masks and conversation pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the label that a loss ignores.
IGNORED = -100


def held_out(key: Column, share: float = 0.15, seed: int = 42) -> Column:
    """Whether a key falls into the held-out part: by hash, so the same in every run and partitioning; share 0 disables it."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return bucket % 10_000 < round(share * 10_000)


def split(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(held_out(F.col(key), share, seed), "validation").otherwise("train"))


def mask_labels(ids: Column, mask: Column, prompt_length: Column) -> Column:
    """Token ids where the completion is, ``IGNORED`` for the prompt and the padding."""
    return F.transform(ids, lambda x, i: F.when((i < prompt_length) | (F.element_at(mask, i + 1) == 0), IGNORED).otherwise(x))


def fit(ids: Column, length: int, pad: int = 0) -> tuple[Column, Column]:
    """Token ids cut or padded to ``length``, and their attention mask."""
    kept = F.slice(ids, 1, length)
    gap = F.greatest(F.lit(0), F.lit(length) - F.size(kept))
    return F.concat(kept, F.array_repeat(F.lit(pad), gap)), F.concat(F.transform(kept, lambda x: F.lit(1)), F.array_repeat(F.lit(0), gap))


def fully_masked(labels: Column) -> Column:
    """No label is left: the prompt alone fills the sequence."""
    return ~F.exists(labels, lambda x: x != IGNORED)


def turn_pairs(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Each user turn with the assistant's turn right after it."""
    w = Window.partitionBy(conversation).orderBy(turn)
    nexts = df.withColumn("_role", F.lead(role).over(w)).withColumn("completion", F.lead(text).over(w))
    return nexts.where((F.col(role) == "user") & (F.col("_role") == "assistant")).select(conversation, turn, F.col(text).alias("prompt"), "completion")
