"""Training rows that repeat evaluation rows: equal texts, and shared word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import let
from tallyforge.session import materialize


def normal_text(text: Column) -> Column:
    """Lower case, everything but letters and digits made single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def exact(train: DataFrame, train_text: str, held_out: DataFrame, held_out_text: str) -> DataFrame:
    """Training rows whose normalised text is that of a held-out row."""
    keyed = train.withColumn("_key", F.md5(normal_text(F.col(train_text))))
    keys = held_out.where(normal_text(F.col(held_out_text)) != "").select(F.md5(normal_text(F.col(held_out_text))).alias("_key")).distinct()
    return keyed.join(keys, "_key", "left_semi").drop("_key")


def ngrams(text: Column, n: int) -> Column:
    """The distinct word n-grams of a text, as 64-bit hashes; none if it has fewer words."""
    words = F.transform(F.filter(F.split(normal_text(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w))

    def grams(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, n))))

    return let(words, grams)


#: Held-out n-grams up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_MOST = 1_000_000


def containment(
    train: DataFrame, train_id: str, train_text: str, held_out: DataFrame, held_out_id: str, held_out_text: str, n: int = 8, least: float = 0.5, broadcast_most: int = BROADCAST_MOST
) -> DataFrame:
    """Pairs in which the training row holds at least ``least`` of the held-out row's n-grams.

    A row that holds so many holds one of any ``size - needed + 1`` of them; those that fewest held-out rows have are chosen, so
    wording that many held-out rows share makes no candidates. Of a training row only n-grams that some held-out row has are
    kept, once; the candidates are then counted exactly. Null and short texts, on either side, match nothing.
    """
    wanted = materialize(held_out.select(F.col(held_out_id).alias("item"), F.explode(ngrams(F.col(held_out_text), n)).alias("gram")).distinct(), "held-out-ngrams")
    few = wanted.count() <= broadcast_most
    known = wanted.select("gram").distinct()
    own = train.select(F.col(train_id).alias("doc"), F.explode(ngrams(F.col(train_text), n)).alias("gram"))
    own = materialize(own.join(F.broadcast(known) if few else known, "gram", "left_semi"), "shared-ngrams").distinct()
    spread = wanted.groupBy("gram").agg(F.count("*").alias("items"))
    per_item = Window.partitionBy("item")
    ranked = wanted.join(spread, "gram").select("item", "gram", F.count("*").over(per_item).alias("n_grams"), F.row_number().over(per_item.orderBy("items", "gram")).alias("nth"))
    rare = ranked.where(F.col("nth") <= F.col("n_grams") - F.ceil(F.col("n_grams") * least - 1e-9) + 1).select("item", "gram")
    candidates = own.join(rare, "gram").select("doc", "item").distinct()
    sizes = wanted.groupBy("item").agg(F.count("*").cast("int").alias("n_grams"))
    pairs = candidates.join(wanted, "item").join(own, ["doc", "gram"]).groupBy("doc", "item").agg(F.count("*").alias("shared"))
    return pairs.join(sizes, "item").select("doc", "item", "shared", "n_grams", (F.col("shared") / F.col("n_grams")).alias("containment")).where(F.col("containment") >= least)
