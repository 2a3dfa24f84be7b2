"""Vocabulary, encoding and aligned vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.arrays import pad_ids
from lectern.functions.text import tokens
from lectern.operators.metrics import index_labels
from lectern.plans.ranking import number_rows
from lectern.plans.scratch import settle


def token_freq(df: DataFrame, text: str = "texto") -> DataFrame:
    """Corpus frequency of every token (counted map-side before the shuffle)."""
    words = df.select(F.explode(tokens(text)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def build_vocab(freq: DataFrame, min_freq: int = fixed.MIN_FREQ, most: int = fixed.MAX_VOCAB) -> DataFrame:
    """Words with index and frequency: frequent first, then alphabetical; 0 and 1 are reserved."""
    kept = freq.where((F.col("freq") >= min_freq) & ~F.col("word").isin(fixed.PAD, fixed.UNK))
    ranked = number_rows(kept, [F.desc("freq"), F.asc("word")], out="__r").where(F.col("__r") <= most)
    words = ranked.select("word", (F.col("__r") + 1).cast("int").alias("idx"), "freq")
    spark = freq.sparkSession
    reserved = spark.createDataFrame(
        [(fixed.PAD, fixed.PAD_ID, 0), (fixed.UNK, fixed.UNK_ID, 0)], "word string, idx int, freq long"
    )
    return settle(reserved.unionByName(words), "vocab")


def vocab_summary(vocab: DataFrame) -> DataFrame:
    own = ~F.col("word").isin(fixed.PAD, fixed.UNK)
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"), F.count_if(own).alias("n_words"))


def encode_tokens(df: DataFrame, vocab: DataFrame, id_col: str, toks: str, out: str = "ids") -> DataFrame:
    """Token arrays to id arrays (1 = unknown), keyed by ``id_col`` (unique).

    The compact arrays are shuffled once by id; exploding, the vocabulary lookup (a broadcast
    join while the vocabulary file is below the threshold) and the regrouping then stay in
    place. Arrays are at most one window long.
    """
    placed = df.select(id_col, toks).repartition(F.col(id_col))
    exploded = placed.select(id_col, F.posexplode_outer(toks).alias("pos", "word"))
    looked_up = exploded.join(vocab.select("word", "idx"), "word", "left")
    entry = F.when(
        F.col("pos").isNotNull(), F.struct("pos", F.coalesce("idx", F.lit(fixed.UNK_ID)).alias("i"))
    )
    return looked_up.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["i"]).alias(out)
    )


def encode(
    df: DataFrame, vocab: DataFrame, length: int = fixed.MAX_LEN, id_col: str = "ord", text: str = "texto"
) -> DataFrame:
    """``id, ids``: the ids of the first ``length`` tokens."""
    head = df.select(id_col, F.slice(tokens(text), 1, length).alias("toks"))
    return encode_tokens(head, vocab, id_col, "toks")


def token_table(df: DataFrame, vocab: DataFrame, id_col: str = "ord", text: str = "texto") -> DataFrame:
    """One row per token: position, word, id, whether it is unknown."""
    exploded = df.select(id_col, F.posexplode(tokens(text)).alias("pos", "word"))
    looked_up = exploded.join(vocab.select("word", "idx"), "word", "left")
    return looked_up.select(
        id_col, "pos", "word", F.coalesce("idx", F.lit(fixed.UNK_ID)).alias("idx"),
        F.col("idx").isNull().alias("is_unk"),
    )


def feature_table(
    df: DataFrame, vocab: DataFrame, length: int = fixed.MAX_LEN, id_col: str = "ord", text: str = "texto"
) -> DataFrame:
    """Padded ids and the four class indices of every row."""
    ids = encode(df, vocab, length, id_col, text).select(id_col, pad_ids("ids", length).alias("ids"))
    indices = index_labels(df.select(id_col, *[c for c in df.columns if c in (*fixed.HEADS, "supervision", "domain")]), [id_col])
    # the four index rows of a row id become columns again without leaving its partition
    wide = indices.groupBy(id_col).agg(
        *[F.max(F.when(F.col("head") == h, F.col("y_true"))).alias(f"y_{h}") for h in fixed.HEADS]
    )
    return ids.join(wide, id_col)


def needed_vectors(vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vectors of vocabulary words only, the first line per word."""
    own = vocab.where(~F.col("word").isin(fixed.PAD, fixed.UNK)).select("word")
    return vectors.join(own, "word", "left_semi")


def hashed_normal(seed: int, key: Column, dim: int, scale: float = 0.1) -> Column:
    """``dim`` normal values that depend only on (seed, key, position)."""

    def uniform(position: Column, draw: int) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), position.cast("string"), F.lit(str(draw)))
        bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
        return (bits + 1.0) / float(2**32 + 1)

    def value(position: Column) -> Column:
        radius = F.sqrt(-2.0 * F.ln(uniform(position, 0)))
        return (F.lit(scale) * radius * F.cos(2.0 * F.pi() * uniform(position, 1))).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)


def align_vectors(vocab: DataFrame, vectors: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """``idx, word, found, vec`` for every vocabulary row: the file's vector; zeros for the
    reserved rows; seeded normal values for words without a vector."""
    usable = needed_vectors(vectors, vocab).where(F.size("vec") == dim).select("word", "vec")
    joined = vocab.select("word", "idx").join(usable, "word", "left")
    reserved = F.col("word").isin(fixed.PAD, fixed.UNK)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    filled = F.when(reserved, zeros).otherwise(F.coalesce("vec", hashed_normal(seed, F.col("idx"), dim)))
    return joined.select("idx", "word", F.col("vec").isNotNull().alias("found"), filled.alias("vec"))


def vector_coverage(aligned: DataFrame) -> DataFrame:
    """Vocabulary words with and without a vector, and the share without."""
    own = aligned.where(~F.col("word").isin(fixed.PAD, fixed.UNK))
    n, hit = F.count(F.lit(1)), F.count_if("found")
    return own.agg(
        n.alias("n_words"), hit.alias("n_found"), F.when(n > 0, (n - hit) / n).otherwise(0.0).alias("oov_rate")
    )


def oov_rate(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unknown share of a token table."""
    return table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if("is_unk").alias("n_unknown"),
        F.avg(F.col("is_unk").cast("double")).alias("oov_rate"),
    )
