"""Corpus BLEU and ROUGE over tokenised predictions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from incidentry.functions.probability import array_sum
from incidentry.session import spread


def words(c: Column, pattern: str = r"\s+") -> Column:
    return F.filter(F.split(c, pattern), lambda w: w != "")


def shared_count(x: Sequence, y: Sequence, k: int) -> int:
    """Number of ``k``-grams of ``x`` found in ``y``, each at most as often as there."""
    of_y = Counter(zip(*[y[i:] for i in range(k)]))
    return (Counter(zip(*[x[i:] for i in range(k)])) & of_y).total()


def shared_ngrams(orders: Sequence[int]):
    """Arrow UDF of two token arrays: :func:`shared_count` of every order; a distinct pair of a batch is counted once."""

    @F.pandas_udf(ArrayType(LongType()))
    def count(a, b):
        import pandas as pd

        seen: dict = {}
        out = []
        for x, y in zip(a, b, strict=True):
            pair = (() if x is None else tuple(x), () if y is None else tuple(y))
            if pair not in seen:
                seen[pair] = [shared_count(*pair, k) for k in orders]
            out.append(seen[pair])
        return pd.Series(out)

    return count


def _of_order(tokens: Column, k: int) -> Column:
    """How many ``k``-grams a token array has."""
    return F.coalesce(F.greatest(F.size(tokens) - (k - 1), F.lit(0)), F.lit(0))


def bleu(df: DataFrame, id_col: str, pred: str, truth: str, order: int = 4) -> DataFrame:
    """One row: corpus BLEU, brevity penalty and the n-gram precisions, one reference text per row."""
    orders = range(1, order + 1)
    p, t = F.col("p"), F.col("t")
    rows = spread(df.select(id_col, words(F.col(pred)).alias("p"), words(F.col(truth)).alias("t")), id_col)
    counted = rows.select("p", "t", shared_ngrams(orders)("p", "t").alias("shared"))

    def precision(k: int) -> Column:
        total = F.sum(_of_order(p, k))
        return F.when(total > 0, F.sum(F.get("shared", F.lit(k - 1))) / total).otherwise(F.lit(0.0))

    out = counted.agg(F.sum(F.size(p)).alias("pred_length"), F.sum(F.size(t)).alias("truth_length"),
                      *[precision(k).alias(f"precision_{k}") for k in orders])
    logs = F.array(*[F.log(F.col(f"precision_{n}")) for n in range(1, order + 1)])
    penalty = F.when(F.col("pred_length") >= F.col("truth_length"), F.lit(1.0)).when(
        F.col("pred_length") > 0, F.exp(1 - F.col("truth_length") / F.col("pred_length"))).otherwise(F.lit(0.0))
    usable = F.least(*[F.col(f"precision_{n}") for n in range(1, order + 1)]) > 0
    score = F.when(usable, penalty * F.exp(array_sum(logs) / order)).otherwise(F.lit(0.0))
    return out.withColumns({"brevity_penalty": penalty, "bleu": score})


def subsequence_length(x: Sequence, y: Sequence) -> int:
    """Length of the longest common subsequence, with the rows of its table as the bits of one number."""
    places: dict = {}
    for i, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(y)) - 1
    row = full
    for w in x:
        met = row & places.get(w, 0)
        row = (row + met | row - met) & full
    return len(y) - row.bit_count()


@F.pandas_udf(IntegerType())
def common_subsequence(a, b):
    """Length of the longest common subsequence of two token arrays; each distinct pair of a batch is compared once."""
    import pandas as pd

    seen: dict = {}
    out = []
    for x, y in zip(a, b, strict=True):
        pair = (() if x is None else tuple(x), () if y is None else tuple(y))
        if pair not in seen:
            seen[pair] = subsequence_length(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="int32")


def rouge(df: DataFrame, id_col: str, pred: str, truth: str) -> DataFrame:
    """One row: mean ROUGE-1, ROUGE-2, ROUGE-L F-measures over lower-case alphanumeric tokens."""
    def tokens(c: str) -> Column:
        return words(F.lower(F.col(c)), r"[^a-z0-9]+")

    def f(shared: Column, n_p: Column, n_t: Column) -> Column:
        return F.when(n_p + n_t > 0, 2 * shared / (n_p + n_t)).otherwise(F.lit(0.0))

    def score(shared: Column, k: int) -> Column:
        return f(shared, _of_order(F.col("p"), k), _of_order(F.col("t"), k))

    rows = spread(df.select(id_col, tokens(pred).alias("p"), tokens(truth).alias("t")), id_col)
    counted = rows.select("p", "t", shared_ngrams((1, 2))("p", "t").alias("shared"),
                          common_subsequence("p", "t").alias("common"))
    return counted.agg(*[F.avg(score(F.get("shared", F.lit(k - 1)), k)).alias(f"rouge{k}") for k in (1, 2)],
                       F.avg(f(F.col("common"), F.size("p"), F.size("t"))).alias("rougeL"))
