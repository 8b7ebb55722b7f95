"""Quality rules as a ledger: each rule is evaluated once and leaves a bit and the figures behind it.

A policy is a versioned set of bits. Applying one, or asking what a rule changes, reads the ledger alone.

Defined results: a null or empty text has no words, all figures 0 and fails ``few_words``. Repeated rows and
repeated ids give one ledger row each. Columns beyond id and text are neither read nor carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import blank_words, row_map

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

Figure = Callable[[str], Column]
#: Rules in the order of their bits, each over the figures of one document. Every comparison is in integers.
RULES: dict[str, Callable[[Figure], Column]] = {
    "few_words": lambda f: f("n_words") < 50,
    "repeated_windows": lambda f: 100 * f("n_repeat_words") > 50 * f("n_words"),
    "symbols": lambda f: 100 * f("n_symbols") > 25 * f("n_words"),
    "repeated_lines": lambda f: 100 * f("n_dup_lines") > 60 * f("n_lines"),
    "long_words": lambda f: f("word_chars") > 30 * f("n_words"),
    "short_words": lambda f: f("word_chars") < 2 * f("n_words"),
    "shouting": lambda f: 100 * f("n_upper") > 60 * f("word_chars"),
}
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of three that stands twice or more in the text. Exact: windows are numbered."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    a = np.fromiter([number(w, len(ids)) for w in words], np.int64, n)
    code, kinds = a[:-1] * len(ids) + a[1:], len(ids)
    if kinds ** 3 >= 2 ** 63:  # number the pairs first, so that no product overflows
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    window = code[:-1] * kinds + a[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, np.unique(twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of one text, in the order of ``FIGURES``."""
    text = text or ""
    words = blank_words(text)
    seen, lines, repeats = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), repeats,
            repeated_words(words), lines, upper)


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << i for i, rule in enumerate(RULES) if rule in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the figures, and ``failed``, the bits of the rules it breaks."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in FIGURES)
    measured = row_map(docs, lambda i, text: (i, *figures(text)), schema, [id_col, text_col])
    return measured.withColumn("failed", failed_bits(F.col))


def failed_bits(figure: Figure) -> Column:
    """The bits of all rules, from the figures that ``figure`` names."""
    bits = [F.when(rule(figure), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return reduce(Column.bitwiseOR, bits).cast("long")


def rejected(policy: str | tuple[str, ...] = CURRENT) -> Column:
    """Over a ledger: whether ``policy`` rejects the row."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) != 0


def ablation(book: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and those that only it rejects.

    Rows are first counted per distinct set of bits, of which there are at most 2 to the number of rules.
    """
    mask = policy_mask(policy)
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, r in enumerate(RULES) if mask >> i & 1])
    return (
        counts.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


def apply_policy(docs: DataFrame, policy: str | tuple[str, ...] = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their columns unchanged.

    The figures are computed beside each row, so nothing is shuffled or joined.
    """
    @F.pandas_udf(", ".join(f"{c} long" for c in FIGURES))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([figures(t) for t in texts], columns=list(FIGURES), dtype="int64")

    mark = "__figures"
    measured = docs.withColumn(mark, measure(F.col(text_col)))
    bits = failed_bits(lambda c: F.col(mark)[c])
    return measured.where(bits.bitwiseAND(F.lit(policy_mask(policy))) == 0).drop(mark)
