"""Line dedup by a log-template tree, in built-in expressions only.

Lines are parsed to a fixed depth: by their number of tokens, then by their leading tokens, tokens with a digit being
variable. In a leaf a token that few lines have at its place is variable too. What is left, with the variable fields
blanked, is the line's template, if enough of it is constant. Lines whose template recurs across documents are dropped.

Support is always a number of different texts: copies count once, and so does a text with many lines of one form. Texts
with the same lines in a leaf are one row with their number, so a line that a third of all documents hold is one row too.
Only leaves that enough texts reach are parsed further. A line of ``LONG_LINE`` tokens is a passage, and recurs from
``LEAST_LONG`` texts on. Long texts are shuffled only if the list of lines to drop is too large to send.

Defined results: null text is empty and has no line; blank lines are kept and never templates; lines of fewer than
``LEAST_CONSTANT`` constant tokens are kept. Repeated rows and ids give one row each. Other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import checked_broadcast, written

#: Leading tokens of the tree.
LEADING = 3
#: Different texts that hold a template, or a token at its place in a leaf, at least.
LEAST_DOCUMENTS = 10
#: Tokens of a passage at least, and different texts that hold it.
LONG_LINE = 50
LEAST_LONG = 2
#: Constant tokens of a template at least, and their share of all.
LEAST_CONSTANT = 3
CONSTANT_SHARE = 0.5
FIELD = "<*>"
#: A token that holds a digit; possessive, so that long tokens are read once.
DIGITS = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def masked(line: Column) -> Column:
    """A line with single blanks and its tokens with digits blanked out."""
    # Most lines need neither change, and to see that is cheaper than to make it.
    blanked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGITS, FIELD)).otherwise(line)
    return F.when(line.rlike(r"[\t\x0B\f\r]| {2}|^ | $"), F.trim(F.regexp_replace(blanked, r"\s+", " "))).otherwise(blanked)


def tokens_in(mask: Column) -> Column:
    return F.when(mask == "", 0).otherwise(F.length(mask) - F.length(F.replace(mask, F.lit(" "), F.lit(""))) + 1)


def leaf_of(mask: Column) -> Column:
    """The leaf of the tree that a masked line falls into, as a hash."""
    return F.xxhash64(tokens_in(mask), F.substring_index(mask, " ", LEADING))


def _parted(docs: DataFrame, text_col: str) -> DataFrame:
    """(whole, at, mask): the masked lines that are long enough for a template, of every row."""
    # Hashed and masked before lines are parted: beside a generator the hash of a text would be made for each line.
    texts = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("whole"),
                        F.transform(lines_of(F.col(text_col)), masked).alias("masks"))
    lines = texts.select("whole", F.posexplode("masks").alias("at", "mask"))
    return lines.where(tokens_in(F.col("mask")) >= LEAST_CONSTANT)


def lines_by_leaf(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(whole, at, leaf, line, passage) of every line, written once: later passes read hashes."""
    mask = F.col("mask")
    return written(_parted(docs, text_col).select(
        "whole", "at", leaf_of(mask).alias("leaf"), F.md5(mask).alias("line"),
        (tokens_in(mask) >= LONG_LINE).alias("passage")), "lines")


def _held(docs: DataFrame, lines: DataFrame, text_col: str) -> DataFrame:
    """(leaf, line, mask) of the different ``lines``, each masked anew from one place in one text that holds it.

    Few lines of a corpus are in leaves that enough texts reach, so masks of all need not be written. The places are those in
    the least hashes, so few texts hold them.
    """
    places = lines.groupBy("leaf", "line").agg(F.min(F.struct("whole", "at")).alias("p"))
    places = written(places.select("leaf", "line", "p.whole", "p.at"), "leaf-places")
    texts = docs.select(F.col(text_col).alias("text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("whole"))
    texts = texts.join(checked_broadcast(places.select("whole").distinct(), 64), "whole", "left_semi")
    parts = texts.select("whole", F.posexplode(lines_of(F.col("text"))).alias("at", "part"))
    found = parts.join(checked_broadcast(places, 128), ["whole", "at"])
    return found.select("leaf", "line", masked(F.col("part")).alias("mask")).dropDuplicates(["leaf", "line"])


def _texts(rows: DataFrame, per: list[str], counted: list[str], name: str) -> DataFrame:
    """Sum of ``n`` per ``per`` over its different ``counted``."""
    return rows.select(*per, *counted, "n").distinct().groupBy(*per).agg(F.sum("n").alias(name))


def templates(docs: DataFrame, lines: DataFrame, text_col: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(line, mask, template, support) of the lines of ``docs`` whose template ``least`` different texts hold.

    ``lines`` is what :func:`lines_by_leaf` gives for ``docs``.
    """
    leaves = _texts(lines.withColumn("n", F.lit(1)), ["leaf"], ["whole"], "reach").where(F.col("reach") >= least)
    leaves = written(leaves.select("leaf"), "leaves")
    # Texts with the same lines in a leaf are one row.
    sets = lines.join(checked_broadcast(leaves, 16), "leaf", "left_semi").groupBy("leaf", "whole").agg(
        F.array_sort(F.collect_set("line")).alias("lines"))
    sets = sets.groupBy("leaf", "lines").agg(F.count("*").alias("n"))
    member = written(sets.select(F.md5(F.array_join("lines", "")).alias("set"), "n", F.explode("lines").alias("line")), "leaf-sets")

    reached = lines.select("leaf", "line", "whole", "at").join(checked_broadcast(leaves, 16), "leaf", "left_semi")
    held = written(_held(docs, reached, text_col), "leaf-lines")
    placed = held.select("leaf", "line", F.posexplode(F.split("mask", " ")).alias("at", "token"))
    constant = _texts(placed.where(F.col("token") != FIELD).join(member, "line"), ["leaf", "at", "token"], ["set"], "held")
    constant = constant.where(F.col("held") >= least).select("leaf", "at", "token", F.lit(True).alias("stays"))
    known = placed.join(constant, ["leaf", "at", "token"], "left")
    field = F.when(F.col("stays"), F.col("token")).otherwise(F.lit(FIELD))
    parsed = known.groupBy("leaf", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", field.alias("t")))), lambda x: x.t), " ").alias(
            "template"),
        F.count("stays").alias("constant"), F.count("*").alias("size"))
    firm = parsed.where((F.col("constant") >= LEAST_CONSTANT) & (F.col("constant") >= CONSTANT_SHARE * F.col("size")))
    firm = written(firm.select("line", "template"), "line-templates")
    support = _texts(firm.join(member, "line"), ["template"], ["set"], "support").where(F.col("support") >= least)
    return firm.join(support, "template").join(held, "line").select("line", "mask", "template", "support")


def passages(lines: DataFrame, least: int = LEAST_LONG) -> DataFrame:
    """(line) of the passages that at least ``least`` different texts hold."""
    return _texts(lines.where("passage").withColumn("n", F.lit(1)), ["line"], ["whole"], "support").where(
        F.col("support") >= least).select("line")


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per row: its id, ``n_lines`` that are not blank, ``n_dropped`` of them, and ``text`` of the lines left."""
    lines = lines_by_leaf(docs, text_col)
    found = templates(docs, lines, text_col, least).select("line").union(passages(lines)).distinct()
    found = written(found, "recurring-lines")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = lines.join(checked_broadcast(found, 64), "line", "left_semi").groupBy("whole").agg(
        F.collect_set("at").alias("gone"))
    gone = written(gone, "dropped-lines")
    width = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    sent = checked_broadcast(gone, max(64, -(-width // max(1, gone.count()))))
    met = rows.withColumn("whole", F.md5("text")).join(sent, "whole", "left")
    kept = F.filter(lines_of(F.col("text")), lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    full = F.regexp_count("text", F.lit(r"\S[^\n]*"))  # one match a line that is not blank
    return met.select(F.col("id").alias(id_col), full.cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
