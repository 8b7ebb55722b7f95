"""Entity jobs over texts: alignment of coded places, tags to spans, data-set statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentry.functions import spans
from incidentry.functions.text import blank_to_null, strip
from incidentry.operators.ranks import null_safe
from incidentry.session import spread

FIELD_LABELS = {"state": "STATE", "district": "DISTRICT", "village_name": "VILLAGE", "other_locations": "OTHER_LOCATION"}

TOKEN_BLOCK = 1 << 16  # places of a document that one task reads together


def align_places(df: DataFrame, id_col: str, text: str = "incident_summary", threshold: float = 85.0) -> DataFrame:
    """(id, start, end, label, text) of every coded place found in its text.

    A literal match comes first. Only places without one go to the Arrow helper for
    the normal-form and fuzzy search; comma lists of other locations are taken apart.
    """

    def labelled(c: str, label: str) -> Column:
        values = F.split(strip(F.col(c)), ",") if c == "other_locations" else F.array(strip(F.col(c)))
        items = F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), strip(v).alias("value")))
        return F.coalesce(items, F.array().cast("array<struct<label:string,value:string>>"))

    parts = [labelled(c, label) for c, label in FIELD_LABELS.items() if c in df.columns]
    items = F.filter(F.concat(*parts), lambda x: F.coalesce(x.value != "", F.lit(False)))
    long = df.filter(blank_to_null(F.col(text)).isNotNull()).select(
        id_col, F.col(text).alias("_text"), F.explode(items).alias("_x"))
    long = long.select(id_col, "_text", "_x.label", "_x.value")
    at = spans.exact_span(F.col("_text"), F.col("value"))
    # Equal pairs stand side by side, so a batch of the loose search meets them together and searches them once.
    long = spread(long, "_text", "value").sortWithinPartitions("_text", "value").withColumn("_at", at)
    # Not deterministic to the planner, which else runs the search for the filter below, before rows are spread, and again.
    loose = spans.loose_span(threshold).asNondeterministic()(F.when(F.col("_at") < 0, F.col("_text")), F.when(F.col("_at") < 0, F.col("value")))
    long = long.withColumn("_loose", loose)
    start = F.when(F.col("_at") >= 0, F.col("_at")).otherwise(F.col("_loose.start"))
    end = F.when(F.col("_at") >= 0, F.col("_at") + F.length("value")).otherwise(F.col("_loose.end"))
    return long.withColumns({"start": start, "end": end}).filter("start is not null").select(
        id_col, "start", "end", "label", F.col("_text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def entity_dataset(df: DataFrame, id_col: str = "incident_number", text: str = "incident_summary") -> DataFrame:
    """(text, entities, metadata) per row with a text: resolved spans beside the coded fields, blanks for missing ones."""
    found = align_places(df, id_col, text).groupBy(id_col).agg(
        F.collect_list(F.struct("start", "end", "label", "text")).alias("_raw"))
    base = df.filter(blank_to_null(F.col(text)).isNotNull()).join(found, id_col, "left")
    fields = [id_col, *[c for c in ("date", *FIELD_LABELS) if c in df.columns]]
    meta = F.struct(*[F.coalesce(strip(F.col(c).cast("string")), F.lit("")).alias(c) for c in fields])
    empty = F.array().cast(spans.ENTITY)
    entities = F.when(F.col("_raw").isNull(), empty).otherwise(spans.resolve_overlaps(F.col("_raw")))
    return base.select(F.col(text).alias("text"), entities.alias("entities"), meta.alias("metadata"))


def dataset_statistics(ner: DataFrame) -> DataFrame:
    """One row: examples with and without entities, entities in all and per label, mean, examples with all three levels."""
    e = F.col("entities")
    labels = F.transform(e, lambda x: x.label)
    core = [F.array_contains(labels, x) for x in spans.SINGLE]

    def times(label: str) -> Column:
        return F.size(F.filter(labels, lambda x: x == label))

    return ner.agg(
        F.count("*").alias("total_examples"),
        F.count_if(F.size(e) > 0).alias("examples_with_entities"),
        F.count_if(F.size(e) == 0).alias("examples_without_entities"),
        F.sum(F.size(e)).cast("bigint").alias("total_entities"),
        F.coalesce(F.avg(F.when(F.size(e) > 0, F.size(e))), F.lit(0.0)).alias("avg_entities_per_example"),
        F.count_if(core[0] & core[1] & core[2]).alias("examples_with_all_types"),
        *[F.sum(times(label)).cast("bigint").alias(f"n_{label.lower()}") for label in spans.LABELS],
    )


def tags_to_spans(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", token: str = "token",
                  tag: str = "tag", block: int = TOKEN_BLOCK) -> DataFrame:
    """Entity spans (doc, label, start_token, end_token, text) of BIO tags, one row per token in.

    A span begins at a B tag, or at an I tag that does not continue the label before
    it. Special tokens and O end a span. ``pos`` is a whole number; gaps are allowed.

    Tokens are read in blocks of ``block`` places, so a document of any length spreads over
    tasks. A span over block borders is found as one piece a block; what a block inherits
    follows from the first and last rows of the blocks before it. Pieces that reach neither
    end of their block are spans as they are: they are neither joined nor shuffled again.
    """
    special = F.col(token).isin(*spans.SPECIAL_TOKENS)
    label = F.when(~special & F.col(tag).rlike("^[BI]-"), F.expr(f"substring(`{tag}`, 3)"))
    unit = [doc, "_block"]
    order = W.partitionBy(*unit).orderBy(pos)
    t = tokens.select(
        doc, F.floor(F.col(pos) / block).alias("_block"), pos, token, label.alias("_label"),
        F.coalesce(F.col(tag).startswith("B-"), F.lit(False)).alias("_b"))
    opens = F.col("_label").isNotNull() & (F.col("_b") | ~F.col("_label").eqNullSafe(F.lag("_label").over(order)))
    t = t.withColumn("_opens", opens.cast("int"))
    t = t.withColumn("_piece", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    end = F.lag(F.lit(1)).over(order).isNull() | F.lead(F.lit(1)).over(order).isNull()

    words = F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda x: x[token])
    pieces = t.withColumn("_end", end).filter("_label is not null").groupBy(*unit, "_piece").agg(
        F.first("_label").alias("label"), F.min(pos).alias("_from"), F.max(pos).alias("_to"), words.alias("_words"),
        F.max("_end").alias("_end"))
    inner = pieces.filter("not _end").select(
        doc, "label", F.col("_from").alias("start_token"), (F.col("_to") + 1).alias("end_token"),
        F.array_join("_words", " ").alias("text"))
    owned = null_safe(pieces.filter("_end"), _inherited(t, doc, pos), unit, "left")
    mine = F.col("_owner").isNull() | (F.col("_piece") > 1)
    parts = owned.select(
        doc, "label", F.when(mine, F.struct("_block", F.col("_piece").cast("long").alias("_piece")))
        .otherwise(F.struct(F.col("_owner._block"), F.col("_owner._piece"))).alias("_span"),
        F.struct("_from", "_to", "_words").alias("_part"))
    whole = parts.groupBy(doc, "_span").agg(
        F.first("label").alias("label"), F.min("_part._from").alias("start_token"), (F.max("_part._to") + 1).alias("end_token"),
        F.array_sort(F.collect_list("_part")).alias("_parts"))
    text = F.array_join(F.flatten(F.transform("_parts", lambda x: x["_words"])), " ")
    return inner.unionByName(whole.select(doc, "label", "start_token", "end_token", text.alias("text")))


def _inherited(t: DataFrame, doc: str, pos: str) -> DataFrame:
    """(doc, _block, _owner) of the blocks whose first piece goes on from an earlier block; the piece that owns it.

    Works on one row per document and block. A block of one piece that itself goes on hands its owner down.
    """
    ends = t.groupBy(doc, "_block").agg(
        F.min_by(F.struct("_label", "_b"), pos).alias("_head"), F.max_by("_label", pos).alias("_tail"),
        F.sum("_opens").alias("_n"))
    along = W.partitionBy(doc).orderBy("_block")
    before = F.lag("_tail").over(along)
    ends = ends.withColumn("_goes_on", F.coalesce(
        ~F.col("_head._b") & (F.col("_head._label") == before), F.lit(False)))
    begins = F.col("_n") > F.col("_goes_on").cast("int")
    last = F.struct("_block", F.col("_n").cast("long").alias("_piece"))
    owner = F.last(F.when(begins, last), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    return ends.withColumn("_owner", owner).filter("_goes_on").select(doc, "_block", "_owner")


def tag_arrays_to_spans(df: DataFrame, doc: str, tokens: str, tags: str) -> DataFrame:
    """The spans of :func:`tags_to_spans` from one row per document with arrays of tokens and tags.

    Nothing is shuffled or sorted: an Arrow batch is one flat array of tags, where a span begins and ends follows
    from comparing neighbours. Array functions of SQL are interpreted word by word and took twice the time. Tags
    without a token and tokens without a tag are outside.
    """
    out = T.StructType([df.schema[doc], T.StructField("label", T.StringType()), T.StructField("start_token", T.IntegerType()),
                        T.StructField("end_token", T.IntegerType()), T.StructField("text", T.StringType())])
    return df.select(doc, F.col(tokens).alias("_tokens"), F.col(tags).alias("_tags")).mapInArrow(_batch_spans, out)


def _batch_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, tokens, tags = batch.columns
        # A list that is null has length null; the shorter list of a row counts.
        n = pc.fill_null(pc.min_element_wise(
            pc.list_value_length(tokens), pc.list_value_length(tags), skip_nulls=False), 0).to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - first[row]
        words = tokens.values.take(pa.array(tokens.offsets.to_numpy()[:-1][row] + place))
        coded = tags.values.take(pa.array(tags.offsets.to_numpy()[:-1][row] + place)).dictionary_encode()

        names = coded.dictionary.to_pylist()
        labels = sorted({x[2:] for x in names if x[:2] in ("B-", "I-")})
        # One more entry stands for null tags.
        label_of = np.array([labels.index(x[2:]) if x[:2] in ("B-", "I-") else -1 for x in names] + [-1])
        begins = np.array([x.startswith("B-") for x in names] + [False])
        code = pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False)
        outside = pc.or_(pc.is_null(words), pc.is_in(words, value_set=pa.array(spans.SPECIAL_TOKENS, words.type)))
        label = np.where(outside.to_numpy(zero_copy_only=False), -1, label_of[code])

        edge = (place == 0) | (label != np.roll(label, 1)) | (label < 0) | begins[code]
        edges = np.append(np.flatnonzero(edge), len(label))
        start = np.flatnonzero(edge & (label >= 0))
        end = edges[np.searchsorted(edges, start, side="right")]
        inside = words.filter(pa.array(label >= 0))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - start)]), pa.int32()), inside)
        yield pa.RecordBatch.from_arrays([
            docs.take(pa.array(row[start])), pa.array(labels, pa.string()).take(pa.array(label[start])),
            pa.array(place[start], pa.int32()), pa.array(place[start] + end - start, pa.int32()),
            pc.binary_join(lists, " ").cast(pa.string()),
        ], names=[batch.schema.names[0], "label", "start_token", "end_token", "text"])


def tag_names(tag_id: str = "tag_id"):
    """BIO tag text of a tag id: 0 outside, then B and I per label."""
    names = ["O"] + [f"{k}-{label}" for label in spans.LABELS for k in ("B", "I")]
    return F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in names]), F.col(tag_id) + 1), F.lit("O"))


def token_table(ner: DataFrame, doc: str) -> DataFrame:
    """(doc, pos, token, tag_id) of a (doc, text, entities) table with white-space tokens."""
    t = ner.withColumn("_tokens", spans.word_offsets(F.col("text")))
    t = t.withColumn("_tags", spans.tag_tokens(F.col("_tokens"), F.col("entities")))
    return t.select(doc, F.posexplode(F.arrays_zip("_tokens", "_tags")).alias("pos", "_x")).select(
        doc, "pos", F.col("_x._tokens.token").alias("token"), F.col("_x._tags").alias("tag_id"))
