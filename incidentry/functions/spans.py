"""Entity spans held as arrays of structs (start, end, label, text[, score])."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentry.functions.similarity import indel_block
from incidentry.functions.text import ABBREVIATIONS, drop_descriptors, let, strip

LABELS = ("STATE", "DISTRICT", "VILLAGE", "OTHER_LOCATION")
SINGLE = LABELS[:3]
ENTITY = "array<struct<start:int,end:int,label:string,text:string>>"

# Lowest score kept per label.
LABEL_FLOORS = {"STATE": 0.6, "DISTRICT": 0.55, "VILLAGE": 0.5, "OTHER_LOCATION": 0.4}

# Words near an entity that support its label.
CONTEXT_WORDS = {
    "STATE": ("state", "territory"),
    "DISTRICT": ("district", "dt.", "dist."),
    "VILLAGE": ("village", "town", "settlement"),
    "OTHER_LOCATION": ("area", "forest", "police station", "ps", "region"),
}

# Names that need support, and the words that give it.
RISKY_WORDS = ("district", "state", "village")
SUPPORT_WORDS = (
    "district", "state", "village", "mandal", "taluka", "area", "region", "territory", "police station")

# Tokens of a model vocabulary that are never part of an entity.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "<s>", "</s>", "<pad>", "[PAD]", "[UNK]", "[BOS]", "[EOS]")


def exact_span(text: Column, name: Column) -> Column:
    """0-based start of the first occurrence, case ignored; -1 when absent or the name is blank."""
    at = F.instr(F.lower(text), F.lower(name)) - 1
    return F.when(text.isNull() | name.isNull() | (name == ""), -1).otherwise(at)


def _normal(text: str) -> str:
    text = text.lower()
    for pattern, word in ABBREVIATIONS:
        text = re.sub(pattern, word, text)
    return " ".join(re.sub(r"[^\w\s\-]", " ", text).split())


def _near_span(text: str, wanted: str, slack: int = 10) -> tuple[int, int] | None:
    """Stretch of ``text`` whose normal form is ``wanted``, within ``slack`` of where the normal form has it.

    A stretch as long as ``wanted`` is preferred, then ones that differ less in length.
    """
    at = _normal(text).find(wanted)
    if at < 0:
        return None
    first, last = max(0, at - slack), min(len(text), at + len(wanted) + slack)
    for off in sorted(range(-slack, slack + 1), key=abs):
        width = len(wanted) + off
        for start in range(first, last - width + 1) if width > 0 else ():
            if _normal(text[start : start + width]) == wanted:
                return start, start + width
    return None


def _letters(words: list[str]) -> np.ndarray:
    """How often each word has a to z, and any other character, as rows."""
    out = np.zeros((len(words), 27), np.int64)
    for row, word in zip(out, words):
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 97
        np.add.at(row, np.where((codes >= 0) & (codes < 26), codes, 26), 1)
    return out


def _windows(words: list[str], wanted: list[str], threshold: float) -> list[tuple[int, int]]:
    """Windows (from, to) of the words that may have an indel ratio of ``threshold`` with ``wanted``.

    Two texts have no longer common subsequence than common characters, and these are counted from running sums.
    """
    n, most = len(words), len(wanted) + 2
    first = np.repeat(np.arange(n), most)
    last = first + np.tile(np.arange(1, most + 1), n)
    first, last = first[last <= n], last[last <= n]
    sums = np.zeros((n + 1, 27), np.int64)
    np.cumsum(_letters(words), axis=0, out=sums[1:])
    blanks, own = last - first - 1, _letters(wanted).sum(axis=0)
    letters = sums[last] - sums[first]
    common = np.minimum(letters, own).sum(axis=1) + np.minimum(blanks, len(wanted) - 1)
    both = letters.sum(axis=1) + blanks + own.sum() + len(wanted) - 1
    hopeful = 200.0 * common >= threshold * both
    return list(zip(first[hopeful].tolist(), last[hopeful].tolist()))


def _fuzzy_span(text: str, words: list[str], wanted: str, threshold: float, margin: int) -> tuple[int, int] | None:
    """Best token window with an indel ratio of at least ``threshold``; earliest and shortest on ties."""
    risky = any(w in wanted for w in RISKY_WORDS)
    windows = []
    for i, j in _windows(words, wanted.split(), threshold):
        if risky:
            around = " ".join(words[max(0, i - margin) : j + margin])
            if not any(w in around for w in SUPPORT_WORDS):
                continue
        windows.append(" ".join(words[i:j]))
    if not windows:
        return None
    ratios = indel_block(windows, [wanted] * len(windows))
    if ratios.max() < threshold:
        return None
    best = windows[int(ratios.argmax())]
    # Offsets refer to the text as written, so the window must occur there.
    hit = re.search(r"\W+".join(map(re.escape, best.split())), text, re.IGNORECASE)
    return (hit.start(), hit.end()) if hit else _near_span(text, best)


def loose_span(threshold: float = 85.0, context_words: int = 3):
    """Arrow UDF (text, name) to struct(start, end): normal-form match, then fuzzy token windows.

    Rows with a null text are skipped, so the caller blanks out the ones already solved. A batch searches each distinct
    pair once and brings each distinct text to its normal form once.
    """

    @F.pandas_udf("start int, end int")
    def find(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        found: dict[tuple, tuple[int, int] | None] = {}
        words: dict[str, list[str]] = {}
        out = []
        for text, name in zip(texts, names, strict=True):
            span = None
            if text and name:
                if (text, name) not in found:
                    wanted = _normal(name)
                    if text not in words:
                        words[text] = _normal(text).split()
                    found[text, name] = wanted and (
                        _near_span(text, wanted) or _fuzzy_span(text, words[text], wanted, threshold, context_words)) or None
                span = found[text, name]
            out.append(span or (None, None))
        return pd.DataFrame(out, columns=["start", "end"]).astype("Int32")

    return find


def _precedence(label: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in LABELS]), label), F.lit(0)), F.lit(999))


def _keep(sorted_entities: Column, clashes) -> Column:
    """Greedy choice in array order: an entity is kept unless it clashes with one kept before."""
    return F.aggregate(
        sorted_entities,
        F.slice(sorted_entities, 1, 0),
        lambda kept, e: F.when(F.exists(kept, lambda k: clashes(k, e)), kept).otherwise(F.array_append(kept, e)),
    )


def _by(entities: Column, *keys) -> Column:
    """Entities sorted ascending by key expressions, their old position last."""
    tagged = F.transform(
        entities,
        lambda e, i: F.struct(*[k(e).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), e.alias("e")),
    )
    return F.transform(F.array_sort(tagged), lambda x: x.e)


def resolve_overlaps(entities: Column) -> Column:
    """Entities without overlaps, in text order.

    Labels rank STATE, DISTRICT, VILLAGE, OTHER_LOCATION; within a label the
    longer span wins, then the earlier. Every overlap with a kept entity removes
    the weaker one, so no overlap survives.
    """
    ranked = _by(
        entities,
        lambda e: _precedence(e.label), lambda e: -(e.end - e.start), lambda e: e.start,
    )
    kept = let(ranked, lambda r: _keep(r, lambda k, e: (e.start < k.end) & (e.end > k.start)))
    return _by(kept, lambda e: e.start)


def suppress(entities: Column, iou: float = 0.5, by_score: bool = True) -> Column:
    """Non-maximum suppression: strongest first, dropping those that overlap a kept one by more than ``iou``."""
    strength = (lambda e: -e.score) if by_score else (lambda e: -(e.end - e.start))

    def clash(k: Column, e: Column) -> Column:
        shared = F.least(k.end, e.end) - F.greatest(k.start, e.start)
        union = (k.end - k.start) + (e.end - e.start) - shared
        return (shared > 0) & (shared > iou * union)

    return let(_by(entities, strength), lambda ranked: _keep(ranked, clash))


def above_label_floor(entities: Column, floors: dict[str, float] | None = None, default: float = 0.4) -> Column:
    floors = LABEL_FLOORS if floors is None else floors
    table = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])
    return F.filter(entities, lambda e: e.score >= F.coalesce(F.try_element_at(table, e.label), F.lit(default)))


def boost_context(entities: Column, text: Column, amount: float = 0.1, reach: int = 50) -> Column:
    """Scores raised, up to 1, where a supporting word stands within ``reach`` characters."""
    low = F.lower(text)

    def boosted(e: Column) -> Column:
        first = F.greatest(e.start - reach, F.lit(0))
        around = F.substring(low, first + 1, e.end + reach - first)
        helped = F.lit(False)
        for label, words in CONTEXT_WORDS.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | around.contains(w)
            helped = helped | ((e.label == label) & hit)
        return e.withField("score", F.when(helped, F.least(F.lit(1.0), e.score + amount)).otherwise(e.score))

    return F.transform(entities, boosted)


def boost_multiword(entities: Column, amount: float = 0.05) -> Column:
    """Scores of entities of several words raised, up to 1."""
    return F.transform(
        entities,
        lambda e: e.withField(
            "score",
            F.when(strip(e.text).rlike(r"\s"), F.least(F.lit(1.0), e.score + amount)).otherwise(e.score),
        ),
    )


def fill_slots(entities: Column, normalise: bool = True, floor: float | None = 0.4) -> Column:
    """Struct (STATE, DISTRICT, VILLAGE, OTHER_LOCATION array) of scored entities.

    The best-scored entity fills each single slot. Other locations are the explicit
    ones, then the entities of the single labels that were not chosen, each once.
    With ``normalise`` descriptors are dropped and unchosen ones need ``floor``.
    """
    if normalise:
        named = F.transform(entities, lambda e: e.withField("text", drop_descriptors(e.text)))
        return let(named, lambda n: _slots(n, floor))
    return let(entities, lambda n: _slots(n, None))


def _slots(named: Column, floor: float | None) -> Column:
    def of(label: str) -> Column:
        return F.filter(named, lambda e: e.label == label)

    chosen = {label: F.try_element_at(_by(of(label), lambda e: -e.score), F.lit(1)).text for label in SINGLE}
    taken = F.array_compact(F.array(*chosen.values()))
    explicit = F.transform(of("OTHER_LOCATION"), lambda e: e.text)
    spare = F.concat(*[of(label) for label in SINGLE])
    if floor is not None:
        spare = F.filter(spare, lambda e: e.score >= floor)
    spare = F.filter(F.transform(spare, lambda e: e.text), lambda t: ~F.array_contains(taken, t))
    others = F.filter(F.array_distinct(F.concat(explicit, spare)), lambda t: t != "")
    return F.struct(*[c.alias(label) for label, c in chosen.items()], others.alias("OTHER_LOCATION"))


def slots_to_structured(slots: Column) -> Column:
    from incidentry.functions.places import build_structured

    return build_structured(slots.STATE, slots.DISTRICT, slots.VILLAGE, F.array_join(slots.OTHER_LOCATION, ", "))


def word_offsets(text: Column) -> Column:
    """White-space tokens with 0-based character offsets, as array of struct (token, start, end)."""
    words = F.filter(F.split(F.regexp_replace(text, r"(\S+)", "$1\u0001"), "\u0001"), lambda w: w.rlike(r"\S"))
    return F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out")),
        lambda acc, w: F.struct(
            (acc.at + F.length(w)).alias("at"),
            F.array_append(
                acc.out,
                F.struct(
                    strip(w).alias("token"),
                    (acc.at + F.length(w) - F.length(F.regexp_replace(w, r"^\s+", ""))).alias("start"),
                    (acc.at + F.length(w)).alias("end"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc.out,
    )


def tag_tokens(tokens: Column, entities: Column) -> Column:
    """Tag id per token: 0 outside, odd B, even I, -100 for tokens without extent.

    A token takes the label that covers most of its characters; it begins an entity
    only when it starts exactly where one starts.
    """

    def covered(t: Column, label: str) -> Column:
        return F.aggregate(
            F.filter(entities, lambda e: e.label == label),
            F.lit(0),
            lambda acc, e: acc + F.greatest(F.least(e.end, t.end) - F.greatest(e.start, t.start), F.lit(0)).cast("int"),
        )

    def tag(t: Column) -> Column:
        cover = F.array(*[covered(t, label) for label in LABELS])
        best = F.array_position(cover, F.array_max(cover)).cast("int")
        starts = F.exists(entities, lambda e: e.start == t.start)
        return (
            F.when((t.start == 0) & (t.end == 0), -100)
            .when(F.array_max(cover) == 0, 0)
            .otherwise(best * 2 - F.when(starts, 1).otherwise(0))
        )

    return F.transform(tokens, tag)
