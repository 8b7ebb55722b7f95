"""Secret scan: fixed patterns, and a linear-chain conditional random field that finds secrets beyond them.

Tokens are the parts of a text between blanks. The field tags each as begin, inside or outside of a secret from its
shape, the words beside it and figures of the whole file. All tokens of a text are decoded together: its best tags are
those of Viterbi over the whole text. Every token is weighed, in arrays of a text; the search itself then runs over
tokens that a bound on the best sum does not prove to be outside.

The field is trained on documents whose pattern spans serve as tags: at most ``SAMPLE_DOCS`` documents, those of
the least hash of their id, and at most ``SAMPLE_RUNS`` of their runs of ``TRAIN_LENGTH`` tokens. Spans of the patterns always stay; spans of
the field are added where they meet none of them. Offsets are code points, ends exclusive.

Defined results: null text is empty and has no span; without a training row nothing is added; repeated rows and ids
give one row each; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import row_map, sha256

SAMPLE_DOCS = 6000
SAMPLE_RUNS = 6000
#: Texts are cut into runs for training, not for decoding.
TRAIN_LENGTH = 32
LONG = 25
FEATURES = 4096
#: Different tokens whose weights a worker remembers at most.
REMEMBERED = 200_000

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of the class that are long enough
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[int, int, int]  # start, number in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind, by start, then kind."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode(
        "utf-8", "surrogatepass")
    out: list[Span] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


NAMES = re.compile(r"passw|passphrase|secret|token|api.?key|private.?key|credential|bearer|auth|pwd", re.I | re.A)
ANCHOR = re.compile(rf"[0-9:=]|\S{{{LONG}}}|passw|passphrase|secret|token|api.?key|private.?key|credential|bearer|auth|pwd", re.I | re.A)
TOKEN = re.compile(r"\S+")
#: One of these is in whatever ``NAMES`` matches.
HINTS = ("passw", "passph", "secret", "token", "key", "credential", "bearer", "auth", "pwd")
BLANK = re.compile(r"\s")


def active_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens that could hold a secret at first sight; a figure of the file is made of their number."""
    out, at = [], 0
    while m := ANCHOR.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = BLANK.search(text, m.start())
        end = stop.start() if stop else len(text)
        out.append((start, end))
        at = end
    return out


SHAPES = (
    ("hex", re.compile(r"[0-9a-f]+")), ("number", re.compile(r"[0-9.,:/%()+-]+")), ("upper", re.compile(r"[A-Z]+[0-9][A-Z0-9]*")),
    ("letters", re.compile(r"[^\W\d_]+")), ("word", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_.=-]+")),
    ("address", re.compile(r"\S+(?:@|://)\S+")),
)
EDGE = "\"'()[]{}<>,;.!?"
#: Levels of a token's size.
SIZES = (4, 6, 9, 12, 16, 20, 24, 32, 48, 64)


def _shape(core: str) -> str:
    if core.isalpha():  # most tokens
        return "letters" if core.strip("abcdef") else "hex"
    return next((name for name, p in SHAPES if p.fullmatch(core)), "other") if core else "none"


def _level(x: float, cuts: tuple) -> int:
    return bisect_right(cuts, x)


def _name(word: str) -> str:
    """The first name word in a token, in lower case; to see that there is none is cheap."""
    low = word.lower()
    for hint in HINTS:
        if hint in low:
            found = NAMES.search(word)
            return found.group(0).lower() if found else ""
    return ""


def _word_class(word: str) -> str:
    if not word:
        return "edge"
    sign = word[-1] if word[-1] in ":=" else ""
    return (_name(word) or _shape(word.strip(EDGE))) + sign


def _look(token: str) -> tuple:
    """What the features of a token alone are made of; few different values, its size second."""
    core = token.strip(EDGE)
    n = len(core)
    digits = sum(map(core.count, "0123456789")) if not core.isalpha() else 0
    return (_shape(core), _level(n, SIZES),
            _level(digits / n if n else 0, (0.01, 0.15, 0.3, 0.5, 0.8)),
            _level(len(set(core)) / n if n else 0, (0.2, 0.4, 0.6, 0.8)), _name(token),
            "=" in token.rstrip("="), ":" in token, token[:1] in EDGE, token[-1:] in EDGE)


def _own(look: tuple) -> list[str]:
    """The features of a token alone."""
    shape, size, digits, kinds, name, equals, colon, first, last = look
    sign = equals, colon
    return ["bias", f"shape={shape}", f"size={size}", f"shape,size={shape},{size}", f"digits={digits}", f"kinds={kinds}",
            f"name={name}", f"sign={sign}", f"name,sign={bool(name)},{sign}", f"quoted={first},{last}"]


def _before(word: str, size: int) -> list[str]:
    before = _word_class(word[-40:])
    return [f"before={before}", f"before,size={before},{size}"]


def _after(word: str) -> list[str]:
    return [f"after={_word_class(word[:40])}"]


def _numbers(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


def run_features(tokens: list[str], file: str, start: int = 0, end: int | None = None) -> list[list[int]]:
    """The feature numbers of the tokens from ``start`` to ``end`` of a text."""
    out = []
    for i in range(start, len(tokens) if end is None else min(end, len(tokens))):
        look = _look(tokens[i])
        out.append(_numbers(_own(look) + _before(tokens[i - 1] if i else "", look[1])
                            + _after(tokens[i + 1] if i + 1 < len(tokens) else "") + [file]))
    return out


def _active(token: str) -> bool:
    return len(token) >= LONG or ":" in token or "=" in token or _name(token) != "" or any(c in token for c in "0123456789")


def file_feature(text: str, active: int) -> str:
    """A figure of the whole file: how dense its active tokens are, and how its lines are."""
    return f"file={_level(1000 * active / (len(text) + 1), (0.5, 2, 8, 30))},{_level(len(text) / (text.count(chr(10)) + 1), (40, 120))}"


BEGIN, INSIDE, OUTSIDE = 0, 1, 2
NEVER = -1e9
#: What rounding may take from a bound on the gain of a tag.
SLACK = 1e-3


class Field:
    """Weights of features per tag and of steps between tags. Inside follows begin or inside alone."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, 3))
        self.weights[:, OUTSIDE] = 1e-3  # untrained, everything is outside
        self.steps = np.zeros((3, 3))
        self.first = np.zeros(3)
        self._forget()

    def _forget(self) -> None:
        self._tokens: dict[str, int] = {}
        self._looks: dict[tuple, int] = {}
        self._befores: dict[str, int] = {}
        self._files: dict[str, np.ndarray] = {}
        self._rows: list[tuple] = []
        self._pairs: list[np.ndarray] = []
        self._tables: tuple = ()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("weights", "steps", "first")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _weight(self, names: list[str]) -> np.ndarray:
        return self.weights[_numbers(names)].sum(0)

    def _look_number(self, look: tuple, before: str, after: str, active: bool) -> int:
        """The number of what tokens of one look have in common: weights, size, class as the word before, whether active."""
        key = look, before, after, active
        if key not in self._looks:
            if before not in self._befores:
                self._befores[before] = len(self._pairs)
                self._pairs.append(np.array([self._weight([f"before={before}", f"before,size={before},{size}"])
                                             for size in range(len(SIZES) + 1)]))
            own = self._weight(_own(look)) if look else np.zeros(3)
            self._looks[key] = len(self._rows)
            self._rows.append((own, self._weight([f"after={after}"]), look[1] if look else 0, self._befores[before], active))
            self._tables = ()
        return self._looks[key]

    def _known(self, token: str) -> int:
        """The number of a token's look, remembered."""
        look = _look(token)
        if len(token) <= 40:
            before = after = (look[4] or look[0]) + (token[-1] if token[-1] in ":=" else "")
        else:
            before, after = _word_class(token[-40:]), _word_class(token[:40])
        active = _active(token) if look[0] != "letters" or look[4] or look[6] or "=" in token else len(token) >= LONG
        out = self._tokens[token] = self._look_number(look, before, after, active)
        return out

    def _emissions(self, tokens: list[str], file: str | None, text: str) -> np.ndarray:
        """The weight of each tag at each token of a text. Tokens differ, but few looks do."""
        if len(self._tokens) > REMEMBERED or len(self._rows) > REMEMBERED // 10:
            self._forget()
        edge = self._look_number((), _word_class(""), _word_class(""), False)
        get = self._tokens.get
        looks = [edge]
        for t in tokens:
            k = get(t)
            looks.append(self._known(t) if k is None else k)
        looks.append(edge)
        if not self._tables:
            self._tables = (*map(np.array, zip(*self._rows)), np.array(self._pairs))
        own, after, size, before, active, pairs = self._tables
        looks = np.array(looks)
        here = looks[1:-1]
        if file is None:
            file = file_feature(text, int(active[here].sum()))
        if file not in self._files:
            self._files[file] = self._weight([file])
        return own[here] + after[looks[2:]] + pairs[before[looks[:-2]], size[here]] + self._files[file]

    def _open_tokens(self, emit: np.ndarray) -> np.ndarray:
        """Which tokens may be other than outside in the best tags.

        Tokens that are not outside stand in runs. A run gains over tags of outside no more than the sum of what each of
        its tokens gains by its better tag and the best step to it, and the step back to outside. Where every run through
        a token loses, the best tags have outside there: so the search is that of Viterbi, only shorter.
        """
        steps, first = self._masks()
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = steps.tolist()
        begin, inside = emit[:, BEGIN] - emit[:, OUTSIDE], emit[:, INSIDE] - emit[:, OUTSIDE]
        gain = np.maximum(begin + max(bb, ib, ob), inside + max(bi, ii)) - oo
        gain[0] = begin[0] + first[BEGIN] - first[OUTSIDE]
        back = max(0.0, bo - oo, io - oo)
        if gain.max() + back < -SLACK:
            return np.zeros(len(emit), bool)
        sums = np.cumsum(gain)
        ahead = np.concatenate(([0.0], sums[:-1]))
        most = np.maximum.accumulate(sums[::-1])[::-1] - np.minimum.accumulate(ahead)
        return most + back >= -SLACK * (1 + 1e-6 * np.abs(sums).max())

    def tags(self, tokens: list[str], file: str | None = None, text: str = "") -> list[int]:
        """The best tags of a whole text: what ``decode`` gives for its features."""
        if not tokens:
            return []
        emit = self._emissions(tokens, file, text)
        out = [OUTSIDE] * len(tokens)
        held = np.concatenate(([False], self._open_tokens(emit), [False])).view(np.int8)
        edges = np.diff(held)
        for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            out[start:end] = self._best(emit[start:end].tolist(), start == 0, end == len(tokens))
        return out

    def _best(self, emit: list[list[float]], starts: bool, ends: bool) -> list[int]:
        """The best tags of a part of a text; what stands before and after it is outside, or the text ends there."""
        steps, first = self._masks()
        (bb, bi, bo), (ib, ii, io), (ob, oi, oo) = steps.tolist()
        (eb, ei, eo), *rest = emit
        vb, vi, vo = first.tolist() if starts else (ob, oi, oo)
        b, i, o = vb + eb, vi + ei, vo + eo
        back = []
        for eb, ei, eo in rest:
            vb, vi, vo, tb, ti, to = b + bb, b + bi, b + bo, 0, 0, 0
            if i + ib > vb:
                vb, tb = i + ib, 1
            if o + ob > vb:
                vb, tb = o + ob, 2
            if i + ii > vi:
                vi, ti = i + ii, 1
            if i + io > vo:
                vo, to = i + io, 1
            if o + oo > vo:
                vo, to = o + oo, 2
            back.append((tb, ti, to))
            b, i, o = vb + eb, vi + ei, vo + eo
        if not ends:
            b, i, o = b + bo, i + io, o + oo
        tag = 0 if b >= i and b >= o else 1 if i >= o else 2
        out = [tag]
        for step in reversed(back):
            tag = step[tag]
            out.append(tag)
        return out[::-1]

    def _masks(self) -> tuple[np.ndarray, np.ndarray]:
        steps, first = self.steps.copy(), self.first.copy()
        steps[OUTSIDE, INSIDE] = first[INSIDE] = NEVER
        return steps, first

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best tags of a run (Viterbi)."""
        steps, first = self._masks()
        emit = self.weights[np.array(features)].sum(1)
        score, back = first + emit[0], []
        for e in emit[1:]:
            every = score[:, None] + steps
            back.append(every.argmax(0))
            score = every.max(0) + e
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def fit(self, sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 150, rate: float = 0.1,
            ridge: float = 1e-3) -> "Field":
        """Conditional likelihood by Adam; forward and backward sums run over all sequences at once."""
        if not sequences:
            return self
        count, longest = len(sequences), max(len(t) for _, t in sequences)
        width = len(sequences[0][0][0])
        ids = np.zeros((count, longest, width), np.int64)
        gold, there = np.full((count, longest), OUTSIDE), np.zeros((count, longest), bool)
        for k, (f, t) in enumerate(sequences):
            ids[k, :len(t)], gold[k, :len(t)], there[k, :len(t)] = f, t, True
        # Tokens differ, but few rows of features do: these are weighed once, and slopes are summed over them first.
        kinds, kind = np.unique(ids[there], axis=0, return_inverse=True)
        kind, on = kind.ravel(), there[..., None]
        want = np.eye(3)[gold] * on
        pair = there[:, 1:]
        gold_steps = np.einsum("kti,ktj->ij", want[:, :-1] * pair[..., None], want[:, 1:])
        moments = {n: [np.zeros_like(getattr(self, n))] * 2 for n in ("weights", "steps", "first")}
        self._forget()
        self.weights[:] = 0
        for r in range(1, rounds + 1):
            steps, first = self._masks()
            emit = np.zeros((count, longest, 3))
            emit[there] = self.weights[kinds].sum(1)[kind]
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = first + emit[:, 0]
            for t in range(1, longest):
                new = _log_sum(alpha[:, t - 1, :, None] + steps, 1) + emit[:, t]
                alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = _log_sum(steps + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(there[:, t + 1, None], new, 0)
            total = _log_sum(alpha[:, -1], 1)[:, None, None]
            mean = np.exp(np.minimum(alpha + beta - total, 0)) * on
            joint = np.exp(np.minimum(alpha[:, :-1, :, None] + steps + (emit[:, 1:] + beta[:, 1:])[:, :, None, :]
                                      - total[..., None], 0)) * pair[..., None, None]
            off = (mean - want)[there] / count
            each = [np.bincount(kind, off[:, j], len(kinds)) for j in range(3)]
            slope = np.stack([np.bincount(kinds.ravel(), np.repeat(x, width), FEATURES) for x in each], 1)
            slopes = {"weights": slope + ridge * self.weights / 10, "steps": (joint.sum((0, 1)) - gold_steps) / count,
                      "first": (mean[:, 0] - want[:, 0]).mean(0)}
            for name, g in slopes.items():
                m, v = moments[name]
                moments[name] = m, v = [m + 0.1 * (g - m), v + 0.01 * (g * g - v)]
                at = getattr(self, name)
                at -= rate * m / (1 - 0.9 ** r) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
        return self


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _tagged(text: str) -> tuple[list[str], list[int]]:
    """The tokens of a text and their tags, those of its pattern spans."""
    spans, tokens, tags, last, at = base_spans(text), [], [], None, 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        near = takewhile(lambda s, end=end: s[0] < end, islice(spans, at, None))
        span = next((s for s in near if s[2] > start), None)
        tokens.append(m.group())
        tags.append(OUTSIDE if span is None else INSIDE if span == last else BEGIN)
        last = span
    return tokens, tags


def _picked(text: str) -> tuple[list[str], list[int], list[tuple[int, bool, int]]]:
    """What ``_tagged`` gives, and (start, no secret, hash) of each run of the text."""
    tokens, tags = _tagged(text)
    return tokens, tags, [
        (k, all(t == OUTSIDE for t in tags[k:k + TRAIN_LENGTH]),
         zlib.crc32(" ".join(tokens[k:k + TRAIN_LENGTH]).encode("utf-8", "surrogatepass")))
        for k in range(0, len(tokens), TRAIN_LENGTH) if tags[k] != INSIDE]


def tagged_runs(text: str, most: tuple[bool, int] = (True, 1 << 32)) -> list[tuple[list[list[int]], list[int]]]:
    """Features and tags of the runs of a text that come no later than ``most`` (no secret, hash)."""
    tokens, tags, found = _picked(text)
    found = [k for k, outside, pick in found if (outside, pick) <= most]
    file = file_feature(text, sum(map(_active, tokens))) if found else ""
    return [(run_features(tokens, file, k, k + TRAIN_LENGTH), tags[k:k + TRAIN_LENGTH]) for k in found]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
        sample_runs: int = SAMPLE_RUNS) -> Field:
    """A field trained on a bounded sample of ``docs``."""
    ids = docs.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")

    # Runs that hold a secret come first, so that a sample of few secrets still has them. Features are made of the
    # runs that the sample can hold alone.
    order = row_map(texts, lambda i, text: ([{"o": o, "h": h} for _, o, h in _picked(text or "")[2]],),
                    "runs array<struct<o:boolean,h:long>>", ["id", "text"]).select(F.inline("runs"))
    most = order.orderBy("o", "h").limit(sample_runs).agg(F.max(F.struct("o", "h")).alias("m")).first().m
    if most is None:
        return Field()
    most = tuple(most)

    def one(i, text):
        return ([{"features": f, "tags": t} for f, t in tagged_runs(text or "", most)],)

    schema = "runs array<struct<features:array<array<int>>,tags:array<int>>>"
    every = row_map(texts, one, schema, ["id", "text"]).select(F.inline("runs"))
    got = every.orderBy(F.forall("tags", lambda t: t == OUTSIDE), F.xxhash64("features"), "tags").limit(sample_runs)
    return Field().fit([(r.features, r.tags) for r in got.collect()])


def all_spans(text: str | None, field: Field) -> list[Span]:
    """The pattern spans and those the field adds, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    tags = field.tags(text.split(), text=text)  # splits where ``TOKEN`` does
    places = [m.span() for m in TOKEN.finditer(text)] if BEGIN in tags else []
    added, begin = [], None
    for (start, end), tag in [*zip(places, tags), ((0, 0), OUTSIDE)]:
        if begin is not None and tag != INSIDE:
            added.append(begin)
            begin = None
        if tag == BEGIN:
            begin = (start, 3, end)
        elif tag == INSIDE and begin is not None:
            begin = (begin[0], 3, end)
    at, extra = 0, []
    for span in added:  # both lists ascend by start
        while at < len(base) and base[at][2] <= span[0]:
            at += 1
        near = takewhile(lambda b, end=span[2]: b[0] < end, islice(base, at, None))
        if not any(b[2] > span[0] for b in near):
            extra.append(span)
    return sorted(base + extra)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and ``spans``, an array of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return row_map(
        docs, lambda i, text: (i, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(text, sent.value)]),
        f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:int,end:int>>", [id_col, text_col])


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, or what overlapping spans cover together, replaced by ``mark``."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, _, b in all_spans(text, sent.value):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join(out) + text[at:]

        return pd.Series([one(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cut(F.col(text_col)))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def digest(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the number of spans of each pattern, ``base_sha256`` of these spans, and all ``spans`` as text."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def one(i, text):
        spans = all_spans(text, sent.value)
        base = [s for s in spans if s[1] < 3]
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        return i, *counts, sha256(_joined(base)), _joined(spans)

    return row_map(docs, one, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, "
                   "base_sha256 string, spans string", [id_col, text_col])
