"""Personal data: fixed patterns plus a skip-chain conditional random field that keeps labels consistent in a document."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read

KINDS = ("email", "ip", "card", "phone")
#: label 0 is "no personal data", label k is KINDS[k - 1]
LABELS = 1 + len(KINDS)
#: documents with digits or @ that the field is fitted on: those with the smallest hash of their id
FIT_DOCS = 2_000
#: tokens of them at most
FIT_TOKENS = 60_000
#: messages settle when none changes by more than this; rounds are bounded by the longest document
SETTLED = 1e-7
#: a token's label is added when its marginal reaches this
CERTAIN = 0.95
#: least log potential of equal labels on a skip edge
AGREE = 6.0

TRIGGER = re.compile("[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its first digit only, so that long runs cost linear time
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, domain with a dot, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """All matches of the fixed patterns by kind, then start."""
    if not TRIGGER.search(text):
        return []
    found: list[Span] = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        # a part above 255 has more than three significant digits or a larger value
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


@dataclass
class Tokens:
    """Candidate tokens of several documents: words that hold a digit or @.

    ``gap`` marks a token that follows the one before it after a single space: these are chain neighbours. ``twin``
    is the first token of the same document that is the same or similar (seven digits or more with the same last seven,
    or the same text but for case and outer punctuation), or -1 at that token itself: these are skip neighbours, so any
    two mentions are at most two edges apart, whatever their number.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    gap: np.ndarray
    twin: np.ndarray
    features: np.ndarray


#: sizes of the one-hot groups of a token's features
GROUPS = (21, 3, 5, 5, 2, 2, 2, 3, 3, 2, 21)


def tokens_of(texts: Sequence[tuple[int, str]]) -> Tokens:
    doc, start, end, gap, twin, features = [], [], [], [], [], []
    for d, text in texts:
        seen: dict[str, int] = {}
        block: list[int] = []
        before = -2
        words = [m for m in WORD.finditer(text) if TRIGGER.search(m.group())]
        for m in words:
            a, b = m.span()
            while a < b and text[a] in "\"'<[{,;:":
                a += 1
            while b > a and text[b - 1] in "\"'>]},;:.!?":
                b -= 1
            word = text[a:b]
            digits = "".join(DIGIT.findall(word))
            at, near = len(doc), m.start() == before + 1
            before = m.end()
            if not near:
                _close_block(block, features)
                block = []
            block.append(at)
            # the same word has the same digits, so one key holds all that are the same or similar
            first = seen.setdefault(digits[-7:] if 7 <= len(digits) <= 19 else word.lower(), at)
            earlier = first if first != at else -1
            doc.append(d), start.append(a), end.append(b), gap.append(near and len(block) > 1), twin.append(earlier)
            features.append(_features(word, digits))
        _close_block(block, features)
    return Tokens(np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(gap, bool),
                  np.array(twin, np.int64), np.array([f[: len(GROUPS)] for f in features], np.int64).reshape(-1, len(GROUPS)))


def _features(word: str, digits: str) -> list:
    after = word.partition("@")[2] if "@" in word else ""
    parts = word.split(".")
    numeric = all(p.isdigit() and p.isascii() for p in parts)
    kind = 0 if not word else "0123456789+(".find(word[0])
    first = 0 if 0 <= kind < 10 else 1 if kind == 10 else 2 if kind == 11 else 3 if word[:1].isalpha() else 4
    return [min(len(digits), 20), 0 if "@" not in word else 2 if "." in after else 1,
            min(word.count("."), 4), first, int(any(c.isalpha() for c in word[:200])),
            int(13 <= len(digits) <= 19 and luhn(digits)),
            int(numeric and len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)),
            0, 0, 0, 0, len(digits), word[:1] == "+"]


def _close_block(block: list[int], features: list[list]) -> None:
    """What tokens joined by single spaces have in common: their digits and whether a plus begins them."""
    if not block:
        return
    total = min(20, sum(features[i][11] for i in block))
    plus = int(any(features[i][12] for i in block))
    for k, i in enumerate(block):
        features[i][7] = 0 if k == 0 else 1 if features[block[k - 1]][12] else 2
        features[i][8] = 0 if k == len(block) - 1 else 1 if features[block[k + 1]][3] == 2 else 2
        features[i][9], features[i][10] = plus, total


def labels_of(tokens: Tokens, spans: dict[int, list[Span]]) -> np.ndarray:
    """Label of each token: the first kind with a span that it overlaps. Spans of a kind do not overlap each other, so
    the one to look at is found by bisection; tokens stand by document."""
    out = np.zeros(len(tokens.doc), dtype=np.int64)
    for d, found in spans.items():
        lo, hi = np.searchsorted(tokens.doc, [d, d + 1])
        if lo == hi or not found:
            continue
        begin, end = tokens.start[lo:hi], tokens.end[lo:hi]
        for kind in sorted({k for k, _, _ in found}, reverse=True):
            mine = np.array(sorted((a, b) for k, a, b in found if k == kind))
            at = np.searchsorted(mine[:, 1], begin, side="right")
            near = np.minimum(at, len(mine) - 1)
            out[lo:hi][(at < len(mine)) & (mine[near, 0] < end)] = kind + 1
    return out


@dataclass(frozen=True)
class SkipChainField:
    """Log potentials: ``unary`` (feature, label), ``chain`` and ``skip`` (label, label)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        offsets = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
        return self.unary[features + offsets].sum(axis=1) + self.unary[-1]

    def marginals(self, tokens: Tokens, clamp: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
        """Label probabilities by loopy sum-product messages over chain and skip edges, all documents at once.

        ``clamp`` fixes labels (0: free): tokens of base spans keep theirs and only inform others. Messages are sent
        until they settle. A message moves one edge a round, so ``rounds`` defaults to a bound from the tokens of the
        longest document; edges of settled documents rest.
        """
        n = len(tokens.doc)
        score = self.scores(tokens.features) if n else np.zeros((0, LABELS))
        if clamp is not None:
            fixed = clamp > 0
            score[fixed] = -1e6  # beyond what any number of neighbours adds up to
            score[fixed, clamp[fixed]] = 0.0
        twin = tokens.twin if clamp is None else _around_labelled(tokens.twin, clamp)
        chained, twins = np.flatnonzero(tokens.gap), np.flatnonzero(twin >= 0)
        left = np.concatenate([chained - 1, twin[twins]])
        right = np.concatenate([chained, twins])
        table = np.concatenate([np.repeat(self.chain[None], len(chained), 0), np.repeat(self.skip[None], len(twins), 0)])
        forth, back = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS))
        belief = score.copy()
        # documents are numbered anew, so that each one's largest change can be kept by number
        number = np.unique(tokens.doc, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        if rounds is None:
            rounds = 60 + 4 * int(np.bincount(number, minlength=1).max())
        home = number[right]
        open_ = np.arange(len(left))
        for _ in range(rounds):
            if not len(open_):
                break
            a, b = left[open_], right[open_]
            to_right = _log_sum((belief[a] - back[open_])[:, :, None] + table[open_], 1)
            to_left = _log_sum((belief[b] - forth[open_])[:, None, :] + table[open_], 2)
            # half of the old message damps oscillation on loops
            new_forth = 0.5 * forth[open_] + 0.5 * (to_right - to_right.max(axis=1, keepdims=True))
            new_back = 0.5 * back[open_] + 0.5 * (to_left - to_left.max(axis=1, keepdims=True))
            moved_forth, moved_back = new_forth - forth[open_], new_back - back[open_]
            forth[open_], back[open_] = new_forth, new_back
            np.add.at(belief, b, moved_forth)
            np.add.at(belief, a, moved_back)
            change = np.zeros(len(number) and int(number.max()) + 1)
            np.maximum.at(change, home[open_], np.maximum(np.abs(moved_forth).max(axis=1), np.abs(moved_back).max(axis=1)))
            open_ = open_[change[home[open_]] > SETTLED]
        belief -= belief.max(axis=1, keepdims=True, initial=-np.inf) if n else 0
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True) if n else p


def _around_labelled(twin: np.ndarray, clamp: np.ndarray) -> np.ndarray:
    """Ties the mentions to the first labelled one of their group instead of the first, if there is one: then what is
    fixed reaches every mention directly."""
    root = np.where(twin >= 0, twin, np.arange(len(twin)))
    hub = np.arange(len(twin))
    labelled = np.flatnonzero(clamp > 0)[::-1]
    hub[root[labelled]] = labelled  # the first one is written last
    hub = hub[root]
    return np.where(hub == np.arange(len(twin)), -1, hub)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit_field(features: np.ndarray, labels: np.ndarray, gap: np.ndarray, twin: np.ndarray, steps: int = 300,
              rate: float = 2.0, ridge: float = 1e-4) -> SkipChainField:
    """Piecewise training: unary potentials by softmax regression, edge potentials by the smoothed log ratio of label
    pairs seen to those expected. Labels that never occur keep low scores. Equal labels of skip neighbours get AGREE at
    least: in a sample they are mostly unlabelled pairs, whose ratio says little about the others."""
    size = sum(GROUPS) + 1
    weights = np.zeros((size, LABELS))
    n = len(labels)
    if n:
        offsets = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
        design = np.zeros((n, size), dtype=np.float32)
        design[np.arange(n)[:, None], features + offsets] = 1
        design[:, -1] = 1
        wanted = np.eye(LABELS, dtype=np.float32)[labels]
        for _ in range(steps):
            score = design @ weights
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= rate * (design.T @ (p - wanted) / n * len(GROUPS) ** 0.5 + ridge * weights)
    else:
        weights[-1, 1:] = -10
    share = (np.bincount(labels, minlength=LABELS) + 1) / (n + LABELS)

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        seen = np.ones((LABELS, LABELS)) * 0.5
        np.add.at(seen, (a, b), 1)
        seen /= seen.sum()
        return np.clip(np.log(seen / np.outer(share, share)), -4, 4)

    chained, twins = np.flatnonzero(gap), np.flatnonzero(twin >= 0)
    skip = ratio(labels[twin[twins]], labels[twins])
    agree = np.where(np.eye(LABELS, dtype=bool), np.maximum(skip, AGREE), np.minimum(skip, 0.0))
    return SkipChainField(weights, ratio(labels[chained - 1], labels[chained]), (agree + agree.T) / 2)


def find_spans(texts: Sequence[str], field: SkipChainField | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start. Added spans do not overlap base ones of any kind."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if field is not None:
        tokens = tokens_of([(i, t) for i, t in enumerate(texts) if TRIGGER.search(t)])
        clamp = labels_of(tokens, dict(enumerate(base)))
        p = field.marginals(tokens, clamp)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        for i in np.flatnonzero((best > 0) & (clamp == 0) & (p.max(axis=1, initial=0) >= CERTAIN)).tolist():
            d, kind, a, b = int(tokens.doc[i]), int(best[i]) - 1, int(tokens.start[i]), int(tokens.end[i])
            last = added[d][-1] if added[d] else None
            if tokens.gap[i] and last and last[0] == kind and last[2] == int(tokens.end[i - 1]):
                added[d][-1] = (kind, last[1], b)
            else:
                added[d].append((kind, a, b))
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        tokens = tokens_of(list(enumerate(texts)))
        labels = labels_of(tokens, {i: base_spans(t) for i, t in enumerate(texts)})
        ends = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
        for d in range(len(texts)):
            own = np.arange(ends[d], ends[d + 1])
            if len(own):
                twin = np.where(tokens.twin[own] >= 0, tokens.twin[own] - own[0], -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[d].as_py()], pa.int64()),
                     *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in
                       (tokens.features[own].ravel(), labels[own], tokens.gap[own].astype(np.int64), twin))],
                    names=["rank", "features", "labels", "gap", "twin"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_docs: int = FIT_DOCS,
        most_tokens: int = FIT_TOKENS) -> SkipChainField:
    """Fit the field on a bounded sample: the ``most_docs`` documents with a digit or @ whose ids hash lowest, labelled
    by the fixed patterns, up to ``most_tokens`` tokens in that order. Only feature numbers reach the driver. Without
    such documents the field adds nothing."""
    marked = docs.select(F.xxhash64(doc_id).alias("rank"), F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    # the last rank first, so that no text but those of the sample is moved
    last = marked.select("rank").orderBy("rank").limit(most_docs).agg(F.max("rank")).first()[0]
    sample = marked.where(F.col("rank") <= F.lit(last).cast("long")).orderBy("rank", "text").limit(most_docs)
    parts = sample.mapInArrow(_fit_rows, "rank long, features array<long>, labels array<long>, gap array<long>, twin array<long>")
    features, labels, gap, twin, total = [], [], [], [], 0
    for row in parts.orderBy("rank", "features").toLocalIterator():
        take = min(len(row.labels), most_tokens - total)
        if not take:
            break
        f, t = np.array(row.features).reshape(-1, len(GROUPS))[:take], np.array(row.twin)[:take]
        features.append(f), labels.append(np.array(row.labels)[:take]), gap.append(np.array(row.gap, bool)[:take])
        twin.append(np.where(t >= 0, t + total, -1))
        total += take
    if not total:
        return fit_field(np.zeros((0, len(GROUPS)), np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    return fit_field(np.concatenate(features), np.concatenate(labels), np.concatenate(gap), np.concatenate(twin))


def _grouped(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: SkipChainField | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, spans``, both arrays of (kind, start, end) by kind as listed, then start;
    code points, end exclusive.

    ``base`` are the matches of the fixed patterns, ``spans`` also what the field adds: tokens that repeat or resemble
    labelled ones of their document, or look like them. Null and empty texts have no spans. Rows are judged alone, so
    null ids, ties and repeated rows pass through; an empty table gives no rows; other columns are not looked at.
    """
    field = fit(docs, doc_id, text) if field is None else field
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans: Sequence[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _grouped([t or "" for t in batch.column(1).to_pylist()]):
                found = find_spans(texts, field)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([named(b) for b, _ in found], shape),
                     pa.array([named(s) for _, s in found], shape)], names=["doc_id", "base", "spans"])
                at += len(texts)

    kind = docs.schema[doc_id].dataType.simpleString()
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, base {span}, spans {span}")


def masked(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the
    first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: SkipChainField | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all spans in ``text`` masked; every row and the other columns stay. Null texts stay null."""
    field = fit(docs, doc_id, text) if field is None else field
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for texts in _grouped([t or "" for t in batch.column(column).to_pylist()]):
                done += [masked(t, s) if s else t for t, (_, s) in zip(texts, find_spans(texts, field), strict=True)]
            new = pa.array(done, batch.column(column).type)
            empty = batch.column(column).is_null().to_pylist()
            if any(empty):
                new = pa.array([None if e else t for e, t in zip(empty, done, strict=True)], new.type)
            columns = list(batch.columns)
            columns[column] = new
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _is(kind: str):
    return lambda found: found == kind


@query("op2_skip_chain_pii")
def op2_skip_chain_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    found = detect(docs)

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter(F.col("base.kind"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
