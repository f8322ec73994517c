"""Toxic documents and their offending sentences by multiple-instance learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrid.llm.common import query, read
from pricegrid.session import materialise

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")

#: hashed parts of words that carry a weight; the model's size does not depend on the data
PART_BITS = 18
#: labelled documents of each class that the model is fitted on, and their characters
FIT_DOCS = 2000
FIT_CHARS = 10_000_000
#: words that a worker remembers the score of; it saves time only
REMEMBERED = 1_000_000
#: characters of a sentence whose words are listed at once
PIECE = 1 << 20


def parts_of(word: str) -> list[int]:
    """Hashed parts of a word: the whole and its beginnings of 3 to 6 characters."""
    return [zlib.crc32(f.encode("utf-8", "replace")) & ((1 << PART_BITS) - 1)
            for f in ("=" + word, *(word[:k] for k in range(3, min(7, len(word) + 1))))]


def words_of(sentence: str) -> set[str]:
    """The distinct lower-cased words of a sentence; a very long one is not held as a list of words."""
    if len(sentence) <= PIECE:
        return set(WORD.findall(sentence.lower()))
    return {m.group().lower() for m in WORD.finditer(sentence)}


class SentenceModel:
    """A sentence is toxic with the probability sigmoid(bias + sum of its distinct words' scores); a word's score is the
    sum of the weights of its parts. A document is toxic unless all its sentences are not (noisy-or)."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights, self.listed = float(bias), weights, None

    def score_of(self, word: str) -> float:
        if self.listed is None:
            self.listed = self.weights.tolist()
        return sum(self.listed[i] for i in parts_of(word))

    def sentences(self, text: str, scores: Scores) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Log-odds and (start, end) of each sentence with a word."""
        odds, spans = [], []
        get = scores.__getitem__
        for m in SENTENCE.finditer(text):
            words = words_of(m.group())
            if words:
                odds.append(self.bias + sum(map(get, sorted(words))))
                spans.append(m.span())
        return np.array(odds), spans


class Scores(dict):
    """Words to scores, as far as remembered."""

    def __init__(self, model: SentenceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.model.score_of(word)
        return found


def noisy_or(odds: np.ndarray) -> float:
    """Probability that at least one sentence is toxic."""
    return float(-np.expm1(-np.logaddexp(0, odds).sum()))


def telling(parts: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Which parts stand in toxic documents more or less often than chance would let any of them: the likelihood ratio
    of presence against the label reaches twice the logarithm of the number of parts."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    a, b = np.zeros(size), np.zeros(size)
    for found, bad in zip(parts, toxic, strict=True):
        (a if bad else b)[found] += 1
    seen = a + b

    def term(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.where(observed > 0, observed, 1) / np.maximum(expected, 1e-300))

    p = n1 / (n1 + n0)
    ratio = 2 * (term(a, seen * p) + term(b, seen * (1 - p)) + term(n1 - a, (n1 + n0 - seen) * p) + term(n0 - b, (n1 + n0 - seen) * (1 - p)))
    return ratio >= 2 * np.log(max(2, np.count_nonzero(seen)))


def fit_model(rows: Iterable[tuple[int, str]], share: float, most_chars: int = FIT_CHARS, steps: int = 300, rate: float = 0.1,
              ridge: float = 1e-5) -> SentenceModel:
    """Fit on (toxic, text) rows; ``share`` is the share of toxic documents among all labelled ones, which the sampled
    classes are weighted back to. Of each class texts are taken in the order given as long as their characters stay
    within ``most_chars``. Only the documents' labels are known: the likelihood is that of the noisy-or, so that a toxic
    document raises the sentences that can explain it and a clean one lowers all. Only telling parts carry weight.
    With one class or none, every sentence gets the same probability, next to 0 or 1.

    Full-batch steps (Adam) on sparse sums: words to sentences to documents.
    """
    size = 1 << PART_BITS
    words: dict[str, int] = {}
    parts: list[np.ndarray] = []
    held: list[np.ndarray] = []
    tokens: list[np.ndarray] = []
    lengths: list[int] = []
    sentences: list[int] = []
    labels: list[int] = []
    left = [most_chars, most_chars]
    for toxic, text in rows:
        if len(text) > left[toxic]:
            continue
        left[toxic] -= len(text)
        n, own = 0, []
        for m in SENTENCE.finditer(text):
            found = sorted(words_of(m.group()))
            for w in found:
                if w not in words:
                    words[w] = len(words)
                    parts.append(np.array(parts_of(w)))
            if found:
                own.append(np.array([words[w] for w in found], np.int64))
                lengths.append(len(found))
                n += 1
        if n:
            held.append(np.unique(np.concatenate([parts[w] for w in np.unique(np.concatenate(own))])))
            tokens += own
            sentences.append(n)
            labels.append(toxic)
    y = np.array(labels, bool)
    if not y.any() or y.all():
        return SentenceModel(20.0 if y.any() else -20.0, np.zeros(size, np.float32))
    kept = telling(held, y, size)
    # pairs (sentence, telling part) of each distinct word; all other words leave a sentence's odds as they are
    n_parts = np.array([len(p) for p in parts])
    part = np.concatenate(parts)
    word = np.repeat(np.arange(len(parts)), n_parts)[kept[part]]
    part = part[kept[part]]
    starts = np.searchsorted(word, np.arange(len(parts) + 1))
    token = np.concatenate(tokens)
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    count = starts[token + 1] - starts[token]
    at = np.repeat(starts[token] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    part, sentence = part[at], np.repeat(sentence, count)
    used, part = np.unique(part, return_inverse=True)

    n_sentences = len(lengths)
    doc_first = np.concatenate([[0], np.cumsum(sentences)[:-1]])
    doc_of = np.repeat(np.arange(len(y)), sentences)
    weight = np.where(y, share / y.sum(), (1 - share) / (~y).sum())
    # one more entry than parts: the bias, at first as likely per sentence as the share of toxic documents says
    x = np.zeros(len(used) + 1)
    x[-1] = np.log(share / np.mean(sentences))
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        odds = np.bincount(sentence, x[part], n_sentences) + x[-1]
        total = np.add.reduceat(np.logaddexp(0, odds), doc_first)
        slope = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * weight
        by_sentence = slope[doc_of] / (1 + np.exp(-np.clip(odds, -500, 500)))
        gradient = ridge * x
        gradient[-1] = by_sentence.sum()
        gradient[:-1] += np.bincount(part, by_sentence[sentence], len(used))
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(size, np.float32)
    weights[used] = x[:-1]
    return SentenceModel(x[-1], weights)


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id, is never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        most_docs: int = FIT_DOCS, most_chars: int = FIT_CHARS) -> SentenceModel:
    """Fit on a bounded sample of labelled documents that are not held out: of each class the ``most_docs`` ids that hash
    lowest, as far as their texts stay within ``most_chars`` characters. An id labelled more than once is toxic when any
    of its labels is; null ids and labels are left out, as are labels of unknown documents. One task fits the model;
    the driver gets its weights, whose number is fixed."""
    known = materialise(
        labels.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("toxic")).dropna()
        .where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi")
        .withColumn("rank", F.xxhash64("id")))
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    picked = [known.where(F.col("toxic") == k).orderBy("rank", "id").limit(most_docs) for k in (0, 1)]
    # at most 2 * most_docs ids
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(
        F.length("text").between(1, most_chars)).join(ids, "id").select("rank", "toxic", "text")
    # an id may stand in many rows
    rows = texts.orderBy("rank", F.xxhash64("text")).limit(2 * most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

        model = fit_model(each(), share, most_chars)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary())], names=["bias", "weights"])

    fitted = rows.repartition(1).sortWithinPartitions("rank").mapInArrow(run, "bias double, weights binary").first()
    if fitted is None:  # no rows, no task
        return fit_model([], share, most_chars)
    return SentenceModel(fitted["bias"], np.frombuffer(fitted["weights"], np.float32))


def score(docs: DataFrame, model: SentenceModel, doc_id: str = "doc_id", text: str = "text", certain: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, score, n_sentences, offending``.

    ``score`` is the noisy-or of the sentences' probabilities (0 to 1; 0 for null, empty and wordless texts), and
    ``offending`` the (start, end, probability) of every sentence that is toxic by itself with ``certain`` or more, or,
    where the document scores that much and no sentence does, of the likeliest; code points, end exclusive. Whole texts
    are read. Rows are judged alone, so null ids, ties and repeated rows pass through; an empty table gives no rows; other
    columns are not looked at, whatever their names. A sentence is the text between ends of sentences and line feeds.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            out, n, marked = [], [], []
            for t in batch.column(1):
                odds, spans = model.sentences(t.as_py() or "", scores)
                p = 1 / (1 + np.exp(-odds))
                total = noisy_or(odds)
                bad = np.flatnonzero(p >= certain)
                if not len(bad) and total >= certain:
                    bad = [int(p.argmax())]
                out.append(total)
                n.append(len(odds))
                marked.append([{"start": spans[i][0], "end": spans[i][1], "probability": float(p[i])} for i in bad])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.float64()), pa.array(n, pa.int64()), pa.array(marked, span)],
                names=["doc_id", "score", "n_sentences", "offending"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(
        run, f"doc_id {kind}, score double, n_sentences long, offending array<struct<start:long,end:long,probability:double>>")


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    found = score(docs, fit(docs, read(spark, sf, "labels")))
    spans = F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.array_join(spans, ",").alias("offending"))
