"""Language-model scoring: a log-bilinear neural model in numpy, trained by noise-contrastive estimation.

Words are counted over all training documents. P(word | context) = P(class | context) P(word | class): the neural model
predicts a word's class from the vectors of the CONTEXT tokens before it, normalised over all classes by batched matrix
products; the word within its class has its smoothed count's share. So any word has a probability, and those of all words
sum to 1. Classes are the FREQUENT most frequent words, and buckets of endings for the rest. Vectors of context words are
more: the number of words with a vector of their own grows with the vocabulary (one in OWN_SHARE, up to OWN); the rest have
that of their class.

The log-bilinear part is trained in every partition of the corpus on every token, from one start, and the partitions'
parameters are averaged by weight in steps of GROUP. Scores so depend on how the corpus is partitioned; counts and base
scores don't.

Counts are held by workers for at most HEAD frequent words of HEAD_BYTES in all, told by a count threshold that is found
from the numbers of words per count; counts of the others meet the documents' rare words in a shuffle join, so any
vocabulary is covered.

Null texts count as empty: one end token. Whole texts of any length are scored, a few megabytes at a time. Repeated rows are
scored each; other columns are ignored, whatever their names. With no training documents every count is 0 and the classes
are predicted evenly. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, worker_state
from lorewright.llm.wordlists import Words, slices

HEAD, HEAD_BYTES = 1 << 19, 16 << 20
CLASSES, FREQUENT = 256, 192
#: Of so many distinct words one has a context vector of its own, up to OWN words.
OWN_SHARE, OWN = 32, 1 << 14
BEGIN, END = 0, 1
CONTEXT, DIM, BATCH, NOISE, RATE = 3, 32, 512, 64, 0.15
#: Tokens that are shuffled at once in training; parameters that one task averages.
BLOCK, GROUP = 200_000, 8
#: Distinct words that a task counts before it passes the counts on.
FLUSH = 200_000


def ending_class(word: bytes) -> int:
    first = 2 + FREQUENT
    return first + zlib.crc32(word.rstrip(b".,;:!?*#$%&\"')")[-2:]) % (CLASSES - first)


def count_class(n: Column) -> Column:
    """A count, rounded down to a multiple of the 1024th part of its power of two, so that there are few of them."""
    part = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(n)) - 10, F.lit(0)))
    return (F.floor(n / part) * part).cast("long")


@dataclasses.dataclass
class Parameters:
    """Vectors of contexts (those of the classes first) and of target classes, a weight vector for each context position, and biases."""

    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.position, self.bias)])

    @staticmethod
    def start(class_counts: np.ndarray, own: np.ndarray) -> Parameters:
        """own: the classes of the words that have a context vector besides those of the classes; they start from these."""
        draw = np.random.default_rng(8)
        bias = np.log((class_counts + 1) / (class_counts + 1).sum())
        bias[BEGIN] = -1e9  # never predicted
        small = lambda *shape: draw.normal(0, 0.1, shape)
        context, target = small(CLASSES, DIM), small(CLASSES, DIM)
        return Parameters(np.concatenate((context, context[own])), target, np.ones((CONTEXT, DIM)) / CONTEXT, bias)

    def like(self, flat: np.ndarray) -> Parameters:
        """Parameters of the same shapes from flat()."""
        parts, at = [], 0
        for x in dataclasses.astuple(self):
            parts.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return Parameters(*parts)


def contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context numbers of the CONTEXT tokens before each token; first: where its document begins."""
    at = np.arange(len(classes))
    out = np.full((len(classes), CONTEXT), BEGIN, np.int64)
    for j in range(CONTEXT):
        before = at - 1 - j
        has = before >= first
        out[has, j] = classes[before[has]]
    return out


def scatter(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, and the sum of each one's rows."""
    numbers = numbers.astype(np.uint16)
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    begin = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    return numbers[begin], np.add.reduceat(rows.take(order, 0), begin, axis=0)


class Trainer:
    """Adagrad on the noise-contrastive loss; a batch's noise classes are shared by its tokens."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int):
        self.p = Parameters(*(x.astype(np.float32).copy() for x in dataclasses.astuple(start)))
        self.squares = [np.full_like(x, 1e-2) for x in dataclasses.astuple(self.p)]
        self.draw, self.seen, self.upto = np.random.default_rng(seed), 0, np.cumsum(noise) / noise.sum()
        self.log_noise = (np.log(NOISE) + np.log(np.maximum(noise, 1e-12))).astype(np.float32)

    def batch(self, context: np.ndarray, target: np.ndarray) -> None:
        """context: numbers of the CONTEXT tokens before (a row for each position)."""
        p, n = self.p, len(target)
        parts = p.context.take(context, 0)
        q = np.einsum("jnd,jd->nd", parts, p.position)
        kinds, times = np.unique(np.searchsorted(self.upto, self.draw.random(NOISE), "right"), return_counts=True)
        wanted, noise = p.target.take(target, 0), p.target.take(kinds, 0)
        own = np.einsum("nd,nd->n", q, wanted) + (p.bias - self.log_noise)[target]
        other = q @ noise.T
        other += (p.bias - self.log_noise)[kinds]
        # Gradients of the loss by the scores: minus the chance of noise for what stands there, the chance of a word for noise.
        with np.errstate(over="ignore"):
            of_own = -1 / (1 + np.exp(own)) / n
            np.exp(np.negative(other, out=other), out=other)
            other += 1
            np.divide(times.astype(np.float32) / n, other, out=other)
        dq = other @ noise
        dq += of_own[:, None] * wanted
        target_grad = np.zeros_like(p.target)
        at, rows = scatter(target, of_own[:, None] * q)
        target_grad[at] = rows
        target_grad[kinds] += other.T @ q
        bias_grad = np.bincount(target, of_own, CLASSES).astype(np.float32)
        bias_grad[kinds] += other.sum(0)
        bias_grad[BEGIN] = 0
        position_grad = np.einsum("nd,jnd->jd", dq, parts)
        met, context_grad = scatter(context.ravel(), (dq * p.position[:, None]).reshape(-1, DIM))
        every = slice(None)
        for x, s, at, d in zip((p.context, p.target, p.position, p.bias), self.squares, (met, every, every, every), (context_grad, target_grad, position_grad, bias_grad), strict=True):
            d *= 100
            square = s[at] + d * d
            s[at] = square
            x[at] -= RATE * d / np.sqrt(square)
        self.seen += n


@dataclasses.dataclass
class Model:
    """All that scoring needs but the counts of rare words."""

    tokens: int
    words: int
    documents: int
    head: dict[bytes, int]
    head_log: np.ndarray
    head_class: np.ndarray
    head_context: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    parameters: Parameters | None = None

    def number(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The texts' words, the number in the head of each distinct one (the size of the head for others), and its class."""
        words = Words(texts, lower=True)
        at = np.array(list(map(self.head.get, words.distinct, repeat(len(self.head)))), np.int64)
        classes = self.head_class[at]
        rare = np.flatnonzero(at == len(self.head))
        classes[rare] = [ending_class(words.distinct[k]) for k in rare.tolist()]
        return words, at, classes

    def sequences(self, words: Words, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and context number of each token, with an end after each text's words, and where each text's tokens begin."""
        context = np.where(at == len(self.head), classes, self.head_context[at])
        ends = words.first[1:]
        both = (np.insert(x[words.codes], ends, END) for x in (classes, context))
        return *both, words.first[:-1] + np.arange(len(ends))

    def log10_classes(self, classes: np.ndarray, first: np.ndarray, context: np.ndarray | None = None) -> np.ndarray:
        """log10 P(class | tokens before), normalised over all classes; context: the tokens' context numbers, their classes if left out."""
        context = classes if context is None else context
        p, out = self.parameters, np.empty(len(classes))
        table = np.ascontiguousarray(np.vstack((p.target.T, p.bias)))  # the last row meets a constant 1
        weighed = [p.context * p.position[j] for j in range(CONTEXT)]
        length = lambda x: np.sqrt((x * x).sum(1).max())
        small = sum(map(length, weighed)) * length(p.target) + p.bias.max() < 60  # else an exponential may be too large
        ones, q = np.ones(CLASSES, table.dtype), np.ones((1024, DIM + 1), table.dtype)
        before = contexts(context, first)
        for lo in range(0, len(classes), 1024):
            own, c = classes[lo : lo + 1024], before[lo : lo + 1024]
            n = len(own)
            q[:n, :DIM] = weighed[0].take(c[:, 0], 0)
            for j in range(1, CONTEXT):
                q[:n, :DIM] += weighed[j].take(c[:, j], 0)
            logits = q[:n] @ table
            if not small:
                logits -= logits.max(1, keepdims=True)
            chosen = logits[np.arange(n), own].astype(np.float64)
            np.exp(logits, out=logits)
            out[lo : lo + 1024] = chosen - np.log(logits @ ones)
        return out / math.log(10)


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary; null for the end) and n, of rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        documents = 0
        rows = lambda: pa.record_batch([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), documents], pa.int64())], ["word", "n"])
        worker_state(("lm",), dict)
        for whole in batches:
            for batch in slices(whole, 0):
                words = Words(batch.column(0), lower=True)
                had = map(counts.get, words.distinct, repeat(0))
                met = np.bincount(words.codes, minlength=len(words.distinct)).tolist()
                counts.update(zip(words.distinct, map(int.__add__, had, met), strict=True))
                documents += batch.num_rows
                if len(counts) >= FLUSH:
                    yield rows()
                    counts.clear()
                    documents = 0
        if documents:
            yield rows()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the counts of the words it doesn't hold itself (word, n)."""
    texts = train.select(train[text_col].alias("text"))
    counts = materialize(count_words(texts), "lm-counts")
    words = counts.where("word is not null").select("word", "n", count_class(F.col("n")).alias("class"))
    # How many words there are of each class of counts: 1024 for each power of two at most.
    spread = sorted(words.groupBy("class").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("bytes"), F.sum("n").alias("tokens")).collect(), reverse=True)
    held, size, threshold = 0, 0, 0
    for r in spread:
        if held + r["words"] > HEAD or size + r["bytes"] > HEAD_BYTES:
            threshold = r["class"]
            break
        held, size = held + r["words"], size + r["bytes"]
    documents = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    head = sorted(((bytes(r["word"]), r["n"]) for r in words.where(F.col("class") > threshold).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    rare = words.where(F.col("class") <= threshold).select("word", "n")
    total = sum(r["words"] for r in spread)
    own = min(len(head), max(FREQUENT, min(OWN, total // OWN_SHARE)))
    classes = np.array([2 + k if k < FREQUENT else ending_class(w) for k, (w, _) in enumerate(head)] + [BEGIN], np.int64)
    context = classes.copy()
    context[FREQUENT:own] = CLASSES + np.arange(max(own - FREQUENT, 0))
    model = Model(
        documents + sum(r["tokens"] for r in spread), total + (documents > 0), documents, {w: k for k, (w, _) in enumerate(head)},
        np.append(np.log10(np.array([n for _, n in head]) + 1.0), 0.0), classes, context, np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64),
    )

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            classes = [ending_class(w) for w in batch.column(0).to_pylist()]
            np.add.at(tokens, classes, batch.column(1).to_numpy())
            np.add.at(words, classes, 1)
        yield pa.record_batch([pa.array(range(CLASSES), pa.int32()), pa.array(tokens), pa.array(words)], ["class", "tokens", "words"])

    for r in rare.mapInArrow(by_class, "class int, tokens bigint, words bigint").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        model.class_tokens[r["class"]] += r["tokens"]
        model.class_words[r["class"]] += r["words"]
    np.add.at(model.class_tokens, classes[:-1], [n for _, n in head])
    np.add.at(model.class_words, classes[:-1], 1)
    model.class_tokens[END], model.class_words[END] = documents, int(documents > 0)
    model.parameters = train_parameters(texts, model, classes[FREQUENT:own])
    return model, rare


def train_parameters(texts: DataFrame, model: Model, own: np.ndarray) -> Parameters:
    """own: the classes of the words that have context vectors of their own besides the classes."""
    spark = texts.sparkSession
    start = Parameters.start(model.class_tokens.astype(np.float64), own)
    if not model.documents:
        return start
    noise = model.class_tokens + 1.0
    noise[BEGIN] = 0
    noise /= noise.sum()
    shared = spark.sparkContext.broadcast((model, start, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("lm",), dict)
        model, start, noise = shared.value
        part = TaskContext.get().partitionId()
        trainer = Trainer(start, noise, part)
        for whole in batches:
            for batch in slices(whole, 0):
                classes, context, begin = model.sequences(*model.number(batch.column(0)))
                first = np.repeat(begin, np.diff(np.append(begin, len(classes))))
                before = np.ascontiguousarray(contexts(context, first).T.astype(np.uint16))
                for lo in range(0, len(classes), BLOCK):
                    at = lo + trainer.draw.permutation(min(BLOCK, len(classes) - lo))
                    for k in range(0, len(at), BATCH):
                        trainer.batch(before[:, at[k : k + BATCH]], classes[at[k : k + BATCH]])
        if trainer.seen:
            yield packed(part, trainer.seen, trainer.p.flat().astype(np.float64) * trainer.seen)

    def packed(part: int, seen: float, total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part]), pa.array([float(seen)]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "seen", "flat"])

    def add(rows: pa.Table) -> pa.Table:
        part, seen, total = rows["part"][0].as_py(), 0.0, 0.0
        for weight, flat in zip(rows["seen"], rows["flat"], strict=True):
            seen, total = seen + weight.as_py(), total + np.frombuffer(flat.as_py(), np.float32).astype(np.float64)
        return pa.Table.from_batches([packed(part // GROUP, seen, total)])

    kind = "part bigint, seen double, flat binary"
    trained = materialize(texts.mapInArrow(run, kind), "lm-parts")
    left = trained.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("n")).first()["n"]
    while left > GROUP:  # a row for each GROUP partitions' parameters, however the rows are dealt to tasks, until few are left
        left = math.ceil(left / GROUP)
        trained = materialize(trained.groupBy(F.floor(F.col("part") / GROUP)).applyInArrow(add, kind), "lm-sums")
    sums = trained.collect()
    seen = sum(r["seen"] for r in sums)
    return start.like(sum(np.frombuffer(r["flat"], np.float32).astype(np.float64) for r in sums) / seen) if seen else start


def score(documents: DataFrame, model: Model, rare_counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_known, base_score and score (log10)."""
    p = model.parameters
    model.parameters = Parameters(*(x.astype(np.float32) for x in (p.context, p.target, p.position, p.bias)))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    model.parameters = p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("lm",), dict)
        model, part, row = shared.value, TaskContext.get().partitionId(), 0
        per_token = math.log10(model.tokens + model.words + 1)
        class_log = np.log10(model.class_tokens + model.class_words + 1.0)
        end_log = math.log10(model.documents + 1)
        for whole in batches:
            for batch in slices(whole, size=1 << 20):
                words, at, kinds = model.number(batch.column(1))
                classes, context, begin = model.sequences(words, at, kinds)
                lengths = words.lengths + 1
                tokens = model.log10_classes(classes, np.repeat(begin, lengths), context) - class_log[classes]
                sums = np.add.reduceat(tokens, begin)
                is_rare = at == len(model.head)
                rows, flags = words.rows(), is_rare[words.codes]
                counted = np.bincount(rows, model.head_log[at][words.codes], batch.num_rows) + end_log
                known = lengths - np.bincount(rows[flags], minlength=batch.num_rows) - (model.documents == 0)
                # Rare words of each text and how often it has them.
                pairs, times = np.unique(rows[flags] * len(words.distinct) + words.codes[flags], return_counts=True)
                of, code = np.divmod(pairs, max(len(words.distinct), 1))
                ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32())
                names = pa.array(words.distinct, pa.binary()).take(pa.array(code, pa.int64()))
                keys = (part << 33) + row + np.arange(batch.num_rows)
                row += batch.num_rows
                yield pa.record_batch(
                    [
                        batch.column(0), pa.array(keys), pa.array(lengths), pa.array(known), pa.array(counted - lengths * per_token), pa.array(sums + counted),
                        pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                    ],
                    ["id", "row", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = materialize(rows.mapInArrow(run, f"id {kind}, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<binary>, times array<bigint>"), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(rare_counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("log"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    extra = F.coalesce("log", F.lit(0.0))
    return out.select("id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
