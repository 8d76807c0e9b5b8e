"""Language ID by nearest centroid: normalised TF-IDF vectors of character n-grams against several centroids a language.

Features are the hashed 1-, 2- and 3-grams of a text's lower-cased letters (runs of other characters count as one space).
Document frequencies are counted over all training rows. Each language's centroids come from spherical k-means over a
bounded random sample of its labelled rows (`sample` rows expected per language, drawn by a hash of the id). A text gets
the language of the centroid with the largest cosine; it is rejected if that cosine is below the language's own distance
bound, so texts unlike anything learned fall out. The bound is a low quantile of the cosines of the language's rows that
were drawn beside the sample and kept out of the fit; where these are fewer than CALIBRATION, it is a share of the lowest
cosine in the sample, which rejects little.

Null texts and texts without letters are `und` and rejected. Without labelled rows every text is `und`. Repeated rows are
predicted each; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.common import bound_batches, worker_state

BITS = 13
UND = "und"
#: One of so many drawn rows is kept out of the fit, to set the rejection bound.
KEPT_OUT = 5
#: The least number of such rows that tell a quantile.
CALIBRATION = 15
#: Vectors made at once.
ROWS = 128


def text_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs of anything else as one 32, a 32 at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes > 191) & (codes != 215) & (codes != 247) & ((codes < 0x2000) | (codes > 0x2BFF)))
    codes = np.where(letter, codes, 32)
    padded = np.concatenate(([np.uint32(32)], codes.astype(np.uint32), [np.uint32(32)]))
    return padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams."""
    c = text_codes(text)
    a = c * np.uint32(0x9E3779B1)
    grams = [a[1:-1] ^ np.uint32(0x1B873593)]
    two = (a[:-1] * np.uint32(31)) ^ (c[1:] * np.uint32(0x85EBCA6B))
    grams.append(two)
    grams.append((two[:-1] * np.uint32(0xCC9E2D51)) ^ (c[2:] * np.uint32(0xC2B2AE35)))
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + log tf) idf."""
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for k, text in enumerate(texts):
        tf = counts(text)
        hit = np.flatnonzero(tf)
        v = (1 + np.log(tf[hit])) * idf[hit]
        x[k, hit] = v / max(np.sqrt((v * v).sum()), 1e-12)
    return x


@dataclasses.dataclass(frozen=True)
class CentroidModel:
    """languages[k] is the language of centroids[k]; floors[k] the cosine under which that centroid rejects."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Language, score (softmax over the languages' best cosines), cosine, rejected."""
        out = [(UND, 0.0, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        names = sorted(set(self.languages))
        own = [np.flatnonzero(np.array(self.languages) == n) for n in names]
        some = [k for k, t in enumerate(texts) if has_letter(t)]
        for lo in range(0, len(some), ROWS):
            block = some[lo : lo + ROWS]
            cosines = vectors([texts[k] for k in block], self.idf) @ self.centroids.T
            best = np.stack([cosines[:, c].max(1) for c in own], 1)
            weights = np.exp(20 * (best - best.max(1, keepdims=True)))
            weights /= weights.sum(1, keepdims=True)
            for row, k in enumerate(block):
                lang, near = int(best[row].argmax()), int(cosines[row].argmax())
                out[k] = (names[lang], float(weights[row, lang]), float(cosines[row, near]), bool(cosines[row, near] < self.floors[near]))
        return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of unit length. Starts are drawn with a chance that grows with the distance from those taken."""
    if not len(x):
        return x
    draw = np.random.default_rng(seed)
    taken = [int((x @ x.mean(0)).argmax())]
    for _ in range(min(k, len(x)) - 1):
        far = np.maximum(1 - (x @ x[taken].T).max(1), 0).astype(np.float64)
        taken.append(int(draw.choice(len(x), p=far / far.sum())) if far.sum() > 0 else 0)
    c = x[taken].copy()
    for _ in range(rounds):
        cell = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (cell == j).any():
                v = x[cell == j].sum(0)
                c[j] = v / max(float(np.linalg.norm(v)), 1e-12)
    return c


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 4, sample: int = 500, margin: float = 0.4, quantile: float = 0.01) -> CentroidModel:
    """Learn from rows whose text and lang aren't null.

    Document frequencies cover every row. `sample` bounds what the centroids are fitted on: about that many rows of each
    language, drawn by a hash of the id with a chance that makes the expected number `sample`, and a quarter as many beside
    them that are kept out. The rejection bound is the quantile of the latter's cosines to their language's nearest
    centroid; where they are too few, margin scales the lowest cosine in the sample to it.
    """
    spark = train.sparkSession
    bound_batches(spark)
    # Rows without an id are drawn by their text.
    drawn_by = F.coalesce(train[id_col].cast("string"), F.concat(F.lit("null "), F.md5(train[text_col].cast("binary"))))
    rows = train.select(drawn_by.alias("id"), train[text_col].alias("text"), train[lang_col].alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("langid",), dict)
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += counts(text.as_py()) > 0
                n += 1
        hit = np.flatnonzero(total)
        if n:
            yield pa.record_batch([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], n))], ["feature", "n"])

    found = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    n = found.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(found)] = list(found.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not per:
        return CentroidModel([], idf, np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    chance = spark.createDataFrame([(k, min(1.0, sample / v * KEPT_OUT / (KEPT_OUT - 1))) for k, v in per.items()], "lang string, chance double")
    drawn = rows.join(F.broadcast(chance), "lang").where((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("chance"))
    languages, centroids, floors = [], [], []
    texts: dict[str, list[tuple[bool, str, str]]] = {}
    for r in drawn.select("lang", "id", "text", (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(KEPT_OUT)) == 0).alias("out")).toLocalIterator():
        if has_letter(r["text"]):
            texts.setdefault(r["lang"], []).append((r["out"], r["id"], r["text"]))
    for lang in sorted(texts):
        rows = sorted(texts[lang])
        x = vectors([t for _, _, t in rows], idf)
        out = sum(r[0] for r in rows)
        held, x = (x[len(x) - out :], x[: len(x) - out]) if CALIBRATION <= out < len(x) else (x[:0], x)
        c = spherical_kmeans(x, per_language)
        languages += [lang] * len(c)
        centroids += [*c]
        floor = np.quantile((held @ c.T).max(1), quantile) if len(held) else margin * (x @ c.T).max(1).min()
        floors += [float(floor)] * len(c)
    return CentroidModel(languages, idf, np.array(centroids, np.float32).reshape(len(languages), 1 << BITS), np.array(floors))


def predict(documents: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score (0 to 1), cosine, rejected. The model is a fixed number of short vectors."""
    bound_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("langid",), dict)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lang, score, cosine, rejected = zip(*shared.value.predict(batch.column(1).to_pylist()), strict=True)
                yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "cosine", "rejected"])

    rows = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, cosine double, rejected boolean")


def flag(documents: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """The documents' own columns and a boolean column lw_rejected; one pass without a join, for filtering stages."""
    bound_batches(documents.sparkSession)
    shared, schema = documents.sparkSession.sparkContext.broadcast(model), documents.schema
    at = schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("langid",), dict)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                rejected = [x[3] for x in shared.value.predict(batch.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rejected, pa.bool_())], [*batch.schema.names, "lw_rejected"])

    return documents.mapInArrow(run, type(schema)([*schema.fields]).add("lw_rejected", "boolean"))
