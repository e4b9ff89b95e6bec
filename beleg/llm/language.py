"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of distinct letter n-grams (lengths 1 to 4 together, presence only) that both hold,
divided by the geometric mean of their numbers. Landmark texts give a Nyström approximation of its feature space; a
one-versus-rest kernel ridge regression is fitted in it. A batch of texts is scored by two matrix products: presence rows
times landmark presence gives the kernel values, kernel values times coefficients the class values.

The model is fitted on a bounded sample: of each language the ``per_language`` training documents with the smallest hash of
their id. It is at most 2^16 x landmarks bytes, so it travels with the tasks. Every text is read whole in prediction.

N-grams are hashed to 2^16 places. Letters are folded to lower case; every run of other characters is one space.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything when no labelled row can
be learned from. Ties go to the language that sorts first. A training row with null language or no letter is not used.
Repeated rows are predicted one by one. An empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PER_LANGUAGE = 160
LANDMARKS_PER_LANGUAGE = 16
RIDGE = 0.1
PLACES = 1 << 16
BATCH = 32  # texts whose kernel values are taken at a time
UNKNOWN = "und"

_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for anything that is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def present(text: str | None, places: np.ndarray) -> np.ndarray | None:
    """The places of the distinct n-grams of a text, or None without a letter. places: an all-zero scratch row, left so."""
    if not text:
        return None
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    letter = codes != 32
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    gram = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, 5):
        if len(codes) < n:
            break
        gram = gram[:len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(n)
        places[(gram * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1
    found = np.flatnonzero(places)
    places[found] = 0
    return found


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # places x landmarks, 0 or 1
    scale: np.ndarray  # 1 / sqrt(n-grams) of each landmark
    coefficients: np.ndarray  # landmarks x languages

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts (as their places, none empty) and landmarks: sparse presence rows times a dense matrix."""
        starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
        common = np.add.reduceat(self.landmarks[np.concatenate(rows)], starts, axis=0, dtype=np.float32)
        return common * self.scale / np.sqrt([[len(r)] for r in rows])

    def predict(self, texts: list[str | None], batch: int = BATCH) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        places, rows, at = np.zeros(PLACES, dtype=np.uint8), [], []

        def flush() -> None:
            values = self.kernel(rows) @ self.coefficients
            best = values.argmax(axis=1)
            for i, k, v in zip(at, best, values[np.arange(len(best)), best]):
                names[i], scores[i] = self.languages[k], float(min(1.0, max(0.0, (1 + v) / 2)))
            rows.clear(), at.clear()

        if self.languages:
            for i, text in enumerate(texts):
                if (row := present(text, places)) is not None:
                    rows.append(row), at.append(i)
                    if len(rows) == batch:
                        flush()
            if rows:
                flush()
        return names, scores


def fit(rows: list[tuple[str, int, np.ndarray]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """rows: language, order and n-gram places of the sampled documents."""
    rows = sorted(rows, key=lambda r: r[:2])
    languages = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((PLACES, 0), np.uint8), np.zeros(0), np.zeros((0, 0)))
    chosen = []
    for language in languages:
        # The richer half of a language's texts holds its landmarks: short texts share few n-grams with any other.
        own = sorted((r for r in rows if r[0] == language), key=lambda r: -len(r[2]))
        own = own[:max(landmarks_per_language, len(own) // 2)]
        chosen += own[::max(1, len(own) // landmarks_per_language)][:landmarks_per_language]
    landmarks = np.zeros((PLACES, len(chosen)), dtype=np.uint8)
    for j, (_, _, row) in enumerate(chosen):
        landmarks[row, j] = 1
    model = Model(languages, landmarks, 1 / np.sqrt([len(r[2]) for r in chosen]), np.zeros((len(chosen), len(languages))))
    own_kernel = np.concatenate([model.kernel([r[2] for r in chosen[at:at + BATCH]]) for at in range(0, len(chosen), BATCH)])
    values, vectors = np.linalg.eigh(own_kernel.astype(np.float64))
    sound = values > 1e-6 * values.max()
    root = vectors[:, sound] / np.sqrt(values[sound])
    # Only the sums of the products are held; the kernel's rows come a batch at a time.
    counts = Counter(r[0] for r in rows)
    square, right = ridge * np.eye(root.shape[1]), np.zeros((root.shape[1], len(languages)))
    for at in range(0, len(rows), BATCH):
        some = rows[at:at + BATCH]
        features = model.kernel([r[2] for r in some]) @ root
        target = np.where(np.array([[r[0] == language for language in languages] for r in some]), 1.0, -1.0)
        balance = np.array([[len(rows) / len(languages) / counts[r[0]]] for r in some])
        square += features.T @ (balance * features)
        right += features.T @ (balance * target)
    model.coefficients = root @ np.linalg.solve(square, right)
    return model


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on text and language of rows that are not held out; docs needs doc_id, text and lang.

    The sample is chosen by ids and languages alone; only the chosen rows' texts are turned to n-grams, on the executors. Of rows
    with the same id and language one with a letter stays, that with the least hash of its n-grams.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).select("doc_id", "lang", order.alias("rank_hash")).distinct()
    best = Window.partitionBy("lang").orderBy("rank_hash", "doc_id")
    ids = usable.withColumn("rank_in", F.row_number().over(best)).filter(F.col("rank_in") <= per_language).select("doc_id", "lang")
    schema = T._parse_datatype_string("lang string, doc_id long, hash long, places binary")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch, least = np.zeros(PLACES, dtype=np.uint8), {}
        for batch in batches:
            rows = []
            for lang, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (row := present(text, scratch)) is not None:
                    places = row.astype(np.uint16).tobytes()
                    number = xxhash.xxh64_intdigest(places) >> 1
                    if number < least.get((lang, i), 1 << 64):  # only improvements leave the task
                        least[lang, i] = number
                        rows.append((lang, i, number, places))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    # At most per_language ids of each language, and a row of each.
    sample = docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", F.col("doc_id").cast("long"), "text").mapInArrow(grams, schema)
    sample = sample.groupBy("lang", "doc_id").agg(F.min_by("places", "hash").alias("places"))
    return fit([(r["lang"], r["doc_id"], np.frombuffer(r["places"], dtype=np.uint16)) for r in sample.collect()], landmarks_per_language, ridge)


def any_language() -> Model:
    """A model that tells texts with a letter from those without, where there is nothing to learn from."""
    return Model(["mul"], np.zeros((PLACES, 1), np.uint8), np.ones(1), np.zeros((1, 1)))


def predict(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with the predicted language and its score; reads nothing but the text."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    sent, at, target = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=target)

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, **settings: float) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, **settings)
    slim = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")
