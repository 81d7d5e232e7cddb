"""Language identification with string kernels.

Two texts are as alike as the sets of character n-grams they contain: the blended-spectrum presence
kernel counts common n-grams of every length up to three and divides by the root of the product of
both counts. Nystroem landmarks turn it into a fixed number of features, kernel ridge regression
learns one score per language against the rest, and texts are scored in batches by matrix products.

Characters fold to a fixed number of classes (lower case; the most frequent ones of the sample get a
class each, the rest share one), so n-grams are places in a table of fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CLASSES = 64
ORDERS = 3
UNDETERMINED = "und"
_PLACES = sum(CLASSES**n for n in range(1, ORDERS + 1))


def presence(text: str, classes: np.ndarray) -> np.ndarray:
    """Sorted places of the n-grams, n = 1 to ORDERS, that the whole text contains."""
    code = classes[np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4"), len(classes) - 1)]
    seen = np.zeros(_PLACES, bool)
    base, gram = 0, code
    for n in range(1, ORDERS + 1):
        if len(code) < n:
            break
        if n > 1:
            gram = gram[:-1] * CLASSES + code[n - 1 :]
        seen[base + gram] = True
        base += CLASSES**n
    return np.flatnonzero(seen)


def character_classes(sample: list[str]) -> np.ndarray:
    """The class of each code point up to U+FFFF (and of all others, as the last)."""
    counts: Counter = Counter()
    for text in sample:
        counts.update(text.lower())
    classes = np.full(0x10000, CLASSES - 1, np.int64)
    for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 1]):
        if ord(c) < len(classes) - 1:
            classes[ord(c)] = i
    return classes


@dataclass(frozen=True)
class Model:
    languages: list[str]
    classes: np.ndarray
    columns: np.ndarray  # place of an n-gram -> column of `landmarks`, -1 if no landmark has it
    landmarks: np.ndarray  # 0/1, one row each
    weights: np.ndarray  # from kernel values with the landmarks to a score per language

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(grams), self.landmarks.shape[1]), np.float32)
        for i, g in enumerate(grams):
            at = self.columns[g]
            x[i, at[at >= 0]] = 1
        norm = np.sqrt(np.maximum(1, [len(g) for g in grams]))[:, None] * np.sqrt(self.landmarks.sum(1))[None, :]
        return (x @ self.landmarks.T) / norm

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return self.kernel(grams) @ self.weights


def fit(texts: list[str], languages: list[str], landmarks: int = 96, ridge: float = 1e-2) -> Model:
    """Learns from whole labelled texts; the first texts of each language, in turn, are the landmarks."""
    names = sorted(set(languages))
    classes = character_classes(texts)
    grams = [presence(t, classes) for t in texts]
    turns = {n: [i for i, lang in enumerate(languages) if lang == n] for n in names}
    order = [i for k in range(max(map(len, turns.values()))) for n in names for i in turns[n][k : k + 1]]
    chosen = [i for i in order if len(grams[i])][:landmarks]
    places = np.unique(np.concatenate([grams[i] for i in chosen]))
    columns = np.full(_PLACES, -1, np.int64)
    columns[places] = np.arange(len(places))
    marks = np.zeros((len(chosen), len(places)), np.float32)
    for row, i in enumerate(chosen):
        marks[row, columns[grams[i]]] = 1
    model = Model(names, classes, columns, marks, np.zeros((len(chosen), len(names))))
    k = np.concatenate([model.kernel(grams[i : i + 64]) for i in range(0, len(grams), 64)]).astype(np.float64)
    values, vectors = np.linalg.eigh(model.kernel([grams[i] for i in chosen]).astype(np.float64))
    keep = values > values.max() * 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ half
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([1 / max(1, len(turns[n])) for n in languages])
    weighted = phi * share[:, None]
    beta = np.linalg.solve(weighted.T @ phi + ridge * np.eye(phi.shape[1]), weighted.T @ y)
    return Model(names, classes, columns, marks, (half @ beta).astype(np.float32))


def held_out(id_: int | None) -> bool:
    return zlib.crc32(str(id_).encode()) % 4 == 2


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 250,
    sample_chars: int = 16 << 20,
    sample_texts: int = 20_000,
) -> DataFrame:
    """The predicted language of every whole text.

    Returns id_col, held_out (crc32 of the id as text modulo 4 is 2), lang_pred and score (0 to 1).
    The model learns only from rows that aren't held out and have text, a letter and a language; of
    those from at most `per_language` of each language, chosen by a hash of the id, and at most
    `sample_chars` characters and `sample_texts` texts in all, taken from the languages in turn: texts
    that would pass that are left out whole, and of rows equal in id and
    language the first text counts. Every text is then predicted.

    Null text or text without a letter is `und` with score 0, and so is every text if there is
    nothing to learn from. Of equal scores the first language by name wins. A null id isn't held
    out; repeated rows keep a row each; an empty table gives no rows; other columns, and the
    label of the row itself, play no part in a prediction.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), out.alias("out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    lettered = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    chance = F.xxhash64("id", "lang")
    sizes = rows.filter(~F.col("out") & F.col("lang").isNotNull() & lettered).select("id", "lang", F.char_length("text").alias("n"), chance.alias("chance"))
    ranked = sizes.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id", "n")))
    wanted, room = [], sample_chars
    for r in ranked.filter(F.col("nth") <= per_language).orderBy("nth", "lang").limit(sample_texts).collect():
        if r["n"] <= room:
            wanted.append((r["id"], r["lang"]))
            room -= r["n"]
    schema = "id long, lang string"
    keys = docs.sparkSession.createDataFrame(sorted(set(wanted), key=repr), schema)
    learnt = (
        rows.filter(~F.col("out") & F.col("lang").isNotNull() & lettered)
        .join(F.broadcast(keys.withColumnRenamed("id", "k").withColumnRenamed("lang", "l")), F.col("id").eqNullSafe(F.col("k")) & (F.col("lang") == F.col("l")))
        .groupBy(chance.alias("chance"), "id", "lang").agg(F.min("text").alias("text")).collect()
    ) if wanted else []
    learnt.sort(key=lambda r: (r["chance"], repr(r["id"]), r["text"]))
    model = fit([r["text"] for r in learnt], [r["lang"] for r in learnt]) if learnt else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = part.column(2).to_pylist()
                known = [i for i, t in enumerate(texts) if m is not None and t is not None and any(map(str.isalpha, t))]
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if known:
                    s = m.scores([presence(texts[i], m.classes) for i in known])
                    best = s.argmax(1)
                    for i, k, v in zip(known, best.tolist(), s[np.arange(len(known)), best].tolist()):
                        names[i], scores[i] = m.languages[k], min(1.0, max(0.0, (v + 1) / 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return rows.select("id", "out", "text").mapInArrow(predict, f"`{id_col}` long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
