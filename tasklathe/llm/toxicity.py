"""Toxicity: a counterfactual-regularised classifier.

Method.  A text's features are its distinct words and word beginnings (4, 5 and 6
bytes), hashed to 64 bits.  Features are screened by how much their share of
toxic texts departs from the base rate, and a logistic model is fitted to the
ones that pass.  Every labelled text that mentions an identity term gets
counterfactuals in which the terms are swapped for others of their kind and for
a neutral word; the loss adds a penalty on the change of score between text and
counterfactual.  So terms for groups can't raise a score by themselves, and
neutral mentions stay below the threshold.

Labels are learnt from a bounded sample (``LABELLED_MOST`` rows, those with the
smallest hash of their identifier); scoring covers every whole text, in Arrow
batches without Python per word.  The model is a few thousand numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordbuf
from .sparkio import durable, release, width
from .wordbuf import U64

#: Labelled rows that are learnt from, at most.
LABELLED_MOST = 20_000
#: Features of the model, at most, and texts that must have one.
FEATURES_MOST, TEXTS_LEAST = 2048, 3
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
# Identity terms by kind; a term is swapped within its kind, or for the kind's last word, a neutral one.
IDENTITY = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "believers"),
    ("black", "white", "asian", "african", "latino", "hispanic", "arab", "european", "american", "mexican", "chinese", "indian", "local"),
    ("gay", "lesbian", "bisexual", "transgender", "trans", "queer", "straight", "heterosexual", "human"),
    ("immigrants", "refugees", "migrants", "foreigners", "residents"),
    ("deaf", "blind", "disabled", "paralyzed", "autistic", "tall"),
    ("old", "elderly", "young", "teenage", "adult"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "croyants"),
    ("noirs", "blancs", "asiatiques", "africains", "arabes", "européens", "habitants"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels", "personnes"),
    ("immigrés", "réfugiés", "étrangers", "riverains"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken", "gläubige"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "araber", "europäer", "einwohner"),
    ("homosexuelle", "lesben", "bisexuelle", "heterosexuelle", "personen"),
    ("einwanderer", "flüchtlinge", "ausländer", "anwohner"),
    ("mujeres", "hombres", "chicas", "chicos", "gente"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "creyentes"),
    ("negros", "blancos", "asiáticos", "africanos", "árabes", "europeos", "vecinos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales", "personas"),
    ("inmigrantes", "refugiados", "extranjeros", "residentes"),
)
_KIND = {term: kind for kind in IDENTITY for term in kind}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> list[str]:
    """Counterfactuals of a text: each term for the next of its kind, and each for the neutral word.  None if there's no term."""
    if not _TERMS.search(text):
        return []

    def following(match: re.Match) -> str:
        kind = _KIND[match[0].lower()]
        return kind[(kind.index(match[0].lower()) + 1) % len(kind)]

    return [_TERMS.sub(following, text), _TERMS.sub(lambda m: _KIND[m[0].lower()][-1], text)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the rows' words, in no order and with repeats, and the row of each."""
    begin, end, at = wordbuf.words(data, offsets, wordbuf.LETTERS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    hashes, rows = [wordbuf.word_hashes(data, begin, end)], [row]
    for n in BEGINNINGS:
        long = end - begin > n
        hashes.append(wordbuf.mix(wordbuf.word_hashes(data, begin[long], begin[long] + n) + U64(n)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _identity_features() -> np.ndarray:
    data, offsets = wordbuf.utf8(pa.array(sorted(_KIND)))
    return np.unique(features(data, offsets)[0])


@dataclass
class Model:
    """Weights of sorted feature hashes, and the score's constant on the logit scale."""

    hashes: np.ndarray
    weights: np.ndarray
    constant: float

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of the texts, as two arrays in row order."""
        hashed, rows = features(data, offsets)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True
        near = maybe[(hashed & U64(0xFFFF)).astype(np.int64)]
        hashed, rows = hashed[near], rows[near]
        place = np.minimum(np.searchsorted(self.hashes, hashed), max(0, len(self.hashes) - 1))
        held = self.hashes[place] == hashed if len(self.hashes) else np.zeros(0, dtype=bool)
        pairs = np.unique(rows[held] * max(1, len(self.hashes)) + place[held])
        return pairs // max(1, len(self.hashes)), pairs % max(1, len(self.hashes))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.constant)
        for a, b, data, offsets in wordbuf.pieces(column):
            row, feature = self.hits(data, offsets)
            out[a:b] += np.bincount(row, weights=self.weights[feature], minlength=b - a) if len(row) else 0.0
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature -> number of texts that have it, and of toxic ones among them, block by block."""
    wordbuf.kept("toxicity")
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, offsets in wordbuf.pieces(batch.column("text")):
            hashed, rows = features(data, offsets)
            order = np.lexsort((rows, hashed))
            hashed, rows = hashed[order], rows[order]
            new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (rows[1:] != rows[:-1])]) if len(hashed) else np.zeros(0, dtype=bool)
            hashed, rows = hashed[new], rows[new]
            kinds, inverse = np.unique(hashed, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(kinds)).astype(np.int64)), pa.array(np.bincount(inverse, weights=toxic[a:b][rows], minlength=len(kinds)).astype(np.int64))],
                names=["feature", "texts", "toxic"],
            )


def _hit_rows(model: Model):
    """Labelled texts -> their features' places, and those of their counterfactuals."""

    def places(texts: list[str]) -> list[list[int]]:
        row, feature = model.hits(*wordbuf.utf8(pa.array(texts, type=pa.string())))
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        return [feature[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordbuf.kept("toxicity")
        for batch in batches:
            column = batch.column("text").fill_null("")
            for a, b, _, _ in wordbuf.pieces(column):
                texts = column.slice(a, b - a).to_pylist()
                others = [swapped(t) for t in texts]
                flat = places([x for o in others for x in o])
                at = np.cumsum([0, *map(len, others)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, b - a).cast(pa.int32()), pa.array(places(texts), type=pa.list_(pa.int32())), pa.array([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], type=pa.list_(pa.list_(pa.int32())))],
                    names=["toxic", "own", "other"],
                )

    return run


def _pairs(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([x for r in rows for x in r], dtype=np.int64)


def train(own: list[list[int]], other: list[tuple[int, list[int]]], toxic: np.ndarray, width: int, steps: int = 300, ridge: float = 2e-4, swap_weight: float = 20.0) -> tuple[np.ndarray, float]:
    """Weights and constant of the logistic loss + ridge + swap_weight * mean squared score change, by Adam.

    own: feature places of each text; other: (text, places) of each counterfactual.
    """
    n = len(own)
    rows, cols = _pairs(own)
    source = np.array([i for i, _ in other], dtype=np.int64)
    swap_rows, swap_cols = _pairs([c for _, c in other])
    share = min(max(toxic.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    weight = weight / max(weight.sum(), 1e-9)
    theta = np.zeros(width + 1)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        score = sigmoid(np.bincount(rows, weights=theta[cols], minlength=n) + theta[-1])
        slope = weight * (score - toxic)
        swap_score = sigmoid(np.bincount(swap_rows, weights=theta[swap_cols], minlength=len(source)) + theta[-1])
        swap_slope = np.zeros(0)
        if len(source):
            gap = 2 * swap_weight * (score[source] - swap_score) / len(source)
            slope = slope + np.bincount(source, weights=gap * score[source] * (1 - score[source]), minlength=n)
            swap_slope = -gap * swap_score * (1 - swap_score)
        gradient = np.zeros(width + 1)
        gradient[:-1] = np.bincount(cols, weights=slope[rows], minlength=width)[:width] + 2 * ridge * theta[:-1]
        if len(source):
            gradient[:-1] += np.bincount(swap_cols, weights=swap_slope[swap_rows], minlength=width)[:width]
        gradient[-1] = slope.sum() + swap_slope.sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(labelled: DataFrame, most: int = LABELLED_MOST) -> Model:
    """A model from ``text`` and ``toxic`` (0 or 1) of labelled rows; ``doc_id`` picks the sample where there are more than ``most``.

    Rows without a label are passed over; null texts read as empty.  The rows that
    are learnt from are read once and stand in the shared folder until the model is
    made.  Rows that repeat count each; of rows equal in id, as many as the bound
    leaves room for.  With no rows, or none of one label, every text scores near
    the share of toxic rows.  Whole texts are learnt from; other columns play no part.
    """
    rows = labelled.where("toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    if rows.select("doc_id").count() > most:  # else every row is in the sample, and stays where it is
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).repartition(width(labelled.sparkSession))
    sample = durable(rows.select("text", "toxic"))
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = min(max(positive / n if n else 0.0, 1e-3), 1 - 1e-3)
    counts = sample.mapInArrow(_tally, "feature long, texts long, toxic long").groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).where(F.col("texts") >= TEXTS_LEAST)
    q = F.col("toxic") / F.col("texts")
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    surprise = F.col("texts") * (part(q, F.lit(share)) + part(1 - q, F.lit(1 - share)))
    # A share this far from the base rate would come by chance less than once in some twenty tables.
    chosen = counts.withColumn("surprise", surprise).withColumn("bar", F.lit(np.log(max(n, 1)).item() * 2 + 3.0)).where("surprise > bar").orderBy(F.desc("surprise"), "feature").limit(FEATURES_MOST)
    learnt = np.array([r.feature for r in chosen.select("feature").collect()], dtype=np.int64).view(U64)
    hashes = np.unique(np.concatenate([learnt, _identity_features()]))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)
    held = sample.mapInArrow(_hit_rows(model), "toxic int, own array<int>, other array<array<int>>").collect()  # at most ``most`` rows of places
    release(sample)
    own = [r.own for r in held]
    other = [(i, x) for i, r in enumerate(held) for x in r.other]
    weights, constant = train(own, other, np.array([r.toxic for r in held], dtype=np.float64), len(hashes))
    return Model(hashes, weights, constant)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learnt: crc32 of the identifier's text leaves 1 after division by 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def labelled_part(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learnt from: label columns other than doc_id and toxic, and docs' own, play no part.

    An id that several label rows give is one label, toxic if any of them says so;
    documents that share an id share its label.
    """
    marks = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_MOST)
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def _score(model: Model, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wordbuf.kept("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column("text")))], names=[*batch.schema.names, out])
        wordbuf.give_back()

    return run


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` (a column ``text``, and any others) with ``out``, from 0 to 1; a column of that name is replaced.

    Whole texts are scored.  Null and empty texts get the model's constant.
    Repeated rows get equal scores; an empty table stays empty.
    """
    docs = docs.drop(out)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(model, out), f"{kept}, `{out}` double")
