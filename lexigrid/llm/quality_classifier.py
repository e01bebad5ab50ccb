"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Tokens are what white space separates. Four groups of n-grams are hashed to ``2**bits``
weights: single tokens and pairs, each as words (lower case, without punctuation) and as
shapes (kinds of characters, runs shortened); a pair of equal words is one feature of
its own whatever the word. A feature's value is its share of its group times ``SCALE``.
Weights are learnt by follow-the-regularised-leader updates with L1 and L2, and a text's
score is the logistic function of the sparse dot product with them.

Defined results
* null and empty texts have no feature: their score is that of the intercept.
* without labelled rows, or with one class alone, weights stay 0 and the intercept is
  the share of that class, smoothed. Ties in ids and repeated rows: one row an id is learnt.
* rows are scored one by one; other columns pass through, but for ``score`` and
  ``predicted``, which are replaced. An empty table gives an empty table.

Scale: fitting sees at most ``SAMPLE`` labelled rows. Scoring is one pass with
``2**bits`` weights sent along, of the same size for any input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_64_intdigest

from lexigrid.llm._shared import fold_rows
from lexigrid.llm.training import fit_in_task, sample

#: Labelled rows that are learnt from at most; weights; passes over the sample.
SAMPLE, BITS, PASSES = 12_000, 18, 3
#: FTRL: learning rate, its smoothing, L1, L2.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
SCALE, THRESHOLD = 8.0, 0.3
REMEMBERED = 1 << 18
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_RUNS = ((re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}"), "XX"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def _shape(token: str) -> str:
    for run, short in _RUNS:
        token = run.sub(short, token)
    return token[:16]


class Features:
    """Tokens -> hashed n-grams; remembers the hashes of tokens."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, bytes] = {}

    def _hash(self, token: str) -> bytes:
        word = _EDGE.sub("", token).lower() or token[:4]
        made = np.array([xxh3_64_intdigest("w" + word), xxh3_64_intdigest("s" + _shape(token))], np.uint64).tobytes()
        self.known[token] = made
        return made

    def of(self, text: str) -> list[np.ndarray]:
        """Feature numbers of each group of n-grams."""
        tokens, known = text.split(), self.known
        if not tokens:
            return []
        if len(known) > REMEMBERED:
            known.clear()
        for token in [t for t in set(tokens) if t not in known]:
            self._hash(token)
        words, shapes = np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.uint64).reshape(-1, 2).T
        groups = []
        for hashes in (words, shapes):
            groups.append(hashes & self.mask)
            if len(hashes) > 1:
                pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
                pairs ^= pairs >> np.uint64(29)
                if hashes is words:
                    pairs[hashes[:-1] == hashes[1:]] = np.uint64(0x517CC1B727220A95)
                groups.append(pairs & self.mask)
        return groups

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        groups = self.of(text)
        if not groups:
            return np.empty(0, np.int64), np.empty(0)
        values = np.concatenate([np.full(len(g), SCALE / len(g)) for g in groups])
        ids, at = np.unique(np.concatenate(groups).astype(np.int64), return_inverse=True)
        return ids, np.bincount(at, weights=values)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bits: int


def fit(rows: list[tuple[str, int]], bits: int = BITS, passes: int = PASSES) -> Model:
    """FTRL-proximal over (text, label) rows, in their order."""
    size, features = 1 << bits, Features(bits)
    z, n = np.zeros(size), np.zeros(size)
    good = sum(y for _, y in rows)
    base = float(np.log((good + 1) / (len(rows) - good + 1)))
    if 0 < good < len(rows):
        data = [(*features.sparse(t), y) for t, y in rows]
        for _ in range(passes):
            for ids, values, y in data:
                zi, ni = z[ids], n[ids]
                w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
                w[np.abs(zi) <= L1] = 0
                p = 1 / (1 + np.exp(-np.clip(base + w @ values, -35, 35)))
                g = (p - y) * values
                z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[ids] = ni + g * g
    weights = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    weights[np.abs(z) <= L1] = 0
    return Model(weights.astype(np.float32), base, bits)


def _score(model: Model, threshold: float, text_index: int, schema: pa.Schema):
    def run(batches):
        features, weights = Features(model.bits), model.weights
        for batch in batches:
            dots = [sum(float(weights[g].mean(dtype=np.float64)) for g in features.of(t or "")) for t in batch.column(text_index).to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(model.intercept + SCALE * np.array(dots, np.float64), -35, 35)))
            made = {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema=schema)

    return run


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, where: Column | None = None) -> Model:
    """Learn ``labels.quality`` from ``docs`` (``doc_id, text``) on at most ``limit`` rows."""
    return fit_in_task(sample(docs, labels, F.col("quality"), limit, where), fit)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score double`` and ``predicted int``."""
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    docs = docs.select(*[f.name for f in fields])
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(fold_rows(_score, model, threshold, docs.columns.index(text_col), to_arrow_schema(schema)), schema)
