"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each later model also gets the
probabilities of the earlier categories. So that these are as uncertain in training as
they will be on new texts, earlier probabilities of a training row come from models of
other folds (out-of-fold), never from one that has seen the row.

Only "toxic or not" is labelled. The earlier categories are found in the data: toxic
training rows are dealt into ``GROUPS`` groups by the words that set them apart (spherical
k-means), in order of size, and a category is "toxic, of this group". The last one is
"toxic". For each fold, features are selected and groups are found on the other folds
alone; all rows decide only which of a fold's groups gets which number.

Features: the distinct words of a text and their beginnings of ``PREFIXES`` letters, among
those that ``MIN_TEXTS`` training texts have at least and that tell toxic ones apart; rare
words never share a weight. Models are logistic regressions by AdaGrad steps with an L1 step.

Defined results
* null and empty texts have no feature: probabilities are those of the intercepts.
* without labelled rows, or of one class alone, that category's probability is the
  smoothed share of its class; groups that no toxic row is left for are such categories.
  Repeated ids: one labelled row an id is learnt.
* rows are scored one by one; other columns pass through, but for the added ones. An
  empty table gives an empty table.

Scale: fitting sees at most ``SAMPLE`` labelled rows and keeps at most ``VOCABULARY``
features. Of a row it holds four bytes a feature, not the names, and sums over all rows are
made by pieces of ``PIECE`` features. Scoring is one pass over the table with that model
sent along.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.llm._shared import fold_rows
from lexigrid.llm.training import fit_in_task, sample

SAMPLE, VOCABULARY, MIN_TEXTS, PREFIXES, FOLDS, EPOCHS = 12_000, 1 << 16, 3, (4, 5, 6, 7), 3, 12
#: Categories before the last; features that groups are told apart by; rounds of k-means.
GROUPS, GROUP_FEATURES, ROUNDS = 3, 512, 25
RATE, L1, BATCH = 0.3, 2e-4, 512
#: Standard deviations by which a feature's toxic texts differ at least; start of AdaGrad's sums.
LEAST_EXCESS, DAMPING = 4.0, 1e-3
THRESHOLD = 0.35
REMEMBERED = 1 << 18
#: Features of rows that are gathered at once.
PIECE = 1 << 18
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def _names(token: str) -> tuple[str, ...]:
    word = _EDGE.sub("", token).lower()
    return (word, *[word[:n] + "*" for n in PREFIXES if n <= len(word)]) if word else ()


def text_features(text: str) -> set[str]:
    return {name for token in set(text.split()) for name in _names(token)}


@dataclass
class Chain:
    names: list[str]
    words: dict[str, int]
    weights: np.ndarray  # a row a category
    links: np.ndarray  # weights of earlier categories' probabilities
    intercepts: np.ndarray


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Rows:
    """Sparse binary rows, one behind the other."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.ids = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.ends = np.cumsum([0, *map(len, rows)])

    def take(self, rows: np.ndarray) -> _Rows:
        out = _Rows([])
        sizes = np.diff(self.ends)[rows]
        out.ends = np.concatenate(([0], np.cumsum(sizes)))
        out.ids = self.ids[np.repeat(self.ends[rows] - out.ends[:-1], sizes) + np.arange(out.ends[-1])]
        return out

    def pieces(self, rows: np.ndarray) -> Iterator[tuple[slice, _Rows]]:
        """These rows by ``PIECE`` features, or one larger row, and where they stand in ``rows``."""
        sums, at = np.cumsum(np.diff(self.ends)[rows]), 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PIECE, side="right")))
            yield slice(at, end), self.take(rows[at:end])
            at = end

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.ids])))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]


def _regress(rows: _Rows, extra: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, weights of the extra columns, intercept)."""
    w, v, b = np.zeros(size), np.zeros(extra.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if y.sum() in (0, len(y)):
        return w, v, b
    # About their means, earlier probabilities can't stand in for the intercept.
    mean = extra.mean(axis=0)
    extra = extra - mean
    seen_w, seen_v, seen_b = np.full(size, DAMPING), np.full(len(v), DAMPING), DAMPING
    random, batch = np.random.default_rng(7), max(16, min(BATCH, len(y) // 16))
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            mine = order[at : at + batch]
            part = rows.take(mine)
            wrong = (_logistic(part.dot(w) + extra[mine] @ v + b) - y[mine]) / len(mine)
            g = np.bincount(part.ids, weights=np.repeat(wrong, np.diff(part.ends)), minlength=size)
            seen_w += g * g
            step = RATE / np.sqrt(seen_w)
            met = g != 0
            w[met] -= step[met] * g[met]
            w[met] = np.sign(w[met]) * np.maximum(np.abs(w[met]) - L1 * step[met] * 0.01, 0)
            gv, gb = extra[mine].T @ wrong, float(wrong.sum())
            seen_v += gv * gv
            v -= RATE / np.sqrt(seen_v) * gv
            seen_b += gb * gb
            b -= RATE / np.sqrt(seen_b) * gb
    return w, v, b - float(mean @ v)


class Part:
    """What some of the rows show: the features that tell toxic ones apart, and their groups."""

    def __init__(self, data: _Rows, toxic: np.ndarray, rows: np.ndarray, size: int, groups: int) -> None:
        self.data, self.rows = data, rows
        y, seen, bad = toxic[rows], np.zeros(size, np.int64), np.zeros(size)
        for at, mine in data.pieces(rows):
            seen += np.bincount(mine.ids, minlength=size)
            bad += np.bincount(mine.ids, weights=np.repeat(y[at], np.diff(mine.ends)), minlength=size)
        share = float(y.mean()) if len(y) else 0.0
        # Words that toxic texts have about as often as others only add noise, and go.
        excess = (bad - share * seen) / np.sqrt(seen * share * (1 - share) + 1e-9)
        kept = np.flatnonzero((seen >= MIN_TEXTS) & (np.abs(excess) >= LEAST_EXCESS))
        self.kept = kept[np.lexsort((kept, -np.abs(excess[kept])))][:VOCABULARY]
        self.column = np.full(size, -1, np.int32)
        self.column[self.kept] = np.arange(len(self.kept))
        telling = self.kept[excess[self.kept] > 0][:GROUP_FEATURES]
        self.group = np.full(len(rows), -1)
        of_toxic = np.flatnonzero(y)
        self.group[of_toxic] = grouped(self._dense(rows[of_toxic], telling, seen), groups)
        self.targets = [*[(self.group == k).astype(np.float64) for k in range(groups)], y]

    def _dense(self, rows: np.ndarray, telling: np.ndarray, seen: np.ndarray) -> np.ndarray:
        at = np.full(len(self.column), -1)
        at[telling] = np.arange(len(telling))
        out = np.zeros((len(rows), len(telling)))
        for where, mine in self.data.pieces(rows):
            row, col = np.repeat(np.arange(where.start, where.stop), np.diff(mine.ends)), at[mine.ids]
            out[row[col >= 0], col[col >= 0]] = 1
        out /= np.sqrt(np.maximum(seen[telling], 1))
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    def take(self, rows: np.ndarray) -> _Rows:
        """These rows, of the selected features."""
        found, sizes = [], [np.zeros(1, np.int64)]
        for _, mine in self.data.pieces(rows):
            columns = self.column[mine.ids]
            found.append(columns[columns >= 0])
            sizes.append(np.diff(np.concatenate(([0], np.cumsum(columns >= 0)))[mine.ends]))
        out = _Rows(found)
        out.ends = np.cumsum(np.concatenate(sizes))
        return out

    def number_like(self, other: Part, groups: int) -> None:
        """Number the groups so that most rows have the numbers that ``other`` gives them."""
        theirs = np.full(len(self.data.ends) - 1, -1)
        theirs[other.rows] = other.group
        theirs = theirs[self.rows]
        both = np.array([[np.sum((self.group == a) & (theirs == b)) for b in range(groups)] for a in range(groups)])
        best = max(permutations(range(groups)), key=lambda p: sum(both[a, b] for a, b in enumerate(p)))
        self.group = np.array([*best, -1])[self.group]
        self.targets[:groups] = [(self.group == k).astype(np.float64) for k in range(groups)]


def grouped(points: np.ndarray, groups: int) -> np.ndarray:
    """Group of each row by spherical k-means, larger groups first; -1 for rows of zeros."""
    out = np.full(len(points), -1)
    some = np.flatnonzero(points.any(axis=1))
    if not len(some):
        return out
    mine = points[some]
    centres = mine[[int(np.argmax(mine @ mine.mean(axis=0)))]]
    while len(centres) < groups:  # farthest first
        centres = np.vstack([centres, mine[int(np.argmin((mine @ centres.T).max(axis=1)))]])
    for _ in range(ROUNDS):
        near = np.argmax(mine @ centres.T, axis=1)
        sums = np.array([mine[near == k].sum(axis=0) for k in range(groups)])
        now = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.array_equal(now, centres):
            break
        centres = now
    order = np.argsort(-np.bincount(near, minlength=groups), kind="stable")
    out[some] = np.argsort(order)[near]
    return out


def numbered(features: Iterable[set[str]]) -> tuple[list[str], _Rows]:
    """Names that enough texts have, and the texts as rows of their numbers.

    Sets are taken one by one and not kept: as sets of names, a sample takes over a GB.
    """
    first: dict[str, int] = {}
    rows = [np.array([first.setdefault(name, len(first)) for name in f], np.int32) for f in features]
    counts = np.zeros(len(first), np.int32)
    for row in rows:
        counts[row] += 1
    names = sorted(name for name, i in first.items() if counts[i] >= MIN_TEXTS)
    number = np.full(len(first), -1, np.int32)
    number[[first[name] for name in names]] = np.arange(len(names))
    for i, row in enumerate(rows):
        now = number[row]
        rows[i] = np.sort(now[now >= 0])
    return names, _Rows(rows)


def fit(rows: list[tuple[str, int]], groups: int = GROUPS, overall: str = "toxic") -> Chain:
    """A chain over the groups of toxic rows, then the labelled category."""
    names, data = numbered(text_features(t) for t, _ in rows)
    toxic = np.array([y for _, y in rows], np.float64)
    fold = np.arange(len(rows)) % FOLDS
    whole = Part(data, toxic, np.arange(len(rows)), len(names), groups)
    parts = [Part(data, toxic, np.flatnonzero(fold != f), len(names), groups) for f in range(FOLDS)]
    for part in parts:
        part.number_like(whole, groups)
    before, weights, links, intercepts = np.empty((len(rows), 0)), [], np.zeros((groups + 1, groups + 1)), []
    learnt = whole.take(whole.rows)
    for k in range(groups + 1):
        w, v, b = _regress(learnt, before, whole.targets[k], len(whole.kept))
        weights.append(w)
        links[k, :k] = v
        intercepts.append(b)
        if k < groups:
            before = np.column_stack([before, out_of_fold(parts, fold, before, k)])
    words = {names[i]: at for at, i in enumerate(whole.kept.tolist())}
    return Chain([*[f"{overall}_{k + 1}" for k in range(groups)], overall], words, np.array(weights, np.float32).reshape(groups + 1, len(words)), links, np.array(intercepts))


def out_of_fold(parts: list[Part], fold: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """Probability of category ``k`` of each row, by the part that has not seen it."""
    unseen = np.zeros(len(fold))
    for f, part in enumerate(parts):
        own = np.flatnonzero(fold == f)
        w, v, b = _regress(part.take(part.rows), before[part.rows], part.targets[k], len(part.kept))
        unseen[own] = _logistic(part.take(own).dot(w) + before[own] @ v + b)
    return unseen


class Scorer:
    def __init__(self, chain: Chain) -> None:
        self.chain, self.known = chain, {}

    def of(self, text: str) -> list[float]:
        chain, known = self.chain, self.known
        if len(known) > REMEMBERED:
            known.clear()
        found: set[int] = set()
        for token in set(text.split()):
            ids = known.get(token)
            if ids is None:
                ids = known[token] = tuple(chain.words[n] for n in _names(token) if n in chain.words)
            found.update(ids)
        sums = chain.weights[:, np.fromiter(sorted(found), np.int64, len(found))].sum(axis=1, dtype=np.float64) + chain.intercepts
        made: list[float] = []
        for k in range(len(chain.names)):
            made.append(float(_logistic(sums[k] + chain.links[k, :k] @ np.array(made))))
        return made


def _score(chain: Chain, threshold: float, text_index: int, schema: pa.Schema):
    def run(batches):
        scorer = Scorer(chain)
        for batch in batches:
            made = np.array([scorer.of(t or "") for t in batch.column(text_index).to_pylist()]).reshape(-1, len(chain.names))
            columns = {f"p_{n}": pa.array(made[:, k]) for k, n in enumerate(chain.names)}
            columns["predicted"] = pa.array((made[:, -1] >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(batch.schema.get_field_index(n)) for n in schema.names], schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Chain:
    """Learn ``labels.toxic`` and the groups before it from at most ``limit`` rows."""
    return fit_in_task(sample(docs, labels, F.col("toxic"), limit), fit)


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a probability ``p_<category>`` each, and ``predicted`` 1 where toxic."""
    added = [f"p_{n}" for n in chain.names]
    fields = [f for f in docs.schema.fields if f.name not in (*added, "predicted")]
    docs = docs.select(*[f.name for f in fields])
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in added], T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(fold_rows(_score, chain, threshold, docs.columns.index(text_col), to_arrow_schema(schema)), schema)
