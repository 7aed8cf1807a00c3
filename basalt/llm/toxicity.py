"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

A lexicon of words and word beginnings is learned from one part of a bounded
sample of labelled rows, the trees and the calibration from the other. Features
of a text are densities of lexicon hits (plain, weak, undone obfuscations), how
many lie near a second-person word, how they cluster, capitals, punctuation and
obfuscation rates. Scoring is a narrow pass over the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from basalt.llm import caches

# Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
# Characters written in place of letters.
UNMASK = str.maketrans("013457@$!|€", "oieastasile")

EDGE = re.compile(r"^\W+|\W+$")
MASKED = re.compile(r"[^\W\d_][\d@$!|*€._-]+[^\W\d_]|(.)\1\1")
SQUEEZE = re.compile(r"(.)\1+")
STEMS = (4, 5, 6)
NEAR, WINDOW = 5, 25
FEATURES = ("words", "strong_rate", "strong", "weak_rate", "weak", "near_you", "cluster", "capitals", "shouted", "punctuation", "marks", "masked", "masked_hits", "distinct", "digits")
CACHED_TOKENS = 300_000

#: Rows of labels that training may use, 60 % for the lexicon and 40 % for the trees.
MAX_ROWS = 20_000
MAX_LEXICON = 2_000


def units(token: str) -> list[str]:
    """A token's word and its beginnings (marked ``*``), lower case, outer punctuation off."""
    word = EDGE.sub("", token).lower()
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)] if word else []


@dataclass
class Trees:
    """Boosted depth-limited trees on quantile bins, logistic loss."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, np.ndarray, np.ndarray]]] = field(default_factory=list)
    start: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, smooth: float = 5.0) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                wide = 1 << level
                best = np.full(wide, 1e-9), np.zeros(wide, np.int64), np.full(wide, bins + 1)
                for j in range(b.shape[1]):
                    at = node * (bins + 1) + b[:, j]
                    g, h = (np.bincount(at, w, wide * (bins + 1)).reshape(wide, -1).cumsum(1) for w in (grad, hess))
                    left, right = g[:, :-1] ** 2 / (h[:, :-1] + smooth), (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + smooth)
                    gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + smooth)
                    k = gain.argmax(1)
                    better = gain[np.arange(wide), k] > best[0]
                    for out, new in zip(best, (gain[np.arange(wide), k], np.full(wide, j), k)):
                        out[better] = new[better]
                splits.append(best[1:])
                node = node * 2 + (b[np.arange(len(b)), best[1][node]] > best[2][node])
            g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
            leaf = rate * g / (h + smooth)
            self.trees.append((splits, leaf))
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (x, probability), non-decreasing."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


@dataclass
class Model:
    lexicon: dict[str, int]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps the order inside flat parts."""
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw))


class Tokens(dict):
    """Token -> row of ``stats``: strong, weak, second person, letters, capitals, shouted, punctuation, marks, masked, masked hit, digits, unit."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.stats, self.names = lexicon, np.zeros((CACHED_TOKENS + 1, 12), np.float32), {}

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHED_TOKENS:
            raise OverflowError
        row = len(self)
        self.stats[row] = self.look(token)
        if len(token) <= 64:
            self[token] = row
            return row
        self.stats[CACHED_TOKENS] = self.stats[row]
        raise KeyError(token)

    def look(self, token: str) -> list[float]:
        letters = sum(c.isalpha() for c in token)
        capitals = sum(c.isupper() for c in token)
        own = units(token)
        tier, hit = max(((self.lexicon.get(u, 0), u) for u in own), default=(0, ""))
        masked, undone = bool(MASKED.search(token)), 0
        if masked and not tier:
            plain = token.lower().translate(UNMASK)
            tries = [plain, re.sub(r"[^\w]|_", "", plain), SQUEEZE.sub(r"\1", plain)]
            undone = max(self.lexicon.get(u, 0) for t in tries for u in units(t) or [""])
        word = own[0] if own else ""
        unit = self.names.setdefault(hit, len(self.names)) if tier == 2 else -1
        return [
            tier == 2, tier == 1, word in SECOND_PERSON, letters, capitals, letters > 2 and capitals == letters,
            sum(not c.isalnum() for c in token), token.count("!") + token.count("?"), masked, undone == 2, sum(c.isdigit() for c in token), unit,
        ]


class Featurizer:
    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.tokens = lexicon, Tokens(lexicon)

    def rows(self, text: str) -> np.ndarray:
        words = text.split()
        try:
            at = np.fromiter(map(self.tokens.__getitem__, words), np.int64, len(words))
            return self.tokens.stats[at]
        except (OverflowError, KeyError) as full:
            if isinstance(full, OverflowError):
                self.tokens = Tokens(self.lexicon)
            return np.array([self.tokens.look(w) for w in words], np.float32)

    def of(self, text: str | None) -> np.ndarray:
        s = self.rows(text or "")
        n = len(s)
        if not n:
            return np.zeros(len(FEATURES))
        total = s[:, :11].sum(0, dtype=np.float64)
        near = cluster = distinct = 0
        if total[0]:
            hits = np.concatenate([[0], np.cumsum(s[:, 0])])
            at = np.arange(n)
            cluster = (hits[np.minimum(at + WINDOW, n)] - hits[:-1]).max()
            you = np.concatenate([[0], np.cumsum(s[:, 2])])
            close = you[np.minimum(at + NEAR + 1, n)] - you[np.maximum(at - NEAR, 0)] > 0
            near = float((s[:, 0] * close).sum())
            distinct = len(np.unique(s[s[:, 0] > 0, 11]))
        letters = max(total[3], 1)
        log, per = np.log1p, lambda v: v / n
        return np.array([
            log(n), 100 * per(total[0]), log(total[0]), 100 * per(total[1]), log(total[1]), log(near), cluster, total[4] / letters, per(total[5]),
            total[6] / (letters + total[6]), per(total[7]), per(total[8]), log(total[9]), log(distinct), total[10] / letters,
        ])


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, y, part) of at most ``max_rows`` labelled rows, chosen by a hash of the id.

    Several labels of one id count as toxic if any is; null labels and ids don't count.
    The sample is broadcast: ``max_rows`` bounds it. Equal texts count once.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.max("y").alias("y")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5)))


def learn_lexicon(rows: DataFrame, least_docs: int = 5, weak: float = 8.0, strong: float = 30.0) -> dict[str, int]:
    """Units that toxic texts hold far more often: 2 for strong, 1 for weak, MAX_LEXICON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update({u for t in set(text.split()) for u in units(t)})
                seen[y][" "] += 1
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][u] for u in both], pa.int64()), pa.array([seen[0][u] for u in both], pa.int64())], ["unit", "pos", "neg"])

    counts = rows.select("text", "y").mapInArrow(run, "unit string, pos bigint, neg bigint").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = F.broadcast(counts.where("unit = ' '").select(F.col("pos").alias("p"), F.col("neg").alias("n")))  # one row
    ratio = ((F.col("pos") + 0.5) / (F.col("p") + 1)) / ((F.col("neg") + 0.5) / (F.col("n") + 1))
    kept = counts.where(f"unit <> ' ' AND pos >= {least_docs}").join(top, F.lit(True))
    kept = kept.withColumn("ratio", ratio).where((F.col("ratio") >= weak) & (F.col("pos") * 200 >= F.col("p")))
    best = kept.orderBy(F.desc("ratio"), "unit").limit(MAX_LEXICON).collect()
    return {r["unit"]: 2 if r["ratio"] >= strong else 1 for r in best}


def features(rows: DataFrame, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Featurizer(lexicon)
        for batch in batches:
            x = [look.of(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").orderBy("x").collect()
    return np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float)


def fit(rows: DataFrame) -> Model:
    """From ``labelled`` rows. Without rows of both classes the score is the smoothed share of toxic rows."""
    rows = rows.repartition(16, "text").persist()
    try:
        lexicon = learn_lexicon(rows.where("part < 3"))
        x, y = features(rows.where("part >= 3"), lexicon)
        n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    finally:
        rows.unpersist()
    prior = (toxic + 0.5) / (n + 1)
    if len(np.unique(y)) < 2:
        return Model(lexicon, None, None, float(prior))
    fold = np.arange(len(y)) % 5
    raw = np.zeros(len(y))
    for k in range(5):
        raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return Model(lexicon, Trees().fit(x, y), isotonic(raw, y), float(prior))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1), every other column as it is.

    Null text is empty; the empty text has a score too. Only the text is an input.
    ``docs`` must have no such column yet; rows may repeat and ids be null.
    """
    if score_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {score_col} already: choose another score_col")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("toxicity")
        look = Featurizer(held.value.lexicon)
        for batch in batches:
            x = np.array([look.of(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.probability(x))], [*names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))

