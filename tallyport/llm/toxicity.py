"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A sample of labelled rows, bounded by max_rows, is drawn by hash. One part in five of it is set aside for calibration.
2. Lexicon: words, and word beginnings of four, five and seven characters, with the highest smoothed log-odds of standing in a toxic
   document of the fitting part; beginnings also catch inflected and joined forms. Bounded by lexicon_size.
3. Features of a text: densities and counts of lexicon hits, hits near second-person words, share of capitals, of exclamation
   and other marks, of masked words (letters with signs or digits between), repeated letters, lengths.
4. Boosted trees on the logistic loss over binned features; pool-adjacent-violators on the set-aside part maps raw scores to
   probabilities, kept strictly increasing by a small share of the raw probability.
5. Scoring reads each whole text once, in Arrow batches; words are told apart in Arrow and looked up once a batch.

Language, source, ids and labels are not features. Fitted on the driver from max_rows rows of some twenty numbers: one text an id.

Defined results: null and empty texts have all features zero and get the model's score of that; without labelled rows of both
classes every score is the share of toxic rows (0 without any); repeated rows are scored each by itself; repeated labels of a
document count as toxic if one does; unlike texts of one id are scored each by itself, the one of the smallest hash is learned from; a null id
is held out, its text scored; very long texts are read whole, in slices of some MB of a batch; ties of scores stay ties; other columns are left
out; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, groups, spread, text_column

MAX_ROWS, LEXICON_SIZE, FOLDS = 20_000, 512, 5
#: Second-person words of the four languages.
SECOND_PERSON = ["dein", "deine", "dich", "dir", "du", "euch", "ihr", "te", "ti", "toi", "ton", "tu", "tus", "tú", "u", "usted", "vos", "votre", "vous", "you", "your", "yours", "yourself"]
NEAR = 3
FEATURES = ["hits", "hit_share", "distinct_hits", "weight", "weight_share", "max_weight", "near_second", "second_share", "capital_share", "capital_words", "exclamations", "questions", "marks", "masked_share", "repeated_letters", "log_words", "mean_length", "digit_share"]


class Lexicon:
    """Weights of words and of word beginnings; a word's weight is the largest that it matches."""

    MARKS = "".join(chr(c) for c in range(33, 48)) + ":;<=>?@[\\]^_`{|}~"

    def __init__(self, weights: dict[str, float]):
        self.weights, self.second = weights, set(SECOND_PERSON)

    @classmethod
    def keys(cls, word: str) -> list[str]:
        w = word.strip(cls.MARKS).lower()
        return [w] + [f"{w[:n]}*" for n in (4, 5, 7) if len(w) > n] if len(w) > 2 else []

    def weight(self, word: str) -> float:
        return max((self.weights.get(k, 0.0) for k in self.keys(word)), default=0.0)

    def table(self, words: list[str]) -> np.ndarray:
        """(n, 8): weight, second person, characters, capitals, all capitals, masked, repeated letters, digits."""
        out = np.zeros((len(words), 8))
        for i, w in enumerate(words):
            core = w.strip(self.MARKS)
            inner = core and not core.isalpha()
            upper = sum(map(str.isupper, w)) if not w.islower() else 0
            out[i] = (
                self.weight(w),
                core.lower() in self.second,
                len(w),
                upper,
                len(core) > 2 and core.isupper(),
                bool(inner) and any(map(str.isalpha, core)) and any(c in "*#@$%!013457" for c in core),
                any(a == b == c for a, b, c in zip(core, core[1:], core[2:], strict=False)),
                sum(map(str.isdigit, w)) if inner else 0,
            )
        return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    texts = pc.fill_null(texts, "")
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in groups(texts):
        part = texts.slice(lo, hi - lo)
        words = pc.ascii_split_whitespace(part)
        at = words.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        facts = lexicon.table(names) if names else np.zeros((0, 8))
        place = coded.indices.to_numpy()
        per = facts[place]
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        total = lambda x: np.bincount(doc, x, minlength=hi - lo)
        n = np.maximum(total((per[:, 2] > 0).astype(float)), 1)
        chars = np.maximum(total(per[:, 2]), 1)
        hit = per[:, 0] > 0
        spots = np.flatnonzero(hit)
        second = np.concatenate([[0], np.cumsum(per[:, 1])])
        a, b = np.maximum(spots - NEAR, at[doc[spots]]), np.minimum(spots + NEAR + 1, at[doc[spots] + 1])
        near = np.bincount(doc[spots], second[b] - second[a] > 0, minlength=hi - lo)
        best = np.zeros(hi - lo)
        np.maximum.at(best, doc[spots], per[spots, 0])
        pairs = np.unique(doc[spots] * (len(names) + 1) + place[spots])
        distinct = np.bincount(pairs // (len(names) + 1), minlength=hi - lo)
        count = lambda pattern: pc.count_substring(part, pattern).to_numpy(zero_copy_only=False).astype(float)
        hits, weight = total(hit.astype(float)), total(per[:, 0])
        out[lo:hi] = np.stack(
            [
                hits, hits / n, distinct, weight, weight / n, best, near, total(per[:, 1]) / n, total(per[:, 3]) / chars, total(per[:, 4]) / n,
                count("!") / n, count("?") / n, sum(count(c) for c in "*#@$%&") / n, total(per[:, 5]) / n, total(per[:, 6]) / n, np.log(n), chars / n, total(per[:, 7]) / chars,
            ],
            axis=1,
        )
    return out


class BoostedTrees:
    """Logistic gradient boosting; trees split bins of feature quantiles, level by level."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            node, feature, cut = self._grow(b, y - p, p * (1 - p))
            grad, hess = np.bincount(node, y - p, 1 << self.depth), np.bincount(node, p * (1 - p), 1 << self.depth)
            leaf = self.rate * grad / (hess + self.ridge)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]
        return self

    def _grow(self, b, g, h):
        """(leaf of each row, feature and bin of each inner node, in heap order)."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, int), np.full(inner, self.bins)
        node = np.zeros(len(b), int)
        for level in range(self.depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            for f in range(b.shape[1]):
                key = node * self.bins + b[:, f]
                gs, hs = (np.cumsum(np.bincount(key, v, width * self.bins).reshape(width, self.bins), axis=1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best).tolist():
                    best[k] = top[k]
                    feature[width - 1 + k], cut[width - 1 + k] = f, at[k]
            own = width - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[own]] > cut[own])
        return node, feature, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                own = (1 << level) - 1 + node
                node = 2 * node + (b[rows, feature[own]] > cut[own])
            score += leaf[node]
        return score


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (raw scores, rising means) of the blocks' ends."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first, last
    for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        if blocks and x == blocks[-1][3]:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    return x, np.repeat([b[0] / b[1] for b in blocks], 2)


class ToxicityModel:
    SHARE = 0.02  # of the raw probability in a score: keeps order where the isotonic map is level

    def __init__(self, lexicon: Lexicon, trees: BoostedTrees | None, steps: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.trees, self.steps, self.prior = lexicon, trees, steps, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(features(texts, self.lexicon))
        level = np.interp(raw, *self.steps) if len(self.steps[0]) else 1 / (1 + np.exp(-raw))
        return np.clip((1 - self.SHARE) * level + self.SHARE / (1 + np.exp(-raw)), 0, 1)


def _key_counts(batches):
    """Rows (key, toxic documents, documents) of a batch of labelled texts."""
    for batch in batches:
        every, toxic = {}, {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for k in {k for w in set((text or "").split()) for k in Lexicon.keys(w)}:
                every[k] = every.get(k, 0) + 1
                if y:
                    toxic[k] = toxic.get(k, 0) + 1
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic.get(k, 0) for k in names], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["key", "toxic", "n"])


def held_out(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lexicon_size: int = LEXICON_SIZE) -> ToxicityModel:
    """docs: (doc_id, text). labels: (doc_id, toxic), rows that may be learned from.

    At most max_rows rows are learned from: one text an id, the one with the smallest hash where an id has several.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit(7), F.col("doc_id"))
    # at most max_rows rows of two numbers
    sample = labels.withColumn("draw", draw).orderBy("draw", "doc_id").limit(max_rows)
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    ws = Workspace(docs.sparkSession)
    rows = ws.save(one.select("doc_id", "text", "toxic", (F.pmod(F.col("draw"), F.lit(5)) == 0).alias("aside")), "sample")
    try:
        prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        fitting = rows.where(~F.col("aside"))
        total = fitting.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
        if not prior or not total["toxic"] or total["toxic"] == total["n"]:
            return ToxicityModel(Lexicon({}), None, None, float(prior or 0))
        counts = fitting.select("text", "toxic").mapInArrow(_key_counts, "key string, toxic long, n long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        clean = total["n"] - total["toxic"]
        odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (clean + 1.0))
        least = max(2, round(0.002 * total["toxic"]))
        ranked = counts.where(F.col("toxic") >= least).withColumn("weight", odds).where("weight > 2").orderBy((F.col("weight") * F.sqrt(F.col("toxic").cast("double"))).desc(), "key").limit(lexicon_size)
        lexicon = Lexicon({r["key"]: float(r["weight"]) for r in ranked.collect()})
        kinds = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

        def run(batches):
            for batch in batches:
                x = features(batch.column("text"), lexicon)
                columns = [batch.column("doc_id"), batch.column("toxic"), batch.column("aside"), *map(pa.array, x.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "aside", *[f"f{i}" for i in range(len(FEATURES))]])

        id_kind, label_kind = dict(rows.dtypes)["doc_id"], dict(rows.dtypes)["toxic"]
        found = rows.select("doc_id", "text", "toxic", "aside").mapInArrow(run, f"doc_id {id_kind}, toxic {label_kind}, aside boolean, {kinds}").toPandas()
    finally:
        ws.close()
    found = found.sort_values(["doc_id", *[f"f{i}" for i in range(len(FEATURES))]])
    x, y, aside = found.iloc[:, 3:].to_numpy(float), found["toxic"].to_numpy(float), found["aside"].to_numpy(bool)
    trees = BoostedTrees().fit(x[~aside], y[~aside])
    return ToxicityModel(lexicon, trees, isotonic(trees.raw(x[aside]), y[aside]), float(prior))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each document; held-out documents' labels are not read."""
    narrow = text_column(docs, id_col, text_col)
    known = labels.select(F.col("doc_id"), F.col("toxic")).where(~held_out(F.col("doc_id")))
    model = fit(narrow, known, max_rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")))], names=["doc_id", "score"])

    scored = spread(narrow, "doc_id").mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
