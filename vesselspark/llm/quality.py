"""Quality classifier: EM over the votes of overlapping heuristic labellers, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import free_name, written
from .text import Words, finish, slices, utf8

#: Texts of fewer words are judged by symbols, stutter and emptiness alone: other shares say little there.
FEW_WORDS, ALWAYS = 12, ("symbols", "stutter", "empty")
#: Votes.
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Fixed values: (name, statistic, bad from, good up to); a labeller without a good bound never votes good.
LABELLERS = (
    ("symbols", "symbol_share", 0.06, None),
    ("shouting", "upper_share", 0.5, None),
    ("stutter", "same_share", 0.15, None),
    ("cells", "lone_share", 0.1, None),
    ("loops", "loop_share", 0.4, None),
    ("odd words", "odd_share", 0.35, 0.08),
    ("no sentences", "unsentenced", 0.985, 0.97),
    ("empty", "shortness", 1.0, None),
)
STATS = tuple(stat for _, stat, _, _ in LABELLERS)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b'"#$%&*+/<=>@[\\]^_`{|}~')] = True
SHOUT = np.zeros(256, bool)
SHOUT[0x41:0x5B] = True
LETTER = SHOUT.copy()
LETTER[0x61:0x7B] = LETTER[0x80:] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
ENDING = np.zeros(256, bool)
ENDING[list(b".,;:?!")] = True
#: Slots of hashed features; 64 bins of each statistic are hashed into them too.
SLOTS, BINS = 1 << 12, 64


def shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def repeated(words: Words, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Per document the share of its keys that come again in it."""
    doc = words.doc[where]
    n = len(words.n)
    if not len(keys):
        return np.zeros(n)
    _, back, count = np.unique(keys ^ finish(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    return shares(np.bincount(doc, weights=count[back] > 1, minlength=n), np.bincount(doc, minlength=n))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, len(STATS)) shares between 0 and 1."""
    words = Words(data, offsets)
    n, n_docs = words.n, len(words.n)
    if not len(words.start):
        return np.tile(np.array([0.0] * (len(STATS) - 2) + [1.0, 1.0]), (n_docs, 1))

    def total(flags: np.ndarray) -> np.ndarray:
        """How many bytes of each word have the flag."""
        up_to = np.cumsum(flags.view(np.uint8), dtype=np.int64)
        return up_to[words.end - 1] - np.where(words.start > 0, up_to[words.start - 1], 0)

    per_doc = lambda values: np.bincount(words.doc, weights=values, minlength=n_docs)
    size = words.end - words.start
    symbols, shout, letters, digits, endings = (total(t[data]) for t in (SYMBOLS, SHOUT, LETTER, DIGIT, ENDING))
    final = ENDING[data[words.end - 1]]
    hashes = words.hashes()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    odd = (letters + final < size) & (digits < size) | (endings > 1) | same
    where, loops = words.windows(hashes, 8)
    return np.stack(
        [
            shares(per_doc(symbols), per_doc(size)),
            shares(per_doc(shout), per_doc(letters)),
            shares(per_doc(same), n),
            shares(per_doc(letters + digits == 0), n),
            repeated(words, loops, where),
            shares(per_doc(odd), n),
            1 - shares(per_doc(final), n),
            np.exp(-n / 4),
        ],
        1,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    out = np.full(stats.shape, ABSTAIN, np.int8)
    short = stats[:, STATS.index("shortness")] > np.exp(-FEW_WORDS / 4)
    for k, (name, _, bad, good) in enumerate(LABELLERS):
        if good is not None:
            out[stats[:, k] <= good, k] = GOOD
        out[(stats[:, k] >= bad) & (~short | (name in ALWAYS)), k] = BAD
    return out


@dataclass
class LabelModel:
    """P(good) and P(vote | class), class 0 bad and 1 good; tables (labeller, class, vote)."""

    good: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of votes."""
        logs = np.log(self.table)
        log_odds = np.log(self.good) - np.log1p(-self.good)
        log_odds = log_odds + sum(logs[k, 1, patterns[:, k]] - logs[k, 0, patterns[:, k]] for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM over vote patterns with their counts. It starts from a belief that fixes which class is which: a bad vote is rare on good texts."""
    m = patterns.shape[1]
    start = np.tile(np.array([[0.55, 0.40, 0.05], [0.38, 0.02, 0.60]]), (m, 1, 1))
    model = LabelModel(0.85, start)
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack([(1 - p) * counts, p * counts])
        table = np.stack([[np.bincount(patterns[:, k], weights=w, minlength=3) for w in weight] for k in range(m)]) + start
        table /= table.sum(2, keepdims=True)
        good = float((weight[1].sum() + 8.5) / (counts.sum() + 10))
        if np.abs(table - model.table).max() < 1e-9:
            break
        model = LabelModel(good, table)
    return model


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of the byte trigram at each place, whether it lies in one document); two places fewer than bytes."""
    number = data[:-2].astype(np.uint32) << 16
    number |= data[1:-1].astype(np.uint32) << 8
    number |= data[2:]
    inside = np.ones(len(number), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return number * np.uint32(2654435761) >> np.uint32(32 - 12), inside


def bins_of(stats: np.ndarray) -> np.ndarray:
    """The slot of each statistic's bin; bins are finer towards 0."""
    bins = np.minimum(np.sqrt(stats) * BINS, BINS - 1).astype(np.uint64)
    return (finish(bins + np.arange(stats.shape[1], dtype=np.uint64) * np.uint64(1000)) % np.uint64(SLOTS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense (documents, SLOTS) rows: trigram shares, and 1 for each statistic's bin."""
    n = len(offsets) - 1
    slot, inside = slots_of(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(offsets))[: len(slot)]
    x = np.bincount((doc * SLOTS + slot)[inside], minlength=n * SLOTS).reshape(n, SLOTS).astype(np.float32)
    x *= 4 / np.maximum(x.sum(1, keepdims=True), 1)
    np.add.at(x, (np.arange(n)[:, None], bins_of(statistics(data, offsets))), 1)
    return x


def scores(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """What the dense rows would score, without making them."""
    slot, inside = slots_of(data, offsets)
    value = weights[slot]
    value[~inside] = 0
    whole, total = np.diff(offsets), np.zeros(len(offsets) - 1)
    some = np.flatnonzero(whole > 2)
    if len(some):
        total[some] = np.add.reduceat(value, offsets[some])
    z = bias + 4 * shares(total, np.maximum(whole - 2, 0)) + weights[bins_of(stats)].sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_scorer(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch gradient steps with momentum, all in single precision: a mixed product would copy x each time."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    dw, db = np.zeros_like(w), np.float32(0)
    x, target, weight = x.astype(np.float32, copy=False), target.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    rate, decay, keep = np.float32(rate), np.float32(decay), np.float32(0.9)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - target) * weight
        dw = keep * dw - rate * (x.T @ error + decay * w)
        db = keep * db - rate * error.sum()
        w, b = w + dw, b + db
    return w, float(b)


def classify_quality(docs: DataFrame, threshold: float = 0.5, per_class: int = 1500, text_col: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Every row of docs (columns `carry`, else all) with score (P(good) by the scorer), posterior (by the label model) and keep, their names after `prefix`; columns of docs by such names are left out.

    The labellers vote on every whole text; EM runs on the counts of vote patterns over all rows (at most 3 to the
    number of labellers, whatever the table's size). The scorer is fitted on a bounded sample: of each side of
    posterior 0.5 the per_class different texts that hash lowest, weighted back to the side's share; each text counts with
    all its trigrams. It then scores every row. Ids play no part, so null or repeated ones change nothing; equal texts score
    alike and are one text of the sample. Null counts as empty, which one
    labeller holds against a text. Rows stand alone otherwise. If all posteriors lie on one side the scorer is fitted on that side alone;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    added = [prefix + c for c in ("score", "posterior", "keep")]
    carry = [c for c in carry or docs.columns if c.lower() not in added]
    text_name = free_name(carry, "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pattern = votes(statistics(*utf8(batch.column("text")))) @ (3 ** np.arange(len(STATS)))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(pattern, pa.int32())], names=["hash", "pattern"])

    texts = docs.select(F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("hash"), docs[text_col].alias("text"))
    cast = written(texts.mapInArrow(vote, "hash long, pattern int"), "votes")
    counts = cast.groupBy("pattern").count().toPandas()
    if counts.empty:
        return docs.select(*carry, *(x.alias(c) for x, c in zip((F.lit(0.0), F.lit(0.0), F.lit(True)), added, strict=True)))
    patterns = counts["pattern"].to_numpy()[:, None] // 3 ** np.arange(len(STATS)) % 3
    model = fit_label_model(patterns, counts["count"].to_numpy(float))
    belief = dict(zip(counts["pattern"].tolist(), model.posterior(patterns).tolist(), strict=True))

    # the bounded sample: patterns are few, so each side is a filter on the vote table
    chosen, shares_of = [], []
    for side in (False, True):
        own = [p for p, b in belief.items() if (b >= 0.5) == side]
        if own:
            chosen.append(cast.filter(F.col("pattern").isin(own)).distinct().orderBy("hash").limit(per_class))
            shares_of.append((side, float(counts["count"][counts["pattern"].isin(own)].sum())))
    picked = written(chosen[0] if len(chosen) == 1 else chosen[0].union(chosen[1]), "sample")
    rows = texts.join(F.broadcast(picked), "hash")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a text that comes often is described once a task
        for batch in slices(batches, "text"):
            new = []
            for k, h in enumerate(batch.column("hash").to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            x = features(*utf8(batch.column("text")))
            at = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("pattern"), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(x, at, strict=True)], pa.binary())], names=["hash", "pattern", "slots", "parts"])

    described = rows.select("hash", "pattern", "text").mapInArrow(describe, "hash long, pattern int, slots binary, parts binary")
    found = described.groupBy("hash").agg(F.any_value("pattern").alias("pattern"), F.min(F.struct("slots", "parts")).alias("x")).select("pattern", "x.slots", "x.parts").collect()
    x = np.zeros((max(len(found), 1), SLOTS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["slots"], np.int32)] = np.frombuffer(r["parts"], np.float32)
    target = np.array([belief[r["pattern"]] for r in found] or [1.0])
    weight = np.ones(len(target))
    for side, n in shares_of:
        # half of the evidence from each side's own share keeps a rare side from being drowned
        weight[(target >= 0.5) == side] = np.sqrt(n) / max(((target >= 0.5) == side).sum(), 1)
    w, b = fit_scorer(x, target, weight)
    sent = spark.sparkContext.broadcast((w.astype(np.float64), b, belief))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, belief = sent.value
        for batch in slices(batches, text_name):
            data, offsets = utf8(batch.column(text_name))
            stats = statistics(data, offsets)
            z = scores(data, offsets, stats, w, b)
            pattern = votes(stats) @ (3 ** np.arange(len(STATS)))
            post = np.array([belief.get(p, 0.5) for p in pattern.tolist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(z), pa.array(post, pa.float64()), pa.array(z >= threshold)], names=[*carry, *added])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*carry).dtypes) + f", `{added[0]}` double, `{added[1]}` double, `{added[2]}` boolean"
    return docs.select(*carry, docs[text_col].alias(text_name)).mapInArrow(score, schema)
