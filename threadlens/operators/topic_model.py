"""Online variational topic model whose updates read one chunk of the corpus each.

The corpus is written once, a folder a chunk. An update reads its folder only: every task infers the topic shares
of its texts with the current model and adds up what they say about words, Spark sums these rows by word, and
the driver, which holds topics x vocabulary numbers anyway, blends the sum into the model. So passes over N texts
read passes x N rows, whatever the chunk size.

Bags are arrays of (term_id, cnt). The vocabulary's ``keep_n`` bounds what the driver and the tasks hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.runtime import drop_path, fresh_path

BAG = "array<struct<term_id:int,cnt:bigint>>"
# Steps and mean change at which a text's shares are settled, and how fast later chunks lose weight.
STEPS, SETTLED = 50, 1e-3
OFFSET, DECAY = 1.0, 0.5
#: Texts of a chunk that one file holds about; words of texts inferred at once. Files are the least that a task reads, so
#: a chunk of some ten thousand texts is work for as many tasks as there are cores.
FILE_TEXTS, TOGETHER = 2_000, 200_000


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for x above 0."""
    y = x + 6
    shifted = sum(1 / (x + i) for i in range(6))
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - shifted


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    shifted = sum(1 / (x + i) ** 2 for i in range(6))
    return 1 / y + 1 / (2 * y**2) + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7) - 1 / (30 * y**9) + shifted


def expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet rows."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True)))


def infer(lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, words: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Dirichlet weights of every text's topics; a text stops when it is settled, whatever texts are beside it.

    ``words`` is terms x topics. Texts without a term keep the prior.
    """
    shares = np.tile(prior, (len(lengths), 1))
    live = np.flatnonzero(lengths)
    starts = np.cumsum(lengths) - lengths
    shares[live] = 1.0
    held = None
    for _ in range(STEPS):
        if not len(live):
            break
        if held is None or len(live) < 0.75 * len(held):
            held = live
            size = lengths[held]
            first = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(starts[held] - first, size)
            text, word, weight = np.repeat(np.arange(len(held)), size), words[terms[at]], counts[at]
        topics = expected(shares[held])
        norm = np.einsum("ij,ij->i", topics[text], word) + 1e-100
        found = prior + topics * np.add.reduceat((weight / norm)[:, None] * word, first, axis=0)
        moving = np.isin(held, live, assume_unique=True)
        change = np.abs(found - shares[held]).mean(axis=1)
        shares[held[moving]] = found[moving]
        live = held[moving & (change > SETTLED)]
    return shares


def bag_column(terms: Sequence[str], tokens: str | Column = "tokens") -> Column:
    """Sorted (term_id, cnt) of a token column, looked up inside each task; null tokens give an empty bag."""
    known = pa.array(list(terms), pa.string())

    def count(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
        owner = pc.list_parent_indices(lists).to_numpy()
        ids = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), -1).to_numpy()
        keep = ids >= 0
        pairs, counts = np.unique(owner[keep].astype(np.int64) * max(1, len(known)) + ids[keep], return_counts=True)
        texts, term = np.divmod(pairs, max(1, len(known)))
        ends = np.searchsorted(texts, np.arange(len(lists) + 1)).astype(np.int32)
        entry = pa.StructArray.from_arrays([pa.array(term.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["term_id", "cnt"])
        return pa.ListArray.from_arrays(pa.array(ends), entry)

    return F.arrow_udf(count, BAG)(tokens)


def _rows(bags: pa.Array):
    """Slices of bags as (lengths, terms, counts), of about TOGETHER entries each."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(bags), 0).to_numpy())])
    entries = bags.flatten()
    terms, counts = entries.field("term_id").to_numpy(), entries.field("cnt").to_numpy().astype(float)
    at = 0
    while at < len(bags):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER, side="right")) - 1)
        yield np.diff(ends[at : to + 1]), terms[ends[at] : ends[to]], counts[ends[at] : ends[to]]
        at = to


class TopicModel:
    """Word weights (topics x terms) and the prior of the topics."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray):
        self.weights, self.prior = weights, prior

    @property
    def num_topics(self) -> int:
        return self.weights.shape[0]

    @property
    def num_terms(self) -> int:
        return self.weights.shape[1]

    def word_shares(self) -> np.ndarray:
        """Probability of every word in every topic."""
        return self.weights / self.weights.sum(axis=1, keepdims=True)

    def topic_shares(self, bag: str | Column = "bag") -> Column:
        """Share of every topic in a text, by topic; a text without a known word has the normalised prior."""
        words, prior = expected(self.weights).T.copy(), self.prior

        def shares(bags: pa.Array) -> pa.Array:
            parts = [infer(n, t, c, words, prior) for n, t, c in _rows(bags)]
            found = np.concatenate(parts) if parts else np.zeros((0, len(prior)))
            found /= found.sum(axis=1, keepdims=True)
            ends = np.arange(0, found.size + 1, len(prior), dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        return F.arrow_udf(shares, "array<double>")(bag)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(a), w.tolist()) for i, (a, w) in enumerate(zip(self.prior, self.weights, strict=True))]
        spark.createDataFrame(rows, "topic_id int, prior double, weights array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        rows = spark.read.parquet(path).orderBy("topic_id").collect()  # one row a topic
        return cls(np.array([r.weights for r in rows]), np.array([r.prior for r in rows]))


def learned_prior(prior: np.ndarray, mean_log: np.ndarray, texts: int, rate: float) -> np.ndarray:
    """One Newton step towards the prior under which the texts' mean log shares are likeliest, halved until it stays positive."""
    total = prior.sum()
    slope = texts * (digamma(np.array(total)) - digamma(prior) + mean_log)
    own, common = -texts * trigamma(prior), texts * trigamma(np.array(total))
    shift = (slope / own).sum() / (1 / common + (1 / own).sum())
    step = rate * (slope - shift) / own
    while (step >= prior).any():
        step = step / 2
    return prior - step


def train(
    vectors: DataFrame,
    num_topics: int,
    passes: int,
    chunk_size: float,
    num_terms: int | None = None,
    learn_alpha: bool = True,
    alpha: float | Sequence[float] | None = None,
    online: bool = True,
    seed: int = 0,
) -> TopicModel:
    """Fit over the ``bag`` column of ``vectors``; see ``topics.train_topics``."""
    spark = vectors.sparkSession
    texts = vectors.count()
    if not texts:
        raise ValueError("no texts to train on")
    rows = max(1, math.ceil(texts * chunk_size)) if chunk_size < 1 else chunk_size
    chunks = math.ceil(texts / rows) if online else 1

    # dealt by row, not by text, so that equal texts spread; written once, so that no later run numbers rows anew
    path = fresh_path(spark, "chunks")
    dealt = vectors.select("bag", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("_deal"))
    dealt = dealt.select("bag", F.pmod("_deal", F.lit(chunks)).alias("chunk"), F.pmod(F.expr(f"_deal div {chunks}"), F.lit(math.ceil(rows / FILE_TEXTS))).alias("_file"))
    dealt.repartition("chunk", "_file").drop("_file").write.partitionBy("chunk").parquet(path)
    stored = spark.read.parquet(path)
    sizes = {r["chunk"]: r["count"] for r in stored.groupBy("chunk").count().collect()}
    if num_terms is None:
        num_terms = 1 + (stored.agg(F.max(F.expr("try_element_at(bag, -1).term_id"))).first()[0] or 0)

    prior = np.full(num_topics, 1 / num_topics) if alpha is None else np.broadcast_to(np.array(alpha, dtype=float), num_topics).copy()
    weights = np.random.default_rng(seed).gamma(100, 0.01, (num_topics, num_terms))
    done = 0
    for turn in range(passes):
        for chunk in sorted(sizes):
            words, logs = _statistics(spark, f"{path}/chunk={chunk}", expected(weights).T.copy(), prior)
            rate = (OFFSET + turn + done) ** -DECAY if online else 1.0
            weights = (1 - rate) * weights + rate * (1 / num_topics + texts / sizes[chunk] * words)
            if learn_alpha:
                prior = learned_prior(prior, logs / sizes[chunk], sizes[chunk], rate)
            done += 1
    drop_path(spark, path)
    return TopicModel(weights, prior)


def _statistics(spark: SparkSession, path: str, words: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected word counts (topics x terms) and summed log shares of one chunk: one row a word that occurs."""
    topics = len(prior)
    names = [f"t{i}" for i in range(topics)]
    sent = spark.sparkContext.broadcast((words, prior))

    def step(batches):
        words, prior = sent.value
        sums, logs = np.zeros(words.shape), np.zeros(len(prior))
        for batch in batches:
            for lengths, terms, counts in _rows(batch.column(0)):
                shares = infer(lengths, terms, counts, words, prior)
                logs += (digamma(shares) - digamma(shares.sum(axis=1, keepdims=True))).sum(axis=0)
                topic, word = expected(shares)[np.repeat(np.arange(len(lengths)), lengths)], words[terms]
                part = topic * word * (counts / (np.einsum("ij,ij->i", topic, word) + 1e-100))[:, None]
                for t in range(len(prior)):
                    sums[:, t] += np.bincount(terms, part[:, t], minlength=len(sums))
        seen = np.flatnonzero(sums.any(axis=1))
        columns = np.vstack([logs, sums[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], seen]).astype(np.int32)), *(pa.array(columns[:, t].copy()) for t in range(len(prior)))], names=["term_id", *names])

    rows = spark.read.schema(f"bag {BAG}").parquet(path).mapInArrow(step, "term_id int, " + ", ".join(f"{n} double" for n in names))
    found = rows.groupBy("term_id").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sent.destroy()
    ids, values = found["term_id"].to_numpy(), np.stack([found[n].to_numpy() for n in names], axis=1)
    sums = np.zeros(words.shape)
    sums[ids[ids >= 0]] = values[ids >= 0]
    return sums.T, values[ids < 0].sum(axis=0)
