"""LM scoring: a log-bilinear neural model over word classes, with corpus counts for the words of the open class.

Tokens are words (A-Z lower-cased) and one end per text. The most frequent tokens are classes of their own, and
their number grows with the corpus (``class_count``); all others share one open class. The log-bilinear model
predicts a class from the two before it: the vectors of the context, each through its position's matrix, add up to
a predicted vector, whose product with a class vector plus a bias is the class's score. Training is
noise-contrastive estimation in numpy: a start on a sample, then ``PASSES`` passes over the windows of **all**
training documents. In a pass every task goes on from the same weights over its own windows, and the results are
averaged by what each task has seen. Scores are normalised over all classes for every context, by batched matrix
products. A word of the open class adds its add-one share of that class. Token counts, N, V and the shares come
from all training documents as well.

Counting and scoring read the text once. Each task turns slices of documents into a list of distinct words and
numbers; words meet their corpus counts by a join on the word, one row per slice and word, and the counts
go back to their slice. So a frequent word costs a row per slice, not per occurrence.

Defined results: null text counts as empty (one end token); without training documents all counts are 0 and the
model is uniform over classes; repeated rows are scored and counted as often as they come. Other columns are not
read, so they may clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import parts
from threadlens.runtime import snapshot

#: Fewest classes; vector width. ``class_count`` gives the classes of a corpus.
CLASSES, WIDTH = 512, 24
#: Up to so many classes the normalisers of all contexts are one table; beyond, each slice makes those it needs.
TABLE_CLASSES = 1024
#: Documents and epochs of the start, passes over all training documents.
SAMPLE_DOCS, EPOCHS, PASSES, BATCH, NOISE, RATE = 2000, 2, 1, 2048, 128, 0.05
SLICE_CHARS = 6_000_000
#: No word has white space in it, so this names the end token.
END = " "
OPEN, LN10 = 0, float(np.log(10))


def class_count(n: int) -> int:
    """Classes for ``n`` training tokens: twice the cube root, ``CLASSES`` at least (16 bits hold a class)."""
    return min(max(CLASSES, int(2 * round(n ** (1 / 3)))), 1 << 16)


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END.encode()]


def slices(docs: DataFrame, held: Column, text: str, key: str) -> DataFrame:
    """One row per slice of documents: keys, held, lengths, token numbers (packed), words and their training counts."""
    rows = docs.select(F.col(key).cast("string").alias("_key"), F.coalesce(held, F.lit(False)).alias("_held"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        for piece, texts in parts(batches, "_text", SLICE_CHARS):
            numbers: dict[bytes, int] = {}
            lengths, found = [], []
            for text_ in texts:
                words = tokens(text_)
                lengths.append(len(words))
                found += [numbers.setdefault(w, len(numbers)) for w in words]
            ids = np.array(found, dtype=np.int32)
            trained = ~np.repeat(np.array(piece.column(1).to_pylist(), dtype=bool), lengths)
            counts = np.bincount(ids[trained], minlength=len(numbers))
            packed = pa.compress(ids.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([base + count], pa.int64()),
                    "keys": pa.array([piece.column(0).to_pylist()], pa.list_(pa.string())),
                    "held": pa.array([piece.column(1).to_pylist()], pa.list_(pa.bool_())),
                    "lengths": pa.array([lengths], pa.list_(pa.int32())),
                    "ids": pa.array([packed], pa.binary()),
                    "words": pa.array([[w.decode("utf-8", "surrogatepass") for w in numbers]], pa.list_(pa.string())),
                    "counts": pa.array([counts], pa.list_(pa.int64())),
                }
            )
            count += 1

    return rows.mapInArrow(run, "slice long, keys array<string>, held array<boolean>, lengths array<int>, ids binary, words array<string>, counts array<long>")


@dataclass
class Model:
    """Log-bilinear weights, and what the open class needs."""

    context: np.ndarray  # class vectors as context
    first: np.ndarray  # matrix of the token before
    second: np.ndarray  # matrix of the one before that
    target: np.ndarray  # class vectors as prediction
    bias: np.ndarray

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class scores by each context position (rows: context class), and the log normaliser of every context."""
        near, far = self.context @ self.first @ self.target.T + self.bias, self.context @ self.second @ self.target.T
        n = len(near)
        total = np.empty((n, n), dtype=np.float32)
        for i in range(n):  # all contexts with the class i before
            both = near[i] + far
            top = both.max(axis=1)
            total[i] = top + np.log(np.exp(both - top[:, None]).sum(axis=1))
        return near.astype(np.float32), far.astype(np.float32), total

    def log_p(self, near: np.ndarray, far: np.ndarray, next_: np.ndarray) -> np.ndarray:
        """Log probability of each next class, normalised over all classes; each distinct context is normalised once."""
        v_near, v_far, target, bias = ((x).astype(np.float32) for x in (self.context @ self.first, self.context @ self.second, self.target, self.bias))
        n = len(target)
        pairs, of = np.unique(near * n + far, return_inverse=True)
        total = np.empty(len(pairs))
        step = max(1, 4_000_000 // n)
        for i in range(0, len(pairs), step):
            some = pairs[i : i + step]
            both = (v_near[some // n] + v_far[some % n]) @ target.T
            both += bias
            top = both.max(axis=1)
            both -= top[:, None]
            total[i : i + step] = top + np.log(np.exp(both, out=both).sum(axis=1))
        out = bias[next_] - total[of]
        for i in range(0, len(next_), 200_000):
            at = slice(i, i + 200_000)
            out[at] += np.einsum("ij,ij->i", v_near[near[at]] + v_far[far[at]], target[next_[at]])
        return out


def start_weights(n: int, unigram: np.ndarray, width: int = WIDTH, seed: int = 5) -> Model:
    """Small vectors, and biases at the classes' own shares."""
    random = np.random.default_rng(seed)
    small = lambda *shape: random.normal(scale=0.1, size=shape)
    return Model(small(n, width), np.eye(width) + small(width, width), np.eye(width) + small(width, width), small(n, width), np.log(unigram))


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to the same of ``n`` places."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), weights=rows.ravel(), minlength=n * width).reshape(n, width)


def descend(weights: list[np.ndarray], speed: list[np.ndarray], ids: np.ndarray, unigram: np.ndarray, random: np.random.Generator) -> None:
    """One epoch of noise-contrastive estimation over windows (far, near, next), in place; noise is the unigram share."""
    context, first, second, target, bias = weights
    n, log_noise, cumulative = len(unigram), np.log(NOISE * unigram).astype(bias.dtype), np.cumsum(unigram)
    order = random.permutation(len(ids))
    for start in range(0, len(order), BATCH):
        far, near, true = ids[order[start : start + BATCH]].T
        size = len(true)
        noise = np.minimum(np.searchsorted(cumulative, random.random(NOISE)), n - 1)
        v_near, v_far = context[near], context[far]
        predicted = v_near @ first + v_far @ second
        real = (predicted * target[true]).sum(axis=1) + bias[true] - log_noise[true]
        fake = predicted @ target[noise].T + (bias[noise] - log_noise[noise])
        d_real = (1 / (1 + np.exp(-np.clip(real, -30, 30))) - 1) / size
        d_fake = 1 / (1 + np.exp(-np.clip(fake, -30, 30))) / size
        d_predicted = d_real[:, None] * target[true] + d_fake @ target[noise]
        slopes = [
            _added(near, d_predicted @ first.T, n) + _added(far, d_predicted @ second.T, n),
            v_near.T @ d_predicted,
            v_far.T @ d_predicted,
            _added(true, d_real[:, None] * predicted, n) + _added(noise, d_fake.T @ predicted, n),
            np.bincount(true, d_real, n) + np.bincount(noise, d_fake.sum(axis=0), n),
        ]
        for w, s, slope in zip(weights, speed, slopes, strict=True):
            s += slope**2
            w -= RATE * slope / np.sqrt(s)


def begin(ids: np.ndarray, n: int, unigram: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[Model, list[np.ndarray]]:
    """Weights after ``epochs`` over the windows, and their sums of squared slopes."""
    model, random = start_weights(n, unigram, seed=seed), np.random.default_rng(seed)
    weights = [model.context, model.first, model.second, model.target, model.bias]
    speed = [np.full_like(w, 1e-4) for w in weights]
    for _ in range(epochs if len(ids) else 0):
        descend(weights, speed, ids, unigram, random)
    return model, speed


def fit(ids: np.ndarray, n: int, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """A model of the given windows (far, near, next) alone."""
    return begin(ids, n, (np.bincount(ids[:, 2], minlength=n) + 1.0) / (len(ids) + n), epochs, seed)[0]


def windows(classes: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class before each token and the one before that; ends stand before a text."""
    first = np.cumsum(lengths) - lengths
    near = np.concatenate([[end], classes[:-1]])
    near[first] = end
    far = np.concatenate([[end], near[:-1]])
    far[first] = end
    return near, far


def unpacked(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * size, codec="zstd", asbytes=True), dtype=np.int32)


def train_pass(cut: DataFrame, model: Model, speed: list[np.ndarray], unigram: np.ndarray, classes: dict[str, int], end: int, seed: int) -> Model:
    """The model after every training token of ``cut`` has been a target once.

    A task gives one row per row of the weights, times what it counts: context vectors by how often the task
    met the class as context, all else by the task's tokens. The sums have a fixed number of rows, whatever
    the number of tasks.
    """
    n, width = model.context.shape
    start = [w.astype(np.float32) for w in (model.context, model.first, model.second, model.target, model.bias)]
    speed = [s.astype(np.float32) for s in speed]
    names = [f"w{i}" for i in range(width + 1)]

    def run(batches):
        weights, pace, random = [w.copy() for w in start], [s.copy() for s in speed], np.random.default_rng([seed, TaskContext.get().partitionId()])
        met, seen = np.zeros(n), 0
        for batch in batches:
            for i in range(batch.num_rows):
                held, lengths, packed, words = (batch.column(c)[i] for c in range(4))
                lengths = np.array(lengths.values, dtype=np.int64)
                trained = ~np.repeat(np.array(held.as_py(), dtype=bool), lengths)
                if not trained.any():
                    continue
                of_word = np.fromiter((classes.get(w, OPEN) for w in words.as_py()), dtype=np.int64)
                ids = of_word[unpacked(packed.as_py(), int(lengths.sum()))]
                near, far = windows(ids, lengths, end)
                found = np.stack([far, near, ids], axis=1)[trained]
                descend(weights, pace, found, unigram, random)
                met += np.bincount(found[:, 0], minlength=n) + np.bincount(found[:, 1], minlength=n)
                seen += len(found)
        if seen:
            context, first, second, target, bias = weights
            rows = np.zeros((2 * n + 2 * width, width + 1))
            rows[:, :width] = np.concatenate([context, target, first, second])
            rows[n : 2 * n, width] = bias
            weigh = np.concatenate([met, np.full(n + 2 * width, float(seen))])
            rows *= weigh[:, None]
            some = np.flatnonzero(weigh)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(weigh[some]), *(pa.array(c[some]) for c in rows.T)], names=["row", "weigh", *names])

    made = cut.select("held", "lengths", "ids", "words").mapInArrow(run, ", ".join(["row int", "weigh double", *(f"{x} double" for x in names)]))
    rows = np.zeros((2 * n + 2 * width, width + 1))
    rows[:n, :width] = start[0]  # a class that no task met as context stays as it was
    # two rows a class and two a dimension
    for r in made.groupBy("row").agg(F.sum("weigh").alias("weigh"), *(F.sum(x).alias(x) for x in names)).collect():
        rows[r[0]] = np.array(r[2:]) / r[1]
    return Model(rows[:n, :width], rows[2 * n : 2 * n + width, :width], rows[2 * n + width :, :width], rows[n : 2 * n, :width], rows[n : 2 * n, width])


def _sample(docs: DataFrame, held: Column, classes: dict[bytes, int], text: str, key: str, sample_docs: int) -> np.ndarray:
    """Windows (far, near, next) of classes from about ``sample_docs`` training documents, drawn by a hash of the key."""
    rows = docs.where(~F.coalesce(held, F.lit(False))).select(F.col(text).cast("string").alias("_text"), F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("lm")), 34).alias("_draw"))
    total = rows.count()
    drawn = rows.where(F.col("_draw") < F.lit(int(min(1.0, sample_docs / max(total, 1)) * 2**30))).select("_text")

    def run(batches):
        for _, texts in parts(batches, "_text"):
            made = [np.array([classes.get(w, OPEN) for w in tokens(t)], dtype=np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(made, pa.binary())})

    # the limit only bounds tables whose keys repeat; texts become numbers before it
    found = sorted(bytes(r["ids"]) for r in drawn.mapInArrow(run, "ids binary").limit(2 * sample_docs).collect())
    end, windows = classes.get(END.encode(), OPEN), []
    for row in found:
        ids = np.concatenate([[end, end], np.frombuffer(row, dtype=np.int32)]).astype(np.int64)
        windows.append(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1))
    return np.concatenate(windows) if windows else np.zeros((0, 3), dtype=np.int64)


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", classes: int | None = None, sample_docs: int = SAMPLE_DOCS, passes: int = PASSES) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    cut = snapshot(slices(docs, held, text, key), "slices")
    listed = cut.select("slice", F.posexplode(F.arrays_zip("words", "counts"))).select("slice", "pos", F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    counts = snapshot(listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("word")).first())
    classes = classes or class_count(n)
    # the open class and at most ``classes`` - 1 words: below 65,536 rows
    top = counts.orderBy(F.desc("c"), "word").limit(classes - 1).collect()
    number = {r["word"].encode("utf-8", "surrogatepass"): i + 1 for i, r in enumerate(top)}
    open_tokens, open_words = n - sum(r["c"] for r in top), v - len(top)
    end = number.get(END.encode(), OPEN)
    size_ = len(top) + 1
    unigram = (np.array([open_tokens, *(r["c"] for r in top)]) + 1.0) / (n + size_)
    model, speed = begin(_sample(docs, held, number, text, key, sample_docs), size_, unigram)
    for number_ in range(passes if n else 0):
        model = train_pass(cut, model, speed, unigram, {r["word"]: i + 1 for i, r in enumerate(top)}, end, number_)
    table = model.scores() if size_ <= TABLE_CLASSES else None
    base_log, open_log = np.log10(n + v + 1), np.log10(open_tokens + open_words + 1)

    names = ("key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    schema = pa.schema(list(zip(names, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)))

    def run(whole: pa.Table, known: pa.Table) -> pa.Table:
        made = []
        for row in range(whole.num_rows):
            count, of_word = np.zeros(known.num_rows, dtype=np.int64), np.zeros(known.num_rows, dtype=np.int64)
            found = known["found"].to_numpy()
            count[known["pos"].to_numpy()], of_word[known["pos"].to_numpy()] = found >> 16, found & 0xFFFF
            keys, held_out, lengths = (whole[x][row].as_py() for x in ("keys", "held", "lengths"))
            size = sum(lengths)
            ids = unpacked(whole["ids"][row].as_py(), size)
            logs = np.log10(count + 1)
            next_, first = of_word[ids], np.cumsum(lengths) - lengths
            before, second = windows(next_, np.array(lengths), end)
            if table:
                near, far, total = table
                log_p = (near[before, next_] + far[second, next_] - total[before, second]).astype(np.float64) / LN10
            else:
                log_p = model.log_p(before, second, next_).astype(np.float64) / LN10
            log_p += np.where(next_ == OPEN, logs[ids] - open_log, 0)
            add = lambda x: np.add.reduceat(x, first)
            made.append(pa.table([keys, held_out, lengths, add((count[ids] > 0).astype(np.int64)), [int(n)] * len(keys), add(logs[ids] - base_log), add(log_p)], schema=schema))
        return pa.concat_tables(made) if made else schema.empty_table()

    # a word's count and class go back to its slice in one number
    named = docs.sparkSession.createDataFrame([(r["word"], i + 1) for i, r in enumerate(top)], "word string, class long")
    known_words = counts.join(named, "word", "left").select("word", F.shiftleft("c", 16).bitwiseOR(F.coalesce("class", F.lit(OPEN).cast("long"))).alias("found"))
    met = listed.select("slice", "pos", "word").join(known_words, "word", "left").select(F.col("slice").alias("part"), "pos", F.coalesce("found", F.lit(0).cast("long")).alias("found"))
    scored = cut.drop("counts", "words").groupBy("slice").cogroup(met.groupBy("part")).applyInArrow(run, "key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *names[1:])
