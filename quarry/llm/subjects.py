"""Subject areas of documents by averaged word and subword embeddings.

A unit is a sentence or a code line.  Its features are its words and the character
n-grams of each word, hashed into a fixed number of rows of an embedding table; a
word is the mean of its rows, a unit the mean of its words, and every subject has an
independent logistic output on the unit.

Training is data-parallel: the units of at most ``TRAIN_DOCS`` labelled documents
(chosen by hash) are prepared once in partitions of ``PART_DOCS``; in each step every
partition computes the gradient of its units under the shared parameters, and the
summed gradient makes one Adam step.  A unit starts with the subjects of its
document; after ``WARM`` steps a subject counts for a unit only where the model itself
supports it, which takes filler sentences out of the positive examples, and subjects
that the raters left out but the model is sure of are ignored rather than held
against it.

Every document is scored unit by unit; it has the subjects that at least
``MIN_SHARE`` of its units are about.  Null, empty and blank texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.workspace import Workspace

TRAIN_DOCS = 3_000
PART_DOCS = 750
BUCKETS = 1 << 15
DIM = 16
STEPS = 60
WARM = 25
MIN_SHARE = 0.2
CUTOFF = 0.25
#: Keeps rows that few units touch from being learned by heart.
RARE = 5e-6
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = re.compile(r"(?<=[.!?。])\s+")


def units(text: str | None) -> list[str]:
    """Sentences and code lines; lines without a letter do not count."""
    if not text:
        return []
    out = []
    for line in text.splitlines():
        for part in _END.split(line):
            if _WORD.search(part):
                out.append(part)
    return out


def words(unit: str) -> list[str]:
    """Lower-case words of a unit; names are split at underscores, digits and humps."""
    return [w.lower() for run in _WORD.findall(unit) for w in _HUMP.split(run) if len(w) > 1]


def rows_of(word: str) -> list[int]:
    """Embedding rows of a word and of its n-grams of 4 and 5 characters."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams]


class Prepared:
    """Units of a partition as index arrays: unit -> distinct words -> rows."""

    def __init__(self, unit_words: list[list[str]], targets: np.ndarray):
        ids: dict[str, int] = {}
        flat = [ids.setdefault(w, len(ids)) for ws in unit_words for w in ws]
        self.word = np.array(flat, np.int32)
        self.starts = np.cumsum([0, *(len(ws) for ws in unit_words)])[:-1].astype(np.int64)
        self.lengths = np.array([len(ws) for ws in unit_words], np.float32)
        per = [rows_of(w) for w in ids]
        self.row = np.array([r for p in per for r in p], np.int32)
        self.row_starts = np.cumsum([0, *map(len, per)])[:-1].astype(np.int64)
        self.row_lengths = np.array([len(p) for p in per], np.float32)
        self.targets = targets
        self.by_word = np.argsort(self.word, kind="stable")
        self.word_starts = np.searchsorted(self.word[self.by_word], np.arange(len(ids)))

    def gradient(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        vectors = np.add.reduceat(table[self.row], self.row_starts) / self.row_lengths[:, None]
        mean = np.add.reduceat(vectors[self.word], self.starts) / self.lengths[:, None]
        p = 1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30)))
        y, weight = self.targets, np.ones_like(p)
        if refine:
            y = self.targets * (p > 0.35)
            weight = np.where((self.targets == 0) & (p > 0.9), 0.0, np.where((self.targets == 1) & (p > 0.2) & (p <= 0.35), 0.0, 1.0)).astype(np.float32)
        miss = (p - y) * weight
        d_mean = (miss @ out.T) / self.lengths[:, None]
        unit = np.repeat(np.arange(len(self.starts)), self.lengths.astype(np.int64))
        d_word = np.add.reduceat(d_mean[unit[self.by_word]], self.word_starts) / self.row_lengths[:, None]
        d_table = np.zeros_like(table)
        np.add.at(d_table, self.row, np.repeat(d_word, self.row_lengths.astype(np.int64), axis=0))
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum())
        return d_table, mean.T @ miss, miss.sum(axis=0), loss


def _training_sets(documents: DataFrame, labels: DataFrame, n_subjects: int, ws: Workspace, train_docs: int) -> DataFrame:
    """One row for each partition with its prepared units, pickled."""
    import pickle

    marks = labels.where("doc_id is not null and place is not null").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = ws.save(marks.orderBy(order, "doc_id").limit(train_docs), "chosen")
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, targets = [], []
        for batch in batches:
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                y = np.zeros(n_subjects, np.float32)
                y[places] = 1
                for u in units(text):
                    ws_ = words(u)
                    if ws_:
                        bags.append(ws_)
                        targets.append(y)
        if bags:
            yield pa.record_batch([pa.array([pickle.dumps(Prepared(bags, np.stack(targets)))], pa.binary()), pa.array([len(bags)], pa.int64())], ["data", "n"])

    return ws.save(texts.repartition(max(1, -(-train_docs // PART_DOCS)), "doc_id").select("text", "places").mapInArrow(run, "data binary, n bigint"), "training")


class _Ids(dict):
    """From a run of letters to the numbers of its words; new words get a row of contributions."""

    def __init__(self, model: "Model"):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> list[int]:
        self[run] = found = [self.model.number(w.lower()) for w in _HUMP.split(run) if len(w) > 1]
        return found


class Model:
    """Linear after averaging: each word contributes a fixed amount to each output."""

    def __init__(self, table: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table, out, bias
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((1024, self.out.shape[1]), np.float32)
        self.runs = _Ids(self)

    def __getstate__(self):
        return {"table": self.table.astype(np.float16), "out": self.out, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(state["table"].astype(np.float32), state["out"], state["bias"])

    def number(self, w: str) -> int:
        n = self.numbers.get(w)
        if n is None:
            n = self.numbers[w] = len(self.numbers)
            if n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n] = self.table[rows_of(w)].mean(axis=0) @ self.out
        return n

    def score(self, parts: list[str]) -> np.ndarray:
        """Probabilities of units by subject; a unit without words has none."""
        if len(self.runs) > 400_000:
            self._forget()
        flat: list[int] = []
        ends = np.empty(len(parts), np.int64)
        runs, more = self.runs, flat.extend
        for i, part in enumerate(parts):
            for run in _WORD.findall(part):
                more(runs[run])
            ends[i] = len(flat)
        sizes = np.diff(ends, prepend=0)
        some = np.flatnonzero(sizes)
        p = np.zeros((len(parts), self.out.shape[1]), np.float32)
        if len(some):
            sums = np.add.reduceat(self.rows[flat], (ends - sizes)[some])
            p[some] = 1 / (1 + np.exp(-np.clip(sums / sizes[some, None] + self.bias, -30, 30)))
        return p


def train(documents: DataFrame, labels: DataFrame, n_subjects: int, ws: Workspace, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Model | None:
    """The trained model, or null when no labelled document has a text."""
    import pickle

    spark: SparkSession = documents.sparkSession
    data = _training_sets(documents, labels, n_subjects, ws, train_docs)
    n = data.agg(F.sum("n")).first()[0]
    if not n:
        return None
    rng = np.random.default_rng(5)
    table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, n_subjects)).astype(np.float32)
    bias = np.full(n_subjects, -2.0, np.float32)
    params = [table, out, bias]
    first = [np.zeros_like(x) for x in params]
    second = [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast(pickle.dumps((params[0].astype(np.float16), params[1], params[2], step > WARM)))  # the model's fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, o, b, refine = pickle.loads(shared.value)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    d_table, d_out, d_bias, loss = pickle.loads(blob).gradient(t.astype(np.float32), o, b, refine)
                    at = np.flatnonzero(np.abs(d_table).sum(axis=1)).astype(np.int32)
                    yield pa.record_batch([pa.array([pickle.dumps((at, d_table[at].astype(np.float32), d_out, d_bias, loss))], pa.binary())], ["g"])

        grads = [np.zeros_like(x) for x in params]
        for r in data.select("data").mapInArrow(run, "g binary").collect():  # one row of at most the model's size for each PART_DOCS documents
            at, d_table, d_out, d_bias, _ = pickle.loads(r["g"])
            grads[0][at] += d_table
            grads[1] += d_out
            grads[2] += d_bias
        shared.unpersist()
        rate = 0.08 if step <= steps * 0.7 else 0.03
        for i, g in enumerate(grads):
            g = g / n * 10
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + RARE)
    return Model(*params)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, ws: Workspace, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE, cutoff: float = CUTOFF) -> DataFrame:
    """``(doc_id, subject, share)`` for the subjects that hold at least ``min_share`` of a document's units.

    ``labels`` has ``(doc_id, subject_id)`` of a sample, noisy and incomplete; labels of
    unknown documents or subjects are ignored.  ``subjects`` is a small fixed table.
    Without usable labels nothing can be learned and the result is empty.
    """
    spark = documents.sparkSession
    names = [(r["subject_id"], r["subject"]) for r in subjects.select("subject_id", "subject").where("subject_id is not null and subject is not null").distinct().orderBy("subject_id").collect()]
    places = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(names)], "subject_id int, place int")
    marked = labels.select("doc_id", F.col("subject_id").cast("int").alias("subject_id")).join(F.broadcast(places), "subject_id").select("doc_id", "place")
    model = train(documents, marked, len(names), ws, train_docs) if names else None
    if model is None:
        return spark.createDataFrame([], "doc_id bigint, subject string, share double")
    shared = spark.sparkContext.broadcast(model)
    titles = [t for _, t in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            docs, counts, parts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = units(text)
                if own:
                    docs.append(doc)
                    counts.append(len(own))
                    parts += own
            ids, found, shares = [], [], []
            if docs:
                hits = np.add.reduceat((m.score(parts) >= cutoff).astype(np.float32), np.cumsum([0, *counts[:-1]]))
                share = hits / np.array(counts, np.float32)[:, None]
                for d, k in zip(*np.nonzero(share >= min_share - 1e-6)):
                    ids.append(docs[d])
                    found.append(titles[k])
                    shares.append(float(share[d, k]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "subject", "share"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "doc_id bigint, subject string, share double")


def corpus_make_up(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, characters and their shares by subject; a null subject holds documents without one."""
    sizes = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    per = sizes.join(found, "doc_id", "left").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))
    total = sizes.agg(F.count("*").alias("all_documents"), F.sum("chars").alias("all_chars"))
    return per.crossJoin(F.broadcast(total)).select("subject", "documents", "chars", (F.col("documents") / F.col("all_documents")).alias("document_share"), (F.col("chars") / F.col("all_chars")).alias("char_share"))
