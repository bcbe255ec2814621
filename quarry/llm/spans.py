"""Long spans that stand verbatim in more than one record.

The index is log-structured.  A batch of records becomes one immutable run: its
selected window hashes with the record they came from, in buckets of the hash and
sorted within them.  A new batch is merge-joined with itself and with all earlier runs,
bucket by bucket and without a shuffle; runs of one level are compacted into a run of
the next as soon as there are ``FANOUT`` of them, so adding a batch never rewrites the
whole history.  An index lives in a folder and can be opened again by a later session,
which then reads only the records that are not in it.

Hashes are taken of every window of ``GRAM`` characters and thinned by winnowing
over 160 - GRAM + 1 windows, so every span of 160 characters that two records share
has a selected hash in common.  Pairs that meet are checked on the full texts: all
windows of the wanted length are compared, and equal hashes are confirmed on the
characters.  Characters are code points, case and blanks count.

A hash that more than ``CROWD`` different texts hold (a licence header) is kept out of
the runs and forms no pairs.  Instead every window of the wanted length whose smallest
hash it is gets a 128-bit hash of its own; texts share a span exactly where they share
such a window.  What a record shares is read off them without any pair.  Where pairs
are asked for, two texts are paired where their runs of common windows begin, that is
at windows with different ones before them, so a long common passage gives a pair once.

Null texts and texts shorter than the length share nothing.  Equal texts enter the
index once and are expanded at the end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shingles import mix, sliding_min, winnow
from quarry.plans.sized import MAX_BROADCAST_ROWS, keep_keys
from quarry.workspace import Workspace, delete, finished_tables

GRAM = 120
#: Runs of a level that are compacted; an index for many batches rewrites less with more.
FANOUT = 2
#: One more than FANOUT, so that the last batch meets a compacted run.
BATCHES = 3
CROWD = 32
#: Most keys that are broadcast (about 8 MB).
MOST_KEYS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(chars: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of every window of k characters, in time linear in the text; another one for each salt."""
    if salt:
        chars = mix(chars.astype(np.uint64) + np.uint64(salt << 32))
    n = len(chars)
    if n < k:
        return np.empty(0, np.uint64)
    powers = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    # aligned to the highest power of the text, so that equal windows agree at any position
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    down = np.concatenate([np.ones(1, np.uint64), np.full(n - k, inverse, np.uint64)]).cumprod(dtype=np.uint64)
    return mix((sums[k:] - sums[: n - k + 1]) * down)


class Frequent:
    """Hashes that more than ``crowd`` of the texts of one task hold, counted in pieces of bounded size."""

    def __init__(self, crowd: int, most: int = 4_000_000):
        self.crowd, self.most = crowd, most
        self.parts: list[np.ndarray] = []
        self.size, self.found = 0, set()
        self.seen: set[bytes] = set()

    def add(self, digest: bytes, hashes: np.ndarray) -> None:
        if digest not in self.seen:  # equal texts count once
            self.seen.add(digest)
            self.parts.append(hashes)
            self.size += len(hashes)
            if self.size > self.most:
                self.count()

    def count(self) -> list[int]:
        if self.parts:
            values, times = np.unique(np.concatenate(self.parts), return_counts=True)
            self.found.update(values[times > self.crowd].tolist())
        self.parts, self.size, self.seen = [], 0, set()
        return sorted(self.found)


def fingerprints(texts: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """``texts(id, batch, text)`` to ``(id, batch, sig_a, sig_b, hashes)`` for texts of the length or more.

    A task ends with a row of batch -1 without id: the hashes it found to be crowded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(crowd)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 5
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["id", "batch", "sig_a", "sig_b", "hashes"])

        for part in batches:
            rows = []
            for rid, batch, text in zip(*(c.to_pylist() for c in part.columns)):
                if len(text) < length:
                    continue
                hashes = window_hashes(code_points(text), gram)
                d = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                sig = int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
                chosen = np.unique(hashes[winnow(hashes, length - gram + 1)]).view(np.int64)
                frequent.add(d, chosen)
                rows.append((rid, batch, *sig, chosen))
            yield out(rows)
        if crowded := frequent.count():
            yield out([(None, -1, 0, 0, crowded)])

    return texts.select("id", "batch", "text").where("text is not null").mapInArrow(run, "id bigint, batch int, sig_a bigint, sig_b bigint, hashes array<bigint>")


def _union(parts: list[DataFrame]) -> DataFrame | None:
    """All rows of the parts.

    Spark takes a union of bucketed scans for bucketed even where it then reads them without
    their buckets, so runs are joined one by one and united afterwards.
    """
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


class SpanIndex:
    """Immutable runs ``(h, id, batch)`` in a folder, beside the crowded hashes and the members of each text.

    ``runs/run-<first>-<last>-<buckets>`` holds the batches first to last.  A run whose
    batches all lie in another one was compacted and is ignored, so a crash between the
    writing of a compacted run and the deletion of its parts does no harm.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT, crowd: int = CROWD):
        self.spark, self.path, self.fanout, self.crowd = spark, path, fanout, crowd
        self.open: dict[tuple[int, int], tuple[str, DataFrame]] = {}
        self.buckets = buckets or max(8, spark.sparkContext.defaultParallelism)
        found = [tuple(map(int, n.split("-")[1:])) for n in finished_tables(spark, f"{path}/runs")]
        for first, last, width in found:
            self.buckets = width
            if not any(a <= first and last <= b and (a, b) != (first, last) for a, b, _ in found):
                self.open[first, last] = self._register(first, last)
        self.made = max([n for _, n, _ in found] + [int(n.split("-")[1]) for n in finished_tables(spark, f"{path}/crowd")], default=0)

    def _place(self, first: int, last: int) -> str:
        return f"{self.path}/runs/run-{first}-{last}-{self.buckets}"

    def _register(self, first: int, last: int) -> tuple[str, DataFrame]:
        name = f"span_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h BIGINT, id BIGINT, batch INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self._place(first, last)}'")
        return name, self.spark.table(name)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        name = f"span_run_{uuid.uuid4().hex}"
        out = rows.select("h", "id", "batch").repartition(self.buckets, "h").write.format("parquet").mode("overwrite")
        out.bucketBy(self.buckets, "h").sortBy("h").option("path", self._place(first, last)).saveAsTable(name)
        self.open[first, last] = name, self.spark.table(name)

    def table(self, kind: str, schema: str) -> DataFrame:
        """All parts of one of the side tables ``crowd``, ``crowd_rows`` and ``members``."""
        names = finished_tables(self.spark, f"{self.path}/{kind}")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def append(self, kind: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/part-{self.made}-{uuid.uuid4().hex}")

    def crowded(self) -> DataFrame:
        return self.table("crowd", "h bigint").distinct()

    def add(self, rows: DataFrame, ws: Workspace) -> DataFrame:
        """Indexes ``rows(h, id)`` as one batch; the pairs ``(a, b)``, a < b, that it forms with itself and all runs.

        Hashes that are crowded by now are noted as such instead of being paired.
        """
        self.made += 1
        now = self.made
        crowd = self.crowded()
        known = crowd.limit(MOST_KEYS + 1).count()
        if known:
            crowd = F.broadcast(crowd) if known <= MOST_KEYS else crowd
            self.append("crowd_rows", rows.select("h", "id").join(crowd, "h", "left_semi"))
            rows = rows.join(crowd, "h", "left_anti")
        self._write(rows.withColumn("batch", F.lit(now)), now, now)
        earlier = [run for place, (_, run) in self.open.items() if place != (now, now)]
        new = self.open[now, now][1]
        own = new.groupBy("h").agg(F.count("*").alias("k"))
        # both sides of each join have the same buckets, so nothing is shuffled
        met = _union([run.join(own.select("h"), "h").select("h", "id", "batch") for run in earlier])
        met = ws.save(met, f"met{now}") if met is not None else None
        repeated = own.where("k > 1").select("h")
        keys = ws.save(repeated if met is None else repeated.unionByName(met.select("h")).distinct(), f"keys{now}")
        # beyond a few keys they go to the buckets of the run, which stays where it is
        small = keys.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        rows = new.join(F.broadcast(keys) if small else keys.repartition(self.buckets, "h").hint("shuffle_hash"), "h", "left_semi").select("h", "id", "batch")
        rows = rows if met is None else rows.unionByName(met)
        rows = rows.withColumn("n", F.count("*").over(W.partitionBy("h")))
        # a crowded hash collects nothing
        members = F.collect_list(F.when(F.col("n") <= self.crowd, F.struct("id", "batch")))
        touched = ws.save(rows.groupBy("h").agg(F.first("n").alias("n"), members.alias("m")), f"touched{now}")
        for name in ("met", "keys"):
            ws.drop(f"{name}{now}")
        self.append("crowd", touched.where(F.col("n") > self.crowd).select("h"))
        self._compact(now)
        pair = lambda x: F.transform(F.filter("m", lambda y: (x["id"] < y["id"]) & ((x["batch"] == now) | (y["batch"] == now))), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
        return touched.where(F.size("m") > 1).select(F.explode(F.flatten(F.transform("m", pair))).alias("p")).select("p.a", "p.b")

    def _level(self, run: tuple[int, int]) -> int:
        return int(math.log(run[1] - run[0] + 1 + 0.5, self.fanout)) if self.fanout > 1 else 0

    def _compact(self, now: int) -> None:
        while True:
            last = self._level(max(self.open, key=lambda r: r[1]))
            same = sorted(r for r in self.open if self._level(r) == last)
            if len(same) < self.fanout:
                return
            # rows of hashes that became crowded move out of the runs
            crowd = self.crowded()
            self.append("crowd_rows", _union([self.open[r][1].join(crowd, "h", "left_semi").select("h", "id") for r in same]))
            self._write(_union([self.open[r][1].join(crowd, "h", "left_anti") for r in same]), same[0][0], same[-1][1])
            for r in same:
                name, _ = self.open.pop(r)
                self.spark.sql(f"DROP TABLE {name}")
                delete(self.spark, self._place(*r))

    def crowd_rows(self) -> DataFrame:
        """``(h, id)`` of all texts with a crowded hash, in the runs or moved out of them."""
        crowd = self.crowded()
        return _union([self.table("crowd_rows", "h bigint, id bigint"), *(run.join(crowd, "h", "left_semi").select("h", "id") for _, run in self.open.values())])

    def close(self) -> None:
        """Forgets the tables in this session; the files stay."""
        for name, _ in self.open.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def common_spans(a: str, b: str, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Character ranges of a and of b that lie in a common span of at least ``length``."""
    ha, hb = window_hashes(code_points(a), length), window_hashes(code_points(b), length)
    shared = np.intersect1d(ha, hb)
    if len(shared) == 0:
        return [], []
    at_a, at_b = np.flatnonzero(np.isin(ha, shared)), np.flatnonzero(np.isin(hb, shared))
    texts_b = {int(hb[q]): q for q in at_b.tolist()}
    sure = [p for p in at_a.tolist() if a[p : p + length] == b[texts_b[int(ha[p])] : texts_b[int(ha[p])] + length]]
    if not sure:
        return [], []
    good = {int(ha[p]) for p in sure}
    return _ranges(sure, length), _ranges([q for q in at_b.tolist() if int(hb[q]) in good], length)


def _ranges(starts: list[int], length: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


_RANGES = "array<struct<start:int,stop:int>>"


def verified(pairs: DataFrame, texts: DataFrame, ids: DataFrame, length: int) -> DataFrame:
    """Pairs that do share a span, with the shared ranges of both texts."""
    wanted = keep_keys(texts.select("id", "text"), ids, ["id"])
    both = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                ra, rb = common_spans(ta, tb, length)
                if ra:
                    rows.append((a, b, [{"start": s, "stop": e} for s, e in ra], [{"start": s, "stop": e} for s, e in rb]))
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), kind, kind]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["a", "b", "ranges_a", "ranges_b"])

    return both.mapInArrow(run, f"a bigint, b bigint, ranges_a {_RANGES}, ranges_b {_RANGES}")


def crowded_windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Windows ``(id, pos, wa, wb, before)`` of ``texts(id, text, grams)`` whose smallest hash is one of ``grams``.

    ``before`` is the hash of the window one character earlier, null if that is not one of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, grams in zip(*(c.to_pylist() for c in batch.columns)):
                chars = code_points(text)
                smallest = sliding_min(window_hashes(chars, gram), length - gram + 1)
                at = np.flatnonzero(np.isin(smallest, np.array(grams, np.int64).view(np.uint64)))
                wa, wb = window_hashes(chars, length)[at], window_hashes(chars, length, 1)[at]
                both = mix(wa ^ mix(wb)).view(np.int64)
                follows = np.diff(at, prepend=-2) == 1
                before = pa.array(np.roll(both, 1), pa.int64(), mask=~follows)
                yield pa.record_batch([pa.array(np.full(len(at), rid), pa.int64()), pa.array(at, pa.int32()), pa.array(wa.view(np.int64)), pa.array(wb.view(np.int64)), before], ["id", "pos", "wa", "wb", "before"])

    return texts.select("id", "text", "grams").mapInArrow(run, "id bigint, pos int, wa bigint, wb bigint, before bigint")


def window_pairs(windows: DataFrame, ws: Workspace) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ids that share one of ``windows(id, wa, wb, before)``.

    Texts with the same window before share that one too and are paired there; so only
    texts of different classes of ``before`` are paired, and a window whose texts all
    have the same one before is left out without a look at its texts.
    """
    key = ["wa", "wb"]
    rows = windows.select("id", *key, F.coalesce("before", F.xxhash64(F.lit("start"), "id")).alias("p")).distinct()
    begins = rows.groupBy(*key).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi").select(*key)
    rows = ws.save(rows.join(begins, key, "left_semi"), "begins")
    classes = ws.save(rows.select(*key, "p").distinct(), "befores")
    two = classes.select(*key, F.col("p").alias("p1")).join(classes.select(*key, F.col("p").alias("p2")), key).where("p1 < p2")
    one = two.join(rows.select(*key, F.col("p").alias("p1"), F.col("id").alias("x")), [*key, "p1"]).join(rows.select(*key, F.col("p").alias("p2"), F.col("id").alias("y")), [*key, "p2"])
    return one.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@dataclass
class Shared:
    """Spans in common: ``links(a, b, ranges_a, ranges_b)`` of pairs of texts, ``windows(id, pos, wa, wb, before)``
    that stand in two texts or more (none where no hash is crowded), and ``members(rep, id, fresh)`` of each text."""

    links: DataFrame
    windows: DataFrame | None
    members: DataFrame
    length: int


_MEMBER = "sig_a bigint, sig_b bigint, rep bigint, id bigint"


def shared_spans(
    records: DataFrame, ws: Workspace, length: int = 160, gram: int = GRAM, batches: int = BATCHES, text_col: str = "orig_context", id_col: str = "record_id", time_col: str | None = "loaded_at",
    index_path: str | None = None, fanout: int = FANOUT, crowd: int = CROWD,
) -> Shared:
    """What the texts of ``records`` have in common.

    Records enter the index in ``batches`` batches by arrival time (all in one without
    ``time_col``).  Without ``index_path`` the index is made for this call and deleted.
    With it, ``records`` are all records so far: those already in the index are not read
    into it again, and links, windows and members are those that new ones take part in.
    ``length``, ``gram`` and ``crowd`` of an index must not change.
    """
    if gram > length:
        raise ValueError("gram must not exceed length")
    spark = records.sparkSession
    batch = F.lit(0)
    if time_col and batches > 1:
        when = F.col(time_col).cast("timestamp").cast("double")
        cuts = records.select(when.alias("t")).approxQuantile("t", [i / batches for i in range(1, batches)], 0.01)
        for c in cuts:
            batch = batch + F.coalesce((when > F.lit(c)).cast("int"), F.lit(0))
    texts = records.select(F.col(id_col).cast("bigint").alias("id"), batch.cast("int").alias("batch"), F.col(text_col).alias("text"))
    path = index_path or f"{ws.path}/index"
    old = SpanIndex(spark, path).table("members", _MEMBER) if index_path else None
    again = old is not None and not old.isEmpty()
    prints = ws.save(fingerprints(texts.join(old.select("id"), "id", "left_anti") if again else texts, length, gram, crowd), "prints", ["batch"])
    key = ["sig_a", "sig_b"]
    known = prints.where("batch >= 0")
    firsts = known.groupBy(*key).agg(F.min("id").alias("rep"))
    if again:
        seen = old.where("rep = id").select(*key, F.col("rep").alias("old_rep"))
        firsts = firsts.join(seen, key, "left").select(*key, F.coalesce("old_rep", "rep").alias("rep"))
    # written, so that a text with a third of all records as copies is split
    members = ws.save(known.select(*key, "id").join(ws.save(firsts, "firsts"), key), "members")
    copies = members.where("id != rep").select("id")
    few = copies.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    rows = known.join(F.broadcast(copies) if few else copies, "id", "left_anti").select("batch", "id", F.explode("hashes").alias("h"))
    size = known.agg(F.sum(F.size("hashes"))).first()[0] or 0
    # buckets of about 4 million rows
    index = SpanIndex(spark, path, max(8, spark.sparkContext.defaultParallelism, size // 4_000_000), fanout, crowd)
    index.append("crowd", prints.where("batch < 0").select(F.explode("hashes").alias("h")).distinct())
    found = None
    for b in range(batches if time_col else 1):
        pairs = index.add(rows.where(F.col("batch") == b).select("h", "id"), ws)
        found = pairs if found is None else found.unionByName(pairs)
    found = ws.save(found.distinct(), "found")
    ids = ws.save(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    links = ws.save(verified(found, texts, ids, length), "links")
    marks = ws.save(index.crowd_rows().groupBy("id").agg(F.collect_set("h").alias("grams")), "marks")
    windows = None
    if not marks.isEmpty():
        wanted = keep_keys(texts.select("id", "text"), marks.select("id"), ["id"]).join(marks, "id")
        windows = ws.save(crowded_windows(wanted, length, gram), "every_window")
        two = windows.groupBy("wa", "wb").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("wa", "wb")
        windows = ws.save(windows.join(two, ["wa", "wb"], "left_semi"), "windows")
    own = members.select("rep", "id", F.lit(True).alias("fresh"))
    if index_path:
        index.append("members", members.select(*key, "rep", "id"))
        own = own.unionByName(old.select("rep", "id", F.lit(False).alias("fresh"))) if again else own
    own = ws.save(own, "own")
    index.close()
    for name in ("prints", "firsts", "members", "every_window", "index", *(f"touched{n}" for n in range(1, index.made + 1))):
        ws.drop(name)
    return Shared(links, windows, own, length)


def span_pairs(shared: Shared) -> DataFrame:
    """Pairs of records ``(record_id_a, record_id_b)``, a < b, with a common span, one of them new."""
    members = shared.members
    ws = Workspace(members.sparkSession, "pairs")
    linked = shared.links.select("a", "b")
    if shared.windows is not None:
        linked = ws.save(linked.unionByName(window_pairs(shared.windows, ws)).distinct(), "linked")
    crowd = ws.save(members.groupBy("rep").agg(F.count("*").alias("k")).where("k > 1").select("rep"), "crowd")
    copies = members.join(crowd, "rep", "left_semi")
    turned = lambda rep, n, df: df.select(F.col("rep").alias(rep), F.col("id").alias(n), F.col("fresh").alias(f"fresh_{n}"))
    within = turned("rep", "x", copies).join(turned("rep", "y", copies), "rep").where("x < y").drop("rep")
    across = linked.join(turned("a", "x", members), "a").join(turned("b", "y", members), "b").drop("a", "b")
    both = within.unionByName(across).where("fresh_x or fresh_y")
    return both.select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))


def shared_share(shared: Shared, records: DataFrame, text_col: str = "orig_context", id_col: str = "record_id") -> DataFrame:
    """For each record ``(record_id, n_chars, shared_chars, shared_share)``.

    A character is shared if it lies in a span that another record also has.  Records
    with an equal text of the length or more share all of it.  Null texts have null
    counts, empty texts a share of 0.
    """
    links, members = shared.links, shared.members
    ends = F.array(F.struct(F.col("a").alias("rep"), F.col("ranges_a").alias("ranges")), F.struct(F.col("b").alias("rep"), F.col("ranges_b").alias("ranges")))
    ranges = links.select(F.explode(ends).alias("e")).select("e.rep", F.explode("e.ranges").alias("r")).select("rep", "r.start", "r.stop")
    if shared.windows is not None:
        ranges = ranges.unionByName(shared.windows.select(F.col("id").alias("rep"), F.col("pos").alias("start"), (F.col("pos") + F.lit(shared.length)).alias("stop")))
    ranges = ranges.distinct()
    before = W.partitionBy("rep").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = ranges.select("rep", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), seen)).alias("fresh"))
    covered = fresh.groupBy("rep").agg(F.sum("fresh").alias("covered"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    # written, so that a text with a third of all records as copies is split
    per = Workspace(members.sparkSession, "share").save(sizes.join(covered, "rep", "left"), "per")
    per = members.join(per, "rep").select(F.col("id").alias("record_id"), "copies", "covered")
    n = F.length(F.col(text_col)).cast("bigint")
    base = records.select(F.col(id_col).cast("bigint").alias("record_id"), n.alias("n_chars"))
    mine = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    out = base.join(per, "record_id", "left").withColumn("shared_chars", F.when(F.col("n_chars").isNotNull(), mine).cast("bigint"))
    return out.select("record_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).when(F.col("n_chars") == 0, F.lit(0.0)).alias("shared_share"))
