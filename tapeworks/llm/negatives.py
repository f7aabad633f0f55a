"""Hard negatives by Kronecker-packed products (operator 13).

Vectors become integers and all rows are laid into blocks of ``BLOCK_ROWS``,
anchors into blocks of ``BLOCK_ANCHORS``; every anchor block meets every block
by an equi-join on the number of the share that the block was dealt to. Within
a pair of blocks, component j of all rows, made non-negative by a bias, fills
separate fields of one wide integer. Each component of an anchor multiplies
that integer once; the sum over components holds the exact products of the
anchor with all rows, one a field, and the biases are taken off again. Fields
are as wide as the largest sum needs, whatever the components hold.

The first pass finds each anchor's positives, the second its negatives within
the score range that each positive sets. From every pair of blocks at most
``positives`` or ``negatives`` rows an anchor (and positive) go on, and those
are cut again before they are shuffled.

Defined results: rows without id, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as filled up with
zeros, an empty one has score 0 with all; equal rows are candidates one by
one, but rows with the anchor's id are neither positives nor negatives of it;
anchors that agree in id, label and vector are one anchor; ties go to the
smaller id; positives with a negative score have no negatives; scores are
compared exactly up to WIDEST, beyond which they count as equal, and those past
64 bits are returned as the nearest 64-bit number;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import executors_tasks, stored

BLOCK_ROWS, BLOCK_ANCHORS = 2048, 256
#: Shares that blocks are dealt to, for each task.
SHARES_A_TASK = 4
LEAST, MOST = -(2**63), 2**63 - 1
#: Numbers beyond go through Python's integers; sums over a million components of others stay below 64 bits.
EXACT = 2**40
#: Scores beyond count as equal.
WIDEST = 10**37


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is between these shares, in percent, of the positive's.
    low_pct: int = 80
    high_pct: int = 100
    scale: float = 256.0
    #: Rows whose id this divides are anchors.
    every: int = 100


BLOCK_SCHEMA = "block long, ids binary, labels binary, dims int, numbers binary, wide array<string>"


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """The rows that take part, as id, label and vector of doubles."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & sound)
    return kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"))


def _quantised(vectors: pa.ListArray, scale: float) -> tuple[np.ndarray, list[str] | None]:
    """Row-wise floor(scale * x), filled up with zeros: as int64, or as decimal text where one is beyond EXACT."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
    dims = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    if not np.isfinite(out).all():
        # scale * x passes the doubles: the product of a double and a power of two is taken in integers
        exact = [[math.floor(int(x) * int(scale)) if abs(x) > EXACT else math.floor(x * scale) for x in v] for v in vectors.to_pylist()]
        return np.zeros(out.shape, np.int64), [str(x) for v in exact for x in [*v, *[0] * (dims - len(v))]]
    if len(flat) and np.abs(flat).max() > EXACT:
        return np.zeros(out.shape, np.int64), [str(int(x)) for x in out.ravel()]
    return out.astype(np.int64), None


def in_blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows of each partition in blocks of up to ``size``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(part: pa.Table, no: int) -> pa.RecordBatch:
            numbers, wide = _quantised(part.column("vector").combine_chunks(), scale)
            kind = next(t for t in (np.int16, np.int32, np.int64) if not numbers.size or np.abs(numbers).max() <= np.iinfo(t).max)
            as_bytes = lambda c: part.column(c).to_numpy().astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int64()), pa.array([as_bytes("id")], pa.binary()), pa.array([as_bytes("label")], pa.binary()), pa.array([numbers.shape[1]], pa.int32()),
                 pa.array([numbers.astype(kind).tobytes()], pa.binary()), pa.array([wide], pa.list_(pa.string()))],
                ["block", "ids", "labels", "dims", "numbers", "wide"],
            )

        no = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                table = pa.Table.from_batches(held)
                while table.num_rows >= size:
                    yield block(table.slice(0, size), no)
                    table, no = table.slice(size), no + 1
                held, n = table.to_batches(), table.num_rows
        if n:
            yield block(pa.Table.from_batches(held), no)

    return rows.mapInArrow(pack, BLOCK_SCHEMA)


def _matrix(dims: int, numbers: bytes, wide: list[str] | None, n: int) -> np.ndarray:
    if wide is None:
        return np.frombuffer(numbers, f"<i{len(numbers) // max(1, n * dims) or 8}").reshape(n, dims).astype(np.int64)
    return np.array([int(x) for x in wide], object).reshape(n, dims)


class Packed:
    """A block of rows, component by component in the fields of wide integers."""

    def __init__(self, rows: np.ndarray, anchor_span: int):
        """``anchor_span``: the largest that a component of an anchor is above the anchors' least one."""
        n, dims = rows.shape
        self.n = n
        self.low = [int(x) for x in rows.min(axis=0)] if n and dims else [0] * dims
        biased = rows - np.array(self.low, rows.dtype).reshape(1, dims)
        sums = biased.sum(axis=1) if dims else np.zeros(n, np.int64)
        self.sums = np.array([int(x) for x in sums], object) if rows.dtype == object else sums
        most = int(biased.max()) if biased.size else 0
        bits = (max(1, most) * max(1, anchor_span) * max(1, dims)).bit_length()
        self.width = 4 if bits <= 32 else 8 if bits <= 63 else (bits + 7) // 8
        if rows.dtype != object and self.width in (4, 8):
            columns = np.ascontiguousarray(biased.T.astype(f"<u{self.width}"))
            self.columns = [int.from_bytes(columns[j].tobytes(), "little") for j in range(dims)]
        else:
            self.columns = [int.from_bytes(b"".join(int(x).to_bytes(self.width, "little") for x in biased[:, j]), "little") for j in range(dims)]

    def scores(self, anchor: list[int], least: int) -> np.ndarray:
        """The inner products of one anchor with all rows; ``least`` is its bias, no component is below it."""
        total = 0
        for column, a in zip(self.columns, anchor):
            if a != least:
                total += column * (a - least)  # one product for all rows
        fields = total.to_bytes(self.width * self.n, "little")
        if self.width in (4, 8):
            own = np.frombuffer(fields, f"<u{self.width}").astype(np.int64)
        else:
            own = np.array([int.from_bytes(fields[i : i + self.width], "little") for i in range(0, len(fields), self.width)], object)
        offset = sum(low * a for low, a in zip(self.low, anchor))
        if own.dtype != object and self.sums.dtype != object and (abs(least) + 1) * (int(self.sums.max(initial=0)) + 1) < 2**61 and abs(offset) < 2**61:
            return own + self.sums * least + offset
        return np.array([int(x) + int(s) * least + offset for x, s in zip(own, self.sums)], object)


def _first(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The places of the first ``n`` of ``among`` by falling score, then rising id."""
    if len(among) > 4 * n and scores.dtype != object:
        own = scores[among]
        among = among[own >= np.partition(own, len(own) - n)[len(own) - n]]  # ties at the cut stay
    return np.array(sorted(among.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))[:n], np.int64)


def _met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block with every block of anchors, by shares."""
    tasks = executors_tasks(blocks.sparkSession)
    shares = tasks * SHARES_A_TASK
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("block", "ids"), F.lit(shares)).cast("int")).repartition(tasks, "share")
    each = anchors.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(tasks, "share")
    return dealt.join(each.select("share", *[F.col(c).alias(f"a_{c}") for c in anchors.columns]), "share").drop("share")


PAIR_SCHEMA = "anchor binary, anchor_id long, positive_id long, positive_score string, id long, score string"


def _text(score: int) -> str:
    return str(max(-WIDEST, min(WIDEST, int(score))))


def _anchor_keys(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[bytes]:
    return [hashlib.md5(f"{i}|{n}|{','.join(map(str, r))}".encode()).digest() for i, n, r in zip(ids.tolist(), labels.tolist(), rows.tolist())]


def _scored(pairs: DataFrame, mining: Mining, negatives: bool) -> DataFrame:
    """The first candidates of every pair of blocks."""

    def one(row: dict) -> Iterator[tuple]:
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        a_ids, a_labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
        rows = _matrix(row["dims"], row["numbers"], row["wide"], len(ids))
        anchors = _matrix(row["a_dims"], row["a_numbers"], row["a_wide"], len(a_ids))
        dims = min(rows.shape[1], anchors.shape[1])  # components beyond are zero on one side
        whole = anchors
        rows, anchors = rows[:, :dims], anchors[:, :dims]
        least = int(anchors.min()) if anchors.size else 0
        packed = Packed(rows, (int(anchors.max()) if anchors.size else 0) - least)
        keys = _anchor_keys(a_ids, a_labels, whole)
        for k, anchor in enumerate(anchors.tolist()):
            found = row["a_positives"][k] if negatives else None
            if negatives and not found:
                continue
            scores = packed.scores(anchor, least)
            same = labels == a_labels[k]
            other = ids != a_ids[k]
            if not negatives:
                for i in _first(scores, ids, np.flatnonzero(same & other), mining.positives):
                    yield keys[k], int(a_ids[k]), None, None, int(ids[i]), _text(scores[i])
                continue
            for p in found:
                top = int(p["score"])
                low, high = -(-mining.low_pct * top // 100), mining.high_pct * top // 100
                if low > high:
                    continue
                for i in _first(scores, ids, np.flatnonzero(~same & other & (scores >= low) & (scores <= high)), mining.negatives):
                    yield keys[k], int(a_ids[k]), p["id"], p["score"], int(ids[i]), _text(scores[i])

    schema = pa.schema([("anchor", pa.binary()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.string()), ("id", pa.int64()), ("score", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row holds a pair of blocks
                out = list(one(batch.slice(i, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pairs.mapInArrow(work, PAIR_SCHEMA)


def _best(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group with their ranks; cut before the exchange as well."""
    exact = F.col("score").cast("decimal(38,0)")
    order = Window.partitionBy(*by).orderBy(exact.desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", mining: Mining = Mining()) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id and both scores."""
    taking = usable(rows, id_col, vector_col, label)
    blocks = stored(in_blocks(taking, BLOCK_ROWS, mining.scale), "vectors")
    own = taking.filter(F.col("id") % mining.every == 0).distinct()
    anchors = stored(in_blocks(own, BLOCK_ANCHORS, mining.scale).withColumn("block", F.xxhash64("block", "ids", "labels", "numbers")), "anchors")
    positives = _best(_scored(_met(blocks, anchors), mining, negatives=False), ["anchor"], mining.positives)
    of_anchor = positives.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # as many as asked for at most

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("anchor", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                keys = _anchor_keys(ids, labels, _matrix(row["dims"], row["numbers"], row["wide"], len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(keys, pa.binary())], schema=schema)

    places = anchors.mapInArrow(keyed, "block long, place int, anchor binary").join(of_anchor, "anchor", "left")
    by_block = places.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "positives"))).alias("_p"))  # BLOCK_ANCHORS at most
    with_positives = stored(anchors.join(by_block, "block").withColumn("positives", F.transform("_p", lambda x: x["positives"])).drop("_p"), "positives")
    found = _best(_scored(_met(blocks, with_positives), mining, negatives=True), ["anchor", "positive_id", "positive_score"], mining.negatives)
    long = lambda c: F.least(F.greatest(F.col(c).cast("decimal(38,0)"), F.lit(LEAST)), F.lit(MOST)).cast("long")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), long("positive_score").alias("positive_score"), long("score").alias("negative_score"))


def relabelled(id_col: str = "vec_id", label_col: str = "label", of: int = 7, classes: int = 10) -> Column:
    """The label, moved on by one for rows whose id ``of`` divides."""
    return F.when(F.col(id_col) % of == 0, (F.col(label_col) + 1) % classes).otherwise(F.col(label_col))


def negatives_table(rows: DataFrame) -> DataFrame:
    return hard_negatives(rows, relabelled())


ORACLE = """
with e as (
  select cast(vec_id as bigint) as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), long_e as (
  select id, label, unnest(q) as c, generate_subscripts(q, 1) as j from e
), s as (
  select a.id as anchor_id, r.id, a.label = r.label as same, sum(a.c * r.c) as score
  from long_e a join long_e r on a.j = r.j and a.id <> r.id where a.id % 100 = 0
  group by a.id, r.id, a.label = r.label
), p as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as place from s where same) where place <= 5
), n as (
  select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score
from n where rank <= 5
"""
