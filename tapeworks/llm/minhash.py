"""MinHash near-deduplication (operator 6).

Texts with equal shingle sets form one class, named by 128 bits of its set. Of
each class, universal hash minima give a signature; equal bands of signatures
make buckets; signatures that agree often enough are compared on their full
sets; the links that hold give components by alternating large-star and
small-star.

No bucket is expanded into all pairs. Buckets choose a member that shares most
with others as their reference (see ``_stars``), and each member is compared
to it: signatures first, and only where they agree, or where the reference has
further members, the sets. Two members that are both linked with the reference
are in one component already. Any other pair that is linked must share a part
of what sets its members apart from the reference, by exact bounds, so such
pairs meet by those differences (see ``_linked``), never by the text that
their whole group shares, only while their components are not known to be one,
and are confirmed on all differences, which is the same as on the full sets.

Defined results: a null text, an empty one or one without a word has an empty
set and is linked with nothing; texts with fewer words than a shingle have one
shingle of all their words; long texts are taken whole; rows that share an id
share their component's verdict row by row; repeated rows are one class; a
null id is no component's smallest id (a component of null ids has a null id
and keeps its rows); an empty table gives an empty result. Columns named
``_n_id`` and ``_n_key`` are refused by ``one_of_each``; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps, hashing
from .chunks import slices
from .common import NOT_BLANK, stored
from .components import components, joined_on


#: Text that a worker shingles at once.
SLICE_BYTES = 2 << 20
#: Words of more bytes take a cryptographic hash: running sums modulo 2**64
#: are equal for some different strings of 1,024 bytes and more.
LONG_WORD = 256
#: Turns a shingle that the reference has and a member lacks into a token of its own.
LACKS = 0x5851F42D4C957F2D
#: Members of a bucket that meet whatever their x, and classes of x in a factor of two for more of them.
SMALL, PARTS = 32, 6


@dataclass(frozen=True)
class Near:
    """At 32 bands of 4 minima a pair at the threshold shares no band with
    probability (1 - t**4)**32: 6e-11 at 0.85, 5e-8 at 0.8."""

    shingle: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 4
    #: Signatures that agree in fewer places than the threshold by so many
    #: standard errors are not compared on their sets.
    errors: float = 5.0
    seed: int = 11

    def least_agreement(self) -> float:
        t, n = self.percent / 100, self.bands * self.rows
        return t - self.errors * (t * (1 - t) / n) ** 0.5


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts, sorted within each, and how many each has."""
    lower = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    solid = ~_BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge], ends[edge - 1] = solid[edge], solid[edge - 1]  # words end with their text
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = hashing.of_ranges(hashing.running(data), starts, stops)
    for i in np.flatnonzero(stops - starts > LONG_WORD):
        words[i] = int.from_bytes(blake2b(data[starts[i] : stops[i]], digest_size=8).digest(), "little")
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    odd = np.array([pow(hashing.B, 2 * i + 3, 1 << 64) for i in range(k)], np.uint64)
    full = hashing.mix(sum(words[i : len(words) - k + 1 + i] * odd[i] for i in range(k))) if len(words) >= k else np.zeros(0, np.uint64)
    sets = []
    for a, n in zip(first.tolist(), n_words.tolist()):
        if n >= k:
            sets.append(np.unique(full[a : a + n - k + 1]))
        elif n:
            sets.append(hashing.mix((words[a : a + n] * odd[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def signatures(flat: np.ndarray, sizes: np.ndarray, s: Near) -> np.ndarray:
    """One row per non-empty set: the minima of multiply-add hashes modulo 2**32, 16 bits of each.

    Equal minima stay equal; different ones pass for equal once in 65,536."""
    rng = np.random.default_rng(s.seed)
    n = s.bands * s.rows
    a, b = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), n), np.uint16)
    for j in range(n if len(starts) else 0):
        out[:, j] = np.minimum.reduceat(x * a[j] + b[j], starts).astype(np.uint16)
    return out


def _names(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each non-empty set: two sums over its shingles, mixed differently, with its size."""
    some = sizes > 0
    starts, n = (np.cumsum(sizes) - sizes)[some], sizes[some].astype(np.uint64)
    sums = [hashing.mix(np.add.reduceat(hashing.mix(flat ^ np.uint64(salt)), starts) + n) for salt in (77, 0xD1B54A32D192ED03)]
    return [row.tobytes() for row in np.column_stack(sums)] if some.any() else []


def _sketch(docs: DataFrame, s: Near) -> DataFrame:
    """(id, text_key, n_shingles, node, sig); the node names the whole set, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                flat, sizes = shingle_sets(batch.column(1).slice(a, b - a), s.shingle)
                some = sizes > 0
                node, sig = np.full(len(sizes), None, object), np.full(len(sizes), None, object)
                if some.any():
                    node[some] = _names(flat, sizes)
                    sig[some] = [row.tobytes() for row in signatures(flat, sizes, s)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["id", "text_key", "n_shingles", "node", "sig"]
                )

    return docs.withColumn("key", F.xxhash64("text")).mapInArrow(run, "id long, text_key long, n_shingles long, node binary, sig binary")


def _band_hashes(sigs: pa.Array, s: Near) -> np.ndarray:
    """One row of band hashes for each signature."""
    odd = np.array([pow(hashing.B, 2 * i + 5, 1 << 64) for i in range(s.rows)], np.uint64)
    sig = np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, s.bands, s.rows).astype(np.uint64)
    return hashing.mix((sig * odd).sum(axis=2, dtype=np.uint64) + np.arange(s.bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _bands(nodes: DataFrame, s: Near) -> DataFrame:
    """(band): one row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_band_hashes(batch.column(0), s).ravel().view(np.int64))], ["band"])

    return nodes.select("sig").mapInArrow(run, "band long")


def _in_buckets(nodes: DataFrame, buckets: DataFrame, s: Near) -> DataFrame:
    """(node, id, n, sig, bands) of nodes with bands in ``buckets``; a bounded bitmap picks them,
    so a few bands too many may stay."""
    log2 = bitmaps.log2_bits(buckets.count())
    marked = nodes.sparkSession.sparkContext.broadcast(bitmaps.filled_cells(buckets, "band", 1, log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            band = _band_hashes(batch.column(3), s)
            keep = bitmaps.maybe_in(marked.value, band.ravel(), log2).reshape(band.shape)
            some, n = keep.any(axis=1), keep.sum(axis=1)
            offsets = np.append(0, np.cumsum(n[some])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(pa.array(some)) for i in range(4)), lists], ["node", "id", "n", "sig", "bands"])

    return nodes.select("node", "id", F.col("n_shingles").alias("n"), "sig").mapInArrow(run, "node binary, id long, n long, sig binary, bands array<long>")


def _stars(near: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, ref): each node with the references of its buckets.

    A node's weight is the number of members of all its buckets. A bucket
    takes up its heaviest member, a node the heaviest of those that its
    buckets took up, and a bucket's reference is the heaviest one of its
    members' choices. So the buckets of a group of copies agree on one
    reference, which mostly is the text that the others were made from.
    """
    of_each = F.collect_list("band").alias("bands")  # no more than a signature has
    rows = near.select("node", F.explode("bands").alias("band")).join(buckets, "band")
    weights = stored(rows.groupBy("node").agg(F.sum("members").alias("weight"), of_each), "weights")
    rows = weights.select("node", "weight", F.explode("bands").alias("band"))
    heaviest = rows.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top"))
    choices = stored(rows.join(heaviest, "band").groupBy("node").agg(F.max("top").alias("choice"), of_each), "choices")
    rows = choices.select("node", "choice", F.explode("bands").alias("band"))
    refs = rows.groupBy("band").agg(F.max("choice").alias("ref"))
    return rows.join(refs, "band").select("node", F.col("ref.node").alias("ref")).filter("node <> ref").distinct()


def _agreeing(stars: DataFrame, near: DataFrame, s: Near) -> DataFrame:
    """(node, ref, id_node, id_ref, members, alike): whether sizes and signatures allow a link, and how many
    members the reference has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (5, 6))
            alike = (left == right).mean(axis=1) >= s.least_agreement()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(alike)], ["node", "ref", "id_node", "id_ref", "members", "alike"])

    of = lambda end: near.select(F.col("node").alias(end), F.col("id").alias(f"id_{end}"), F.col("sig").alias(f"sig_{end}"))
    crowds = stars.groupBy("ref").agg(F.count(F.lit(1)).alias("members"))
    both = stars.join(crowds, "ref").join(of("node"), "node").join(of("ref"), "ref")
    both = both.select("node", "ref", "id_node", "id_ref", "members", "sig_node", "sig_ref")
    return both.mapInArrow(run, "node binary, ref binary, id_node long, id_ref long, members long, alike boolean")


def _sets_of(docs: DataFrame, wanted: DataFrame, s: Near) -> DataFrame:
    """(node, shingles) of the nodes with wanted ids (id): a bounded bitmap of them picks the texts,
    so a few nodes too many may stay."""
    log2 = bitmaps.log2_bits(wanted.count(), 24)
    marked = docs.sparkSession.sparkContext.broadcast(bitmaps.filled_cells(wanted.select(F.xxhash64("id").alias("h")), "h", 1, log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(bitmaps.maybe_in(marked.value, batch.column(1).to_numpy(), log2)))
            for a, b in slices(own.column(0), SLICE_BYTES):
                flat, sizes = shingle_sets(own.column(0).slice(a, b - a), s.shingle)
                names = _names(flat, sizes)
                if names:
                    offsets = np.append(0, np.cumsum(sizes[sizes > 0])).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), lists], ["node", "shingles"])

    found = docs.select("text", F.xxhash64("id").alias("h")).mapInArrow(run, "node binary, shingles array<long>")
    return found.dropDuplicates(["node"])


def _differences(stars: DataFrame, sets: DataFrame, s: Near) -> DataFrame:
    """(node, ref, n, n_ref, d, linked, tokens): the shingles that a member has and its reference
    lacks, then those that it lacks, each in order; d is their number."""
    both = stars.join(sets.select("node", F.col("shingles").alias("own")), "node").join(sets.select(F.col("node").alias("ref"), F.col("shingles").alias("theirs")), "ref")
    lacks = F.transform(F.array_except("theirs", "own"), lambda x: x.bitwiseXOR(F.lit(LACKS)))
    tokens = F.concat(F.array_sort(F.array_except("own", "theirs")), F.array_sort(lacks))
    out = both.select("node", "ref", "alike", "members", F.size("own").alias("n"), F.size("theirs").alias("n_ref"), tokens.alias("tokens")).withColumn("d", F.size("tokens"))
    return out.withColumn("linked", _close(F.col("d"), F.col("n") + F.col("n_ref"), s) & F.col("alike")).drop("alike")


def _close(apart: Column, sizes: Column, s: Near) -> Column:
    """Whether two sets of so many shingles together, so many of them in one set only, are linked."""
    return apart * (100 + s.percent) <= sizes * (100 - s.percent)


def _pivots(first: DataFrame) -> DataFrame:
    """(ref, u, v): each member of a (ref, token) bucket with two members of it, where they may be linked:
    the one of least ``x``, whose few differences leave room for the others', and another one for each token."""
    row, hashed = F.struct("node", "linked", "x", "y"), F.xxhash64("node", "token")
    chosen = first.groupBy("ref", "token").agg(F.min_by(row, F.struct("x", hashed)).alias("nearest"), F.max_by(row, hashed).alias("other"))
    met = first.join(chosen, ["ref", "token"]).withColumn("pivot", F.explode(F.array("nearest", "other")))
    met = met.filter(~(F.col("linked") & F.col("pivot.linked")) & (F.col("pivot.x") <= F.col("y")) & (F.col("x") <= F.col("pivot.y")))
    return met.withColumn("v", F.col("pivot.node")).filter("node <> v").select("ref", F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()


def _confirmed(pairs: DataFrame, diffs: DataFrame, s: Near) -> DataFrame:
    """Those pairs (ref, u, v) that are linked, judged on all differences."""
    of = lambda end: diffs.select("ref", F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("d").alias(f"d_{end}"), F.col("tokens").alias(f"of_{end}"))
    both = pairs.join(of("u"), ["ref", "u"]).join(of("v"), ["ref", "v"])
    apart = F.col("d_u") + F.col("d_v") - 2 * F.size(F.array_intersect("of_u", "of_v"))
    return both.filter(_close(apart, F.col("n_u") + F.col("n_v"), s))


def _first_tokens(rows: DataFrame, s: Near) -> DataFrame:
    """The differences of each member by which it may meet a partner, one a row, with their ``y``, the number
    ``many`` of members that share them, and the classes ``at`` (as partner of larger x) and ``to`` (of ``at``
    to ``to`` are the larger partners' classes); see ``_linked``."""
    t, whole = s.percent, 100 + s.percent
    each = rows.withColumn("token", F.explode("tokens")).drop("tokens")
    of_token = [F.count(F.lit(1)).alias("many"), F.min("x").alias("least"), F.min(F.when(~F.col("linked"), F.col("x"))).alias("least_out")]
    several = each.groupBy("ref", "token").agg(*of_token).filter("many > 1 and least_out is not null")
    rest = Window.partitionBy("ref", "node").orderBy(F.desc("many"), F.desc("token"))
    met = each.join(several, ["ref", "token"]).withColumn("left", F.row_number().over(rest).cast("long"))
    met = met.withColumn("y", 2 * whole * F.col("left") - F.col("x"))
    asked = F.col("y") >= F.when(F.col("linked"), F.col("least_out")).otherwise(F.col("least"))
    met = met.filter(asked & ((F.col("d") - F.col("left")) * t <= F.col("n") * (100 - t)))
    part = lambda x: F.when(F.col("many") > SMALL, F.floor(F.log2(F.greatest(F.col(x), F.col("floor"))) * PARTS)).otherwise(0)
    return stored(met.select("ref", "token", "node", "n", "kept", "linked", "x", "y", "many", part("x").alias("at"), part("y").alias("to")), "first-tokens")


def _linked(diffs: DataFrame, s: Near) -> DataFrame:
    """(node, component) by the links to references and those between members of one reference.

    Two members with ``d_u`` and ``d_v`` differences, ``o`` of them shared, are
    apart by ``d_u + d_v - 2 o``. With ``x = (100 + t) d - (100 - t) n`` a link
    asks ``x_u + x_v <= 2 (100 + t) o``, and a member is linked with the
    reference if its x is below ``(100 - t) n_ref + 1``, the floor. A pair of two
    such members is in one component already; the others' x is the larger.

    Differences stand in one order, the rarest within the reference's members
    first; those without an unlinked member besides count for none. A pair
    meets at the first one that it shares. Having ``left`` of them from there
    on, u shares no more, so with ``y = 2 (100 + t) left - x`` a link asks
    ``x_v <= y_u`` and ``x_u <= y_v``. A difference that most members share
    comes last, has few left, and lets only those meet that have hardly any
    others. As x_u lies between x_v and y_v, or both are ranked as the floor,
    members of large buckets meet by classes of x, a constant ratio wide; a
    member's classes are a bounded number, as y_v - x_v is at most
    ``2 (100 - t) n_v``.

    First every member of a bucket meets two members of it, which joins most of
    what belongs together; then only members of different components meet, and
    the pairs that are linked join these components.
    """
    t, whole = s.percent, 100 + s.percent
    outside = diffs.filter("not linked").select("ref").distinct()
    adds = ((F.col("n") - F.col("n_ref") + F.col("d")) / 2).cast("int")
    rows = diffs.filter("members > 1").join(outside, "ref").select(
        "ref", "node", "n", "d", "linked", "tokens", (F.col("n") - adds).alias("kept"), (F.col("d").cast("long") * whole - F.col("n").cast("long") * (100 - t)).alias("x"), (F.col("n_ref").cast("long") * (100 - t) + 1).alias("floor")
    )
    first = _first_tokens(rows, s)
    met = stored(_pivots(first), "pivots")
    near = _confirmed(met, diffs, s).select("u", "v")
    by_ref = diffs.filter("linked").select(F.col("node").alias("u"), F.col("ref").alias("v"))
    found = components(near.unionByName(by_ref))
    named = first.join(found, "node", "left").withColumn("c", F.coalesce("component", "node"))
    side = lambda of, end: of.select("ref", "token", "part", F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("c", "n", "kept", "linked", "x", "y")])
    larger = side(named.filter("not linked").withColumn("part", F.col("at")), "u")
    lesser = side(named.filter("at <= to").withColumn("part", F.explode(F.sequence("at", "to"))), "v")
    ranked = F.col("linked_v") | (F.struct("x_u", "u") > F.struct(F.col("x_v").alias("x_u"), F.col("v").alias("u")))
    apart = (F.col("c_u") != F.col("c_v")) & ranked & (F.col("x_v") <= F.col("y_u")) & (F.col("x_u") <= F.col("y_v"))
    sized = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * t
    asked, least = (F.col("n_u") + F.col("n_v")) * t, F.least("kept_u", "kept_v") * whole
    enough = asked - least <= F.least(F.col("n_u") - F.col("kept_u"), F.col("n_v") - F.col("kept_v")) * whole
    pairs = larger.join(lesser, ["ref", "token", "part"]).filter(apart & sized & enough)
    pairs = stored(pairs.select("ref", "u", "v", "c_u", "c_v").distinct(), "across")
    return joined_on(found, _confirmed(pairs, diffs, s).select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))


def members(docs: DataFrame, id_col: str, text_col: str, s: Near) -> DataFrame:
    """One row per document: (id, text_key, n_shingles, c); c names the component, null without words."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stored(_sketch(slim, s), "sketch")
    worded = sketch.filter("node is not null")
    nodes = stored(worded.groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "nodes")
    buckets = stored(_bands(nodes, s).groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    near = stored(_in_buckets(nodes, buckets, s), "near")
    # a member that its signature rules out is still of use if its reference has other members
    stars = stored(_agreeing(stored(_stars(near, buckets), "stars"), near, s).filter("alike or members > 1"), "agreeing")
    wanted = stars.select(F.explode(F.array("id_node", "id_ref")).alias("id"))
    diffs = stored(_differences(stars, stored(_sets_of(slim, wanted, s), "sets"), s), "differences")
    labels = _linked(diffs, s)
    label = F.coalesce("component", "node")
    named = worded.select("id", "text_key", "n_shingles", "node").join(labels, "node", "left").select("id", "text_key", "n_shingles", label.alias("c"))
    return stored(named.unionByName(sketch.filter("node is null").select("id", "text_key", "n_shingles", F.lit(None).cast("binary").alias("c"))), "members")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    found = members(docs, id_col, text_col, near)
    linked = found.filter("c is not null")
    least = stored(linked.groupBy("c").agg(F.min("id").alias("component_id")), "least-ids")
    rows = linked.join(least, "c").select("id", "n_shingles", "component_id").unionByName(found.filter("c is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Near = Near()) -> DataFrame:
    """The input's columns, one row of each component: that with the smallest id (and, of equal
    ids, the smallest text hash; of equal rows any one). Rows without words all stay."""
    found = members(docs, id_col, text_col, near).filter("c is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("first")
    keep = stored(found.groupBy("c").agg(first).select(F.col("first.id").alias("_n_id"), F.col("first.text_key").alias("_n_key")), "kept-ids")
    worded = F.coalesce(F.col(text_col).rlike(NOT_BLANK), F.lit(False))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_n_id")) & (F.xxhash64(text_col) == F.col("_n_key"))
    kept = docs.filter(worded).join(keep, same).dropDuplicates(["_n_id", "_n_key"]).select(*docs.columns)
    return kept.unionByName(docs.filter(~worded))
