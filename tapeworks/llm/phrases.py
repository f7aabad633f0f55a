"""Phrase collocation mining by best-first branch and bound (operator 12).

A phrase of two to five words scores, per language, the least over its cuts of
``floor(1000 * a * n / (l * r))``: its own count and those of both parts. As no
part is rarer than the whole, a phrase that begins with word w scores
``floor(1000 * n / f(w))`` at most: the count of a prefix's first word bounds
all that grows from it. Words are expanded in falling order of that bound, a
share of the corpus's words a round: all phrases from them are counted, and a
language is settled when ``top`` surviving scores lie above the bound of every
word left, so that ties are settled as well. The last round expands the rest.

Every pass reads whole texts once. Within a task, words are codes of a
dictionary and phrases are counted by codes, so counts belong to the words
themselves, never to hashes; only filters that may let too much through go by
hashes (frequent words, pairs of words found often enough, expanded words,
phrases asked for). What a task has counted is summed up before it is shuffled.

Defined results: a null or empty text has no words; a null language is
``und``, together with rows that say so; repeated rows and rows without id
count each on their own; ties go by count, then by phrase in byte order; with
fewer survivors than ``top`` all are returned; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps, hashing
from .chunks import slices
from .common import stored

LONGEST = 5
SLICE_BYTES = 1 << 20
#: Rows of counts that a task holds before it sums and, if they stay, hands them on.
HELD_ROWS = 1 << 18
SALTS = 32
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"


@dataclass(frozen=True)
class Phrases:
    least: int = 100
    top: int = 2000
    #: Shares of all words that rounds have expanded; one more round expands the rest.
    shares: tuple[float, ...] = (0.1,)


_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.LargeStringArray, lang: str) -> np.ndarray:
    """Hashes of the words of one language, for filters only."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: int(offsets[-1])]
    return hashing.mix(hashing.of_ranges(hashing.running(data), offsets[:-1], offsets[1:]) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def extended(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    h = (h ^ (h >> np.uint64(31))) * _MIX + words
    return h ^ (h >> np.uint64(29))


def phrase_hashes(phrases: pa.Array, lang: str) -> np.ndarray:
    split = pc.split_pattern(phrases.cast(pa.large_string()), " ")
    sizes = split.value_lengths().to_numpy(zero_copy_only=False)
    flat = pa.concat_arrays([split.flatten().slice(0, 0), split.flatten()])
    own, starts = word_hashes(flat, lang) if len(flat) else np.zeros(0, np.uint64), np.cumsum(sizes) - sizes
    h = own[starts]
    for k in range(1, LONGEST):
        more = sizes > k
        h[more] = extended(h[more], own[starts[more] + k])
    return h


class Slice:
    """The words of some texts of one language, in order: codes, hashes and how many follow in the piece."""

    def __init__(self, lang: str, texts: pa.Array):
        texts = pc.ascii_lower(pa.concat_arrays([texts.slice(0, 0), texts]))  # a copy whose bytes begin with the first text
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: int(sizes.sum())]
        kind = _KIND[data]
        inside = kind == 0
        text_starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        first = np.zeros(len(data) + 1, bool)
        first[text_starts] = first[-1] = True
        starts = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (first[1:] | ~np.append(inside[1:], False))) + 1
        lengths = ends - starts
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))
        coded = words.dictionary_encode()
        self.lang, self.words = lang, coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.searchsorted(np.flatnonzero((kind == 2) | first[:-1]), starts, "right")
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(piece) else np.zeros(0, np.int64)
        #: Words from each place to the end of its piece, itself included.
        self.room = np.repeat(last + 1, np.diff(last, prepend=-1)) - np.arange(len(starts))
        self._hashes: np.ndarray | None = None

    @property
    def word_hashes(self) -> np.ndarray:
        """The hash of each distinct word."""
        if self._hashes is None:
            self._hashes = word_hashes(self.words, self.lang)
        return self._hashes

    def phrases(self, at: np.ndarray, n: int) -> tuple[list[str], np.ndarray]:
        """The distinct phrases of ``n`` words that start at ``at``, and how often each does."""
        ids = self.codes[at]
        for k in range(1, n):
            _, ids = np.unique(ids * len(self.words) + self.codes[at + k], return_inverse=True)
        _, first, counts = np.unique(ids, return_index=True, return_counts=True)
        columns = [self.words.take(pa.array(self.codes[at[first] + k])) for k in range(n)]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if n > 1 else columns[0], counts


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """The texts of (lang, text) batches by language, some megabytes at a time."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for no, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, no))
            for a, b in slices(texts, SLICE_BYTES):
                yield Slice(lang, texts.slice(a, b - a).cast(pa.large_string()))
        pa.default_memory_pool().release_unused()


class Counts:
    """Counts by (lang, key), summed up within the task."""

    def __init__(self, key: pa.Field):
        self.schema = pa.schema([("lang", pa.string()), key, ("n", pa.int64())])
        self.key, self.held, self.rows = key, [], 0

    def add(self, lang: str, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(n):
            return
        self.held.append(pa.table([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), pa.array(keys, self.key.type) if not isinstance(keys, pa.Array) else keys.cast(self.key.type), pa.array(n, pa.int64())], schema=self.schema))
        self.rows += len(n)
        if self.rows >= HELD_ROWS:
            whole = self.summed()
            self.held, self.rows = [whole], whole.num_rows
            if self.rows >= HELD_ROWS // 2:
                yield from self.flush()

    def summed(self) -> pa.Table:
        out = pa.concat_tables(self.held).group_by(["lang", self.key.name], use_threads=False).aggregate([("n", "sum")])
        return out.rename_columns([{"n_sum": "n"}.get(c, c) for c in out.column_names]).select(self.schema.names).cast(self.schema)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self.summed().to_batches()
        self.held, self.rows = [], 0


PHRASE = pa.field("phrase", pa.string())
COUNTED = "lang string, phrase string, n long"


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """All words by language, each with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(PHRASE)
        for s in cut(batches):
            yield from held.add(s.lang, s.words, np.bincount(s.codes, minlength=len(s.words)))
        yield from held.flush()

    return texts.mapInArrow(count, COUNTED).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


class Filter:
    """A Bloom filter of phrases: it may let others through, never keeps one back."""

    def __init__(self, phrases: DataFrame):
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs = b.column(0).dictionary_encode()
                for no, lang in enumerate(langs.dictionary.to_pylist()):
                    h = phrase_hashes(b.column(1).filter(pc.equal(langs.indices, no)), lang)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

        # written, so that no task runs the Python of two steps at once
        self._fill(stored(phrases.select("lang", "phrase").mapInArrow(hashed, "h long"), "hashes"))

    def _fill(self, hashes: DataFrame) -> None:
        self.log2 = bitmaps.log2_bits(hashes.count())
        self.spark, self.bits = hashes.sparkSession, bitmaps.filled_cells(hashes, "h", 1, self.log2)

    @classmethod
    def of_hashes(cls, hashes: DataFrame) -> Filter:
        out = cls.__new__(cls)
        out._fill(hashes)
        return out

    def shared(self):
        """What tasks call with an array of hashes; 128 MB at most are broadcast."""
        bits, log2 = self.spark.sparkContext.broadcast(self.bits), self.log2
        return lambda h: bitmaps.maybe_in(bits.value, h, log2)


def frequent_pairs(texts: DataFrame, frequent: Filter, least: int) -> DataFrame:
    """Hashes of pairs of neighbouring words that stand ``least`` times or more, or share a hash with such."""
    known = frequent.shared()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            begins = np.flatnonzero(np.append(True, np.diff(h[order]) != 0))
            return h[order[begins]], np.add.reduceat(n[order], begins)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["h", "n"])

        for s in cut(batches):
            if len(s.codes) < 2:
                continue
            often = known(s.word_hashes)[s.codes]
            at = np.flatnonzero((s.room >= 2)[:-1] & often[:-1] & often[1:])
            _, first, n = np.unique(s.codes[at] * len(s.words) + s.codes[at + 1], return_index=True, return_counts=True)
            own = s.word_hashes[s.codes]
            held.append((extended(own[at[first]], own[at[first] + 1]).view(np.int64), n))
            rows += len(n)
            if rows >= 2 * HELD_ROWS:
                yield flushed()
                held, rows = [], 0
        if rows:
            yield flushed()

    # tasks have summed already: rows go straight to the exchange
    counted = texts.mapInArrow(count, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).select("h")


def grown(texts: DataFrame, pairs: Filter, expanded: Filter, least: int) -> DataFrame:
    """All phrases of 2 to 5 words from expanded words with their counts, ``least`` or more."""
    often, wanted = pairs.shared(), expanded.shared()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(PHRASE)
        for s in cut(batches):
            own = s.word_hashes[s.codes]
            linked = np.zeros(len(own), bool)
            linked[:-1] = (s.room[:-1] >= 2) & often(extended(own[:-1], own[1:])) if len(own) else False
            at = np.flatnonzero(wanted(s.word_hashes)[s.codes] & linked)
            for n in range(2, LONGEST + 1):
                if not len(at):
                    break
                yield from held.add(s.lang, *s.phrases(at, n))
                at = at[linked[at + n - 1]]  # the pair that the next word ends is frequent, too
        yield from held.flush()

    return texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def counted(texts: DataFrame, asked: Filter, followed: Filter) -> DataFrame:
    """Counts of the phrases of 2 to 4 words asked for, and of those of ``followed`` with the word before them."""
    wanted, after = asked.shared(), followed.shared()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts(PHRASE)
        for s in cut(batches):
            own = s.word_hashes[s.codes]
            places = np.arange(len(own))
            h, before = own, np.zeros(len(own), bool)
            for n in range(2, LONGEST + 1):
                going = s.room[places] >= n
                places, h = places[going], h[going]
                if not len(places):
                    break
                h = extended(h, own[places + n - 1])
                take = before[places] | (wanted(h) if n < LONGEST else False)
                yield from held.add(s.lang, *s.phrases(places[take], n))
                before = np.zeros(len(own), bool)
                tail = places[after(h) & (places > 0)]
                before[tail[s.room[tail - 1] > n] - 1] = True  # those with one more word before them in the piece
        yield from held.flush()

    return texts.mapInArrow(count, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _first_words(k: Column) -> Column:
    return F.array_join(F.slice("_w", 1, k), " ")


def _cuts(candidates: DataFrame) -> DataFrame:
    """One row per candidate and cut: lang, phrase, a, k, first part, rest."""
    split = candidates.select("lang", "phrase", "a", F.split("phrase", " ").alias("_w"))
    each = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
    return each.select("lang", "phrase", "a", "k", _first_words(F.col("k")).alias("first"), F.array_join(F.slice("_w", F.col("k") + 1, LONGEST), " ").alias("rest"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (left * right))`` without rounding or overflow of 64 bits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def survivors(candidates: DataFrame, words: DataFrame, others: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one contains whenever they stand, with their lowest cut.

    ``others`` holds counts of phrases that are no candidates here; where the
    count of a rest is not known yet, its least possible one stands in, so the
    score is an upper bound. Columns: lang, phrase, a, l, r, n, score.
    """
    all_counts = words.select("lang", "phrase", "f").unionByName(candidates.select("lang", "phrase", F.col("a").alias("f"))).unionByName(others.select("lang", "phrase", "f"))
    counts = all_counts.groupBy("lang", "phrase").agg(F.max("f").alias("f"))  # a phrase can be known from more than one pass
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = _cuts(candidates).join(left, ["lang", "first"]).join(right, ["lang", "rest"], "left").withColumn("r", F.coalesce("r", "a")).join(F.broadcast(totals), "lang")
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = counts.select("lang", "f", F.split("phrase", " ").alias("_w")).filter(F.size("_w") > 2)
    parts = longer.select("lang", "f", F.explode(F.array(F.array_join(F.slice("_w", 1, F.size("_w") - 1), " "), F.array_join(F.slice("_w", 2, LONGEST), " "))).alias("phrase"))
    held = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    open_ = lowest.join(held, ["lang", "phrase"], "left").filter(F.coalesce("longer", F.lit(0)) < F.col("a"))
    return open_.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, cut by salted shares first so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _limits(words: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """The highest count of an expanded word by language: what a power of two allows within the share of all words."""
    steps = words.groupBy("lang", F.floor(F.log2("f")).cast("int").alias("step")).agg(F.sum("f").alias("held"))
    upto = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # 64 rows a language at most
    known = steps.withColumn("held", F.sum("held").over(upto)).join(totals, "lang")
    return known.groupBy("lang", "n").agg(F.coalesce(F.max(F.when(F.col("held") <= share * F.col("n"), F.col("step"))), F.min("step")).alias("step")).select(
        "lang", "n", (F.pow(F.lit(2.0), F.col("step") + 1).cast("long") - 1).alias("limit")
    )


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", how: Phrases = Phrases()) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = _texts(docs, lang_col, text_col)
    every = stored(word_counts(texts), "words")
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = stored(every.filter(F.col("f") >= how.least), "frequent")
    pairs = Filter.of_hashes(stored(frequent_pairs(texts, Filter(words), how.least), "pairs"))
    none = words.limit(0).select("lang", "phrase", "f")
    settled: DataFrame | None = None
    done: DataFrame | None = None
    candidates: DataFrame | None = None
    for share in how.shares:
        limits = stored(_limits(words, totals, share), "limits")
        if done is not None:
            limits = stored(limits.join(done, "lang", "left_anti"), "limits")
        bound = F.floor(F.lit(1000) * F.col("n") / (F.col("limit") + 1))
        # counts of a round hold those of the rounds before it
        first = words.join(F.broadcast(limits), "lang").filter(F.col("f") <= F.col("limit"))
        grew = grown(texts.join(F.broadcast(limits.select("lang")), "lang", "left_semi"), pairs, Filter(first), how.least)
        own = grew.withColumn("w", F.substring_index("phrase", " ", 1)).join(first.select("lang", F.col("phrase").alias("w")), ["lang", "w"]).drop("w")
        candidates = stored(own, "candidates")
        upper = stored(survivors(candidates, words, none, totals).join(F.broadcast(limits.select("lang", bound.alias("bound"))), "lang").filter(F.col("score") > F.col("bound")), "open")
        rests = _cuts(upper).filter(F.contains("rest", F.lit(" "))).select("lang", F.col("rest").alias("phrase")).distinct()
        short = upper.filter(F.size(F.split("phrase", " ")) < LONGEST)
        others = stored(counted(texts, Filter(rests), Filter(short)), "others")
        exact = stored(survivors(candidates, words, others, totals).join(F.broadcast(limits.select("lang", bound.alias("bound"))), "lang").filter(F.col("score") > F.col("bound")), "exact")
        enough = exact.groupBy("lang").count().filter(F.col("count") >= how.top).select("lang")
        done_now = stored(enough, "settled")
        own_result = stored(exact.join(F.broadcast(done_now), "lang", "left_semi").drop("bound"), "result")
        settled = own_result if settled is None else settled.unionByName(own_result)
        done = done_now if done is None else done.unionByName(done_now)
    rest = totals if done is None else totals.join(F.broadcast(done), "lang", "left_anti")
    rest = stored(rest, "unsettled")
    open_words = words.join(F.broadcast(rest.select("lang")), "lang", "left_semi")
    grew = stored(grown(texts.join(F.broadcast(rest.select("lang")), "lang", "left_semi"), pairs, Filter(open_words), how.least), "candidates")
    found = survivors(grew, open_words, none, rest)
    return _ranked(found if settled is None else found.unionByName(settled), how.top)


ORACLE = r"""
with d as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), piece as (
  select lang, doc, unnest(ps) as p, generate_subscripts(ps, 1) as no from (select lang, doc, string_split_regex(t, '[.,;:!?\x0A-\x0D]') as ps from d)
), w as (
  select lang, doc, no, unnest(ws) as word, generate_subscripts(ws, 1) as i
  from (select lang, doc, no, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as ws from piece)
), total as (
  select lang, count(*) as n from w group by lang
), run as (
  select lang, word as w1, lead(word, 1) over z as w2, lead(word, 2) over z as w3, lead(word, 3) over z as w4, lead(word, 4) over z as w5
  from w window z as (partition by doc, no order by i)
), ngram as (
  select lang, 1 as m, [w1] as words from run union all
  select lang, 2, [w1, w2] from run where w2 is not null union all
  select lang, 3, [w1, w2, w3] from run where w3 is not null union all
  select lang, 4, [w1, w2, w3, w4] from run where w4 is not null union all
  select lang, 5, [w1, w2, w3, w4, w5] from run where w5 is not null
), f as (
  select lang, array_to_string(words, ' ') as phrase, m, words, count(*) as f from ngram group by lang, m, words having count(*) >= 100
), c as (
  select * from f where m >= 2 and f >= 100
), cuts as (
  select c.lang, c.phrase, c.m, c.f as a, k, l.f as l, r.f as r, n, cast((cast(1000 as hugeint) * c.f * n) // (cast(l.f as hugeint) * r.f) as bigint) as score
  from (select *, unnest(range(1, m)) as k from c) c
  join total on c.lang = total.lang
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.words[k + 1:], ' ')
), lowest as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts) where place = 1
), held as (
  select lang, array_to_string(words[1:m - 1], ' ') as phrase, f from c where m > 2 union all
  select lang, array_to_string(words[2:], ' ') as phrase, f from c where m > 2
), open as (
  select * from lowest x where not exists (select 1 from held where held.lang = x.lang and held.phrase = x.phrase and 100 * held.f >= 100 * x.a)
)
select * from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from open
) where rank <= 2000
"""
