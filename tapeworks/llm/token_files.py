"""Token ids in grammar-compressed shards (operator 10).

Documents are dealt by ranges of their ids, encoded, closed with an end id and
packed into shards of whole documents. Each shard is compressed on its own by
Re-Pair: the frequent pairs of neighbouring symbols (16 places or more) become
nonterminals, again and again, until no pair is frequent; symbols take 16 bits,
or 32 where there are more than 65,536. A file row holds the shard's document
ids and token counts, the rules, each rule's expansion length and the
remaining sequence as little-endian integers; the expansion lengths let any
token range be decoded without its predecessors. Files are Parquet tables of
such rows, so that Spark's commit protocol covers lost tasks.

Defined results: a null text counts as empty and holds the end id alone; null
ids sort first; rows that share an id are ordered by their text's hash; a very
long text makes a shard of its own; an empty table gives no shards. Other
columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .common import executors_tasks, scratch_path, stored, text_of

END_ID = 2
#: Pieces that a worker keeps the ids of, and their bytes.
CACHED_CHUNKS = 700_000
CACHED_BYTES = 64 << 20
SHARD_SCHEMA = "part int, shard int, doc_ids array<bigint>, doc_tokens array<bigint>, n_tokens bigint, base int, rules binary, lengths binary, sequence binary"
#: A character that no blank class knows; only before these is a blank surely the start of a pre-token.
SOLID = re.compile(r" (?=[!-~¡-¬®-ᙿᚁ-᠍᠐-῿‐-‧‰-⁞⁰-⿿、-퟿-﻾＀-\U0010ffff])")


#: Marks that form one pre-token after a word; the apostrophe is left out, for contractions.
MARKS = ".,!?;:*#$%&"
LATIN_END = "\u0250"
NOT_LATIN = r"[^\x00-\x{24F}]"


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's printable stand-in for each byte: itself, or the next free code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in plain]
    return {x: x for x in plain} | {x: 256 + i for i, x in enumerate(others)}


def _rest(texts: pa.Array, begins: pa.Array) -> pa.Array:
    """What follows in each text after its beginning, which ends before an ASCII character or with the text."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes = np.diff(at) - pc.binary_length(begins).to_numpy(zero_copy_only=False)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[chunks.ranges(at[1:] - sizes, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))


class Pieces:
    """Ids of pieces, by piece; ``encode`` gives those of new ones, and how many each has.

    With more than ``most`` pieces or ``most_bytes`` held, those that the
    latest slice did not use are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, most_bytes: int = CACHED_BYTES):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.known, self.ids, self.starts, self.sizes = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def entries(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces, to look up in ``starts`` and ``sizes``."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            added = pieces.take(pa.array(new))
            if len(self.known) + len(added) > self.most or self.known.nbytes + added.nbytes > self.most_bytes:
                held = at[at >= 0]
                self.known = self.known.take(pa.array(held))
                self.ids, self.sizes = self.ids[chunks.ranges(self.starts[held], self.sizes[held])], self.sizes[held]
                self.starts = np.cumsum(self.sizes) - self.sizes
                at[at >= 0] = np.arange(len(held))
            ids, sizes = self.encode(added.to_pylist())
            at[new] = len(self.known) + np.arange(len(new))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
            self.known = pa.concat_arrays([self.known, added])
        return at


class BpeEncoder:
    """The tokenizers library over whole texts, remembering pieces.

    A chunk of one Latin word and marks after it is two pre-tokens: the word
    goes to the library's model, the marks are remembered on their own. Other
    chunks are one piece and go through the library's whole encoding.
    """

    def __init__(self, path: str, cached_chunks: int = CACHED_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base, self.model = self.tokenizer.get_vocab_size(), self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.letters = byte_letters()
        self.first = chunks.Memo(lambda texts: (*self._encode(texts), np.zeros(len(texts))), cached_chunks // 8)
        self.after_blank, self.marks = Pieces(self._encode_after_blank, cached_chunks), Pieces(self._encode_marks, cached_chunks // 8)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._packed([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    @staticmethod
    def _packed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _word(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def _encode_after_blank(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.byte_level:
            return self._encode([" " + c for c in parts])
        blank, tokenize = chr(self.letters[32]), self.model.tokenize
        flat: list[int] = []  # no list per piece stays, which the garbage collector would go through
        ends, others = np.zeros(len(parts), np.int64), []
        for i, c in enumerate(parts):
            if c.isascii() and c.isalpha():  # letters that stand for themselves
                flat += [t.id for t in tokenize(blank + c)]
            elif c.isalpha() and max(c) < LATIN_END:
                flat += self._word(" " + c)
            else:
                others.append(i)
            ends[i] = len(flat)
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        ids, sizes[others] = self._encode([" " + parts[i] for i in others])
        starts[others] = len(flat) + np.cumsum(sizes[others]) - sizes[others]
        return np.concatenate([np.array(flat, np.uint32), ids])[chunks.ranges(starts, sizes)], sizes

    def _encode_marks(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._packed([self._word(c) if c else [] for c in parts])

    def _after_blanks(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks that follow a blank and how many each has."""
        coded = parts.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        if not self.byte_level:
            entry = self.after_blank.entries(distinct)[which]
            sizes = self.after_blank.sizes[entry]
            return self.after_blank.ids[chunks.ranges(self.after_blank.starts[entry], sizes)], sizes
        body = pc.utf8_rtrim(distinct, MARKS)
        cut = pc.and_(pc.utf8_is_alpha(body), pc.invert(pc.match_substring_regex(body, NOT_LATIN)))
        before = pc.if_else(cut, body, distinct)
        sides = []
        for held, pieces in ((self.after_blank, before), (self.marks, _rest(distinct, before))):
            own = pieces.dictionary_encode()
            entry = held.entries(own.dictionary)[own.indices.to_numpy(zero_copy_only=False)]
            sides.append((held.ids, held.starts[entry], held.sizes[entry]))
        (ids, starts, sizes), (mark_ids, mark_starts, mark_sizes) = sides
        starts, mark_starts = starts[which], mark_starts[which] + len(ids)
        sizes, mark_sizes = sizes[which], mark_sizes[which]
        some = np.flatnonzero(mark_sizes)  # marks stand in between, behind their word
        places = chunks.ranges(np.insert(starts, some + 1, mark_starts[some]), np.insert(sizes, some + 1, mark_sizes[some]))
        return np.concatenate([ids, mark_ids])[places], sizes + mark_sizes

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Chunks and how many each text has; blanks that may not begin a pre-token do not split.

        The first byte tells: printable ASCII and the Latin letters' lead
        bytes are sure. Texts with another one are split by a slower pattern.
        """
        parted = pc.split_pattern(texts, " ")
        values, lengths = parted.flatten(), pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        data = np.append(np.frombuffer(values.buffers()[2] or b"", np.uint8), np.uint8(0))
        lead = np.where(np.diff(at) > 0, data[at[:-1]], 0)
        unsure = ~(((lead > 0x20) & (lead < 0x7F)) | ((lead >= 0xC3) & (lead <= 0xC9)))
        unsure[offsets[:-1]] = False  # what begins a text follows no blank
        again = np.unique(np.searchsorted(offsets, np.flatnonzero(unsure), "right") - 1)
        plain = np.setdiff1d(np.arange(len(texts)), again)
        if not len(again):
            return values, lengths
        own = [SOLID.split(t) for t in texts.take(pa.array(again)).to_pylist()]
        return chunks.interleaved(
            len(texts),
            [
                (plain, values.take(pa.array(chunks.ranges(offsets[plain], lengths[plain]))), lengths[plain]),
                (again, pa.array([c for x in own for c in x], pa.string()), np.array([len(x) for x in own], np.int64)),
            ],
        )

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and how many each text has."""
        n = len(texts)
        whole = np.zeros(n, bool)
        for token in self.special:  # the library finds these before it splits
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list = [None] * n
        easy = np.flatnonzero(~whole)
        if len(easy):
            split, counts = self._split(texts.take(pa.array(easy)))
            starts = np.cumsum(counts) - counts
            head = self.first.texts(split.take(pa.array(starts)), np.ones(len(easy), np.int64))
            tail, sizes = self._after_blanks(split.take(pa.array(chunks.ranges(starts + 1, counts - 1))))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts - 1)]
            for row, a, b in zip(easy, np.split(head[0], np.cumsum(head[1])[:-1]), np.split(tail, ends[:-1])):
                out[row] = np.concatenate([a, b, [END_ID]]).astype(np.uint32)
        for row in np.flatnonzero(whole):
            out[row] = np.append(self._encode([texts[int(row)].as_py()])[0], END_ID).astype(np.uint32)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, n)


@functools.cache
def _encoder(path: str, cached_chunks: int) -> BpeEncoder:
    """One encoder in each Python worker, which its later tasks use too."""
    return BpeEncoder(path, cached_chunks)


def _by_pair(seq: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``places`` sorted by the pair that stands there, where each pair begins among them, and how many it has."""
    left, right = seq[places].astype(np.uint64), seq[places + 1].astype(np.uint64)
    bits, low = int(seq.max()).bit_length(), len(places).bit_length()
    if 2 * bits + low <= 64:  # one number holds pair and place
        packed = ((left << np.uint64(bits) | right) << np.uint64(low)) | np.arange(len(places), dtype=np.uint64)
        packed.sort()
        key = packed >> np.uint64(low)
        places = places[(packed & np.uint64((1 << low) - 1)).astype(np.int64)]
    else:
        key = (left << np.uint64(32)) | right
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return places, first, np.diff(np.append(first, len(key)))


def compress(ids: np.ndarray, base: int, least: int = 16, rules_a_round: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules, expansion length of each rule, remaining sequence).

    Each round counts the neighbouring pairs exactly, makes nonterminals of
    the most frequent ones and replaces them; of overlapping places every other
    one is taken, from the left. Rounds go on until no pair stands at ``least``
    places. Pairs of old symbols only get rarer, so after the first round those
    that were frequent and those with a new symbol are counted.
    """
    seq = ids.astype(np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    may = np.arange(len(seq)) < len(seq) - 1  # places whose pair may be frequent
    while may.any():
        places, first, counts = _by_pair(seq, np.flatnonzero(may))
        often = np.flatnonzero(counts >= least)
        may[:] = False
        may[places[chunks.ranges(first[often], counts[often])]] = True
        if not len(often):
            break
        often = np.sort(often[np.argsort(-counts[often], kind="stable")[:rules_a_round]])
        at = places[first[often]]
        number = np.full(len(seq), -1, np.int32)
        number[places[chunks.ranges(first[often], counts[often])]] = np.repeat(np.arange(len(often)), counts[often])
        places = np.flatnonzero(number >= 0)
        run = np.append(True, np.diff(places) != 1)
        run_start = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run_start) % 2 == 0]
        taken = np.bincount(number[places], minlength=len(often)) > 0
        rule = (np.cumsum(taken) - 1)[number[places]]
        pairs = np.stack([seq[at], seq[at + 1]], axis=1)[taken]
        size = np.where(pairs < base, 1, np.append(lengths, 0)[np.minimum(np.maximum(pairs, base) - base, len(lengths))])
        new = base + len(rules)
        seq[places] = new + rule
        keep = np.ones(len(seq), bool)
        keep[places + 1] = False
        seq, may = seq[keep], may[keep]
        fresh = seq >= new
        may |= fresh
        may[:-1] |= fresh[1:]
        may[-1] = False
        lengths = np.append(lengths, size.sum(axis=1).astype(np.uint32))
        rules = np.vstack([rules, pairs])
    return rules, lengths, seq


def _wide(base: int, rules: int) -> type:
    return np.uint16 if base + rules <= 1 << 16 else np.uint32


class Shard:
    """A compressed shard: whole or by ranges of tokens."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, sequence: bytes):
        self.base = base
        self.rules, self.lengths = np.frombuffer(rules, "<u4").reshape(-1, 2), np.frombuffer(lengths, "<u4")
        self.sequence = np.frombuffer(sequence, np.dtype(_wide(base, len(self.rules))).newbyteorder("<"))

    def whole(self) -> np.ndarray:
        """All tokens: rules are expanded level by level into one table, which the sequence gathers from."""
        rules = self.rules.astype(np.int64)
        sizes = np.append(np.ones(self.base, np.int64), self.lengths.astype(np.int64))
        starts = np.cumsum(sizes) - sizes
        table = np.zeros(int(sizes.sum()), np.uint32)
        table[: self.base] = np.arange(self.base)
        done = np.arange(len(sizes)) < self.base
        while not done.all():
            ready = np.flatnonzero(~done[self.base :] & done[rules].all(axis=1))
            at = starts[self.base + ready]
            for side in (0, 1):
                symbol = rules[ready, side]
                table[chunks.ranges(at, sizes[symbol])] = table[chunks.ranges(starts[symbol], sizes[symbol])]
                at = at + sizes[symbol]
            done[self.base + ready] = True
        return table[chunks.ranges(starts[self.sequence], sizes[self.sequence])]

    def some(self, start: int, size: int) -> np.ndarray:
        """Tokens start .. start + size, going only into the symbols that hold them."""
        sizes = np.append(np.ones(self.base, np.int64), self.lengths.astype(np.int64))[self.sequence]
        ends = np.cumsum(sizes)
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + size, "left")
        out, stack = [], [int(x) for x in self.sequence[first : last + 1][::-1]]
        skip, want = start - int(ends[first] - sizes[first]) if first < len(ends) else 0, size
        while stack and want > 0:
            symbol = stack.pop()
            own = 1 if symbol < self.base else int(self.lengths[symbol - self.base])
            if skip >= own:
                skip -= own
            elif symbol < self.base:
                out.append(symbol)
                want -= 1
            else:
                left, right = self.rules[symbol - self.base].tolist()
                stack += [right, left]
        return np.array(out, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20, cached_chunks: int = CACHED_CHUNKS) -> str:
    """Encode every text and write the shards in ascending order of ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).repartitionByRange(executors_tasks(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, cached_chunks)
        part, shard = TaskContext.get().partitionId(), 0
        ids, counts, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            rules, lengths, seq = compress(np.concatenate(held), encoder.base)
            row = [part, shard, [x for own in ids for x in own], np.concatenate(counts).tolist(), total, encoder.base, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(np.dtype(_wide(encoder.base, len(rules))).newbyteorder("<")).tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks.slices(texts):
                flat, sizes = encoder.encode(texts.slice(a, b - a))
                names, ends, done = batch.column(0).slice(a, b - a).to_pylist(), np.cumsum(sizes), 0
                while done < len(sizes):  # whole documents up to shard_tokens
                    before = ends[done - 1] if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, before + shard_tokens - total, "right"))) if total < shard_tokens else done
                    if upto == done or (total and ends[upto - 1] - before + total > shard_tokens):
                        yield close()
                        ids, counts, held, total, shard = [], [], [], 0, shard + 1
                        continue
                    ids.append(names[done:upto])
                    counts.append(sizes[done:upto])
                    held.append(flat[before : ends[upto - 1]])
                    total, done = total + int(ends[upto - 1] - before), upto
        if held:
            yield close()

    rows.mapInArrow(pack, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start): tokens of all shards before, counted in two steps.

    The first step adds up one row per part, the second orders the shards
    within their own part.
    """
    sizes = stored(shards.select("part", "shard", "n_tokens"), "token-sizes")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "shard", (F.col("before") + F.col("within")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    schema = "doc_id long, part int, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(Shard(row["base"], row["rules"], row["lengths"], row["sequence"]).whole().astype("<u4").tobytes())
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                n = len(sizes)
                parts = [data[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    shards = read_shards(spark, path)
    docs = shards.select("part", "shard", "doc_ids", "doc_tokens", "base", "rules", "lengths", "sequence").mapInArrow(unpack, schema)
    return docs.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files into the shared folder and read them back."""
    return read_documents(docs.sparkSession, write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer))
