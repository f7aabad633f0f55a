"""SentencePiece-style Unigram encoding and decoding (operator 2).

Pieces and their scores come from a model file. A double-array trie finds the
pieces that begin at a place; Viterbi picks the segmentation with the largest
sum of scores. Blanks are written as the marker U+2581 with one before the
text, and characters that no piece covers fall back to byte pieces. Pieces
never reach over the marker of a following word, so each distinct word is
segmented once per task, all words of a slice side by side.

Defined results: a null or empty text has no ids and score 0; of segmentations
with equal scores the one whose last piece is longest wins, place by place;
characters U+2581 in a text decode as blanks, everything else comes back as it
was; repeated rows are encoded each on its own; an empty table gives an empty
result; ``encode`` and ``decode`` keep all other columns of their input, and
refuse one that has the name of a column that they add.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks

MARKER = "▁"
LONG_WORD = 192
#: Words that a worker keeps the ids of, and text it segments at once: a few 100 MB in all.
CACHED_WORDS = 300_000
SLICE_BYTES = 3 << 20
UNKNOWN_COST = 10.0
ROOT = 1


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[bytes]  # what each id decodes to
    scores: np.ndarray
    byte_ids: np.ndarray  # of the 256 byte pieces, -1 without
    unknown: int
    base: np.ndarray  # double array: a child by byte c of state s stands at base[s] + c + 1 ...
    check: np.ndarray  # ... where check names s
    value: np.ndarray  # the id of the piece that ends in a state, or -1


def double_array(words: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The double-array trie of ``words``, states placed first-fit in breadth-first order."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, number in zip(words, ids):
        node = 0
        for c in word:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = number
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [0] * size, [-1] * size
    check[0] = check[ROOT] = -1
    queue, lone_from, several_from = [(0, ROOT)], 300, 1
    for node, state in queue:
        value[state] = ends[node]
        own = sorted(children[node])
        if not own:
            continue
        while check[lone_from]:
            lone_from += 1
        at, tries = (lone_from - own[0] - 1, 0) if len(own) == 1 else (several_from, 0)
        while any(check[at + c + 1] for c in own):
            at, tries = at + 1, tries + 1
            if at + 600 >= len(base):
                base, check, value = base + [0] * size, check + [0] * size, value + [-1] * size
        if len(own) > 1 and tries > 64:
            several_from = at - 32  # crowded up to here; single children fill the gaps
        base[state] = at
        for c in own:
            check[at + c + 1] = state
            queue.append((children[node][c], at + c + 1))
        if lone_from + 600 >= len(base):
            base, check, value = base + [0] * size, check + [0] * size, value + [-1] * size
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


def load(path: str) -> Vocabulary:
    """Read pieces and scores from a SentencePiece model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = proto.ModelProto.SentencePiece
    out, byte_ids, unknown, words, ids = [], np.full(256, -1, np.int64), 0, [], []
    for i, p in enumerate(model.pieces):
        if p.type in (kind.NORMAL, kind.USER_DEFINED):
            if MARKER in p.piece.lstrip(MARKER):
                raise ValueError(f"piece {i} reaches over a word's start")
            words.append(p.piece.encode())
            ids.append(i)
            out.append(p.piece.replace(MARKER, " ").encode())
        elif p.type == kind.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            out.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            unknown = i if p.type == kind.UNKNOWN else unknown
            out.append(" ⁇ ".encode() if p.type == kind.UNKNOWN else b"")
    return Vocabulary(out, np.array([p.score for p in model.pieces]), byte_ids, unknown, *double_array(words, ids))


class Unigram:
    def __init__(self, vocabulary: Vocabulary, cached_words: int = CACHED_WORDS):
        self.v = vocabulary
        known = self.v.value[self.v.value >= 0]
        self.unknown_score = float(self.v.scores[known].min()) - UNKNOWN_COST if len(known) else -UNKNOWN_COST
        self.has_bytes = bool((vocabulary.byte_ids >= 0).all())
        self.memo = chunks.Memo(self.encode_words, cached_words)

    def _fallback(self, data: np.ndarray, at: int, size: int) -> list[int]:
        """Ids, in order, of a character that no piece covers."""
        return self.v.byte_ids[data[at : at + size]].tolist() if self.has_bytes else [self.v.unknown]

    def one(self, word: bytes) -> tuple[list[int], float]:
        """Viterbi over one word, place by place: the plain form, used for very long words."""
        v, n = self.v, len(word)
        base, check, value, scores = _lists(v)
        best, back = [-np.inf] * n + [-np.inf], [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = word[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, end, covered, here = ROOT, at, False, best[at]
            while end < n:
                nxt = base[state] + word[end] + 1
                if check[nxt] != state:
                    break
                state, end = nxt, end + 1
                piece = value[state]
                if piece >= 0:
                    covered |= end - at == size
                    if here + scores[piece] > best[end]:
                        best[end], back[end] = here + scores[piece], (at, piece)
            if not covered and here + self.unknown_score > best[at + size]:
                best[at + size], back[at + size] = here + self.unknown_score, (at, -1)
            at += size
        out, end, data = [], n, np.frombuffer(word, np.uint8)
        while end > 0:
            start, piece = back[end]
            out.append([piece] if piece >= 0 else self._fallback(data, start, end - start))
            end = start
        return [x for own in out[::-1] for x in own], best[n]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over all words side by side: ids, ids of each word, score of each word.

        Step p handles, in every word longer than p, the pieces that begin at
        its byte p; the walk through the trie goes on for the words whose
        bytes still match.
        """
        v = self.v
        raw = [w.replace(" ", MARKER).encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        score, counts = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        long: dict[int, list[int]] = {}
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            long[i], score[i] = self.one(raw[i])
            counts[i] = len(long[i])
        order = np.flatnonzero(sizes <= LONG_WORD)
        order = order[np.argsort(-sizes[order], kind="stable")]
        if len(order):
            data = np.frombuffer(b"".join(raw[i] for i in order) + b"\0" * 4, np.uint8)
            size = sizes[order]
            off = np.cumsum(size) - size
            slot = off + np.arange(len(order))  # one more place than bytes in each word
            best = np.full(int(size.sum()) + len(order), -np.inf)
            back = np.zeros(len(best), np.int64)
            piece = np.full(len(best), -1, np.int64)
            best[slot] = 0.0
            for p in range(int(size.max())):
                live = np.arange(np.searchsorted(-size, -p, "left"))  # the words longer than p
                lead = data[off[live] + p]
                live, lead = live[(lead & 0xC0) != 0x80], lead[(lead & 0xC0) != 0x80]
                width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
                here, covered = best[slot[live] + p], np.zeros(len(live), bool)
                row, state, d = np.arange(len(live)), np.full(len(live), ROOT, np.int64), 0
                while len(row):
                    inside = size[live[row]] > p + d
                    row, state = row[inside], state[inside]
                    nxt = v.base[state] + data[off[live[row]] + p + d].astype(np.int64) + 1
                    ok = v.check[nxt] == state
                    row, state, d = row[ok], nxt[ok], d + 1
                    found = v.value[state]
                    hit = np.flatnonzero(found >= 0)
                    if len(hit):
                        own, which = row[hit], found[hit]
                        covered[own] |= width[own] == d
                        total, to = here[own] + v.scores[which], slot[live[own]] + p + d
                        better = total > best[to]
                        to = to[better]
                        best[to], back[to], piece[to] = total[better], p, which[better]
                row = np.flatnonzero(~covered)
                total, to = here[row] + self.unknown_score, slot[live[row]] + p + width[row]
                better = total > best[to]
                to, row = to[better], row[better]
                best[to], back[to], piece[to] = total[better], p, -1
            score[order] = best[slot + size]
            at, word, steps = size.copy(), np.arange(len(order)), []
            while len(word):
                here = slot[word] + at[word]
                steps.append((word, piece[here], back[here], at[word].copy()))
                at[word] = back[here]
                word = word[at[word] > 0]
            of = np.concatenate([s[0] for s in steps])
            which, start, end = (np.concatenate([s[k] for s in steps]) for k in (1, 2, 3))
            rank = np.argsort(of * (LONG_WORD + 1) + start)
            of, which, start, end = of[rank], which[rank], start[rank], end[rank]
            lost = which < 0
            n = np.where(lost & self.has_bytes, end - start, 1)
            which = np.repeat(np.where(lost, self.v.unknown, which), n)
            if self.has_bytes and lost.any():
                which[np.repeat(lost, n)] = self.v.byte_ids[data[chunks.ranges(off[of[lost]] + start[lost], n[lost])]]
            own = np.bincount(of, weights=n, minlength=len(order)).astype(np.int64)
            counts[order] = own
            begin = np.zeros(len(raw), np.int64)
            begin[order] = np.cumsum(own) - own
        else:
            which, begin = np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        for i, own_ids in long.items():
            begin[i] = len(which)
            which = np.append(which, own_ids)
        return which[chunks.ranges(begin, counts)].astype(np.uint32), counts, score

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, ids of each text, score of each text.

        Words are split at blanks; texts with blanks side by side are split
        before runs of blanks, since pieces of several markers may cover them.
        """
        texts = pc.fill_null(texts, "")
        doubled = pc.match_substring(pc.binary_join_element_wise(" ", texts, ""), "  ").to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        plain, runs = np.flatnonzero(~doubled & ~empty), np.flatnonzero(doubled)
        parted = pc.split_pattern(texts.take(pa.array(plain)), " ")
        marked = pc.binary_join_element_wise(" ", parted.flatten(), "")
        own = [re.findall(" +[^ ]*", " " + t) for t in texts.take(pa.array(runs)).to_pylist()]
        words, counts = chunks.interleaved(
            len(texts),
            [
                (plain, marked, pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)),
                (runs, pa.array([c for x in own for c in x], pa.string()), np.array([len(x) for x in own], np.int64)),
            ],
        )
        return self.memo.texts(words, counts)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.v.pieces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=1)
def _lists_of(key: int) -> dict:
    return {}


def _lists(v: Vocabulary) -> tuple[list, list, list, list]:
    """The trie as lists, which are faster one place at a time."""
    held = _lists_of(id(v))
    if not held:
        held["lists"] = (v.base.tolist(), v.check.tolist(), v.value.tolist(), v.scores.tolist())
    return held["lists"]


_WORKERS: dict[str, Unigram] = {}


def _worker(key: str, vocabulary, cached_words: int) -> Unigram:
    """One encoder in each Python worker, which its later tasks use too."""
    if key not in _WORKERS:
        _WORKERS[key] = Unigram(vocabulary.value, cached_words)
    return _WORKERS[key]


def _extended(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    clash = {c.lower() for c in df.columns} & {n for n, _ in added}
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    return T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in added)])


def _spare(v: Vocabulary) -> np.ndarray:
    """Which ids are byte pieces or the unknown one."""
    out = np.zeros(len(v.pieces) + 1, bool)
    out[v.byte_ids[v.byte_ids >= 0]] = out[v.unknown] = True
    return out


def _encoded(unigram: Unigram, texts: pa.Array, spare: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """The four columns that encoding adds, all ids, and where each text's begin."""
    ids, sizes, score = unigram.encode(texts)
    offsets = np.append(0, np.cumsum(sizes))
    lost = np.diff(np.append(0, np.cumsum(spare[ids]))[offsets])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return [lists, pa.array(sizes), pa.array(lost), pa.array(score)], ids, offsets


def encode(docs: DataFrame, model: str, text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """Add piece_ids, n_pieces, n_fallback (byte and unknown ids) and piece_score.

    The trie is built once on the driver and sent to the workers; its size is
    that of the model file's vocabulary.
    """
    v = load(model)
    sent = docs.sparkSession.sparkContext.broadcast(v)
    schema = _extended(docs, [("piece_ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("n_fallback", T.LongType()), ("piece_score", T.DoubleType())])
    spare = _spare(v)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _worker(model, sent, cached_words)
        for batch in batches:
            for a, b in chunks.slices(batch.column(place), SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *_encoded(unigram, part.column(place), spare)[0]], schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "piece_ids") -> DataFrame:
    """Add decoded_text; null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(model))
    schema = _extended(encoded, [("decoded_text", T.StringType())])
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _worker(model, sent, 0)
        for batch in batches:
            texts = (None if x is None else unigram.decode(x) for x in (own.as_py() for own in batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded_text"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, id_cols: list[str], text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """Encode, decode, and say whether the text came back (null and empty: true).

    Both in one pass, so that a task holds one worker and texts do not travel twice.
    """
    v = load(model)
    sent = docs.sparkSession.sparkContext.broadcast(v)
    slim = docs.select(*id_cols, F.col(text_col).alias("text"))
    added = [("piece_ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("n_fallback", T.LongType()), ("piece_score", T.DoubleType()), ("round_trip", T.BooleanType())]
    schema = _extended(slim.drop("text"), added)
    spare = _spare(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = _worker(model, sent, cached_words)
        for batch in batches:
            for a, b in chunks.slices(batch.column(len(id_cols)), SLICE_BYTES):
                part = batch.slice(a, b - a)
                columns, ids, offsets = _encoded(unigram, part.column(len(id_cols)), spare)
                texts = part.column(len(id_cols))
                back = (unigram.decode(ids[x:y].tolist()) == (texts[k].as_py() or "").replace(MARKER, " ") for k, (x, y) in enumerate(zip(offsets[:-1], offsets[1:])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(id_cols)], *columns, pa.array(back, pa.bool_())], schema.names)

    return slim.mapInArrow(run, schema)
