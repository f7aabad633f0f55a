"""Language identification with error-correcting output codes (operator 8).

Each language has a codeword; binary classifiers over hashed byte trigrams
predict its bits, and loss-weighted decoding picks the nearest codeword.
Classifiers are fitted on the driver on a bounded sample of labelled rows
(``Settings.docs_per_language`` documents of each language, of
``Settings.chars_per_document`` characters each); prediction reads the whole
of every text.

Defined results: a null text or one without a letter is ``und`` with score 0;
a null id is never held out and never learned from; without any labelled row
every text is ``und``; with one language, every text with letters gets it;
equal losses go to the first language in alphabetical order. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 300
    chars_per_document: int = 20_000  # of the fitting sample only
    log2_grams: int = 13
    steps: int = 120
    ridge: float = 1e-3
    ambiguous_below: float = 0.1
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # grams + 1 x bits; the last row, of grams without letters, is zero
    bias: np.ndarray
    bit_weight: np.ndarray  # languages x bits


def codewords(n: int, seed: int) -> np.ndarray:
    """All splits of up to seven languages, dense random codes beyond."""
    if n <= 7:
        bits = np.array([[(s >> k) & 1 for s in range(1, 1 << max(0, n - 1))] for k in range(n)], int).reshape(n, -1)
        code = 2 * bits - 1
        return code if code.shape[1] else np.ones((n, 1), int)
    rng, width = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    tried = (2 * rng.integers(0, 2, (n, width)) - 1 for _ in range(64))
    far = lambda c: min(int((c[i + 1 :] != c[i]).sum(1).min()) for i in range(n - 1))
    return max(tried, key=far)


def _letters() -> np.ndarray:
    """Byte to itself; ASCII that is no letter to a blank."""
    keep = np.arange(256, dtype=np.uint8)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    ascii_letter[128:] = True
    return np.where(ascii_letter, keep, 32).astype(np.uint8)


def gram_codes(data: np.ndarray, log2_grams: int) -> np.ndarray:
    """Hashed code of the trigram at each place but the last two; the code past the last for blanks."""
    t = _letters()[data].astype(np.uint32)
    packed = t[:-2] | (t[1:-1] << np.uint32(8)) | (t[2:] << np.uint32(16))
    code = (packed * np.uint32(2654435761)) >> np.uint32(32 - log2_grams)
    return np.where(packed == 0x202020, np.uint32(1 << log2_grams), code)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of lower-cased texts one after the other, and where each begins and ends."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    lower = lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower
    ends = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def summed(data: np.ndarray, ends: np.ndarray, table: np.ndarray, log2_grams: int, chunk: int = 1 << 19) -> np.ndarray:
    """The sum of ``table`` rows over the grams of each text; memory is bounded by ``chunk`` places."""
    out = np.zeros((len(ends) - 1, table.shape[1]))
    dead = table.shape[0] - 1
    for a in range(0, max(0, len(data) - 2), chunk):
        b = min(a + chunk, len(data) - 2)
        code = gram_codes(data[a : b + 2], log2_grams)
        first, last = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b, "left")
        edges = ends[max(first, 0) : last + 1]
        for back in (1, 2):  # grams that run over a text's end
            at = edges - back
            code[at[(at >= a) & (at < b)] - a] = dead
        starts = np.maximum(ends[first:last], a)
        own = np.flatnonzero(np.append(np.diff(starts) > 0, True)) if len(starts) else np.zeros(0, int)
        own = own[np.minimum(ends[first + 1 : last + 1], b)[own] > starts[own]]
        if len(own):
            out[first + own] += np.add.reduceat(table[code], starts[own] - a, axis=0)
    return out


def fit(texts: list[str], labels: list[str], s: Settings) -> Model:
    """Logistic classifiers of the code's bits on gram frequencies."""
    languages = sorted(set(labels))
    code = codewords(len(languages), s.seed)
    size = 1 << s.log2_grams
    x = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        data, _ = buffers(pa.array([text]))
        if len(data) > 2:
            counts = np.bincount(gram_codes(data, s.log2_grams), minlength=size + 1)[:size]
            x[i] = counts / max(1, counts.sum())
    scale = x.std(axis=0) + 1e-4
    x /= scale
    own = np.array([languages.index(k) for k in labels])
    y = code[own].astype(np.float32)
    w, b = np.zeros((size, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    rate = 4.0 / max(1e-6, float((x**2).sum(axis=1).mean()))
    for _ in range(s.steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
        w -= rate * (x.T @ g + s.ridge * w)
        b -= rate * g.sum(axis=0)
    right = np.sign(x @ w + b) == y
    hit = np.array([right[own == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    table = np.vstack([w / scale[:, None], np.zeros((1, w.shape[1]))])
    return Model(languages, code, table.astype(np.float32), b, hit / hit.sum(axis=1, keepdims=True))


def decode(outputs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The language of least weighted loss, and how clear it is: 0 (two equal) to 1."""
    margin = outputs[:, None, :] * model.code[None]
    loss = (np.log1p(np.exp(np.clip(-margin, -30, 30))) * model.bit_weight[None]).sum(axis=2)
    best = loss.argmin(axis=1)
    if loss.shape[1] == 1:
        return best, np.ones(len(best))
    two = np.partition(loss, 1, axis=1)[:, :2]
    return best, (two[:, 1] - two[:, 0]) / (two[:, 0] + two[:, 1] + 1e-12)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, s: Settings) -> Model | None:
    """Fit on a sample that the number of languages and ``s`` bound."""
    shown = docs.filter((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in shown.groupBy(lang_col).count().collect()}  # one row per language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(s.seed)), F.lit(1 << 30))
    spark = docs.sparkSession
    cut = spark.createDataFrame([(k, int(min(1.0, 2.0 * s.docs_per_language / n + 32 / n) * (1 << 30))) for k, n in counts.items()], "lang string, cut long")
    drawn = (
        shown.select(F.col(lang_col).alias("lang"), draw.alias("draw"), F.substring(text_col, 1, s.chars_per_document).alias("text"))
        .join(F.broadcast(cut), "lang")  # one row per language
        .filter("draw < cut")
    )
    rows = [(r.lang, r.text) for r in drawn.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "text"))), 1, s.docs_per_language).alias("rows")).selectExpr("lang", "explode(rows.text) as text").toLocalIterator()]
    rows.sort()
    return fit([t for _, t in rows], [k for k, _ in rows], s)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous."""
    s = settings
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, s))
    schema = "id long, lang_pred string, score double, ambiguous boolean"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n = batch.num_rows
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if m is not None and n:
                data, ends = buffers(batch.column(1))
                table = np.hstack([m.weights, np.append(np.ones(len(m.weights) - 1), 0)[:, None].astype(np.float32)])
                sums = summed(data, ends, table, s.log2_grams)
                best, clear = decode(sums[:, :-1] / np.maximum(1, sums[:, -1:]) + m.bias, m)
                names = np.where(lettered, np.array(m.languages, object)[best], UNKNOWN)
                score = np.where(lettered, clear, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(score < s.ambiguous_below)], ["id", "lang_pred", "score", "ambiguous"]
            )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(predict, schema)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "ambiguous")
