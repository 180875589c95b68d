"""Quality rules: two base rules and boosted trees over document statistics.

Statistics of all documents come from the text buffers without a Python object
per word. The trees are fitted on labelled documents, at most `sample` of them,
with the score bound to fall with symbols, repeated lines and repeated words;
every document is then scored where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import gbt
from quern.llm.common import U64, covered, full_windows, give_back, mix, owner, parts, small_batches, spans_hash, utf8, windows_hash, words

#: Characters that count as symbols; a word window; the base rules' bounds.
SYMBOLS, REPEAT_WORDS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Most labelled documents that the trees are fitted on.
SAMPLE = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and how the score may move with each: 1 up, -1 down, 0 either way.
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1,
    "upper_share": 0, "digit_share": 0, "mark_share": 0, "exclaim_share": -1, "letter_words": 1, "words_per_line": 0, "same_as_last": -1,
}


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[off[1:]] - total[off[:-1]]


def _kinds(*groups: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, g in enumerate(groups):
        table[list(g)] |= 1 << k
    return table


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_TABLE = _kinds(SYMBOLS, _UPPER, bytes(range(48, 58)), b".,;:!?'\"()-", b"!", _UPPER + _LOWER + bytes(range(0xC3, 0x100)), b"\n", bytes(range(0x80)) + bytes(range(0xC0, 0x100)))
_SYM, _UP, _DIGIT, _MARK, _EXCLAIM, _LETTER, _LINE, _LEAD = (1 << k for k in range(8))


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts (COUNTS) and features (FEATURES) of each text, a row each."""
    n, texts = int(off[-1]), len(off) - 1
    kind = _TABLE[data[:n]]
    starts, ends, woff = words(data, off)
    n_words = np.diff(woff)
    inside = np.zeros(n + 1, np.int8)
    inside[starts] = 1
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8) > 0
    word_chars = _per_text(inside & (kind & _LEAD > 0), off)
    symbols = _per_text(kind & _SYM > 0, off)
    h = spans_hash(data, starts, ends)
    doc = owner(woff)
    # Lines: each ends before a newline or at its text's end.
    breaks = np.flatnonzero(kind & _LINE)
    line_start = np.sort(np.r_[off[:-1], breaks + 1])
    line_end = np.sort(np.r_[off[1:], breaks])
    line_doc = np.repeat(np.arange(texts), _per_text(kind & _LINE > 0, off) + 1)
    at = np.searchsorted(starts, line_start)
    worded = (at < len(starts)) & (np.r_[starts, n + 1][np.minimum(at, len(starts))] < line_end)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    line = mix(spans_hash(data, line_start, line_end, 3) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    dup_lines = np.bincount(line_doc[again], minlength=texts)
    lines = np.bincount(line_doc, minlength=texts)
    # Word windows found twice or more in one text.
    full = np.flatnonzero(full_windows(woff, REPEAT_WORDS))
    window = mix(windows_hash(h, REPEAT_WORDS, 9)[full] + doc[full].astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(full), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeated = _per_text(covered(full[twice], REPEAT_WORDS, len(starts)), woff)
    distinct = np.bincount(doc[np.unique(mix(h + doc.astype(U64) * U64(0xBF58476D1CE4E5B9)), return_index=True)[1]], minlength=texts)
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    has_letter = np.r_[0, np.cumsum(kind & _LETTER > 0)]
    lettered = has_letter[ends] > has_letter[starts]
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeated], 1).astype(np.int64)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / w, symbols / c, dup_lines / np.maximum(lines, 1), repeated / w, distinct / w]
        + [_per_text(kind & k > 0, off) / c for k in (_UP, _DIGIT, _MARK, _EXCLAIM)]
        + [_per_text(lettered, woff) / w, n_words / np.maximum(lines, 1), _per_text(follows, woff) / w],
        1,
    )
    return counts, features


def _scan(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> gbt.Model:
    """Trees fitted on at most `sample` labelled documents, those whose key hashes lowest.

    Labels that are null are left out; a key with two labels counts twice, and
    one with several documents once, by the text that hashes lowest. With no
    labelled document at all, the model keeps everything.
    """
    own = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")).where("_key is not null and _label is not null")
    share = min(1.0, sample / max(1, own.count()))
    number = F.pmod(F.xxhash64("_key"), F.lit(1 << 40))
    # In the order of the hash, so that the same labels are drawn whatever ran first.
    own = own.where(number <= F.lit(int(share * (1 << 40)))).orderBy(number, "_key", "_label").limit(sample)
    # At most `sample` keys and labels are broadcast; of a key's documents one is left.
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(own), "_key")
    rows = rows.groupBy("_key", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text")).select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            x = statistics(*utf8(b.column(1)))[1]
            yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = _scan(rows, ["_label", "_text"], run, "label double, x array<double>").toPandas()
    if not len(got):
        return gbt.constant(1.0)
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy() > 0
    order = np.lexsort((*x.T, y))  # the order in which rows arrive doesn't matter
    return gbt.fit(x[order], y[order], list(FEATURES.values()))


def score(df: DataFrame, model: gbt.Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row's key, COUNTS, base_failed, quality (the trees' probability) and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word
    windows. kept: not base_failed, and a quality of threshold or more. A null
    text has no words. Repeated or null keys keep their rows; other columns of
    df are ignored, whatever their names.
    """
    rows = df.select(df[key].alias(key), df[text].alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            counts, x = statistics(*utf8(b.column(1)))
            p = model.probability(x)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            yield pa.record_batch(
                [b.column(0), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                [key, *COUNTS, "base_failed", "quality", "kept"],
            )

    return _scan(rows, [key, "_text"], run, f"`{key}` {kind}, {', '.join(c + ' long' for c in COUNTS)}, base_failed boolean, quality double, kept boolean")


def passed(df: DataFrame, model: gbt.Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, with all its columns, that score() would keep. No shuffle."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, at):
            counts, x = statistics(*utf8(b.column(at)))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            yield b.filter(pa.array(~failed & (model.probability(x) >= threshold)))
        give_back()

    return df.mapInArrow(run, df.schema)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """score() of df by trees fitted on its labelled rows."""
    return score(df, train(df, labels, key, text, label, sample), key, text, threshold)
