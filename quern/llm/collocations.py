"""Phrases whose words belong together, by hierarchical pair naming.

Texts are read once, in chunks of many documents. A chunk becomes a sequence of
numbers of its own distinct words, and tells how often each occurs; all chunks'
counts of a word meet in one place, where a word that is frequent gets a name:
the number of its first occurrence among the chunks' lists. Names go back to the
chunks that hold the word. Then every two adjacent named words are a pair, which
is counted and named in the same way, two adjacent pairs a phrase of three
words, and so on: a (k-1)-gram's name is all that the next level needs.

A name also points at the two names it was made from, the phrase without its
last word and the phrase without its first. Counts of every part that a cut
leaves, the texts, and the longer phrases that swallow a shorter one are found
by following these pointers: joins of the frequent phrases alone.

A chunk sends each word or pair once, however often it holds it, so a word that
makes up a third of all text costs a row per chunk, and no key is hot.

What a task holds is bounded by its chunk: a chunk ends after so many bytes, words
or distinct words, and its texts are looked at a few MB at a time. Only a piece
longer than that, without punctuation or line end, is looked at as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import _M1, U64, chunked, give_back, mix, one_array, small_batches, spans_hash, utf8, written

#: A place in a chunk's list is one long: the chunk above, the place in PLACE bits below; chunks are numbered within a task in CHUNK bits.
PLACE, CHUNK = 31, 12
#: Bytes of text looked at together; words of a chunk, and words in all its parts' lists, after which a new one begins.
PART_BYTES, WORDS, LISTED = 2 << 20, 4 << 20, 1 << 20
#: Parts in which a language's phrases are ranked before its best are ranked together.
SALTS = 32

_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, and whether the next word stands in the same piece of the same text."""
    n = int(off[-1])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    stop = _BREAK[data[:n]]
    inside = ~(_BLANK[data[:n]] | stop)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:n]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, off))
    of = np.repeat(np.arange(len(off) - 1), counts)
    breaks = np.cumsum(stop, dtype=np.int32)
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (of[1:] == of[:-1]) & (breaks[starts[1:] - 1] == breaks[ends[:-1] - 1])
    return starts, ends, of, follows


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, number, count) of the distinct (words, of): where each occurs first, the number of every word, and occurrences.

    They are numbered as they first occur. Words with equal hashes are told apart by a second hash, and by their bytes
    if that ever finds two.
    """
    salt = mix((of.astype(U64) + U64(1)) * _M1)
    _, first, number, count = np.unique(spans_hash(data, starts, ends) ^ salt, return_index=True, return_inverse=True, return_counts=True)
    second = spans_hash(data, starts, ends, 2) ^ salt
    if not np.array_equal(second, second[first][number]):
        raw, seen = data.tobytes(), {}
        number = np.array([seen.setdefault((raw[s:e], k), len(seen)) for s, e, k in zip(starts.tolist(), ends.tolist(), of.tolist(), strict=True)], np.int64)
        _, first, count = np.unique(number, return_index=True, return_counts=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return first[order], rank[number], count[order]


def _cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of spans that ascend and don't overlap, one after another."""
    turn = np.zeros(len(data) + 1, np.int8)
    turn[starts] += 1
    turn[ends] -= 1
    return data[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]


def _windows(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where to cut texts into parts of about PART_BYTES: at ends of texts and after what parts pieces, so that no piece is cut."""
    lo, n, most = 0, int(off[-1]), PART_BYTES
    while lo < n:
        hi = min(lo + most, n)
        breaks = np.flatnonzero(_BREAK[data[lo:hi]])
        cut = max(int(off[np.searchsorted(off, hi, "right") - 1]), lo + int(breaks[-1]) + 1 if len(breaks) else 0)
        if cut > lo:
            yield lo, cut
            lo, most = cut, PART_BYTES
        else:
            most *= 2


def _united(held: list[tuple]) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of several parts (bytes, sizes, languages, counts) made one, and their sequences (places in all parts' lists) joined: (words, languages, counts, sequence)."""
    texts, sizes, langs, counts, sequences = zip(*held, strict=True)
    data, size, lang = np.concatenate([*texts, np.zeros(8, np.uint8)]), np.concatenate(sizes), np.concatenate(langs)
    ends = np.cumsum(size)
    starts = ends - size
    first, number, _ = _distinct(data, starts, ends, lang)
    count = np.zeros(len(first), np.int64)
    np.add.at(count, number, np.concatenate(counts))
    # The last, at -1, is what parts pieces.
    place = np.append(number, -1).astype("<i4")
    sequence = np.concatenate([place[s] for s in sequences])
    offsets = np.r_[0, np.cumsum(size[first])].astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_cut_out(data, starts[first], ends[first])))
    return words, lang[first], count, sequence


def _lists(t: pa.Table) -> Iterator[tuple[pa.StringArray, pa.StringArray, np.ndarray, np.ndarray]]:
    """Of texts (lang, text): distinct words, their languages and counts, and the sequence of places in that list; -1 parts pieces.

    Texts are looked at by parts, of which only the distinct words are held, and
    four bytes a word for the sequence. There is more than one list if there are
    over WORDS words, or parts have over LISTED distinct ones: what is held
    depends neither on how short or varied words are nor on how long a text is.
    """
    langs = one_array(t["lang"]).dictionary_encode()
    by_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = utf8(t["text"])
    held, words, listed = [], 0, 0
    for lo, hi in _windows(data, off):
        part, row = data[lo:hi], int(np.searchsorted(off, lo, "right")) - 1
        part[(part >= 65) & (part <= 90)] += 32
        starts, ends, of, follows = tokens(data[lo : hi + 8], np.clip(off[row : np.searchsorted(off, hi) + 1], lo, hi) - lo)
        lang = by_row[row + of]
        first, number, count = _distinct(data[lo : hi + 8], starts, ends, lang)
        sequence = np.insert((number + listed).astype("<i4"), np.flatnonzero(~follows) + 1, -1)
        held.append((_cut_out(part, starts[first], ends[first]), (ends - starts)[first], lang[first], count, sequence))
        words, listed = words + len(starts), listed + len(first)
        if words >= WORDS or listed >= LISTED or hi == off[-1]:
            found, lang, count, sequence = _united(held)
            yield found, langs.dictionary.take(pa.array(lang)), count, sequence
            held, words, listed = [], 0, 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text): a row for each distinct word of a chunk (at, lang, word, n), and one with the chunk's sequence of places; -1 parts pieces."""
    task, k = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(level=1)
    names = ["at", "lang", "word", "n", "seq"]
    for words, lang, count, sequence in (found for t in chunked(batches) for found in _lists(t)):
        n, at, k = len(words), ((task << CHUNK) + k) << PLACE, k + 1
        rows = [pa.array(at + np.arange(n)), lang, words, pa.array(count), pa.nulls(n, pa.binary())]
        last = [pa.array([at]), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([pack.compress(sequence.tobytes())], pa.binary())]
        yield pa.record_batch(rows, names)
        yield pa.record_batch(last, names)
    give_back()


def _pairs(places: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sequence of places in a list and the names of that list (-1: none; the last is no place's): its distinct adjacent pairs of names (left, right), their counts, and for each place the number of its pair or -1."""
    known = (named >= 0)[places]
    here = np.flatnonzero(known[:-1] & known[1:])
    key = places[here].astype(np.int64)
    key *= len(named)
    key += places[here + 1]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out = np.full(len(places), -1, np.int32)
    out[here[order]] = np.cumsum(new, dtype=np.int32) - 1
    begin = np.flatnonzero(new)
    key = key[begin]
    return named[key // len(named)], named[key % len(named)], np.diff(np.r_[begin, len(order)]), out


def _level(t: pa.Table, names: pa.Table) -> pa.Table:
    """A chunk's distinct pairs (at, left, right, n) of the highest level that has names."""
    if t.num_rows == 0:
        return pa.table({"at": pa.array([], pa.int64()), "left": pa.array([], pa.int64()), "right": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    chunk = int(t["chunk"][0].as_py())
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(t["seq"][0].as_py()), "<i4")
    level, at, name = (names[c].to_numpy() for c in ("level", "place", "id"))
    for k in range(1, int(level.max(initial=1)) + 1):
        of = level == k
        named = np.full(int(max(places.max(initial=-1), at.max(initial=-1))) + 2, -1, np.int64)
        named[at[of]] = name[of]
        left, right, count, places = _pairs(places, named)
    give_back()
    return pa.table({"at": (chunk << PLACE) + np.arange(len(left)), "left": left, "right": right, "n": count.astype(np.int64)})


def _named(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (at, *keys, n) of keys that occur `least` times in all, with f, that count, and id, the least place of the key: its name."""
    key = Window.partitionBy(*keys)
    counted = rows.select("at", *keys, F.sum("n").over(key).alias("f"), F.min("at").over(key).alias("id"))
    return written(counted.where(F.col("f") >= least))


def phrases(df: DataFrame, lang: str = "lang", text: str = "text", max_words: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to max_words words, and words by language (lang, n).

    Phrases have lang, phrase, size, f, heads (counts of the first 1, 2, ...
    words, the phrase itself last), tails (of the last 1, 2, ... words) and
    longer, the count of the most frequent phrase of one word more that holds
    it (0 if none is frequent). Every occurrence counts, overlaps included.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(df[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(df[text], F.lit("")).alias("text"))
    base = written(rows.mapInArrow(_read, "at long, lang string, word string, n long, seq binary"))
    words = base.where("seq is null")
    sequences = base.where("seq is not null").select(F.shiftright("at", PLACE).alias("chunk"), "seq")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))

    def names(level: DataFrame, k: int) -> DataFrame:
        return level.select(F.shiftright("at", PLACE).alias("chunk"), F.lit(k).alias("level"), F.col("at").bitwiseAND((1 << PLACE) - 1).alias("place"), "id")

    level = _named(words.select("at", "lang", "word", "n"), ["lang", "word"], least)
    known = names(level, 1)
    one = level.where("at = id").select("id", "lang", F.col("word").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    levels, longer = [one], []
    for k in range(2, max_words + 1):
        found = sequences.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_level, "at long, left long, right long, n long")
        if k < max_words:
            level = _named(found, ["left", "right"], least)
            known = known.unionByName(names(level, k))
            own = level.where("at = id").select("id", "left", "right", "f")
        else:  # Nothing is made of the last level, so it needs no names.
            own = written(found.groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)).withColumn("id", F.lit(None).cast("long"))
        first = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("first"), F.col("heads").alias("_heads"))
        last = levels[-1].select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), F.col("tails").alias("_tails"))
        made = own.join(first, "left").join(last, "right")
        made = made.select("id", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "f", F.array_append("_heads", F.col("f")).alias("heads"), F.array_append("_tails", F.col("f")).alias("tails"))
        longer.append(own.select(F.col("left").alias("id"), F.col("f").alias("longer")).unionByName(own.select(F.col("right").alias("id"), F.col("f").alias("longer"))).groupBy("id").agg(F.max("longer").alias("longer")))
        levels.append(made if k == max_words else written(made))
    out = []
    for k, own in enumerate(levels, 1):
        own = own.join(longer[k - 1], "id", "left") if k < max_words else own.withColumn("longer", F.lit(None).cast("long"))
        out.append(own.select("lang", "phrase", F.lit(k).alias("size"), "f", "heads", "tails", F.coalesce("longer", F.lit(0).cast("long")).alias("longer")))
    whole = out[0]
    for own in out[1:]:
        whole = whole.unionByName(own)
    return whole, total


def scored(found: DataFrame) -> DataFrame:
    """Phrases of two words and more with the lowest-scoring cut: (lang, phrase, size, a, l, r, score, cut, longer).

    A cut after k words scores floor(1000000 * a * a / (l * r)), counted in
    whole decimals of 38 digits, which hold it for counts below 10 ** 14; of
    equal scores the least k counts.
    """
    wide = lambda c: c.cast("decimal(14,0)")

    def cut(k):
        left, right = F.get("heads", k - 1), F.get("tails", F.col("size") - k - 1)
        top = F.lit(1_000_000).cast("decimal(7,0)") * wide(F.col("f")) * wide(F.col("f"))
        product = wide(left) * wide(right)
        # The remainder is taken first, so that the quotient is whole and no digit is rounded.
        score = ((top - top % product) / product).cast("long")
        return F.struct(score.alias("score"), k.cast("int").alias("cut"), left.alias("l"), right.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))
    return found.where("size >= 2").withColumn("_best", best).select("lang", "phrase", "size", F.col("f").alias("a"), "_best.l", "_best.r", "_best.score", "_best.cut", "longer")


def mine(df: DataFrame, lang: str = "lang", text: str = "text", max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to max_words words: lang, rank, phrase, a, l, r, n, score.

    Text is lower-cased in A-Z, parted at . , ; : ! ? and line ends into pieces
    and at blanks and tabs into words. A phrase that occurs `least` times is a
    candidate; one that lies in a longer candidate with `share` per cent of its
    count or more is dropped. Ordered by score and count, greatest first, then
    phrase. A null text is empty, a null language `und`; repeated rows count as
    often as they stand; an empty table has no phrases. Other columns of df are
    ignored, whatever their names.
    """
    found, total = phrases(df, lang, text, max_words, least)
    left = scored(found).where(100 * F.col("longer") < share * F.col("a"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
