"""Text functions as columns: no Python per row.

White space is JavaScript's (with no-break and other Unicode spaces), word
boundaries are ASCII, and case folds beyond ASCII, so the patterns are written
out here rather than left to the engine's defaults.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed

SPACE = r"[\t-\r    -     　﻿]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
SPACES = "".join(re.findall(SPACE, "".join(map(chr, range(0x10000)))))
#: An ASCII word boundary.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, f"{SPACE}+", " ")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def pattern(some: list[str]) -> str:
    """One pattern that finds any of some, whatever the case."""
    return "(?iu)" + "|".join(f"(?:{p})" for p in some).replace(r"\b", EDGE).replace(r"\s", SPACE).replace(r"\w", "[A-Za-z0-9_]")


def _plain(some: list[str]) -> str:
    """pattern(), for Arrow, whose engine looks at each character once, whatever the number of patterns; its \\b is ASCII."""
    # No class stands in a class there.
    some = [re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", SPACE[1:-1]), p) for p in some]
    return "(?i)" + "|".join(f"(?:{p})" for p in some).replace(".*", "[^\n\r\x85\u2028\u2029]*").replace(r"\s", SPACE).replace(r"\w", "[A-Za-z0-9_]")


def classify(c: Column, tables: dict[str, list[str]] | None = None) -> Column:
    """The class of a text: the first of the tables, in order, with a pattern in it; else customer_incident.

    The fixed tables are sought by Arrow; a caller's own may hold what only the
    engine's patterns can say.
    """
    if tables is None:
        return _fixed_class(c)
    text, out = trim(c), F
    for name, some in tables.items():
        out = out.when(text.rlike(pattern(some)), name)
    return out.otherwise("customer_incident")


def _fixed_class(c: Column) -> Column:
    tables = {name: _plain(some) for name, some in (("monitoring_alert", fixed.MONITORING), ("config_change", fixed.CONFIG), ("administrative", fixed.ADMIN), ("forwarded_email", fixed.FORWARD))}

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        texts = pc.utf8_trim(texts, characters=SPACES)
        out = pa.array(["customer_incident"], pa.string()).take(pa.array([0] * len(texts), pa.int32()))
        for name, found in reversed(tables.items()):
            out = pc.if_else(pc.fill_null(pc.match_substring_regex(texts, found), False), name, out)
        return out

    return run(c)


def is_noise(ticket_class: Column) -> Column:
    return ticket_class.isin("monitoring_alert", "administrative")


def normalize_title(c: Column) -> Column:
    """Lower case, one reply prefix off, white space squeezed, # and brackets off, trimmed; in this order."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring_regex(texts, f"^(?:fw|fwd|vb|sv|re):{SPACE}*", "")
        # A single space is what it becomes.
        texts = pc.replace_substring_regex(texts, f"{SPACE.replace(' ', '', 1)}{SPACE}*|{SPACE}{{2,}}", " ")
        return pc.utf8_trim(pc.replace_substring_regex(texts, r"[#\[\](){}]", ""), characters=SPACES)

    return run(F.lower(c))


def is_proper_noun(c: Column) -> Column:
    return c.rlike("^[A-ZÄÖÅ][A-ZÄÖÅ0-9]{2,}$") | c.rlike("^[A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ]")


def is_proper_topic(c: Column) -> Column:
    return ~c.contains(" ") & (is_proper_noun(c) | c.rlike("^[A-ZÄÖÅ][a-zäöå]{2,}$"))


def is_stop_word(c: Column) -> Column:
    return F.lower(c).isin(fixed.STOP_WORDS)


def words_for_topics(c: Column) -> Column:
    """The words n-grams are made of: no ticket numbers, hex codes, addresses, quotes, brackets or end marks.

    What is rare is sought only where its literal part occurs, and no pattern
    looks at a run of characters twice.
    """
    no_word, numbered = "(?<![A-Za-z0-9_])", c.rlike("[0-9]")
    c = F.when(numbered, F.regexp_replace(c, f"(?i){no_word}(?:IS-|INC-|REF|REQ|SESD-|CAS-|CS)[0-9]++(?![A-Za-z0-9_])", "")).otherwise(c)
    c = F.regexp_replace(c, f"{no_word}[0-9A-Fa-f]{{6,}}+(?![A-Za-z0-9_])", "")
    c = F.when(c.contains("@"), F.regexp_replace(c, f"(?<!{NOT_SPACE}){NOT_SPACE}+@{NOT_SPACE}+", "")).otherwise(c)
    # Brackets become spaces, quotes go.
    c = F.translate(c, "()[]{}<>\"'“”‘’`«»", " " * 8)
    marks = "[.,;:!?]"
    words = F.split(F.concat(F.lit(" "), c, F.lit(" ")), f"(?:(?<!{marks}){marks}+)?{SPACE}+{marks}*+")
    return F.filter(words, lambda w: F.length(w) >= 2)


def topic_terms(word: Column, following: Column) -> Column:
    """(rank, term) of the unigram and the bigram that start at a word; a proper noun keeps its case, bigrams are lower case.

    A term that does not count is null, and so is a bigram without a following word.
    """
    low, next_ = F.lower(word), F.lower(following)
    number = word.rlike("^[0-9]+$")
    single = F.when(~low.isin(fixed.STOP_WORDS) & ~number & ~word.rlike(r"^[0-9]+\.[0-9]+"), F.when(is_proper_noun(word), word).otherwise(low))
    pair = F.when(~low.isin(fixed.STOP_WORDS) & ~next_.isin(fixed.STOP_WORDS) & ~number & ~following.rlike("^[0-9]+$"), F.concat_ws(" ", low, next_))
    return F.array(F.struct(F.lit(0).alias("rank"), single.alias("term")), F.struct(F.lit(1).alias("rank"), pair.alias("term")))


def is_noise_token(c: Column) -> Column:
    return (
        (F.length(c) < 3) | is_stop_word(c) | c.rlike("^[0-9]+$") | c.rlike("^[0-9]{4}[-_][0-9]{2}") | c.rlike(r"(?i)^(IS-|INC-|REF|REQ|SESD-|CAS-|CS[0-9])")
        | c.rlike("(?i)^[0-9A-F]{6,}$") | c.rlike(r"[/\\@]") | c.rlike(r"^[0-9]+\.[0-9]+")
    )


def proper_nouns(c: Column) -> Column:
    """Distinct names in a text: in capitals, in camel case, capitalised within a sentence; in this order."""
    rare = [r"\b([A-ZÄÖÅ][A-ZÄÖÅ0-9]{2,19})\b", r"\b([A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ][a-zA-ZäöåÄÖÅ0-9]*)\b"]
    often = rf"[a-zäöå.,;:]{SPACE}+([A-ZÄÖÅ][a-zäöåA-ZÄÖÅ0-9]{{3,}})\b"
    # What is_noise_token says of a name.
    stop, noise = frozenset(fixed.STOP_WORDS), r"(?i)(?:IS-|INC-|REF|REQ|SESD-|CAS-|CS[0-9]|[0-9A-F]{6,}$)"

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = [None if t is None else [] for t in texts.to_pylist()]
        for p in rare:
            at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, p), False))
            find = re.compile(p, re.ASCII).findall
            for k, t in zip(at.to_pylist(), texts.take(at).to_pylist(), strict=True):
                out[k] += find(t)
        find, bad, known = re.compile(often, re.ASCII).findall, re.compile(noise, re.ASCII), {}
        for k, t in enumerate(texts.to_pylist()):
            if t is None:
                continue
            for w in (names := dict.fromkeys(out[k] + find(t))):
                if w not in known:
                    known[w] = len(w) >= 3 and w.lower() not in stop and not bad.match(w)
            out[k] = [w for w in names if known[w]]
        return pa.array(out, pa.list_(pa.string()))

    return run(c)


def actions(c: Column) -> Column:
    """Action words that stand in a text as words, in the order of the list; a text with none of them is looked at once."""
    each = [(a, _plain([rf"\b{a}\b"])) for a in fixed.ACTIONS]
    either = _plain([rf"\b{a}\b" for a in fixed.ACTIONS])

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, either), False))
        some, out = texts.take(at), [[] for _ in range(len(texts))]
        for name, found in each:
            for k in at.take(pc.indices_nonzero(pc.match_substring_regex(some, found))).to_pylist():
                out[k].append(name)
        return pa.array(out, pa.list_(pa.string()))

    return run(c)


def signature(systems: Column, acts: Column) -> Column:
    """Sorted systems and the first action, or UNKNOWN."""
    return F.coalesce(F.nullif(F.array_join(F.concat(F.array_sort(systems), F.slice(acts, 1, 1)), "|"), F.lit("")), F.lit("UNKNOWN"))


def words_for_tags(c: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of more than two characters that are no stop words; a mark parts words."""
    words = F.split(F.regexp_replace(F.lower(c), f"[^\\p{{L}}\\p{{N}}{SPACE[1:-1]}]", " "), f"{SPACE}+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def nfkc(c: Column) -> Column:
    """The Unicode form NFKC, by Arrow, a batch at a time; there is no built-in function."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, form="NFKC")

    return run(c)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, two characters or more; c should be in Unicode form NFKC."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def lexical_score(query: list[str], phrase: str, c: Column) -> Column:
    """Share of the query's tokens in the text, weighed .85, and .15 if the phrase is in it; at most 1."""
    if not query:
        return F.lit(0.0)
    own = F.array_distinct(tokens(c))
    share = F.size(F.array_intersect(F.array(*map(F.lit, query)), own)) / F.lit(float(len(query)))
    bonus = F.when(F.lower(c).contains(phrase), 0.15).otherwise(0.0) if phrase else F.lit(0.0)
    return F.when(share > 0, F.least(F.lit(1.0), share * 0.85 + bonus)).otherwise(0.0)


def query_tokens(query: str) -> list[str]:
    """A query's distinct tokens and their aliases."""
    import re
    import unicodedata

    low = unicodedata.normalize("NFKC", query).lower()
    found = [w for w in re.split(r"[\W_]+", low) if len(w) >= 2]
    return list(dict.fromkeys([*found, *(fixed.ALIASES[w] for w in found if w in fixed.ALIASES)]))


def query_words(c: Column) -> Column:
    """The same for a column of queries in Unicode form NFKC."""
    known = F.create_map(*[F.lit(x) for pair in fixed.ALIASES.items() for x in pair])
    own = tokens(c)
    return F.array_distinct(F.concat(own, F.filter(F.transform(own, lambda w: known[w]), lambda w: w.isNotNull())))


def described_topics(description: Column) -> Column:
    """The topics that a pattern's description lists, in lower case."""
    listed = F.regexp_extract(F.coalesce(description, F.lit("")), f"Ämnen:{SPACE}*([^.]+)", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda t: F.lower(trim(t))), lambda t: t != "")


def initials(name: Column) -> Column:
    """The first letters of a name's first two words, as capitals; NY without any."""
    words = F.slice(F.filter(F.split(trim(name), f"{SPACE}+"), lambda w: w != ""), 1, 2)
    return F.coalesce(F.nullif(F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), ""), F.lit("")), F.lit("NY"))


def file_size(n: Column) -> Column:
    """Bytes as B, whole KB, or MB with a decimal; what lies just between two decimals goes to the even one, as C's printf has it."""
    kb = F.round(n / 1024, 0).cast("long").cast("string")
    # In whole numbers, for Java's format rounds such a half up.
    tenths, rest = F.floor(n * 10 / 1048576), F.pmod(n * 10, F.lit(1048576))
    tenths = tenths + F.when((rest > 524288) | ((rest == 524288) & (F.pmod(tenths, F.lit(2)) == 1)), 1).otherwise(0)
    mb = F.concat_ws(".", F.floor(tenths / 10).cast("string"), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


# Swedish names of months.
MONTHS = ["januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december"]


def swedish_date(at: Column) -> Column:
    """Day, month by name, year."""
    return F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(at)), F.year(at).cast("string"))


def leading_word(title: Column) -> Column:
    return trim(F.lower(F.when(F.instr(title, " — ") > 1, F.substring_index(title, " — ", 1)).otherwise(title)))


def repeated_form(c: Column) -> Column:
    """Lower case, digits as N, white space squeezed, trimmed."""
    return trim(squeeze(F.regexp_replace(F.lower(c), "[0-9]+", "N")))


def clean_title(reply: Column, fallback: Column, most: int = 80) -> Column:
    """A model's reply as a title: no thoughts, quotes, numbering or label; the fallback if empty or too long."""
    c = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    c = trim(F.regexp_replace(trim(c), r"^[\"'“”«»]+|[\"'“”«»]+$", ""))
    c = trim(F.regexp_replace(c, r"(?i)^(?:[0-9]+[.)]\s*|(?:titel|title)\s*:\s*)", ""))
    return F.when((F.length(c) > 0) & (F.length(c) <= most), c).otherwise(fallback)


def json_array(reply: Column) -> Column:
    """The outermost [ ... ] of a model's reply, without control characters; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(reply, r"(?s)\[.*\]", 0), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
