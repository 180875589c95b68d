"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Everything is DataFrame functions: no Python runs on the rows and nothing is
shuffled, so a row is judged where it is read. A kind's matches are found once
with what stands between them; places follow from the lengths of both, and the
words nearby are the ends of what stands between, so the work is linear in the
text however many matches it has.

The patterns are possessive and start where a run starts. They find the same
spans as their plain forms (in the tests and the SQL), but a long run of digits
or letters is looked at once, not once for each of its characters, and no match
needs a deep stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before and after a span that are searched for words, and what such words add or take; scores are per cent.
BEFORE, AFTER, MORE, LESS = 48, 24, 30, 40
#: A span that is not of the base kinds is reported from this score on.
LEAST = 60
#: Matches that are added up together when places are counted.
BLOCK = 64

#: Characters of an IBAN by country, as the registry of ISO 13616 has them.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VG": 24, "XK": 20,
}
#: Words that speak against any kind.
AGAINST = "order|invoice|isbn|issn|doi|version|serial|model|sku|ticket|article|bestellung|rechnung|commande|facture|pedido|factura"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def part(x: Column, k: Column) -> Column:
        n = x.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether capitals and digits, the first four moved to the end and A..Z read as 10..35, leave 1 modulo 97."""
    chars = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97) == 1


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _iban(x: Column) -> Column:
    """x up to its country's length, where that ends at a word's end; else an empty text."""
    size = F.create_map(*[F.lit(v) for pair in IBAN_SIZES.items() for v in pair])[F.substring(x, 1, 2)]
    return F.coalesce(F.regexp_substr(x, F.concat(F.lit("^(?:\\x20?[A-Z0-9]){"), F.coalesce(size, F.lit(99)).cast("string"), F.lit("}(?=\\x20|$)"))), F.lit(""))


@dataclass(frozen=True)
class Kind:
    """How spans of one kind are proposed, confirmed and scored.

    may says which texts are searched at all. cut shortens a match (to nothing:
    no span). sound takes (match, text before it) and confirms it. near are
    words that speak for the kind; a base kind is reported whatever its score.
    """

    name: str
    pattern: str
    may: Callable[[Column], Column]
    sound: Callable[[Column, Column], Column]
    score: int
    near: str
    base: bool = False
    cut: Callable[[Column], Column] | None = None


#: Runs of digits with single blanks or hyphens between them, none longer and none shorter.
def _run(least: int, most: int) -> str:
    return rf"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){{{least - 1},{most - 1}}}+(?![\x20-]?[0-9])"


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_AWAY = "[A-Za-z0-9+]$"

BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda x, o: F.lit(True), 80, "mail|e-mail|email|contact|write|reply|kontakt|correo|courriel", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), lambda x, o: x.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"), 60, "ip|address|host|server|login|adresse", True),
    Kind("card", _run(16, 19), lambda t: t.rlike(_run(16, 19)), lambda x, o: luhn(_digits(x)), 80, "card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda x, o: F.length(_digits(x)).between(8, 15), 70, "phone|tel|call|mobile|cell|fax|telefon|portable|llamar", True),
)
MORE_KINDS = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), lambda x, o: mod97(F.replace(x, F.lit(" "))) & ~o.rlike(_AWAY), 75, "iban|account|bank|konto|compte|cuenta|bic|swift", cut=_iban),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda x, o: ~o.rlike("[A-Za-z0-9+-]$") & ~x.rlike("^(?:000|666|9)|-00-|-0000$"), 40, "ssn|social security"),
    Kind("card_short", _run(13, 15), lambda t: t.rlike(_run(13, 15)), lambda x, o: luhn(_digits(x)) & ~o.rlike(_AWAY), 40, "card|visa|amex|american express|diners|credit|debit|karte|carte|tarjeta"),
)
KINDS = BASE + MORE_KINDS

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:int>>"


def _starts(found: Column, between: Column, f: Callable[[Column], Column]) -> Column:
    """f(places), with places[k] the code points before match k: sums over blocks of matches, then within a block."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    sizes = F.transform(found, lambda x, k: F.length(x) + F.length(F.get(between, k)))

    def of(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / BLOCK).cast("int")), lambda j: total(F.slice(s, j * BLOCK + 1, F.lit(BLOCK))))
        before = lambda b: F.transform(b, lambda x, j: total(F.slice(b, F.lit(1), j)))
        return let(let(blocks, before), lambda b: let(F.transform(s, lambda x, k: F.get(b, F.floor(k / BLOCK).cast("int")) + total(F.slice(s, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK)) + F.length(F.get(between, k))), f))

    return let(sizes, of)


def _near(words: str, before: Column, after: Column) -> Column:
    """Whether one of words stands, as a word, in either text."""
    pattern = f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"
    return F.lower(before).rlike(pattern) | F.lower(after).rlike(pattern)


def kind_spans(text: Column, kind: Kind) -> Column:
    """Spans of one kind in the order of their places: (kind, start, end, value, score); code points, end exclusive."""

    def spans(found: Column, between: Column, places: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            o, after, at = F.get(between, k), F.get(between, k + 1), F.get(places, k)
            value = kind.cut(x) if kind.cut else x
            before, after = F.right(o, F.lit(BEFORE)), F.left(after, F.lit(AFTER))
            score = F.lit(kind.score) + F.when(_near(kind.near, before, after), MORE).otherwise(0) - F.when(_near(AGAINST, before, after), LESS).otherwise(0)
            made = lambda v: F.struct(F.lit(kind.name).alias("kind"), at.alias("start"), (at + F.length(v)).cast("int").alias("end"), v.alias("value"), F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"), ((v != "") & kind.sound(v, o)).alias("sound"))
            return let(value, made)

        kept = F.filter(F.transform(found, one), lambda s: s["sound"] & (F.lit(True) if kind.base else s["score"] >= LEAST))
        return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"), F.split(text, kind.pattern, -1).alias("between"))
    found = let(both, lambda b: _starts(b["found"], b["between"], lambda places: spans(b["found"], b["between"], places)))
    return F.when(kind.may(text), found).otherwise(F.array().cast(SPAN))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Each row of df with its personal data: key and spans, an array in the order of kinds, then of places.

    A span has kind, start and end (code points, end exclusive), value and
    score. Spans of a base kind that its check confirms are all reported; of the
    others those with a score of LEAST or more. Spans of one kind do not
    overlap; those of two kinds may. A null or empty text has none; a row whose
    key is null or repeated stays a row; other columns are ignored.
    """
    return df.select(df[key].alias(key), F.coalesce(df[text], F.lit("")).alias("_text")).select(key, F.concat(*[kind_spans(F.col("_text"), k) for k in kinds]).alias("spans"))


def spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each span of find()'s rows."""
    return found.select(key, F.inline("spans"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as text (kind:start:end, by commas), from find()'s rows."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[k.name for k in BASE]))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        key, *[count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(F.concat_ws(",", F.transform(base, place)).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", place)).alias("spans"),
    )
