"""Personal data by patterns, checksums and nearby words, in native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_text import evaluated_once, running_sums

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")

_LOCAL = "[A-Za-z0-9._%+-]"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_SIZED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
#: Java patterns. Possessive loops keep long runs off the stack, and a match begins only where a run
#: does (or where the last match ended), so a long run is not scanned again from each of its characters.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_SIZED}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character every match holds: texts without it are not searched.
_NEEDS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-"}
#: Score before context, and words that raise it when they stand shortly before a span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
CONTEXT = {
    "email": "mail|contact|correo|courriel",
    "ip": "address|host|server|adresse|direcci",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|anruf|llam",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "national_id": "ssn|social security|insurance|identity",
}
CONTEXT_BONUS, CONTEXT_CHARACTERS, LEAST_SCORE = 0.3, 48, 0.5
#: Characters between ids of one list or table, which share their context.
NEIGHBOUR_CHARACTERS = 128
#: Pieces that hold at least so many characters on one side of an id: ids have 11, and so do two pieces.
_NEAR_PIECES = 2 * -(-CONTEXT_CHARACTERS // 11) + 1
_MARK, _OTHER = "\x01", "\x02"


def luhn(digits: Column) -> Column:
    """A string of digits passes the Luhn check."""
    back = F.split(F.reverse(digits), "")
    values = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda total, v: total + v) % 10 == 0


def mod97(iban: Column) -> Column:
    """An account number (letters and digits) passes the mod-97 check."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3)
                        & (F.coalesce(F.right(part, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: (kind, start, end, value, score), end exclusive, in code points.

    The text is cut at marks set around each match, so pieces at odd places are the matches and the
    lengths of the pieces before give their places.
    """
    safe = F.translate(text, _MARK, _OTHER)
    pieces = F.split(F.regexp_replace(safe, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")

    def located(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda p: F.length(p)))
        return evaluated_once(ends, lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(
            F.lit(kind).alias("kind"), at[i].alias("start"), at[i + 1].alias("end"), parts[i].alias("value"),
            (F.lit(SCORES[kind]) + F.when(F.lower(F.right(parts[i - 1], F.lit(CONTEXT_CHARACTERS))).rlike(CONTEXT[kind]), CONTEXT_BONUS)
             .otherwise(0.0)).alias("score"))))

    def in_lists(parts: Column) -> Column:
        """Spans whose context is on either side, in the text with its matches, and goes to all ids of a list."""
        before = lambda i: F.right(F.array_join(F.slice(parts, F.greatest(i - _NEAR_PIECES, F.lit(0)) + 1, F.least(i, F.lit(_NEAR_PIECES))), ""), F.lit(CONTEXT_CHARACTERS))
        after = lambda i: F.left(F.array_join(F.slice(parts, i + 2, F.lit(_NEAR_PIECES)), ""), F.lit(CONTEXT_CHARACTERS))
        told = lambda i: F.lower(before(i)).rlike(CONTEXT[kind]) | F.lower(after(i)).rlike(CONTEXT[kind])
        number = lambda spans: running_sums(F.transform(spans, lambda s, k: F.when(s.start - F.get(spans, k - 1).end > NEIGHBOUR_CHARACTERS, 1).otherwise(0)))
        spans = F.transform(located(parts), lambda s, k: s.withField("told", told(2 * k + 1)))

        def shared(spans: Column, lists: Column) -> Column:
            confirmed = F.array_distinct(F.filter(F.transform(spans, lambda s, k: F.when(s.told, lists[k + 1])), lambda x: x.isNotNull()))
            return evaluated_once(confirmed, lambda sure: F.transform(spans, lambda s, k: F.struct(
                s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value"),
                (F.lit(SCORES[kind]) + F.when(F.array_contains(sure, lists[k + 1]), CONTEXT_BONUS).otherwise(0.0)).alias("score"))))

        return evaluated_once(spans, lambda found: evaluated_once(number(found), lambda lists: shared(found, lists)))

    scored = in_lists if kind == "national_id" else located
    kept = lambda s: _valid(kind, s.value) & (s.score >= LEAST_SCORE)
    spans = evaluated_once(pieces, lambda parts: F.when(F.size(parts) > 1, F.filter(scored(parts), kept)).otherwise(none))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), spans).otherwise(none) if kind in _NEEDS else spans


def find_personal_data(documents: DataFrame, *, text_column: str = "text") -> DataFrame:
    """``documents`` with the array ``personal`` of (kind, start, end, value, score) in code points.

    A pattern proposes a span, a checksum or a bound on digits confirms it, and words shortly before it
    raise its score; spans below the least score go (national ids need such a word). Spans come by
    kind as listed in ``KINDS`` and then by place; kinds may overlap. A null text has none; every row is kept, a column named ``personal`` is replaced.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return documents.withColumn("personal", F.concat(*[_spans(kind, text) for kind in KINDS]))


def digest(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the id, spans per kind, a hash of the four plain kinds' spans, and all spans as text."""
    found = find_personal_data(documents.select(F.col(id_column), F.col(text_column)), text_column=text_column)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = lambda s: s.kind.isin(*KINDS[:4])
    number = lambda kind: F.size(F.filter("personal", lambda s: s.kind == kind)).cast("long")
    return found.select(
        id_column, *[number(kind).alias(f"n_{kind}") for kind in KINDS[:4]],
        F.sha2(written(F.filter("personal", base)), 256).alias("base_sha256"), written(F.col("personal")).alias("spans"),
        *[number(kind).alias(f"n_{kind}") for kind in KINDS[4:]])
