"""Personal data in whole texts, with built-in functions only.

Regular expressions propose spans, validators confirm them (octet range, digit
counts, Luhn, mod-97), and words near a span adjust its score.  Every kind is
searched leftmost and without overlaps on its own; a proposal that fails its
validator is dropped and not retried.  ``BASE_KINDS`` are always reported when
valid; ``ADDED_KINDS`` need a score of ``THRESHOLD``.

Patterns are written so that one pass is linear in the text: possessive runs,
and a look-behind (or the end of the previous match) where a run may only be
entered at its start; both find exactly what the plain patterns find.  Offsets
are code points: the pieces between matches and the matches themselves give
lengths, summed in blocks.

Defined cases: a null text is empty; decisions are per row, so repeated rows
get equal results; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span that are searched for context words
#: (up to the neighbouring match of the same kind).
WINDOW = 32
THRESHOLD = 60
BLOCK = 512

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"

#: Letters and digits of an account code by its country: the IBAN registry's
#: lengths and those of countries that use the form unregistered.  A proposal
#: ends there, whatever follows; other countries have no such code.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_RUNS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN.items())

#: kind: (pattern, score in percent, words that raise it, words that lower it)
BASE_KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90,
              "mail|contact|write|kontakt|correo|courriel", "example|noreply"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 60,
           r"\bip\b|address|host|server|adresse", "version|release|section|chapter"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", 80,
             "card|visa|master|credit|karte|carte|tarjeta", "order|invoice|isbn|tracking|serial"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 70,
              "phone|call|tel|mobile|fax|anruf|appel", "order|invoice|serial"),
}
ADDED_KINDS = {
    "iban": (rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_RUNS})", 90,
             "iban|account|bank|konto|compte|cuenta", "serial|tracking"),
    "ssn": (r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++", 40,
            r"ssn|social security|tax id|\btin\b", "part|order|serial|version"),
}
KINDS = {**BASE_KINDS, **ADDED_KINDS}


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(number)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0),
                       lambda acc, i: acc + _let(
                           F.coalesce(F.substring(backwards, i, F.lit(1)).cast("int"), F.lit(0))
                           * F.when(i % 2 == 0, 2).otherwise(1),
                           lambda d: d - F.when(d > 9, 9).otherwise(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without blanks passes the mod-97 check."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    return F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise(
            F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97)
            .otherwise((acc * 100 + F.ascii(c) - 55) % 97))) == 1


def valid(kind: str, value: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _let(F.replace(value, F.lit(" "), F.lit("")),
                    lambda c: F.length(c).between(15, 34) & mod97(c))
    if kind == "ssn":
        return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    """Percent: the kind's own score, adjusted by the words on either side."""
    _, own, good, bad = KINDS[kind]
    near = F.lower(F.concat(before, F.lit(" "), after))
    return (F.lit(own) + F.when(near.rlike(good), 20).otherwise(0)
            - F.when(near.rlike(bad), 30).otherwise(0))


def _confirmed(kind: str, item: Column) -> Column:
    ok = valid(kind, item["value"])
    if kind in ADDED_KINDS:
        ok = ok & (score(kind, item["before"], item["after"]) >= THRESHOLD)
    return ok


def _items(matches: Column, pieces: Column) -> Column:
    return F.transform(matches, lambda m, i: F.struct(
        m.alias("value"), F.length(m).alias("n"), F.length(pieces[i]).alias("gap"),
        F.right(pieces[i], F.lit(WINDOW)).alias("before"),
        F.left(pieces[i + 1], F.lit(WINDOW)).alias("after")))


def _located(items: Column) -> Column:
    """Items with ``start``; sums run within blocks and over block totals."""
    def total(part):
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["n"] + x["gap"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
                         lambda b: total(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))

    def place(sums):
        def one(x, i):
            block = F.floor(i / BLOCK).cast("int")
            start = (F.aggregate(F.slice(sums, F.lit(1), block), F.lit(0), lambda a, s: a + s)
                     + total(F.slice(items, block * BLOCK + 1, i - block * BLOCK)) + x["gap"])
            return F.struct(start.alias("start"), (start + x["n"]).alias("end"),
                            x["value"].alias("value"), x["before"].alias("before"),
                            x["after"].alias("after"))
        return F.transform(items, one)

    return _let(blocks, place)


_SPAN = "array<struct<kind:string,start:int,end:int,score:int,value:string>>"


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind in a text, in order."""
    pattern = F.lit(KINDS[kind][0])

    def located(matches):
        return _let(F.split(text, KINDS[kind][0], -1),
                    lambda pieces: _let(_items(matches, pieces), _located))

    def described(found):
        return F.transform(F.filter(found, lambda s: _confirmed(kind, s)), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            score(kind, s["before"], s["after"]).alias("score"), s["value"].alias("value")))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)),
                lambda m: F.when(F.size(m) == 0, F.array().cast(_SPAN))
                .otherwise(_let(located(m), described).cast(_SPAN)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``found``: a struct with the array of spans of every kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.struct(*[spans_of(text, k).alias(k) for k in KINDS]).alias("found"))


def _replaced(kind: str, text: Column, matches: Column) -> Column:
    def join(pieces):
        parts = F.transform(_items(matches, pieces), lambda x, i: F.concat(
            pieces[i], F.when(_confirmed(kind, x), f"<{kind.upper()}>").otherwise(x["value"])))
        return F.concat(F.array_join(parts, ""), F.element_at(pieces, -1))

    return F.when(F.size(matches) == 0, text).otherwise(
        _let(F.split(text, KINDS[kind][0], -1), join))


def redact(text: Column) -> Column:
    """``text`` with every confirmed span replaced by its kind, kind after kind."""
    def one(kind):
        def replaced(t):
            found = F.regexp_extract_all(t, F.lit(KINDS[kind][0]), F.lit(0))
            return _let(found, lambda m: _replaced(kind, t, m))
        return replaced

    for kind in KINDS:
        text = _let(text, one(kind))
    return text


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced; a column ``size_col``
    follows the new length, all other columns stay.  A null text stays null."""
    out = docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(),
                                           redact(F.col(text_col).cast("string"))))
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind))
                             .otherwise(F.col(size_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
