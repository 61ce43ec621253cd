"""Format-preserving pseudonyms for personal data (built-in functions only).

Numbers and dates that validate (Luhn for cards, mod 97 for IBANs, octets for
addresses, the calendar for dates) and e-mail local parts, phone numbers and
credentials are replaced by a keyed Feistel permutation of their own format:
every second position is moved by a hash of the others, in turns. Lengths,
separators, letter case and checksums stay valid, equal values get equal
pseudonyms in all documents, and different values of a format different ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

ROUNDS = 8
#: Eras of days since 0001-01-01: first day, and two factors of the number of days.
#: A date is permuted within its era, so those of our time stay there; the first
#: ends with 1899, the second covers 200 years of 365 days, the last ends with 9999.
ERAS = ((0, 35, 19_817), (693_595, 200, 365), (766_595, 2344, 1231))

_CREDENTIAL = r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\x22?\s{0,3}[=:]\s{0,3}\x22?)"
_VALUE = r"[\x21\x23-\x26\x28-\x2B\x2D-\x3A\x3C-\x7E]{6,}"
_AWS = r"AKIA[0-9A-Z]{16}"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_DMY = r"[0-9]{2}([./-])[0-9]{2}\1[0-9]{4}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{8,15}"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: 13 or more digits over spaces and hyphens; a card may lie anywhere between them.
_RUN = r"(?=(?:[ -]*[0-9]){13})[0-9][0-9 -]*[0-9](?![0-9@_%+]|[./][A-Za-z0-9])"

#: One scan finds all kinds; ``_VALUE`` counts only behind its credential's name.
def _kinds(cards: str) -> str:
    return "|".join(
        (
            rf"(?<={_CREDENTIAL}){_VALUE}",
            rf"(?<![A-Za-z0-9])(?:{_AWS}|{_EMAIL}|{_IBAN}|{_ISO}|{_DMY.replace('([./-])', '(?<s>[./-])').replace(chr(92) + '1', chr(92) + 'k<s>')}"
            rf"|{_IP}(?!\.?[0-9])|{_SSN}|{cards}|{_PHONE})(?![A-Za-z0-9])",
            rf"(?<![0-9])(?:{_PHONE})(?![0-9])",
        )
    )


_PATTERN = _kinds(f"{_RUN}|{_CARD}")
#: What is left of a run beside its cards is scanned without looking for runs.
_REST = _kinds(_CARD)
#: A text without any of these characters holds none of the kinds.
_HINT = r"[0-9@=:]"


def feistel(values: Column, radix: Column, key: str, kind: Column | str) -> Column:
    """Keyed permutation of an int array; position i stays below radix[i]. The only
    position of an array of one is always moved."""
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def turn(now: Column, r: Column) -> Column:
        others = F.array_join(F.transform(F.filter(now, lambda _, i: i % 2 != r % 2), lambda v: v.cast("string")), ",")
        shape = F.array_join(F.transform(radix, lambda m: m.cast("string")), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), shape, others), 512)

        def move(h: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                step = F.conv(h.substr((i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when(i % 2 == r % 2, (v + step) % F.get(radix, i)).otherwise(v)

            return F.transform(now, one)

        return let(digest, move)

    m = F.get(radix, F.lit(0))
    step = F.conv(F.sha2(F.concat_ws("|", F.lit(key), kind, m.cast("string")), 256).substr(1, 8), 16, 10).cast("long")
    alone = F.array(((F.get(values, F.lit(0)) + 1 + step % (m - 1)) % m).cast("int"))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)
    return F.when((F.size(values) == 1) & (m > 1), alone).otherwise(whole)


def _permuted(text: Column, key: str, kind: str, fixed: int = 0) -> Column:
    """Digits and letters of ``text`` within their class; the first ``fixed``
    characters and all others stay."""

    def body(codes: Column) -> Column:
        def classes(c: Column, i: Column) -> Column:
            free = i >= fixed
            base = F.when(free & c.between(48, 57), 48).when(free & c.between(65, 90), 65).when(free & c.between(97, 122), 97).otherwise(c)
            size = F.when(free & c.between(48, 57), 10).when(free & (c.between(65, 90) | c.between(97, 122)), 26).otherwise(1)
            return F.struct(base.alias("b"), size.alias("m"))

        def shaped(cls: Column) -> Column:
            values = F.zip_with(codes, cls, lambda c, k: (c - k["b"]).cast("int"))
            moved = feistel(values, F.transform(cls, lambda k: k["m"].cast("int")), key, kind)
            return F.array_join(F.zip_with(moved, cls, lambda v, k: F.chr((v + k["b"]).cast("long"))), "")

        return let(F.transform(codes, classes), shaped)

    return let(F.transform(F.split(text, ""), lambda c: F.ascii(c)), body)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def _refill(shape: Column, compact: Column) -> Column:
    """The letters and digits of ``compact`` between the separators of ``shape``,
    so one value written in several ways has one pseudonym."""

    def place(c: Column, i: Column) -> Column:
        before = F.length(_strip(shape.substr(F.lit(1), i)))
        return F.when(c.rlike("[A-Za-z0-9]"), compact.substr(before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), place), "")


def _plain(text: Column, key: str, kind: str) -> Column:
    return let(_permuted(_strip(text), key, kind), lambda p: _refill(text, p))


def _luhn(digits: Column) -> Column:
    """Luhn sum of all digits (the last one counts once)."""
    codes = F.reverse(F.transform(F.split(digits, ""), lambda c: F.ascii(c) - 48))
    each = F.transform(codes, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    body = _permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    closed = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return let(closed, lambda c: _refill(text, c))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN whose first four characters were moved to its end."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))


def _iban(text: Column, key: str) -> Column:
    def check(flat: Column) -> Column:
        return _mod97(F.concat(flat.substr(F.lit(5), F.length(flat)), F.substring(flat, 1, 4)))

    def closed(p: Column) -> Column:
        zero = F.concat(F.substring(p, 1, 2), F.lit("00"), p.substr(F.lit(5), F.length(p)))
        return let(zero, lambda z: F.concat(F.substring(z, 1, 2), F.lpad((98 - check(z)).cast("string"), 2, "0"), z.substr(F.lit(5), F.length(z))))

    flat = _strip(text)
    moved = let(_permuted(flat, key, "iban", fixed=4), closed)
    return F.when(check(flat) == 1, let(moved, lambda p: _refill(text, p))).otherwise(text)


def _ip(text: Column, key: str) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.cast("int"))
    valid = F.forall(octets, lambda o: o < 256)
    moved = feistel(octets, F.expr("array(256, 256, 256, 256)"), key, "ip")
    return F.when(valid, F.array_join(F.transform(moved, lambda o: o.cast("string")), ".")).otherwise(text)


def _date(text: Column, key: str, pattern: Column) -> Column:
    start = F.lit("0001-01-01").cast("date")
    day = F.datediff(F.to_date(F.try_to_timestamp(text, pattern)), start)

    def moved(d: Column) -> Column:
        out = None
        for i, (first, high, low) in enumerate(ERAS):
            at = d - first
            parts = F.array(F.floor(at / low).cast("int"), (at % low).cast("int"))
            to = let(feistel(parts, F.array(F.lit(high), F.lit(low)), key, f"date{i}"), lambda p: F.element_at(p, 1) * low + F.element_at(p, 2) + first)
            inside = d.between(first, first + high * low - 1)
            new = F.call_function("date_format", F.date_add(start, to), pattern)
            out = F.when(inside, new) if out is None else out.when(inside, new)
        return out.otherwise(text)

    return F.coalesce(let(day, moved), text)


def _dmy(text: Column, key: str) -> Column:
    """Day first; month first only where that alone is a date."""
    sep = F.substring(text, 3, 1)
    first = F.when(F.substring(text, 4, 2).cast("int") > 12, F.concat(F.lit("MM"), sep, F.lit("dd"), sep, F.lit("yyyy")))
    return _date(text, key, first.otherwise(F.concat(F.lit("dd"), sep, F.lit("MM"), sep, F.lit("yyyy"))))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of the pattern; itself where it isn't valid."""

    def whole(pattern: str) -> Column:
        return found.rlike(f"^(?:{pattern})$")

    at = F.instr(found, "@")
    email = F.concat(_permuted(F.substring(found, F.lit(1), at - 1), key, "email"), found.substr(at, F.length(found)))
    ssn = ~found.rlike("^(?:000|666|9..)|-00-|-0000$")
    return (
        F.when(whole(_EMAIL), email)
        .when(whole(_AWS), _permuted(found, key, "aws", fixed=4))
        .when(whole(_ISO), _date(found, key, F.lit("yyyy-MM-dd")))
        .when(whole(_DMY), _dmy(found, key))
        .when(whole(_IP), _ip(found, key))
        .when(whole(_SSN), F.when(ssn, _plain(found, key, "ssn")).otherwise(found))
        .when(whole(_IBAN), _iban(found, key))
        .when(whole(_CARD) & (F.length(_digits(found)) >= 13) & (_luhn(_digits(found)) % 10 == 0), _card(found, key))
        .when(whole(_PHONE), _plain(found, key, "phone"))
        .when(whole(_CARD), found)
        .otherwise(_permuted(found, key, "credential"))
    )


def _scan(text: Column, pattern: str, each: Callable[[Column], Column]) -> Column:
    """Array of (o, n): gaps as they are, and what ``each`` gives for the matches."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def parts(p: Column) -> Column:
        gap = F.array(_pair(p["g"], p["g"]))
        return F.when(p["m"].isNull(), gap).otherwise(F.concat(gap, each(p["m"])))

    return F.flatten(F.transform(pairs, parts))


def _pair(old: Column, new: Column) -> Column:
    return F.struct(old.alias("o"), new.alias("n"))


def _cards(run: Column) -> Column:
    """Places (s, e) of the cards in a run, in order: whole groups of digits, 13 to
    19 together, that pass Luhn; the longest first, then the first."""

    def spans(chars: Column) -> Column:
        def digit(i: Column) -> Column:
            return F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("[0-9]")

        def ends(s: Column) -> Column:
            def fits(e: Column) -> Column:
                t = F.array_join(F.slice(chars, s, e - s + 1), "")
                return digit(e) & ~digit(e + 1) & t.rlike(f"^{_CARD}$") & (_luhn(_digits(t)) % 10 == 0)

            def span(e: Column) -> Column:
                n = F.length(_digits(F.array_join(F.slice(chars, s, e - s + 1), "")))
                return F.struct((-n).alias("k"), s.alias("s"), e.alias("e"))

            last = F.least(s + 36, F.size(chars))
            return F.when(last >= s + 12, F.transform(F.filter(F.sequence(s + 12, F.greatest(last, s + 12)), fits), span)).otherwise(F.array().cast(kind))

        starts = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: digit(i) & ~F.when(i > 1, digit(F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(False)))
        return F.array_sort(F.flatten(F.transform(starts, ends)))

    kind = "array<struct<k:int,s:int,e:int>>"
    found = let(F.split(run, ""), lambda c: spans(F.filter(c, lambda x: x != "")))
    apart = F.aggregate(
        found, F.array().cast(kind), lambda a, x: F.when(F.exists(a, lambda y: (y["s"] <= x["e"]) & (x["s"] <= y["e"])), a).otherwise(F.array_append(a, x))
    )
    return F.array_sort(F.transform(apart, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))


def _plain_digits(found: Column, key: str) -> Column:
    """``pseudonym`` of the kinds that hold only digits, spaces and hyphens."""
    ssn = ~found.rlike("^(?:000|666|9..)|-00-|-0000$")
    return (
        F.when(found.rlike(f"^(?:{_ISO})$"), _date(found, key, F.lit("yyyy-MM-dd")))
        .when(found.rlike(f"^(?:{_DMY})$"), _dmy(found, key))
        .when(found.rlike(f"^(?:{_SSN})$"), F.when(ssn, _plain(found, key, "ssn")).otherwise(found))
        .when(found.rlike(f"^(?:{_PHONE})$"), _plain(found, key, "phone"))
        .otherwise(found)
    )


def _inside(run: Column, key: str) -> Column:
    """(o, n) of a run that is no card itself: the cards in it, and the other kinds
    in what is left."""

    def rest(text: Column) -> Column:
        return _scan(text, _REST, lambda m: F.array(_pair(m, _plain_digits(m, key))))

    def cut(cards: Column) -> Column:
        def piece(i: Column) -> Column:
            low = F.when(i > 0, F.get(cards, i - 1)["e"] + 1).otherwise(F.lit(1))
            here = F.get(cards, i)
            before = rest(run.substr(low, F.coalesce(here["s"], F.length(run) + 1) - low))
            card = run.substr(here["s"], here["e"] - here["s"] + 1)
            return F.concat(before, F.transform(F.filter(F.array(card), lambda c: c.isNotNull()), lambda c: _pair(c, _card(c, key))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cards)), piece))

    return let(_cards(run), cut)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and n_replaced for every row of ``docs``. Who
    knows ``key`` can undo the pseudonyms: keep it secret.

    Null text is empty. Matches that don't validate stay (every calendar date from
    0001-01-01 to 9999-12-31 does); in a run of digits that
    is no card, the groups that make one are replaced. Repeated rows come back
    alike; an empty table gives no rows; other columns are not read."""

    def each(m: Column) -> Column:
        digits = _digits(m)
        run = m.rlike(r"^[0-9][0-9 -]*[0-9]$") & (F.length(digits) >= 13) & ~(m.rlike(f"^{_CARD}$") & (_luhn(digits) % 10 == 0))
        return F.when(run, _inside(m, key)).otherwise(F.array(_pair(m, pseudonym(m, key))))

    df = docs.select(F.col("doc_id").alias("_vd_id"), text_of().alias("_vd_text"))
    some = F.col("_vd_text").rlike(_HINT)
    df = df.withColumn("_vd_parts", F.when(some, _scan(F.col("_vd_text"), _PATTERN, each)))
    joined = F.array_join(F.transform("_vd_parts", lambda p: p["n"]), "")
    changed = F.size(F.filter("_vd_parts", lambda p: p["o"] != p["n"]))
    return df.select(
        F.col("_vd_id").alias("doc_id"),
        F.when(some, joined).otherwise(F.col("_vd_text")).alias("text"),
        F.when(some, changed).otherwise(0).cast("long").alias("n_replaced"),
    )
