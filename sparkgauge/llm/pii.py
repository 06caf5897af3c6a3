"""Personal data replaced by keyed surrogates, in SQL functions only and without a shuffle.

E-mail addresses, phone numbers, IPv4 addresses, card numbers and names after a title are
found by one pattern; the words of such a name are then found again wherever they stand
alone in the same text. Each entity has a canonical form (lower case; for numbers the
digits alone), and its surrogate is a keyed permutation of that form:

- letters and digits are replaced by others of the same class: digits, vowels and
  consonants of a script; punctuation stays;
- an address keeps its top-level domain, a phone number its country code, a card number
  its Luhn remainder (valid ones stay valid), octets stay within 1 to 254 (0 and 255 stay);
- names keep their title, and words of four letters or more their last letter, which
  carries the gender in many languages.

The surrogate is then laid into the form of the mention: its case, blanks and dashes. So
all mentions of an entity agree, in whatever form, within a text and between texts.

The permutation is a Feistel network over the characters at even and at odd places: each
half is shifted by a keyed hash of the other half. It is run forwards, one character is
moved on, and it is run backwards, so it is one-to-one on all strings of a form and maps
none to itself. Different entities thus have different surrogates by construction, even if
a form's strings are all in use; no rounds of drawing are needed and nothing can run out.
A surrogate can be the text of another entity, which has itself been replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.quality_rules import let

MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Doña|Госпожа"
_NAME = r"[\p{Lu}][\p{L}'’]+"
_TITLE = rf"(?:{MALE}|{FEMALE})\.? "
NAMED = rf"(?<![\p{{L}}\p{{N}}]){_TITLE}{_NAME}(?: {_NAME})?"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}](?:[\p{L}\p{N}.-]{0,250}[\p{L}\p{N}])?\.[\p{L}]{2,}"
IPV4 = r"(?<![\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{N}]|\.[0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\p{N}])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![\p{N}-])[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])"
CARD = r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])"
PATTERN = "|".join((EMAIL, IPV4, CARD, PHONE, NAMED))
HINT = f"[0-9@]|{MALE}|{FEMALE}"
#: Lengths of country codes: those of one and two digits; all others have three.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
# Digits, then vowels and consonants of Latin, wide Latin, Cyrillic (with its signs) and Greek, then Hebrew and Arabic letters.
ALPHABETS = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿāăąēęěīōőœūůű", "çñćčďđğłńňřśşšťźżž", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
)


def _stream(key: str, form: Column, turn: int, said: Column, size: Column) -> Column:
    """Hex digits, eight for each of ``size`` characters."""
    blocks = F.sequence(F.lit(0), F.ceil(size / 16).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), form, F.lit(str(turn)), said, b.cast("string")), 512)), "")


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, i * 8 + 1, F.lit(8)), 16, 10).cast("long")


def permuted(key: str, form: Column, values: Column, radices: Column) -> Column:
    """Another array of numbers below ``radices``, one-to-one for each ``form`` and array of radices.

    No array is mapped to itself, unless all radices are 1.
    """

    def turned(state: Column, odd: Column, turn: int, sign: int) -> Column:
        """The numbers at odd (or even) places shifted by a hash of the others."""

        def shifted(s: Column) -> Column:
            said = F.array_join(F.transform(F.filter(s, lambda v, i: (i % 2 == 1) != odd), lambda v: v.cast("string")), ",")
            return let(_stream(key, form, turn, said, F.size(s)), lambda h: F.transform(s, lambda v, i: F.when((i % 2 == 1) == odd, F.pmod(v + sign * _number(h, i), F.get(radices, i))).otherwise(v)))

        return let(state, shifted)

    def run(at: Column) -> Column:  # the first place with a choice
        odd = at % 2 == 1
        there = turned(turned(values, odd, 1, 1), ~odd, 2, 1)
        step = F.pmod(_number(_stream(key, form, 3, F.lit(""), F.lit(1)), F.lit(0)), F.greatest(F.get(radices, at) - 1, F.lit(1).cast("long"))) + 1
        moved = F.transform(there, lambda v, i: F.when(i == at, F.pmod(v + step, F.get(radices, i))).otherwise(v))
        return turned(turned(moved, ~odd, 2, -1), odd, 1, -1)

    first = F.array_position(F.transform(radices, lambda r: r > 1), True).cast("int") - 1
    return let(first, lambda at: F.when(at < 0, values).otherwise(run(at)))


def _letters(key: str, kind: str, text: Column, fixed: Column) -> Column:
    """``text`` (lower case) with each letter and digit replaced by one of its class, but for the places of ``fixed``."""
    of = lambda c: reduce(lambda tail, k: F.when(F.instr(F.lit(ALPHABETS[k]), c) > 0, k).otherwise(tail), range(len(ALPHABETS)), F.lit(-1))
    names = F.array(*map(F.lit, ALPHABETS))

    def cells(chars: Column) -> Column:
        def run(kinds: Column) -> Column:
            values = F.transform(chars, lambda c, i: F.when(F.get(kinds, i) >= 0, F.instr(F.get(names, F.get(kinds, i)), c) - 1).otherwise(0).cast("long"))
            radices = F.transform(kinds, lambda k: F.when(k >= 0, F.length(F.get(names, k))).otherwise(1).cast("long"))
            # what stays is part of the form
            form = F.concat(F.lit(f"{kind}:"), F.array_join(F.transform(chars, lambda c, i: F.when(F.get(kinds, i) >= 0, F.get(kinds, i).cast("string")).otherwise(c)), " "))
            made = let(F.struct(values.alias("v"), radices.alias("r"), form.alias("f")), lambda x: permuted(key, x["f"], x["v"], x["r"]))
            return F.zip_with(F.zip_with(made, kinds, lambda v, k: F.when(k >= 0, F.substr(F.get(names, k), v.cast("int") + 1, F.lit(1)))), chars, lambda new, c: F.coalesce(new, c))

        return F.array_join(let(F.transform(chars, lambda c, i: F.when(fixed(i, F.size(chars)), -1).otherwise(of(c))), run), "")

    return let(F.split(text, ""), cells)


def _lower(text: Column) -> Column:
    return F.when(F.length(F.lower(text)) == F.length(text), F.lower(text)).otherwise(text)


def _cased(new: Column, mention: Column) -> Column:
    """``new`` in the case of a mention of its length."""
    chars = F.zip_with(F.split(new, ""), F.split(mention, ""), lambda n, c: F.when(c != F.lower(c), F.upper(n)).otherwise(n))
    return F.array_join(chars, "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid(digits: Column, mention: Column) -> Column:
    """The mention with its digits replaced in order."""
    one = lambda c, i: F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(mention, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(mention, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    value = lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, v: a + v) % 10


_NONE_FIXED = lambda i, n: F.lit(False)


def _email(key: str, text: Column) -> Column:
    head = let(_lower(text), lambda t: _letters(key, "email", F.regexp_extract(t, r"^(.*)(\.[^.]+)$", 1), _NONE_FIXED))
    return let(F.concat(head, F.lower(F.regexp_extract(text, r"(\.[^.]+)$", 1))), lambda new: F.when(F.length(new) == F.length(text), _cased(new, text)).otherwise(new))


def _card(key: str, text: Column) -> Column:
    def made(d: Column) -> Column:
        head = _letters(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), _NONE_FIXED)
        # the last digit keeps the remainder, so it follows from the others and the permutation stays one-to-one
        return let(F.concat(head, F.lit("0")), lambda x: F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.pmod(_luhn(d) - _luhn(x), F.lit(10)).cast("string")))

    return let(let(_digits(text), made), lambda new: _laid(new, text))


def _phone(key: str, text: Column) -> Column:
    plain = F.concat(F.when(text.startswith("+"), "+").otherwise(""), _digits(text))
    new = let(plain, lambda p: let(F.length(F.regexp_extract(p, _CODE, 0)), lambda code: _letters(key, "phone", p, lambda i, n: i < code)))
    return let(_digits(new), lambda d: _laid(d, text))


def _ipv4(key: str, text: Column) -> Column:
    def made(octets: Column) -> Column:
        radices = F.transform(octets, lambda o: F.when(o.between(1, 254), 254).otherwise(1).cast("long"))
        values = F.transform(octets, lambda o: F.when(o.between(1, 254), o - 1).otherwise(0).cast("long"))
        form = F.concat(F.lit("ipv4:"), F.array_join(F.transform(octets, lambda o: F.when(o.between(1, 254), "").otherwise(o.cast("string"))), "."))
        new = let(F.struct(values.alias("v"), radices.alias("r"), form.alias("f")), lambda x: permuted(key, x["f"], x["v"], x["r"]))
        return F.array_join(F.zip_with(octets, new, lambda o, v: F.when(o.between(1, 254), v + 1).otherwise(o).cast("string")), ".")

    return let(F.transform(F.split(text, r"\."), lambda o: o.cast("int")), made)


def _word(key: str, text: Column) -> Column:
    return let(let(_lower(text), lambda t: _letters(key, "name", t, lambda i, n: (n >= 4) & (i == n - 1))), lambda new: _cased(new, text))


def surrogate(key: str, entity: Column) -> Column:
    """The surrogate of one mention of an entity."""
    title = F.regexp_extract(entity, f"^{_TITLE}", 0)
    name = F.concat(title, F.array_join(F.transform(F.split(F.substr(entity, F.length(title) + 1, F.length(entity)), " "), lambda w: _word(key, w)), " "))
    return (
        F.when(entity.contains("@"), _email(key, entity))
        .when(entity.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), _ipv4(key, entity))
        .when(entity.rlike(f"^(?:{CARD})$"), _card(key, entity))
        .when(entity.rlike(r"^[+(0-9]"), _phone(key, entity))
        .otherwise(name)
    )


def _pattern(text: Column) -> Column:
    """The pattern for a text: with the words of its own titled names, where they stand alone."""
    titled = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    words = F.flatten(F.transform(F.filter(titled, lambda e: e.rlike(f"^{_TITLE}")), lambda e: F.split(F.regexp_replace(e, f"^{_TITLE}", ""), " ")))
    alone = lambda w: F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(F.array_distinct(w)), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return let(words, lambda w: F.when(F.size(w) > 0, alone(w)).otherwise(PATTERN))


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with all entities in ``text_col`` replaced, and ``n_entities`` (long).

    Each row is replaced by itself: null ids, repeated rows and rows with one id make no
    difference. Null texts stay null with 0 entities; an empty text stays empty. An
    ``n_entities`` column is replaced; a column named ``__pii`` is dropped; other columns
    stay. An empty table gives an empty result. The key must not be empty.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names = [c for c in docs.columns if c not in ("__pii", "n_entities")]
    text = F.col(text_col).cast("string")

    def woven(pattern: Column) -> Column:
        def weave(hits: Column) -> Column:
            parts = F.zip_with(F.split(text, pattern, -1), F.array_append(F.transform(hits, lambda h: surrogate(key, h)), F.lit("")), lambda a, b: F.concat(a, b))
            return F.struct(F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(text).alias("text"), F.size(hits).cast("long").alias("n"))

        return let(F.regexp_extract_all(text, pattern, F.lit(0)), weave)

    kept = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    found = docs.select(*names).withColumn("__pii", F.when(F.coalesce(text.rlike(HINT), F.lit(False)), let(_pattern(text), woven)).otherwise(kept))
    return found.select(*(F.col("__pii.text").alias(c) if c == text_col else F.col(c) for c in names), F.col("__pii.n").alias("n_entities"))
