"""Column functions on text and digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of words: Latin and the first half of the Cyrillic block.
LETTERS = r"A-Za-zЀ-ѿ"
SPACES = r" \t\n\x0B\f\r"
WORD_RE, CAPITAL_RE = f"^[{LETTERS}]", "^[A-ZА-ЯЁ]"
#: Letters, digits and signs that an e-mail address may hold on either side.
MAIL = LETTERS + r"0-9._+\-"

# Declension of names in the nominative. For words that end so (the first match counts), the tails that
# replace the last letters (as many as the number says).
DECLENSIONS = (
    ("ова ева ёва ина ына", 1, "ой у ы ых"),
    ("ов ев ёв ин ын", 0, "а у ым е ой ы ых ыми"),
    ("ий", 2, "ого ому им ом ая ой ую ие их ими"),
    ("ый", 2, "ого ому ым ом ая ой ую ые ых ыми"),
    ("ой", 2, "ого ому ым ом ая ой ую ые ых ыми"),
    ("ия", 1, "и ю ей"),
    ("я", 1, "и е ю ей"),
    ("а", 1, "ы е у ой"),
    ("ь", 1, "я ю ем е"),
    ("й", 1, "я ю ем е"),
)
HUSHING = "[жшчщц]$"


def fold(c: Column) -> Column:
    """Lower case, with ё as е."""
    return F.translate(F.lower(c), "ё", "е")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def starts_capital(c: Column) -> Column:
    return c.rlike(CAPITAL_RE)


def code_points(b: Column) -> Column:
    """Code points that begin in a binary column: bytes that are no continuation. For short values."""
    starts = F.filter(F.sequence(F.lit(1), F.octet_length(b)), lambda i: ~F.hex(F.substring(b, i, F.lit(1))).between("80", "BF"))
    return F.when(F.octet_length(b) == 0, 0).otherwise(F.size(starts))


def valid_utf8(b: Column) -> Column:
    """Whether each lead byte of a binary column has the continuations it announces and there are no others."""
    return F.regexp_replace(F.hex(b), r"\G(?:[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F[0-7][89AB].[89AB].[89AB].)", "") == ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def luhn_valid(d: Column) -> Column:
    """A string of two digits or more whose Luhn sum is a multiple of ten."""
    return (F.length(d) >= 2) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def _digit(d: Column, i: int) -> Column:
    return F.try_element_at(F.split(d, ""), F.lit(i + 1)).try_cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(d, i) * w
    return total


#: Weights of the check digits of taxpayer numbers.
INN_10, INN_11, INN_12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def inn_valid(d: Column) -> Column:
    check = lambda weights: _weighted(d, weights) % 11 % 10
    ten = (F.length(d) == 10) & (check(INN_10) == _digit(d, 9))
    twelve = (F.length(d) == 12) & (check(INN_11) == _digit(d, 10)) & (check(INN_12) == _digit(d, 11))
    return F.coalesce(ten | twelve, F.lit(False))


def snils_valid(d: Column) -> Column:
    total = _weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, 1))
    check = total % 101 % 100
    return F.coalesce((F.length(d) == 11) & (check == F.substring(d, 10, 2).try_cast("int")), F.lit(False))


def address_key(c: Column) -> Column:
    """Folded letters and digits alone."""
    return F.regexp_replace(fold(c), r"[^0-9a-zа-ѿ]", "")


def has_flat_number(folded: Column) -> Column:
    return folded.rlike(r"кв\.|кварт\.|оф\.")


def name_forms(word: Column) -> Column:
    """Declined forms of a name, of at least two letters before the ending."""
    out = F.transform(F.array(*map(F.lit, ("а", "у", "ом", "е"))), lambda t: F.concat(word, F.when((t == "ом") & word.rlike(HUSHING), "ем").otherwise(t)))
    for endings, cut, tails in reversed(DECLENSIONS):
        fits = F.lit(False)
        for e in endings.split():
            fits = fits | (word.endswith(e) & (F.length(word) >= len(e) + 2))
        forms = F.array(*[F.concat(F.substring(word, F.lit(1), F.length(word) - cut), F.lit(t)) for t in tails.split()])
        out = F.when(fits, forms).otherwise(out)
    return out


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(c), "[\r\n]", ""), "+/", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.unbase64(F.rpad(plain, ((F.length(plain) + 3) / 4).cast("int") * 4, "="))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column under one key of up to 64 bytes."""
    pad = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in pad)), message), 256)
    return F.unhex(F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in pad)), F.unhex(inner)), 256))
