"""Texts written from table keys, one for each rule and kind of evidence and some that must stay, with what the engine must find in them.

Digits of the keys run through the values. What is expected is stated by hand in CASES and turned into SQL; the engine
never sees it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.types import THRESHOLD


@dataclass(frozen=True)
class Case:
    """A text prefix + head + digits of the key + tail + suffix, and the spans in it.

    spans: kind, characters after the start of the value, before its end, codes and total of each that the rule finds.
    others: the same of other rules, their names first. kept: kind and place of what is masked, if not the first span.
    stars, labels: what becomes of value and suffix in the two modes, if not the value alone is masked as a whole.
    """

    rule: str
    prefix: str
    head: str
    digits: int
    tail: str
    spans: tuple[tuple[str, int, int, str, int], ...]
    suffix: str = "!\nno "
    others: tuple[tuple[str, str, int, int, str, int], ...] = ()
    kept: tuple[tuple[str, int, int], ...] | None = None
    stars: str | None = None
    labels: str | None = None

    def found(self) -> list[tuple[str, str, int, int, str, int]]:
        return [(self.rule, *s) for s in self.spans] + list(self.others)

    def masked(self) -> tuple[tuple[str, int, int], ...]:
        return tuple((ty, a, b) for ty, a, b, _, total in self.spans[:1] if total >= THRESHOLD) if self.kept is None else self.kept


def with_luhn(digits: str) -> str:
    """digits and their check digit."""
    double = lambda d: d * 2 - 9 * (d > 4)
    total = sum(double(int(d)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def one(rule: str, ty: str, prefix: str, head: str, digits: int, tail: str, codes: str, total: int, suffix: str = "!\nno ", **more) -> Case:
    return Case(rule, prefix, head, digits, tail, ((ty, 0, 0, codes, total),), suffix, **more)


def none(prefix: str, head: str, digits: int, tail: str) -> Case:
    """A text in which nothing is found."""
    return Case("none", prefix, head, digits, tail, ())


#: Ten digits are a number to call, too; it loses against what the keyword says.
CALL, CARD = (("phone", "phone", 0, 0, "E_COOCCUR", 65),), (("card", "card", 0, 0, "E_COOCCUR", 65),)
FIO = "E_CAPS,E_FORM"
CASES = (
    one("fio", "fio", "клиент ", "Иван Петрович Сидоров", 0, "", f"{FIO},E_ROLE", 100),
    one("fio", "fio", "звонил ", "Кнорре Б. В.", 0, "", FIO, 70),
    one("fio", "fio", "клиент ", "Лорен Ипсен Долор Аметов", 0, "", f"{FIO},E_ROLE", 100),
    one("fio", "fio", "паспорт ", "Анна Кузнецова", 0, "", f"{FIO},E_POSSESS", 105),
    one("fio", "fio", "анкета ", "Анна Кузнецова", 0, "", f"{FIO},E_DOCCTX", 85),
    one("fio", "fio", "имени ", "Анна Кузнецова", 0, "", f"{FIO},E_EPONYM", 15),
    one("fio", "fio", "поэт ", "Анна Кузнецова", 0, "", f"{FIO},E_STOPCTX", 25),
    one("fio", "fio", 'роман "', "Анна Кузнецова", 0, "", f"{FIO},E_TITLE,E_TITLE", 10, '" тут!\nno '),
    one("date", "birth_date", "родился ", "03.04.19", 2, "", "E_KW_NEAR", 65),
    one("date", "issue_date", "выдан ", "05.06.20", 2, "", "E_KW_NEAR", 65),
    one("date_words", "birth_date", "родилась ", "7 марта 19", 2, " года", "E_KW_NEAR", 65),
    one("passport", "passport", "паспорт ", "4611 1", 5, "", "E_KW_NEAR", 80, others=CALL),
    one("passport", "driver_license", "passport водительское ", "7712 2", 5, "", "E_KW_NEAR", 80, others=CALL),
    one(
        "passport", "passport", "паспорт ", "4612 3", 5, "", "E_COOCCUR,E_KW_NEAR", 115, " и почта box@post.example!\nno ", others=(*CALL, ("email", "email", 20, -25, "E_COOCCUR", 90)),
        kept=(("passport", 0, 0), ("email", 20, -25)), stars="**** ****** и почта ****************!\nno ", labels="[passport_15] и почта [email_41]!\nno ",
    ),
    one("passport", "passport", "", "4613 400001", 0, "", "E_COOCCUR,E_WHOLE", 110, "", others=(("phone", "phone", 0, 0, "E_COOCCUR,E_WHOLE", 100),)),
    one("passport_half", "passport", "серия ", "46", 2, "", "E_KW_NEAR", 80),
    one("passport_half", "passport", "паспорт номер ", "5", 5, "", "E_KW_NEAR", 80),
    one("snils", "snils", "снилс ", "123-456-7", 2, " 00", "E_KW_NEAR", 80, others=CALL),
    one("foreign_passport", "foreign_passport", "полис ", "71 61", 5, "", "E_KW_NEAR", 80),
    one("oms", "oms", "полис ", "7812345678901234"[:15] + str((int(with_luhn("781234567890123")[-1]) + 1) % 10), 0, "", "E_KW_NEAR", 80, others=CARD),
    one("dept_code", "dept_code", "код подразделения ", "770-", 3, "", "E_KW_NEAR", 80, "!"),
    one("inn", "inn", "инн ", "3628140950", 0, "", "E_CHECKSUM,E_KW_NEAR", 125, others=CALL),
    one("card", "card", "карта ", with_luhn("402960001234567"), 0, "", "E_CHECKSUM,E_KW_NEAR", 115),
    Case("phone", "телефон ", "+7 912 555-", 2, "-31", (("phone", 0, 0, "E_FORM,E_KW_NEAR", 90), ("phone", 3, 0, "E_KW_NEAR", 70))),
    one("email", "email", "почта ", "box", 4, "@post.example", "", 55),
    Case("citizenship", "гражданство ", "Российская Федерация", 0, "", (("citizenship", 0, 0, "E_CAPS,E_KW_NEAR", 70), ("citizenship", 11, 0, "E_KW_NEAR", 65))),
    one("birth_place", "birth_place", "родился уроженец ", "г Казань", 0, "", "E_KW_NEAR", 65),
    one("issuer", "issuer", "выдан ", "уфмс по городу ", 0, "", "E_KW_NEAR", 65, "19!\nno "),
    one(
        "postal_index", "address", "адрес ", "1", 5, "", "E_KW_NEAR", 80, " Казань!\nno ", others=(("address", "address", 0, -7, "E_KW_NEAR", 80), ("address", "address", 7, -7, "E_KW_NEAR", 80)),
        kept=(("address", 0, -7),), stars="****** ******!\nno ", labels="[address_11]!\nno ",
    ),
    Case(
        "address", "адрес ", "Москва, улица Тверская, 1", 2, "", (("address", 0, 0, "E_CAPS,E_FORM,E_KW_NEAR", 105), ("address", 14, 0, "E_KW_NEAR", 80)),
        others=(("street_number", "address", 14, 0, "E_KW_NEAR", 80),), stars="******, улица ********, ***!\nno ",
    ),
    one("street_number", "address", "адрес ", "Ленская 1", 1, "", "E_KW_NEAR", 80, others=(("address", "address", 0, 0, "E_KW_NEAR", 80),)),
    one("dl_letters", "driver_license", "водительское ", "77 АВ 1", 5, "", "E_KW_NEAR", 80),
    one("cvv", "cvv", "карта cvv ", "1", 2, "", "E_KW_NEAR", 55, "!"),
    one("pin", "pin", "карта пин ", "1", 3, "", "E_KW_NEAR", 55, "!"),
    one("card_holder", "card_holder", "держатель ", "JOHN SMITH", 0, "", "E_CAPS,E_KW_NEAR", 75),
    none("заказ готов, ", "место ", 5, ""),
    Case("none", "горячая линия ", "8 800 555-1", 1, "-42", (), others=(("phone", "phone", 2, 0, "", 30),)),
    none("расход ", "1 250 000,", 2, " рублей"),
    none("счет ", "408178100999100", 5, ""),
    none("замок открыт в ", "12:4", 1, ":07"),
    none("узел ", "192.168.10.", 1, " отвечает"),
    none("стоит @ одно и ", "два@ ", 4, " раз"),
    none("Тихое Утро в лесу, ", "сборка 2.1", 1, ".9"),
)


def texts(keys: DataFrame) -> DataFrame:
    """keys(key) -> (doc_id, text, rule): each key's text, of the case that is its turn."""
    case = F.element_at(F.array(*[F.struct(F.lit(c.rule).alias("rule"), F.lit(c.prefix + c.head).alias("a"), F.lit(c.digits).alias("n"), F.lit(c.tail + c.suffix).alias("z")) for c in CASES]), (F.col("key") % len(CASES) + 1).cast("int"))
    d = keys.select("key", case.alias("c")).select("key", "c.*")
    number = F.when(F.col("n") > 0, F.substring(F.lpad(F.col("key").cast("string"), 9, "0"), F.lit(10) - F.col("n"), F.col("n"))).otherwise("")
    return d.select(F.col("key").alias("doc_id"), F.concat("a", number, "z", F.when(F.col("z").endswith("no "), F.col("key").cast("string")).otherwise("")).alias("text"), "rule")


def annotations(d: DataFrame) -> DataFrame:
    """texts() with spans, array of (start, end, ty): what is to be masked in each, as an annotator would mark it."""
    places = [[(len(c.prefix) + a, len(c.prefix + c.head) + c.digits + len(c.tail) - b, ty) for ty, a, b in c.masked()] for c in CASES]
    known = d.sparkSession.createDataFrame(list(enumerate(places)), "_turn long, spans array<struct<start:int,end:int,ty:string>>")
    return d.join(F.broadcast(known), F.col("doc_id") % len(CASES) == F.col("_turn")).drop("_turn")


def _rows(of) -> str:
    return ", ".join(row for i, c in enumerate(CASES) for row in of(i, c, len(c.prefix), len(c.prefix) + len(c.head) + c.digits + len(c.tail)))


def _codes(codes: str) -> str:
    return ",".join(sorted(filter(None, codes.split(","))))


def expected_sql(table: str, key: str) -> str:
    """SQL with the expected spans of every key: doc_id, rule, ty, start, end, codes, total."""
    rows = _rows(lambda i, c, begin, end: [f"({i}, '{c.rule}', '{ty}', {begin + a}, {end - b}, '{_codes(codes)}', {total})" for ty, a, b, codes, total in c.spans])
    return f"""SELECT k.{key} AS doc_id, e.rule, e.ty, e.s AS start, e.e AS "end", e.codes, e.total FROM {table} k
JOIN (VALUES {rows}) e(turn, rule, ty, s, e, codes, total) ON k.{key} % {len(CASES)} = e.turn"""


def tables_sql(table: str, key: str) -> str:
    """Common tables: x(doc_id, text, stars, labels), e (expected candidates of all rules) and s (expected spans that are masked, nth from 0)."""
    q = lambda t: "NULL" if t is None else "'" + t.replace("\n", "' || chr(10) || '") + "'"
    quoted = ", ".join(f"({i}, {q(c.prefix)}, {q(c.head)}, {c.digits}, {q(c.tail)}, {q(c.suffix)}, {q(c.stars)}, {q(c.labels)}, {q(c.masked()[0][0] if c.masked() else None)})" for i, c in enumerate(CASES))
    found = _rows(lambda i, c, begin, end: [f"({i}, '{rule}', '{ty}', {begin + a}, {end - b}, '{_codes(codes)}', {total})" for rule, ty, a, b, codes, total in c.found()])
    masked = _rows(lambda i, c, begin, end: [f"({i}, {n}, '{ty}', {begin + a}, {end - b})" for n, (ty, a, b) in enumerate(c.masked())])
    return f"""c(turn, prefix, head, digits, tail, suffix, stars, labels, ty) AS (VALUES {quoted}),
v AS (SELECT k.{key} AS doc_id, c.*, head || substr(lpad(k.{key}::VARCHAR, 9, '0'), 10 - digits, digits) || tail AS value, CASE WHEN suffix LIKE '%no ' THEN k.{key}::VARCHAR ELSE '' END AS last FROM {table} k JOIN c ON k.{key} % {len(CASES)} = turn),
x AS (SELECT doc_id, turn, prefix || value || suffix || last AS text,
  prefix || CASE WHEN stars IS NOT NULL THEN stars WHEN ty IS NULL THEN value || suffix ELSE regexp_replace(value, '[^ ]', '*', 'g') || suffix END || last AS stars,
  prefix || CASE WHEN labels IS NOT NULL THEN labels WHEN ty IS NULL THEN value || suffix ELSE '[' || ty || '_' || strlen(prefix) || ']' || suffix END || last AS labels FROM v),
e0(turn, rule, ty, start, "end", codes, total) AS (VALUES {found}),
s0(turn, nth, ty, start, "end") AS (VALUES {masked}),
e AS (SELECT doc_id, text, e0.* FROM x JOIN e0 USING (turn)),
s AS (SELECT doc_id, text, s0.* FROM x JOIN s0 USING (turn))"""
