"""Dictionaries: a table of folded words and category bits, from files or from the built-in short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.text import fold, name_forms
from veilframe.functions.types import FLAG

# Short lists of our own, for tests and first steps; production brings its files (see load).
BUILTIN = {
    "name": "анна иван мария ольга петр сергей",
    "surn": "иванов петров сидоров кузнецова",
    "patr": "иванович ивановна петрович петровна сергеевич",
    "geo": "москва москве казань калуга самара тверская springfield",
    "addr_marker": "г ул улица д дом кв квартира проспект корпус street avenue apt",
    "country": "россия российская федерация беларусь казахстан france germany spain",
    "month": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря january february march april may june july august september october november december",
    "role": "клиент директор заемщик сотрудник client director employee",
    "stop_ctx": "поэт писатель композитор poet writer",
    "doc_ctx": "договор анкета заявление contract application form",
    "eponym_head": "имени улица площадь премия named",
    "possess_head": "паспорт договор счет passport account",
    "kw_passport": "паспорт паспорта серия passport",
    "kw_birth": "дата рождения родился родилась born birth",
    "kw_issue": "выдан выдано выдачи issued",
    "kw_dept": "код подразделения department",
    "kw_dl": "права водительское license licence",
    "kw_addr": "адрес адресу проживаю address",
    "kw_inn": "инн tin",
    "kw_card": "карта карты карту card visa mastercard",
    "kw_cvv": "cvc cvv",
    "kw_cvv_weak": "код code",
    "kw_pin": "пин pin",
    "kw_phone": "телефон тел phone call tel",
    "kw_doc": "снилс полис омс policy insurance",
    "kw_holder": "держатель владелец holder cardholder",
    "kw_citizen": "гражданство citizenship",
    "kw_org": "отдел отделением мвд уфмс police office",
    "kw_birthplace": "уроженец место birthplace",
}
#: Files of a dictionary folder: one word a line, with their category; those marked also bring declined forms.
FILES = {
    "names.txt": ("name", True), "surnames.txt": ("surn", True), "patronymics.txt": ("patr", True), "geox.txt": ("geo", False), "address_markers.txt": ("addr_marker", False),
    "countries.txt": ("country", False), "months.txt": ("month", False), "stop_context.txt": ("stop_ctx", False), "doc_context.txt": ("doc_ctx", False), "roles.txt": ("role", False),
    "heads_eponym.txt": ("eponym_head", False), "heads_possess.txt": ("possess_head", False),
}
DECLINED = ("name", "surn", "patr")
LEAST_ENTRIES = 100


def lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Trimmed lines of a file without blank ones and comments; a missing file has none."""
    try:
        raw = spark.read.text(f"{folder}/{name}")
        raw.schema
    except Exception as e:  # only a missing path is passed over
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], "value string")
    return raw.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def compiled(words: DataFrame) -> DataFrame:
    """words(value, flags, declined) -> (folded, flags): words and, where declined, their forms; categories of equal words are joined."""
    own = F.array(F.col("value"))
    forms = words.select("flags", F.explode(F.when(F.col("declined"), F.concat(own, name_forms(F.lower("value")))).otherwise(own)).alias("form"))
    return forms.groupBy(fold(F.col("form")).alias("folded")).agg(F.bit_or(F.col("flags").cast("long")).alias("flags"))


def builtin(spark: SparkSession) -> DataFrame:
    """(folded, flags) of the built-in lists."""
    rows = [(w, FLAG[c], c in DECLINED) for c, words in BUILTIN.items() for w in words.split()]
    return compiled(spark.createDataFrame(rows, "value string, flags long, declined boolean"))


def persons(spark: SparkSession, folder: str) -> DataFrame:
    """(surname, form): a row for each form of each public person; forms are separated by tabs, the surname is the last word of the first."""
    forms = lines(spark, folder, "public_persons.txt").select(F.split("value", "\t").alias("forms"))
    surname = F.element_at(F.split(F.get("forms", F.lit(0)), " "), -1)
    return forms.select(fold(surname).alias("surname"), F.explode(F.transform("forms", fold)).alias("form"))


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(folded, flags) of the files in folder. Fails closed: with too few entries nothing would be masked."""
    flagged = lambda df, flags, declined: df.select("value", F.lit(flags).cast("long").alias("flags"), F.lit(declined).alias("declined"))
    known = F.create_map(*[F.lit(x) for name, bit in FLAG.items() if name.startswith("kw_") for x in (name.removeprefix("kw_"), bit)])
    pair = F.split("value", " ")
    keywords = lines(spark, folder, "keywords.txt").select(F.get(pair, F.lit(0)).alias("value"), F.try_element_at(known, F.get(pair, F.lit(1))).cast("long").alias("flags"), F.lit(False).alias("declined"))
    words = keywords.where("flags is not null")
    for name, (category, declined) in FILES.items():
        words = words.unionByName(flagged(lines(spark, folder, name), FLAG[category], declined))
    surnames = persons(spark, folder).select(F.col("surname").alias("value")).distinct()
    out = compiled(words.unionByName(flagged(surnames, FLAG["surn"] | FLAG["public_person"], True)))
    if out.limit(LEAST_ENTRIES).count() < LEAST_ENTRIES:
        raise ValueError(f"the dictionary in {folder} has fewer than {LEAST_ENTRIES} entries")
    return out


def offices(spark: SparkSession, folder: str) -> DataFrame:
    """(key): normalised addresses of bank offices."""
    from veilframe.functions.text import address_key

    return lines(spark, folder, "bank_offices.txt").select(address_key(F.col("value")).alias("key")).where("key <> ''").distinct()
