"""Candidate spans. Each rule is an expression on one of few relations: content tokens, digit runs, number islands, name tapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import inn_valid, luhn_valid, snils_valid, starts_capital
from veilframe.functions.types import FLAG, NAME_FLAGS
from veilframe.operators.lexer import HAS_DIGITS, HAS_INITIAL, HAS_MAIL, Segments, by_place

WINDOWS = (2, 4, 5, 6, 8, 10, 12, 20)
DISTANCES = ("kw_issue", "kw_birth", "kw_inn", "kw_passport", "kw_dl")
FAR = 1 << 30
SPAN = "array<struct<rule:string,ty:string,start:int,end:int,start_b:int,end_b:int,lo:int,hi:int,score:int,digits:string>>"

# Words that only continue an address, particles after which a word is no name, words around years.
SECONDARY = (
    "подъезд подьезд подъезде корпус корпуса корп к строение строения стр офис офиса офисе оф литера литеры лит комната комнаты комнате ком этаж этаже эт владение вл влад домовл соор "
    "квартал квартале квартала линия линии проезд проезде тракт аллея аллее"
).split()
PARTICLES, YEAR_WORDS = ("то", "либо", "нибудь"), ("года", "год", "г")


def has(flags: Column, *names: str) -> Column:
    return flags.bitwiseAND(sum(FLAG[n] for n in names)) != 0


def context(t: DataFrame) -> DataFrame:
    """Tokens with their neighbours; content tokens also with flags and distances around them."""
    w = by_place()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    raw = F.struct("surface", "kind", "folded", "n_b")
    t = t.withColumns({"r1": F.lag(raw).over(w), "r2": F.lag(raw, 2).over(w), "s1": F.lead(raw).over(w), "s2": F.lead(raw, 2).over(w), "others": F.sum((F.col("kind") == "other").cast("int")).over(upto)})
    slashed = F.coalesce((F.col("folded") == "у") & (F.col("r1.surface") == "/") & (F.col("r2.folded") == "в"), F.lit(False))
    return t.withColumn("vu", F.coalesce(F.max(slashed.cast("int")).over(w.rowsBetween(-8, -1)), F.lit(0)) == 1)


def content(t: DataFrame) -> DataFrame:
    """The content tokens of context(): windows count content tokens alone."""
    w = by_place()
    c = t.where("content").withColumn("cap", (F.col("kind") == "word") & starts_capital(F.col("surface")))
    token = F.struct("kind", "surface", "folded", "flags", "pos", "start", "start_b", "end", "end_b", "cap", "n_c", "n_b", "others", F.col("s1.surface").alias("then"))
    around = {f"p{i}": F.lag(token, i).over(w) for i in (1, 2, 3)} | {f"x{i}": F.lead(token, i).over(w) for i in (1, 2, 3)}
    none = F.lit(0).cast("long")
    for n in WINDOWS:
        around[f"left{n}"] = F.coalesce(F.bit_or("flags").over(w.rowsBetween(-n, -1)), none)
        around[f"right{n}"] = F.coalesce(F.bit_or("flags").over(w.rowsBetween(1, n)), none)
    for name in DISTANCES:
        there = F.when(has(F.col("flags"), name), F.col("pos"))
        left, right = F.last(there, True).over(w.rowsBetween(-5, -1)), F.first(there, True).over(w.rowsBetween(1, 5))
        around[f"d_{name}"] = F.coalesce(there - F.col("pos"), F.col("pos") - left, right - F.col("pos"), F.lit(FAR))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    counted = {"words": F.col("kind") == "word", "digs": F.col("kind") == "digits"} | {f"n_{f}": has(F.col("flags"), f) for f in ("name", "surn", "patr", "geo", "public_person")}
    around |= {f"c_{k}": F.sum(v.cast("int")).over(upto) for k, v in counted.items()}
    return c.withColumns(around)


def near(n: int, *names: str) -> Column:
    """A flag on the token itself or on n content tokens on either side."""
    return has(F.col("flags").bitwiseOR(F.col(f"left{n}")).bitwiseOR(F.col(f"right{n}")), *names)


def _span(rule: str, ty, score: int, start="start", end="end", lo="pos", hi="pos", digits=None) -> Column:
    """start and end: names of structs or columns that have the places."""
    place = lambda x, f: F.col(f) if x in ("start", "end") else F.col(f"{x}.{f}")
    return F.struct(
        F.lit(rule).alias("rule"), (F.lit(ty) if isinstance(ty, str) else ty).alias("ty"), place(start, "start").alias("start"), place(end, "end").alias("end"), place(start, "start_b").alias("start_b"),
        place(end, "end_b").alias("end_b"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(score).alias("score"), (F.lit(None).cast("string") if digits is None else F.col(digits)).alias("digits"),
    )


def emit(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """A row for each rule whose condition holds."""
    spans = F.filter(F.array(*[F.when(cond, span) for cond, span in rules]).cast(SPAN), lambda s: s.isNotNull())
    return df.select("doc_id", F.inline(spans))


def opaque(df: DataFrame, **columns: Column) -> DataFrame:
    """doc_id and columns, through a generator: later plans see plain attributes, not ever larger copies of these expressions."""
    return df.select("doc_id", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def dated() -> Column:
    return F.when(F.col("d_kw_issue") < F.col("d_kw_birth"), "issue_date").otherwise("birth_date")


def digit_runs(c: DataFrame) -> DataFrame:
    """Digit groups joined by exactly one separator or one white-space byte: groups, digits, sep, and the context of the first group."""
    w = by_place()
    d = c.where("kind = 'digits'")
    joined = F.col("r1.kind").isin("sep", "space") & (F.col("r1.n_b") == 1) & (F.col("r2.kind") == "digits")
    d = d.withColumn("run", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = ["start", "start_b", "flags", "p1", "p2", "p3", "x1", "vu", *[f"left{n}" for n in WINDOWS], *[f"right{n}" for n in WINDOWS], *[f"d_{n}" for n in DISTANCES], "c_words"]
    parts = F.sort_array(F.collect_list(F.struct("pos", "n_c", "surface", F.col("r1.surface").alias("sep"))))
    r = d.groupBy("doc_id", "run").agg(
        F.min_by(F.struct(*keep), "pos").alias("head"), F.max_by(F.struct("end", "end_b", F.col("x1").alias("after"), F.col("c_words").alias("upto")), "pos").alias("tail"),
        F.min("pos").alias("pos"), F.max("pos").alias("last"), parts.alias("parts"),
    )
    r = r.select("doc_id", "run", "pos", "last", "head.*", "tail.*", "parts")
    digits = F.array_join(F.transform("parts", lambda p: p["surface"]), "")
    return r.withColumns({"groups": F.transform("parts", lambda p: p["n_c"]), "digits": digits, "sep": F.get("parts", F.lit(1))["sep"], "total": F.length(digits)}).drop("parts")


def shape(*groups: int) -> Column:
    return F.col("groups") == F.array(*map(F.lit, groups))


def of_runs(r: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    after = F.struct("groups", "start", "start_b", "end", "end_b", "pos", "last", "p1", "c_words")
    r = r.withColumn("next", F.lead(after).over(w))
    card = F.col("total").between(13, 19)
    close = Window.partitionBy("doc_id").orderBy(F.col("start_b").cast("long")).rangeBetween(-199, 199)
    r = r.withColumn("card_close", F.coalesce(F.max(card.cast("int")).over(close), F.lit(0)) == 1)
    next_shape = lambda *g: F.coalesce(F.col("next.groups") == F.array(*map(F.lit, g)), F.lit(False))
    split = (shape(4) | shape(2, 2)) & next_shape(6) & (F.col("next.c_words") - F.col("upto") <= 2)
    r = r.withColumns({
        "series": F.when(F.col("p1.folded").isin("серия", "серии"), F.struct(F.col("p1.start").alias("start"), F.col("p1.start_b").alias("start_b"))).otherwise(F.struct("start", "start_b")),
        "number": F.when(F.col("next.p1.folded").isin("номер", "номера"), F.struct(F.col("next.p1.start").alias("start"), F.col("next.p1.start_b").alias("start_b"))).otherwise(F.struct(F.col("next.start").alias("start"), F.col("next.start_b").alias("start_b"))),
        "next_pos": F.col("next.pos"), "next_last": F.col("next.last"), "prev_pos": F.col("p1.pos"), "number_end": F.struct(F.col("next.end").alias("end"), F.col("next.end_b").alias("end_b")),
    })
    licence = F.when((F.col("d_kw_dl") < F.col("d_kw_passport")) | F.col("vu"), "driver_license").otherwise("passport")
    plain = F.when(F.col("d_kw_dl") < F.col("d_kw_passport"), "driver_license").otherwise("passport")
    taxpayer = (F.col("total") == 10) & inn_valid(F.col("digits")) & (F.col("d_kw_inn") <= F.col("d_kw_passport"))
    one = lambda rule, ty, score: _span(rule, ty, score, hi="last", digits="digits")
    before = lambda words, n: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"p{i}.folded").isin(*words), F.lit(False)) for i in range(1, n + 1)])
    street = (F.size("groups") == 1) & (F.col("total") <= 3) & F.col("p1.cap") & ~has(F.col("p1.flags"), "name", "kw_addr", "addr_marker") & near(6, "kw_addr")
    letters = (F.col("x1.kind") == "word") & (F.col("x1.n_b") == 4) & F.col("x1.cap") & (F.col("x1.start") < F.col("next.start"))
    return emit(
        r,
        (shape(2, 2, 4) | shape(4, 2, 2), one("date", dated(), 40)),
        ((shape(4, 6) | shape(2, 2, 6) | shape(10)) & ~F.coalesce(F.col("sep") == "-", F.lit(False)) & ~taxpayer, one("passport", licence, 60)),
        ((shape(4) & before(("серия",), 2)) | (shape(6) & before(("номер", "номера"), 3) & near(10, "kw_passport")), one("passport_half", "passport", 60)),
        (split, _span("passport_split", plain, 60, start="series", hi="last", digits="digits")),
        (split, _span("passport_split", plain, 60, start="number", end="number_end", lo="next_pos", hi="next_last")),
        (shape(3, 3, 3, 2) | (shape(11) & snils_valid(F.col("digits"))), one("snils", "snils", 60)),
        (shape(2, 7), one("foreign_passport", "foreign_passport", 60)),
        ((shape(16) | shape(4, 4, 4, 4)) & ~luhn_valid(F.col("digits")) & near(5, "kw_doc"), one("oms", "oms", 60)),
        (shape(3, 3), one("dept_code", "dept_code", 40)),
        (shape(10) | shape(12), one("inn", "inn", 60)),
        (card, one("card", "card", 60)),
        (shape(3) & near(12, "kw_cvv", "kw_cvv_weak"), one("cvv", "cvv", 50)),
        (shape(4) & near(5, "kw_pin") & (near(10, "kw_card") | F.col("card_close")), one("pin", "pin", 50)),
        (shape(6) & (F.col("after.kind") == "word") & has(F.col("after.flags"), "geo", "addr_marker", "country") & near(5, "kw_addr", "addr_marker"), one("postal_index", "address", 40)),
        (street, _span("street_number", "address", 40, start="p1", lo="prev_pos", hi="last")),
        (shape(2) & next_shape(6) & letters & (near(10, "kw_dl") | F.col("vu")), _span("dl_letters", "driver_license", 60, end="number_end", hi="next_last")),
    )


def of_phones(t: DataFrame) -> DataFrame:
    """From each digit group of an island of digits, white space, separators and brackets: 10 or 11 digits up to its end."""
    w = by_place()
    member = F.col("kind").isin("digits", "space", "sep") | F.col("surface").isin("(", ")")
    d = t.withColumn("island", F.sum((~member).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind = 'digits'")
    back = Window.partitionBy("doc_id", "island").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"total": F.sum("n_c").over(back), "tail": F.first(F.struct("pos", "end", "end_b")).over(back)})
    d = d.where("total in (10, 11)").withColumns({"last": F.col("tail.pos"), "plus": (F.coalesce(F.col("r1.surface") == "+", F.lit(False))).cast("int")})
    return emit(d.withColumns({"from": F.struct((F.col("start") - F.col("plus")).alias("start"), (F.col("start_b") - F.col("plus")).alias("start_b"))}), (F.lit(True), _span("phone", "phone", 50, start="from", end="tail", hi="last")))


def of_mail(c: DataFrame) -> DataFrame:
    return emit(c, (F.col("kind") == "email", _span("email", "email", 60)))


def of_tokens(c: DataFrame) -> DataFrame:
    word = F.col("kind") == "word"
    month = (F.col("kind") == "digits") & (F.col("n_c") <= 2) & (F.col("x1.kind") == "word") & has(F.col("x1.flags"), "month") & (F.col("x2.kind") == "digits") & (F.col("x2.n_c") == 4)
    place = lambda col, more=0: F.struct((F.col(f"{col}.end") + more).alias("end"), (F.col(f"{col}.end_b") + more).alias("end_b"), F.col(f"{col}.pos").alias("pos"))
    year = F.when(F.col("x3.folded").isin(*YEAR_WORDS), F.when(F.col("x3.then") == ".", place("x3", 1)).otherwise(place("x3"))).otherwise(place("x2"))
    latin = (F.col("surface").rlike("^[A-Za-z]+$")) & F.col("x1.surface").rlike("^[A-Za-z]+$") & (F.col("x1.pos") == F.col("pos") + 2) & (F.col("s1.kind") == "space")
    marked = has(F.col("p1.flags"), "addr_marker")
    c = c.withColumns({"year": year, "x1_pos": F.col("x1.pos"), "from": F.when(marked, F.struct(F.col("p1.start").alias("start"), F.col("p1.start_b").alias("start_b"), F.col("p1.pos").alias("pos"))).otherwise(F.struct("start", "start_b", "pos"))})
    c = c.withColumns({"year_pos": F.col("year.pos"), "from_pos": F.col("from.pos")})
    return emit(
        c,
        (month, _span("date_words", dated(), 40, end="year", hi="year_pos")),
        (word & has(F.col("flags"), "geo", "country") & near(5, "kw_birthplace"), _span("birth_place", "birth_place", 25, start="from", lo="from_pos")),
        (word & latin & ~has(F.col("flags"), "kw_holder", "kw_card") & near(5, "kw_card", "kw_holder"), _span("card_holder", "card_holder", 40, end="x1", hi="x1_pos")),
    )


def of_countries(c: DataFrame) -> DataFrame:
    """Each country word up to the last of those that follow it with one white-space token between."""
    d = c.where((F.col("kind") == "word") & has(F.col("flags"), "country"))
    linked = has(F.col("p1.flags"), "country") & (F.col("p1.kind") == "word") & (F.col("p1.pos") == F.col("pos") - 2) & (F.col("r1.kind") == "space")
    d = d.withColumn("chain", F.sum((~F.coalesce(linked, F.lit(False))).cast("int")).over(by_place().rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("tail", F.max(F.struct("pos", "end", "end_b")).over(Window.partitionBy("doc_id", "chain"))).withColumn("last", F.col("tail.pos"))
    return emit(d, (F.lit(True), _span("citizenship", "citizenship", 25, end="tail", hi="last")))


def of_issuers(t: DataFrame) -> DataFrame:
    """From an organisation word over words, white space and separators to a number, the end of the sentence or the ninth word after it."""
    w = by_place()
    stops = F.col("kind").isin("digits", "email", "other") | F.col("stop")
    t = t.withColumns({"last_content": F.last(F.when(F.col("content"), F.col("pos")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "nth_word": F.sum((F.col("kind") == "word").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    back = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.struct(F.col("pos").alias("pos"), F.col("at").alias("end"), (F.col("end_b") - F.col("n_b")).alias("end_b"), F.col("last_content").alias("hi"))
    t = t.withColumn("edge", F.last(F.when(stops, edge), True).over(back))
    whole = Window.partitionBy("doc_id")
    t = t.withColumn("edge", F.coalesce("edge", F.struct(F.lit(FAR).alias("pos"), F.max("end").over(whole).alias("end"), F.max("end_b").over(whole).alias("end_b"), F.max(F.when(F.col("content"), F.col("pos"))).over(whole).alias("hi"))))
    words = t.where("kind = 'word'").withColumn("ninth", F.lead(F.struct("pos", "end", "end_b", F.col("pos").alias("hi")), 9).over(w))
    d = words.where(has(F.col("flags"), "kw_org")).withColumn("to", F.when(F.col("ninth.pos") < F.col("edge.pos"), F.col("ninth")).otherwise(F.col("edge")))
    return emit(d.withColumn("last", F.greatest("to.hi", "pos")), (F.lit(True), _span("issuer", "issuer", 25, end="to", hi="last")))


def of_names(t: DataFrame, c: DataFrame) -> DataFrame:
    """Names, by a regular expression on each document's tape, which has one letter a token."""
    flags = F.col("flags")
    particle = F.coalesce((F.col("s1.surface") == "-") & F.col("s2.folded").isin(*PARTICLES), F.lit(False))
    name = (F.col("kind") == "word") & (flags.bitwiseAND(NAME_FLAGS) != 0) & ~particle
    placed = F.coalesce(has(F.col("p1.flags"), "addr_marker") & (F.col("p1.others") == F.col("others")), F.lit(False))
    initial = F.col("cap") & (F.col("n_b") == 2) & F.coalesce(F.col("s1.surface") == ".", F.lit(False))
    unknown, role = F.col("cap") & (flags == 0), near(5, "role")
    # K, N: names that may begin a span (K also an initial); M: names after an address word; I, W (role near), J: initials, the
    # first two unknown words; U, V (role near): unknown capitalised words; w: other content
    letter = (
        F.when(name & ~placed, F.when(initial, "K").otherwise("N")).when(name, "M").when(initial & unknown, F.when(role, "W").otherwise("I"))
        .when(initial, "J").when(unknown, F.when(role, "V").otherwise("U")).otherwise("w")
    )
    gap = F.when(F.col("kind") == "space", " ").when(F.col("surface") == ".", ".").otherwise("-")
    cells = c.select("doc_id", "pos", letter.alias("cell")).unionByName(t.where("not content").select("doc_id", "pos", gap.alias("cell")))
    tape = cells.groupBy("doc_id").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"]), "").alias("tape"))
    tape = tape.where(F.col("tape").rlike("[NKIVW]"))
    g, any_word = "[ .-]*", "[A-Zw]"
    more = "(?:[ .]*[NKMIWJ])*"
    grammar = f"[UVIW]{g}[IWJK](?:{g}[IWJK])*|[VW]{g}{any_word}{g}[UVIW]{g}[UVIW]|[UVIW] [NK]{more}|[NK]{more}"
    found = tape.select("doc_id", "first", F.posexplode(F.regexp_extract_all("tape", F.lit(rf"{grammar}|[\s\S]"), F.lit(0))).alias("nth", "piece"))
    w = Window.partitionBy("doc_id").orderBy("nth")
    found = found.withColumns({"lo": (F.col("first") + F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int"), "then": F.lead("piece").over(w)})
    found = found.where("length(piece) > 1 or piece in ('N', 'K')")
    dot = F.col("piece").rlike("[IWJK]$") & F.coalesce(F.col("then").startswith("."), F.lit(False))
    found = found.select("doc_id", "lo", (F.col("lo") + F.length("piece") - 1).cast("int").alias("hi"), dot.cast("int").alias("dot"))
    # tokens lie by segment: they are merged where they are, never sent whole to each task
    ends = c.select("doc_id", F.col("pos").alias("_pos"), "start", "start_b", "end", "end_b").hint("merge")
    found = found.join(ends.select("doc_id", "_pos", "start", "start_b"), (found.doc_id == ends.doc_id) & (F.col("lo") == F.col("_pos"))).select(found["*"], "start", "start_b")
    found = found.join(ends.select("doc_id", "_pos", "end", "end_b"), (found.doc_id == ends.doc_id) & (F.col("hi") == F.col("_pos"))).select(found["*"], "end", "end_b")
    found = found.withColumn("to", F.struct((F.col("end") + F.col("dot")).alias("end"), (F.col("end_b") + F.col("dot")).alias("end_b")))
    return emit(found, (F.lit(True), _span("fio", "fio", 50, end="to", lo="lo", hi="hi")))


def of_addresses(t: DataFrame, c: DataFrame) -> DataFrame:
    """From a place or address word over words, numbers, white space and separators to the end of the sentence."""
    w = by_place()
    marker_before = F.coalesce(has(F.lag("flags").over(w), "addr_marker") & (F.lag("kind").over(w) == "word"), F.lit(False))
    stops = F.col("kind").isin("email", "other") | (F.col("stop") & ~marker_before)
    back = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    edged = t.withColumn("edge", F.coalesce(F.last(F.when(stops, F.col("pos")), True).over(back), F.lit(FAR))).where("content").select("doc_id", "pos", "edge")
    c = c.join(edged.hint("merge"), ["doc_id", "pos"])
    flagged = has(F.col("flags"), "geo", "addr_marker")
    first_no, first_number = F.last(F.when(~flagged, F.col("rank")), True).over(back), F.last(F.when(F.col("kind") == "digits", F.struct("rank", "pos")), True).over(back)
    c = c.withColumns({"plain_rank": F.coalesce(first_no, F.lit(FAR)), "number": first_number, "listed": flagged})
    whole = Window.partitionBy("doc_id")
    c = c.withColumn("most_rank", F.max("rank").over(whole))
    # what an extension that starts at a token would be
    ext = F.struct("pos", "rank", "start", "start_b", "edge", "plain_rank", "number", "kind", "cap", "listed")
    c = c.withColumns({"here": ext, "before1": F.lag(ext).over(w), "before2": F.lag(ext, 2).over(w), "after1": F.lead(ext).over(w)})
    anchor = (F.col("kind") == "word") & has(F.col("flags"), "geo", "kw_addr", "addr_marker") & ~(has(F.col("flags"), "geo") & near(5, "kw_birthplace")) & ~F.col("folded").isin(*SECONDARY)
    marker = has(F.col("flags"), "addr_marker")
    other = lambda p: ~has(F.col(f"{p}.flags"), "kw_addr", "addr_marker")
    numbered = marker & (F.col("p1.kind") == "digits") & (F.col("p2.kind") == "word") & other("p2") & F.col("p2.cap")
    named = marker & (F.col("p1.kind") == "word") & other("p1") & (F.col("p1.flags").bitwiseAND(NAME_FLAGS) == 0) & F.col("p1.cap")
    first = F.when(has(F.col("flags"), "kw_addr", "addr_marker"), F.when(numbered, F.col("before2")).when(named, F.col("before1")).otherwise(F.col("after1"))).otherwise(F.col("here"))
    resides = has(F.col("flags"), "geo") & F.col("cap") & near(4, "kw_addr")
    d = opaque(c.where(anchor), pos=F.col("pos"), first=first, resides=F.coalesce(resides, F.lit(False)), listed=F.col("listed"), most_rank=F.col("most_rank"))
    d = d.where("first is not null and first.pos < first.edge")
    has_number = F.coalesce((F.col("first.number.pos") < F.col("first.edge")) & (F.col("first.number.rank") - F.col("first.rank") <= 8), F.lit(False))
    # without a number only the place words at the start count
    top = F.when(has_number, F.col("first.rank") + 32).otherwise(F.greatest(F.col("first.rank"), F.least(F.col("first.plain_rank") - 1, F.col("first.rank") + 8)))
    d = opaque(d.where(has_number | F.col("resides")), anchor=F.col("pos"), first=F.col("first"), top=F.least(top, F.col("most_rank")), listed=F.col("listed"))
    tail = c.select(F.col("doc_id").alias("_d"), F.col("rank").alias("_rank"), F.col("pos").alias("_pos"), "end", "end_b", F.col("cap").alias("_cap"), F.col("listed").alias("_listed"), F.col("kind").alias("_kind"))
    d = d.join(tail.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("_rank").between(F.col("first.rank"), F.col("top"))) & (F.col("_pos") < F.col("first.edge")))
    d = d.groupBy("doc_id", "anchor").agg(
        F.first("first").alias("first"), F.max(F.struct("_pos", "end", "end_b")).alias("tail"), F.first("listed").alias("listed"), F.bool_or((F.col("_kind") == "word") & (F.col("_cap") | F.col("_listed"))).alias("looks")
    )
    d = d.where("listed or looks").withColumns({"lo": F.col("first.pos"), "hi": F.col("tail._pos")})
    return emit(d, (F.lit(True), _span("address", "address", 40, start="first", end="tail", lo="lo", hi="hi")))


def address_holes(t: DataFrame) -> DataFrame:
    """(doc_id, holes): commas, and address words with the separators right after them; they stay visible in addresses."""
    w = by_place()
    run = F.sum((F.col("kind") != "sep").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("run", run)
    t = t.withColumn("run_end", F.max(F.struct("pos", "end", "end_b")).over(Window.partitionBy("doc_id", "run")))
    comma = (F.col("kind") == "sep") & (F.col("surface") == ",")
    marker = (F.col("kind") == "word") & has(F.col("flags"), "addr_marker")
    hole = F.struct("start", F.when(comma, F.col("end")).otherwise(F.col("run_end.end")).alias("end"))
    return t.where(comma | marker).groupBy("doc_id").agg(F.sort_array(F.collect_list(hole)).alias("all_holes"))


NAMED, PLACED = NAME_FLAGS | FLAG["role"] | HAS_INITIAL, sum(FLAG[n] for n in ("geo", "kw_addr", "addr_marker"))
#: Relations that rules read: what segments must have for any of them to find something, and which kinds they find.
PARTS = (
    (HAS_DIGITS, lambda t, c: of_runs(digit_runs(c)), ("birth_date", "issue_date", "passport", "driver_license", "snils", "foreign_passport", "oms", "dept_code", "inn", "card", "cvv", "pin", "address")),
    (HAS_DIGITS, lambda t, c: of_phones(t), ("phone",)),
    (HAS_MAIL, lambda t, c: of_mail(c), ("email",)),
    (sum(FLAG[n] for n in ("month", "geo", "country", "kw_birthplace", "kw_card", "kw_holder")), lambda t, c: of_tokens(c), ("birth_date", "issue_date", "birth_place", "card_holder")),
    (FLAG["country"], lambda t, c: of_countries(c), ("citizenship",)),
    (FLAG["kw_org"], lambda t, c: of_issuers(t), ("issuer",)),
    (NAMED, lambda t, c: of_names(t, c), ("fio",)),
    (PLACED, lambda t, c: of_addresses(t, c), ("address",)),
)


def candidates(segments: Segments, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All candidates of the segments, or those of some kinds: rule, ty, places, first and last content token, score.

    They are few; those of each relation are found by a job of its own and checkpointed: in one job, tasks of all relations
    would compile each other's code out of Spark's cache.
    """
    found = []
    for hints, rules, finds in PARTS:
        if kinds is None or set(kinds) & set(finds):
            t = context(segments.tokens(hints))
            part = rules(t, content(t))
            found.append((part if kinds is None else part.where(F.col("ty").isin(*kinds))).checkpoint())
    return reduce(DataFrame.unionByName, found)
