"""Evidence for and against candidates, and the weighted two-pass decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import address_key, code_points, digits_of, fold, has_flat_number, inn_valid, luhn_valid, starts_capital
from veilframe.functions.types import ANCHORED, EVIDENCE, KEYWORD_MASK, KEYWORD_WINDOW, KINDS, PERSON_LIKE, THRESHOLD
from veilframe.operators import automata, rules
from veilframe.operators.lexer import SHORT, Segments
from veilframe.operators.rules import address_holes, has

#: An office's key, or a part of it, speaks for an office from so many bytes on.
LEAST_KEY = 12


def _of_kind(values: dict[str, int], default: int = 0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("ty")), F.lit(default))


def placed(cands: DataFrame, segments: Segments) -> DataFrame:
    """Candidates with their value and what stands around them; doc_id is the document's again, part its segment's.

    Of a binary text, values and their surroundings are shown with a sign for what is not UTF-8.

    Values are cut where their segments are: these hold what stands around candidates, so whole texts are not read again.
    Toll-free numbers are no one's phone and go.
    """
    c = rules.content(rules.context(segments.tokens()))
    names = [n for n in c.columns if n.startswith(("left", "right", "c_"))]
    lo = c.select(F.col("doc_id").alias("_d"), F.col("pos").alias("_p"), F.struct("flags", "sentence", *names, "kind").alias("L"))
    hi = c.select(F.col("doc_id").alias("_d2"), F.col("pos").alias("_p2"), F.struct("flags", *[n for n in names if not n.startswith("left")]).alias("H"))
    shown = (lambda c: F.make_valid_utf8(c.cast("string"))) if segments.in_bytes else (lambda c: c)
    length = (lambda c: F.when(F.octet_length(c) < 4 * SHORT, code_points(c)).otherwise(SHORT)) if segments.in_bytes else F.length
    text = segments.texts().select(F.col("doc_id").alias("_d3"), F.col("text").alias("_text"), F.col("first").alias("_first"), "chars")
    at, size = F.col("start") - F.col("_first"), F.col("end") - F.col("start")
    value = F.substring("_text", at + 1, size)
    before, after = F.substring("_text", F.greatest(at - 20, F.lit(0)) + 1, F.least(at, F.lit(20))), F.substring("_text", at + size + 1, F.lit(20))
    d = cands.join(text.hint("merge"), F.col("doc_id") == F.col("_d3")).select(cands["*"], shown(value).alias("value"), shown(before).alias("before"), shown(after).alias("after"), "chars", length(value).alias("own_chars"))
    d = d.join(lo.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("lo") == F.col("_p"))).join(hi.hint("merge"), (F.col("doc_id") == F.col("_d2")) & (F.col("hi") == F.col("_p2"))).drop("_d", "_p", "_d2", "_p2")
    d = d.withColumn("part", F.col("doc_id")).withColumn("doc_id", F.col("part.id"))
    return d.where((F.col("ty") != "phone") | ~digits_of(F.col("value")).rlike("^[78]80[04]"))


#: Mailboxes of offices and duties, before the sign of an address.
ROLE_MAILBOXES = "info support sales admin office help contact noreply no-reply mail hello team hr press billing orders order service feedback shop reception secretary buh job jobs".split()


def without_role_mailboxes(d: DataFrame) -> DataFrame:
    """placed() candidates without e-mail addresses of duties instead of persons."""
    return d.where((F.col("ty") != "email") | ~F.lower(F.substring_index("value", "@", 1)).isin(*ROLE_MAILBOXES))


def collect(d: DataFrame, offices: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """placed() candidates -> with codes, the names of their evidence (all but E_COOCCUR)."""
    ty, L, H = F.col("ty"), (lambda n: F.col(f"L.{n}")), (lambda n: F.col(f"H.{n}"))  # noqa: E741
    anchored = ty.isin(*ANCHORED)

    def near(mask: Column, n: int) -> Column:
        """In n content tokens on either side; for phrases that hold their keyword, on the first token too."""
        outside = L(f"left{n}").bitwiseOR(H(f"right{n}"))
        inside = L("flags").bitwiseOR(L(f"left{n}")).bitwiseOR(L(f"right{n}"))
        return F.when(anchored, inside).otherwise(outside).bitwiseAND(mask) != 0

    flag = lambda *names: F.lit(sum(1 << i for i, n in enumerate(_FLAG_NAMES) if n in names))
    inner = lambda n: H(f"c_{n}") - L(f"c_{n}")  # after the first token
    some = lambda n: (inner(f"n_{n}") > 0) | has(L("flags"), n)
    words = inner("words") + (L("kind") == "word").cast("int")
    mask, window = _of_kind(KEYWORD_MASK).cast("long"), _of_kind(KEYWORD_WINDOW, 5)
    keyword = F.when(window == 12, near(mask, 12)).when(window == 10, near(mask, 10)).otherwise(near(mask, 5))
    folded, left, right = fold(F.col("value")), F.col("before"), F.col("after")
    digits = digits_of(F.col("value"))
    plus = left.endswith("+")
    form = (
        F.when(ty == "fio", (words >= 3) | some("patr") | (some("name") & (some("surn") | some("patr"))))
        .when(ty == "phone", ((F.length(digits) == 11) & digits.rlike("^[78]")) | plus)
        .when(ty == "address", has_flat_number(folded) | (some("geo") & (words >= 3) & ((inner("digs") > 0) | (L("kind") == "digits"))))
        .otherwise(False)
    )
    d = d.withColumn("_folded", folded)
    if persons is not None:
        known = persons.select(F.col("form").alias("_form")).distinct().withColumn("_public", F.lit(True))
        d = d.join(known, F.col("_folded") == F.col("_form"), "left").drop("_form")
    else:
        d = d.withColumn("_public", F.lit(None).cast("boolean"))
    public = F.coalesce("_public", F.lit(False))
    fio, person, short = ty == "fio", ty.isin(*PERSON_LIKE), F.col("chars") < SHORT
    eponym, possess = has(L("left2"), "eponym_head"), has(L("left2"), "possess_head")
    quoted = left.rlike('["«][ \\t]*$')
    if offices is not None:
        d = office_match(d, offices)
    else:
        d = d.withColumn("_office", F.lit(False))
    fired = {
        "E_CHECKSUM": ((ty == "card") & luhn_valid(digits)) | ((ty == "inn") & inn_valid(digits)),
        "E_KW_NEAR": (mask != 0) & keyword,
        "E_WHOLE": short & (F.col("own_chars") * 10 >= F.col("chars") * 9) & ~public,
        "E_POSSESS": fio & possess & ~eponym, "E_ROLE": near(flag("role"), 5), "E_FORM": form, "E_DOCCTX": near(flag("doc_ctx"), 8),
        "E_CAPS": starts_capital(F.col("value")) & (words >= 2), "E_ORGADDR": (ty == "address") & F.col("_office") & ~has_flat_number(folded),
        "E_PUBLIC_FULL": fio & public, "E_PUBLIC_SURN": fio & ~public & some("public_person"), "E_EPONYM": fio & eponym,
        "E_STOPCTX": person & near(flag("stop_ctx"), 5), "E_STOPCTX ": (ty == "birth_place") & near(flag("stop_ctx"), 20),
        "E_TITLE": person & quoted & right.rlike('^[ \\t]*["»]'), "E_TITLE ": person & right.rlike('^[ \\t]*["«]'),
    }
    codes = F.filter(F.array(*[F.when(cond, F.lit(code.strip())) for code, cond in fired.items()]), lambda x: x.isNotNull())
    return d.select("doc_id", "part", "rule", "ty", "start", "end", "start_b", "end_b", "score", "value", F.col("L.sentence").alias("sentence"), codes.alias("codes"))


from veilframe.functions.types import FLAG_NAMES as _FLAG_NAMES  # noqa: E402


#: Characters of the pieces by which containment is joined: keys of LEAST_KEY bytes have so many.
PIECE = 6


def _pieces(key: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - PIECE + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(PIECE))))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of keys where outer holds inner; inner(key) and outer(key) are distinct, inner of LEAST_KEY bytes or more.

    An inner key can lie only where all its pieces do: it is joined by the one that fewest outer keys have, then looked up.
    """
    has = outer.select(F.col("key").alias("outer"), F.explode(_pieces(F.col("key"))).alias("piece"))
    often = has.groupBy("piece").agg(F.count("*").alias("n"))
    mine = inner.select(F.col("key").alias("inner"), F.explode(_pieces(F.col("key"))).alias("piece")).join(often, "piece", "left")
    # a piece that no outer key has rules the inner key out
    mine = mine.groupBy("inner").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    return mine.join(has, "piece").where(F.contains("outer", "inner")).select("inner", "outer")


def office_match(d: DataFrame, offices: DataFrame) -> DataFrame:
    """Adds _office: the value's key holds an office's key or lies in one, from LEAST_KEY bytes on. Any number of offices.

    Up to automata.MOST_KEY_BYTES of keys are looked for by automata where the values are; more are joined by pieces.
    """
    d = d.withColumn("_key", address_key(F.col("value")))
    known = offices.select("key").where("key is not null").distinct()
    if (known.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()[0]) <= automata.MOST_KEY_BYTES:
        keys = sorted(r.key for r in known.collect())
        match = automata.contains_or_lies_in(d.sparkSession, F.when(F.col("ty") == "address", F.col("_key")), keys, LEAST_KEY)
        return d.withColumn("_office", F.coalesce(match, F.lit(False))).drop("_key")
    return _office_join(d, known)


def _office_join(d: DataFrame, known: DataFrame) -> DataFrame:
    long = F.octet_length("key") >= LEAST_KEY
    keys = d.where("ty = 'address'").select(F.col("_key").alias("key")).distinct()
    hits = contained(known.where(long), keys).select(F.col("outer").alias("_hit")).unionByName(contained(keys.where(long), known).select(F.col("inner").alias("_hit"))).distinct()
    d = d.join(hits, F.col("_key") == F.col("_hit"), "left")
    return d.withColumn("_office", (F.col("ty") == "address") & F.col("_hit").isNotNull()).drop("_key", "_hit")


def weigh(codes: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for k, v in EVIDENCE.items() for x in (k, v)])
    return _of_kind({k: base for k, (base, _) in KINDS.items()}) + F.aggregate(codes, F.lit(0), lambda a, c: a + F.element_at(weights, c))


def decide(d: DataFrame) -> DataFrame:
    """collect() candidates -> with total, vetoed, masked and codes, in two passes.

    Candidates that pass alone lend E_COOCCUR to those of other kinds in their sentence, once.
    """
    bits = _of_kind({k: 1 << i for i, k in enumerate(KINDS)}).cast("long")
    veto = F.array_contains("codes", "E_ORGADDR")
    d = d.withColumns({"_bit": bits, "vetoed": veto, "_first": (weigh(F.col("codes")) >= THRESHOLD) & ~veto})
    sentence = Window.partitionBy("doc_id", "sentence")
    d = d.withColumn("_kinds", F.coalesce(F.bit_or(F.when(F.col("_first"), F.col("_bit"))).over(sentence), F.lit(0).cast("long")))
    together = F.col("_kinds").bitwiseAND(F.bitwise_not("_bit")) != 0
    d = d.withColumn("codes", F.when(together, F.array_append("codes", F.lit("E_COOCCUR"))).otherwise(F.col("codes")))
    return d.withColumn("total", weigh(F.col("codes"))).withColumn("masked", (F.col("total") >= THRESHOLD) & ~F.col("vetoed")).drop("_bit", "_first", "_kinds")


def with_holes(d: DataFrame, t: DataFrame) -> DataFrame:
    """decided candidates -> with holes, the parts of addresses that stay visible."""
    found = address_holes(t).withColumnRenamed("doc_id", "_d")
    d = d.join(found, (F.col("part") == F.col("_d")) & (F.col("ty") == "address"), "left").drop("_d", "part")
    inside = F.filter("all_holes", lambda h: (h["start"] >= F.col("start")) & (h["end"] <= F.col("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return d.withColumn("holes", F.coalesce(F.when(F.col("rule") == "address", inside), none)).drop("all_holes")
