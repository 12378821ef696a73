"""Quality rules whose cutoffs are chosen under a bound on false rejections. DataFrame functions only.

Each rule compares a share of a text (signs, repeated lines and words, capitals, exclamations) with a cutoff of its own.
In each stratum (language) the sound documents of a labelled holdout say how many a cutoff rejects falsely; an exact
binomial test keeps the cutoffs at which a false rejection rate of RISK / rules or more would show so few with a
probability of at most CONFIDENCE / (strata * rules). So with confidence 1 - CONFIDENCE all rules together reject at most
RISK of the sound documents in every stratum. A rule's cutoffs are nested and the tail grows with the count, so testing
them from the mildest on needs no further correction. Of a rule's safe cutoffs the one that rejects most labelled poor
documents beyond the sound ones is used, the mildest of equals; where none rejects more poor than sound, the rule does not apply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import WORD, let, settle, table

RISK, CONFIDENCE = 0.05, 0.05
#: Cutoffs are whole levels: steps of 1/16 of the units below, up to 4 units.
STEPS, LEVELS = 16, 64
UNITS = {"signs": 0.1, "lines": 0.5, "repeats": 0.4, "capitals": 0.5, "marks": 0.4}
SIGNS = "[^#*$%&|<>]+"
NOT_UPPER, NOT_MARK = r"[^\p{Lu}]+", "[^!?]+"


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def counted(ranked: Column) -> Column:
        """ranked: windows' hashes with their places, sorted."""
        twice = F.transform(ranked, lambda x, k: F.when((x["g"] == F.get(ranked, k - 1)["g"]) | (x["g"] == F.get(ranked, k + 1)["g"]), x["i"]))
        places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def of(grams: Column) -> Column:
        some = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(some, let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), counted)).otherwise(0)

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) > 3, let(grams, of)).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text; levels: for each rule, the mildest level that rejects it."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words"))

    def lines(full: Column) -> Column:
        return F.struct(F.size(full).alias("n_lines"), (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"))

    left = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("long")
    d = docs.select(
        "doc_id", "lang", let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), counts).alias("c"), let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lines).alias("l"),
        left(SIGNS).alias("n_symbols"), left(NOT_UPPER).alias("n_upper"), left(NOT_MARK).alias("n_marks"),
    )
    d = d.select("doc_id", "lang", "c.*", "l.*", "n_symbols", "n_upper", "n_marks")
    one = F.lit(1)
    shares = {
        "signs": F.col("n_symbols") / F.greatest("word_chars", one), "lines": F.col("n_dup_lines") / F.greatest("n_lines", one), "repeats": F.col("n_repeat_words") / F.greatest("n_words", one),
        "capitals": F.col("n_upper") / F.greatest("word_chars", one), "marks": F.col("n_marks") / F.greatest("n_words", one),
    }
    levels = F.struct(*[F.least(F.floor(share * STEPS / UNITS[k]), F.lit(LEVELS)).cast("long").alias(k) for k, share in shares.items()])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("levels", levels).withColumn("base_failed", failed)


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series eight steps further on; good to 1e-12."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at p; 1 if k / n is not below p.

    Below the mean terms fall at least as fast as those of a normal law, so those more than nine standard deviations
    below the first are under double precision and are left out. The number of terms grows with the root of n.
    """
    k, n = k.cast("double"), n.cast("double")

    def term(j: Column) -> Column:
        j = j.cast("double")
        return F.exp(log_gamma(n + 1) - log_gamma(j + 1) - log_gamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))

    low = F.greatest(F.lit(0.0), k - F.ceil(9 * F.sqrt(n * p * (1 - p))) - 50)
    below = F.aggregate(F.sequence(low.cast("long"), k.cast("long")), F.lit(0.0), lambda a, j: a + term(j))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(below)


def choose(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, cut_<rule>, ...): documents of the stratum whose level of a rule is at its cut or more go; a null cut: the rule does not apply."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"levels.{k}").alias("level")) for k in UNITS]))
    held = measured.where("not base_failed").select(F.col("doc_id").alias("_id"), "lang", "levels").join(labels, F.col("_id") == F.col("doc_id"))
    held = held.select("lang", "quality", rules.alias("r")).groupBy("lang", "r.rule", "r.level")
    held = held.agg(F.count_if(F.col("quality") == 1).alias("sound"), F.count_if(F.col("quality") == 0).alias("poor"))
    strata = max(1, held.select("lang").distinct().count())
    of_rule = Window.partitionBy("lang", "rule")
    down = of_rule.orderBy(F.col("level").desc())
    by = held.withColumns({"k": F.sum("sound").over(down), "hit": F.sum("poor").over(down), "n": F.sum("sound").over(of_rule)}).where("level > 0 and n > 0 and hit > k")
    safe = by.where(binomial_tail(F.col("k"), F.col("n"), risk / len(UNITS)) <= confidence / (strata * len(UNITS)))
    cuts = safe.groupBy("lang", "rule").agg(F.max_by("level", F.struct(F.col("hit") - F.col("k"), "level")).alias("cut"))
    return cuts.groupBy(F.col("lang").alias("stratum")).agg(*[F.max(F.when(F.col("rule") == k, F.col("cut"))).alias(f"cut_{k}") for k in UNITS])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """A row for each row of docs(doc_id, text, lang, ...): the counts, base_failed, kept and failed, the rules that reject it.

    labels(doc_id, quality): the holdout; of several labels of a document the worst counts, null ones do not. Null
    texts have no words and fail the base rules. A null language is a stratum. Repeated rows give rows like others,
    and each counts in the holdout. Empty labels: only the base rules apply. Empty docs: an empty result. Very long
    texts are measured whole. Extra columns are ignored.
    """
    measured = settle(measure(docs), "measured")
    cuts = choose(measured, labels, risk, confidence)
    d = measured.join(cuts, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(f"levels.{k}") >= F.col(f"cut_{k}"), F.lit(k)) for k in UNITS]))
    d = d.withColumn("failed", F.array_join(failed, ","))
    kept = ~F.col("base_failed") & (F.col("failed") == "")
    return d.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op7_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    share = {
        "signs": "n_symbols / greatest(word_chars, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
        "capitals": "n_upper / greatest(word_chars, 1)", "marks": "n_marks / greatest(n_words, 1)",
    }
    levels = ", ".join(f"least({LEVELS}, floor({x} * {STEPS} / {UNITS[k]}::DOUBLE))::BIGINT AS {k}" for k, x in share.items())
    long = " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS rule, {k} AS level FROM m WHERE NOT base_failed" for k in UNITS)
    cut = ", ".join(f"max(cut) FILTER (rule = '{k}') AS cut_{k}" for k in UNITS)
    failed = ", ".join(f"CASE WHEN {k} >= cut_{k} THEN '{k}' END" for k in UNITS)
    p = RISK / len(UNITS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT uid, unnest(range(len(w) - 2)) AS i, w FROM d WHERE len(w) > 3),
g2 AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, w[i + 1], w[i + 2], w[i + 3]) AS n FROM g),
r AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE n > 1) GROUP BY uid),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS solid FROM d),
m0 AS (SELECT uid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '{SIGNS}', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '{NOT_UPPER}', '', 'g'))::BIGINT AS n_upper,
  length(regexp_replace(t, '{NOT_MARK}', '', 'g'))::BIGINT AS n_marks, len(solid) AS n_lines, (len(solid) - len(list_distinct(solid)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r USING (uid)),
m AS (SELECT *, {levels}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT lang, rule, level, count(*) FILTER (quality = 1) AS sound, count(*) FILTER (quality = 0) AS poor FROM ({long}) JOIN lab USING (doc_id) GROUP BY ALL),
b AS (SELECT *, sum(sound) OVER w AS k, sum(poor) OVER w AS hit, sum(sound) OVER (PARTITION BY lang, rule) AS n FROM h WINDOW w AS (PARTITION BY lang, rule ORDER BY level DESC)),
p AS (SELECT *, CASE WHEN k >= n * {p} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))) FROM range(k::BIGINT + 1) r(j)) END AS tail FROM b WHERE level > 0 AND n > 0 AND hit > k),
c AS (SELECT lang, rule, arg_max(level, (hit - k) * 1000 + level) AS cut FROM p WHERE tail <= {CONFIDENCE} / ({len(UNITS)} * greatest(1, (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)))) GROUP BY ALL),
c2 AS (SELECT lang AS stratum, {cut} FROM c GROUP BY lang),
f AS (SELECT m.*, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed FROM m LEFT JOIN c2 ON lang IS NOT DISTINCT FROM stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM f"""


ORACLE = _oracle()
