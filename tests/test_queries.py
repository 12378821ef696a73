import pytest
from oracle import SMALL, of_frame, of_sql

from veilframe.plans import queries

QUICK = [
    "lex_kinds", "tokens_placed", "email_tokens", "folded_texts", "address_keys", "declined_words", "inn_check", "snils_check", "luhn_check", "digit_runs", "luhn_cards", "phone_candidates", "shape_candidates",
    "dict_flags", "resolved_spans", "profile_filter", "glued_spans", "masked_mail", "office_containment", "public_person_semi", "parse_requests", "process_replay", "latency_percentiles", "latency_rate", "find_property", "date_candidates", "base64_names", "env_windows",
    "written_rules", "written_decisions", "written_counts", "written_together", "written_masks", "written_tokens", "written_explained", "written_envelopes", "written_log", "written_score", "written_sizes", "written_over",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    assert of_frame(queries.QUERIES[name](spark, SMALL)) == of_sql(queries.ORACLES[name])


def test_sql_belongs_to_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "masked", "n_spans"] and df.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_envelopes_come_back(spark):
    rows = queries.envelope_roundtrip(spark, SMALL).collect()
    assert rows and all(r.restored and r.other_system == "cannot open" for r in rows)
