"""Kinds of personal data, evidence and dictionary flags: small fixed tables."""

from __future__ import annotations

# Kind, base weight, priority in overlaps.
KINDS = {
    "snils": (40, 105), "passport": (40, 100), "foreign_passport": (40, 98), "driver_license": (40, 95), "oms": (40, 92), "card": (30, 90), "inn": (40, 85), "phone": (30, 80),
    "dept_code": (40, 75), "cvv": (15, 70), "pin": (15, 65), "fio": (45, 60), "address": (40, 55), "birth_date": (25, 50), "issue_date": (25, 50), "birth_place": (25, 45),
    "issuer": (25, 40), "citizenship": (25, 35), "email": (55, 30), "card_holder": (30, 25),
}
THRESHOLD = 50

# Evidence and its weight.
EVIDENCE = {
    "E_CHECKSUM": 45, "E_KW_NEAR": 40, "E_COOCCUR": 35, "E_WHOLE": 35, "E_POSSESS": 35, "E_ROLE": 30, "E_FORM": 20, "E_DOCCTX": 15, "E_CAPS": 5,
    "E_ORGADDR": -70, "E_PUBLIC_FULL": -60, "E_PUBLIC_SURN": -20, "E_EPONYM": -55, "E_STOPCTX": -45, "E_TITLE": -30,
}

# Categories of dictionary words, a bit each, in this order; kw_ ones are keyword categories.
FLAG_NAMES = (
    "name surn patr geo addr_marker country month role stop_ctx doc_ctx eponym_head possess_head public_person "
    "kw_passport kw_birth kw_issue kw_dept kw_dl kw_addr kw_inn kw_card kw_cvv kw_cvv_weak kw_pin kw_phone kw_doc kw_holder kw_citizen kw_org kw_birthplace"
).split()
FLAG = {name: 1 << i for i, name in enumerate(FLAG_NAMES)}
NAME_FLAGS = FLAG["name"] | FLAG["surn"] | FLAG["patr"]

# Keyword categories that confirm a kind.
KEYWORDS = {
    "birth_date": "kw_birth", "birth_place": "kw_birth", "issue_date": "kw_issue", "passport": "kw_passport", "driver_license": "kw_dl", "dept_code": "kw_dept", "address": "kw_addr addr_marker",
    "phone": "kw_phone", "inn": "kw_inn", "card": "kw_card", "cvv": "kw_cvv kw_cvv_weak", "pin": "kw_pin", "card_holder": "kw_holder", "citizenship": "kw_citizen",
    "issuer": "kw_issue kw_passport", "snils": "kw_doc kw_issue", "oms": "kw_doc kw_issue", "foreign_passport": "kw_doc kw_issue",
}
KEYWORD_MASK = {k: sum(FLAG[f] for f in flags.split()) for k, flags in KEYWORDS.items()}
#: Words that keywords may be away; 5 for other kinds.
KEYWORD_WINDOW = {"cvv": 12, "passport": 10, "driver_license": 10}
PERSON_LIKE = ("fio", "birth_place", "birth_date", "citizenship", "card_holder")
ANCHORED = ("issuer", "citizenship", "birth_place")
