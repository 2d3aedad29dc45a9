"""Account and document numbers in the forms in which they are written."""

from __future__ import annotations

import pytest


@pytest.mark.parametrize(
    "text",
    [
        "Account Number: <12345678>",
        "Account No: <12345678>",
        "ACCOUNT no. <12345678>, please",
        "Tax ID: <12-3456789>.",
        "IBAN: <DE89 3704 0044 0532 0130 00> was used",
        "iban <GB82 WEST 1234 5698 7654 32>",
        "IBAN DE: x, Iban=<DE89370400440532013000>",
        "Passport No: <C01234567>",
        "account number is <12345678>",
        "my account number is: <1234 5678 9012>.",
        "SSN <123 45 6789>",
        "account no <20-00-00 12345678>",
        "account number <12345678> 2024 was a year",
        "passport was in my bag, 20 of them",
        "I lost my passport. 1234567 people saw it",
        "\u0130 Passport Number <K1234567>",
    ],
)
def test_account_forms(text):
    from weftmap.llm.personal_data import find_spans

    plain = text.replace("<", "").replace(">", "")
    want = [(text.index("<"), text.index(">") - 1)] if "<" in text else []
    assert [(s, e) for s, e, k in find_spans(plain) if k == "account"] == want


def test_check_digits_settle_where_an_account_number_ends():
    from weftmap.llm.personal_data import redact

    assert redact("IBAN: DE89 3704 0044 0532 0130 00 and on") == "IBAN: <ACCOUNT> and on"
