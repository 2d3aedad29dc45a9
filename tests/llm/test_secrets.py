"""Long secrets are found to their end, in linear time."""

from __future__ import annotations

import time


def test_a_long_secret_is_one_span():
    from weftmap.llm.personal_data import find_spans, redact

    for value in ("ab12" * 200, "eyJ0" * 300 + "." + "Zm9v9" * 400 + "." + "x_-7" * 90):
        text = f"token={value} end"
        assert (6, 6 + len(value), "secret") in find_spans(text)
        assert redact(text) == "token=<SECRET> end"


def test_cues_inside_a_token_do_not_read_it_again():
    from weftmap.llm.personal_data import find_spans

    start = time.perf_counter()
    assert find_spans("-token=" * 100_000) == []
    assert time.perf_counter() - start < 20
