"""Licence texts and usual notices that the registered scan must find."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import docs  # noqa: E402

NOTICES = {
    "MIT": "Licensed under the MIT License.",
    "GPL-2.0": "It is distributed under the GPL version 2.",
    "AGPL": "released under the GNU Affero General Public License",
    "ISC": "Released under the ISC license",
    "Unlicense": "available under the Unlicense license",
    "Zlib": "under the terms of the zlib license",
    "EPL": "Published under the Eclipse Public License",
    "CC-BY-ND": "Licensed under CC BY-ND 4.0",
    "ISC-full": "x PERMISSION to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT",
}


def test_usual_notices_and_bodies(spark):
    from weftmap.llm.license_scan import TEMPLATES, scan_licenses

    gpl = TEMPLATES["GPL-3.0-full"].split()
    texts = [*NOTICES.values(), "before " + " ".join(gpl) + " after", " ".join(gpl[1500:2300]), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    found = {}
    for r in scan_licenses(docs(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)])).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, name in enumerate(NOTICES):
        assert any(x == name or x.startswith(f"{name}-notice") for x in found.get(i, ())), name
    n = len(NOTICES)
    assert "GPL-3.0-full" in found[n]
    assert any(x.startswith("GPL-3.0-part") for x in found[n + 1]) and "GPL-3.0-full" not in found[n + 1]
    assert "MIT-text" in found[n + 2]


def test_templates_fit_the_sql():
    from weftmap.llm.license_scan import TEMPLATES

    assert not any("'" in name + text for name, text in TEMPLATES.items())
