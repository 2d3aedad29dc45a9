"""Each operator on documents against brute force: awkward rows and an empty table."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import TEXTS, docs, rows  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows()]


def by_id(found, *columns):
    return sorted(([r[c] for c in columns] for r in found.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def order(expected):
    return sorted(expected, key=lambda r: tuple((x is not None, x) for x in r))


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def test_encoder_is_the_library_on_odd_texts():
    import random

    from tokenizers import Tokenizer

    from weftmap.llm._tokens import ChunkEncoder

    rng = random.Random(5)
    alphabet = "ab THE'sé ñß,. \n\t\r  \x1c1234²İΣσ́日<|endoftext|>@#_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for t in TEXTS]
    for path in (BYTE, WORD):
        library, own = Tokenizer.from_file(path), ChunkEncoder(path)
        for i in range(0, len(texts), 200):
            for text, ids in zip(texts[i : i + 200], own.encode(texts[i : i + 200])):
                assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_simhash(spark):
    import xxhash

    from weftmap.llm.simhash_dedup import simhash_groups

    near = " ".join(f"w{i}" for i in range(400))
    data = [*rows(), (100, near, *[None] * 8), (101, near.replace("w399", "other"), *[None] * 8), (102, near.upper(), *[None] * 8)]

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1]) for r in data]
    label = list(range(len(data)))
    for _ in data:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    low = {k: min((r[0] for r, m in zip(data, label) if m == k and r[0] is not None), default=None) for k in set(label)}
    expected = [[r[0], f"{p:016x}", low[k]] for r, p, k in zip(data, prints, label)]
    assert by_id(simhash_groups(docs(spark, data)), "doc_id", "fingerprint", "component_id") == order(expected)
    assert simhash_groups(docs(spark, [])).collect() == []


def test_simhash_keeps_one_of_each_group_and_all_columns(spark):
    from weftmap.llm.simhash_dedup import simhash_dedup, simhash_groups

    frame = docs(spark)
    kept = simhash_dedup(frame)
    assert kept.columns == frame.columns
    groups = {r.doc_id: r.component_id for r in simhash_groups(frame).collect() if r.doc_id is not None}
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(set(groups.values()))


def test_simhash_of_large_buckets(spark, monkeypatch):
    from weftmap.llm import _pairs
    from weftmap.llm.simhash_dedup import _fingerprints_of, simhash_groups

    monkeypatch.setattr(_pairs, "CAP", 5)
    base = [f"w{i % 53}x{i}" for i in range(300)]
    texts = [" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 300, 4)] + [" ".join(f"other{j} {j * i}" for j in range(40)) for i in range(20)]
    prints = [int(x) for x in _fingerprints_of(texts)]
    label = list(range(len(texts)))
    for _ in texts:
        before = list(label)
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    found = simhash_groups(docs(spark, [(i, t, *[None] * 8) for i, t in enumerate(texts)]))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(label))


def test_allocation_covers_the_radius():
    from weftmap.llm.simhash_dedup import RADIUS, SPLITS, allocate, distance_shares

    rng = np.random.default_rng(1)
    even, peaked = np.bincount(rng.integers(0, 65536, 5000), minlength=65536), np.bincount(rng.integers(0, 3, 5000), minlength=65536)
    for hists in ([even] * 4, [even, peaked, even, peaked]):
        for n in (100, 10**6, 10**10):
            split, t = allocate([distance_shares(h) for h in hists], n)
            assert split in SPLITS and sum(t) == RADIUS - len(t) + 1 and min(t) >= -1
    shares = distance_shares(even)
    x = np.repeat(np.arange(65536), even)
    d = np.bitwise_count(x[:, None] ^ x[None, :1000])
    assert abs(shares[:6].sum() - (d <= 5).mean()) < 0.01


def test_personal_data(spark):
    from weftmap.llm.personal_data import BASE, find_spans, personal_data, redact, redact_documents

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    def base(t):
        found = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m.group())]
        return sorted(found, key=lambda s: (s[0], BASE.index(s[2])))

    import random

    rng = random.Random(2)
    for i in range(20_000):
        t = "".join(rng.choice(("0123456789..@@++-- () ab", "4111 -.+1@a.b0(")[i % 2]) for _ in range(rng.randint(0, 60)))
        assert [s for s in find_spans(t) if s[2] in BASE] == base(t), t
    expected = []
    for i, t, *_ in rows():
        b = base(t or "")
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        expected.append([i, *(sum(s[2] == k for s in b) for k in BASE), digest])
    found = personal_data(docs(spark))
    assert by_id(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == order(expected)
    assert personal_data(docs(spark, [])).collect() == []
    assert redact("mail a.b@c.de, password=ab12cd34ef56") == "mail <EMAIL>, password=<SECRET>"
    changed = redact_documents(docs(spark))
    assert changed.schema == docs(spark).schema
    for r in changed.collect():
        assert r.text is None or not base(r.text)
        if r.doc_id == 11:
            assert r.n_chars == len(r.text) and "<EMAIL>" in r.text and "<CARD>" in r.text
        if r.doc_id in (6, 13):
            assert r.text == TEXTS[r.doc_id]


def test_packing(spark, byte_ids):
    from weftmap.llm.packing import pack

    found = pack(docs(spark), BYTE).collect()
    ids = {}
    for i, x in byte_ids:
        ids.setdefault(i, []).append(np.array([*x, 0], dtype="<u4"))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == Counter(
        (i, s, min(1024, len(a) - s), zlib.crc32(a[s : s + 1024].tobytes()), len(a)) for i, arrays in ids.items() for a in arrays for s in range(0, len(a), 1024)
    )
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and {r.padded_length for r in pieces} == {at if at & (at - 1) == 0 else 1024}
    assert pack(docs(spark, []), BYTE).collect() == []


def test_plans_use_every_piece_with_little_padding():
    from weftmap.llm.packing import plan_windows

    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1024, 20_000), np.minimum(1023, rng.geometric(0.004, 20_000)), np.full(5000, 1), np.full(999, 700), np.array([], dtype=int)):
        hist = np.bincount(lengths, minlength=1025)
        plan, used = plan_windows(hist), np.zeros(1025, dtype=int)
        for need, times in plan:
            assert sum(n * k for n, k in need) <= 1024 and times > 0
            for n, k in need:
                used[n] += k * times
        assert (used == hist).all()
        if len(lengths) == 20_000:
            assert sum(t for _, t in plan) * 1024 / lengths.sum() < 1.02


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from weftmap.llm.token_files import TokenFile, open_manifest, read_token_files, write_token_files

    t = Tokenizer.from_file(WORD)
    path = f"file://{tmp_path}/ids"
    write_token_files(docs(spark), path, WORD, 2)
    manifest = open_manifest(spark, path)
    found = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at, own = 0, Counter()
    for r in found:
        assert r.start == at
        at += r.n_tokens
        own[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    want = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4")) for i, x, *_ in rows()]
    assert own == Counter((i, len(a), zlib.crc32(a.tobytes())) for i, a in want)
    first = TokenFile(manifest.orderBy("base").first().file)
    assert [len(first.document(i)) for i in range(len(first))] == np.diff(first.ends.all(), prepend=0).tolist()
    assert read_token_files(write_token_files(docs(spark, []), f"file://{tmp_path}/none", WORD, 2)).collect() == []


def test_token_files_roll_over_and_are_read_in_parts(spark, tmp_path, monkeypatch):
    from weftmap.llm import token_files

    monkeypatch.setattr(token_files, "READ_IDS", 50)
    data = [(i % 40, f"text {i} " * (i % 7), *[None] * 8) for i in range(300)]
    whole = by_id(token_files.read_token_files(token_files.write_token_files(docs(spark, data), f"file://{tmp_path}/whole", WORD, 2)), "doc_id", "n_tokens", "ids_crc32")
    monkeypatch.setattr(token_files, "FILE_IDS", 100)
    monkeypatch.setattr(token_files, "READ_DOCS", 3)
    manifest = token_files.write_token_files(docs(spark, data), f"file://{tmp_path}/parts", WORD, 2)
    found = token_files.read_token_files(manifest)
    assert manifest.count() > 4 and by_id(found, "doc_id", "n_tokens", "ids_crc32") == whole
    rows = sorted(found.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]] and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_elias_fano():
    from weftmap.llm.token_files import EliasFano

    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 10), (1, 0), (3000, 50), (3000, 10**9), (5000, 5000)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = EliasFano.encode(values)
        assert (ef.all() == values).all()
        assert [ef.select(i) for i in range(0, n, 97)] == values[::97].tolist()
        for lo, hi in ((0, n), (0, min(1, n)), (n // 3, n // 2), (max(0, n - 5), n), (n // 2, min(n, n // 2 + 600)), (min(n, 512), min(n, 1024))):
            assert ef.selects(lo, hi).tolist() == values[lo:hi].tolist()
        if n > 1000 and top > 1000:
            assert 8 * (len(ef.low) + len(ef.high)) <= n * (2 + math.log2(top / n) + 1)


def test_decontamination(spark):
    from weftmap.llm.decontamination import contamination, decontaminate, longest_matches

    items = [(1, "a b c d e f g h i j k l"), (2, "two words"), (3, None), (4, " - "), (5, "QUICK brown fox jumps over the lazy dog near the river"), (6, "a b c d e f g h i j k l"), (10, "nothing of this occurs anywhere in all those texts at all, really")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    expected = []
    for i, t, *_ in rows():
        w, hit, own = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    own |= x
        expected.append([i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)])
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(contamination(docs(spark), bench), *names) == order(expected)
    assert by_id(contamination(docs(spark), bench, block_bytes=40), *names) == order(expected)
    assert contamination(docs(spark, []), bench).collect() == []
    assert not any(r.contaminated for r in contamination(docs(spark), bench.limit(0)).collect())
    kept = decontaminate(docs(spark), bench)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == {e[0] for e in expected if not e[5]} - {e[0] for e in expected if e[5]}
    assert {r.doc_id for r in decontaminate(docs(spark), bench, block_bytes=40).collect()} == {r.doc_id for r in kept.collect()}
    best = {(r.item_id, r.item_start, r.n_words, r.doc_id, r.doc_start) for r in longest_matches(docs(spark), bench).collect()}
    assert ("1", 0, 12, 15, 0) in best and ("5", 0, 11, 2, 1) in best and not any(b[:3] == ("1", 2, 10) for b in best)


def test_longest_matches_against_brute_force(spark):
    from weftmap.llm.decontamination import contamination, longest_matches, words_of

    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 60)))) for i in range(30)] + [(None, "w0 w1 w0 w1 w0"), (None, "w2 w2 w2 w2")]
    items += [(40, items[3][1] + " and more of it " + items[4][1])]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 90))) for _ in range(40)]
    texts += [f"before {items[i][1]} after" for i in (0, 5, 9)] + ["x " + items[-1][1] * 2, None, ""]
    data = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tests = {i: words_of(t) for i, t in enumerate(t for _, t in items)}

    def reach(w, p):
        """The longest match at p, among items with a window there."""
        best = 0
        for own in tests.values():
            for s in range(len(own)):
                n = 0
                while p + n < len(w) and s + n < len(own) and w[p + n] == own[s + n]:
                    n += 1
                if n >= 6 or (n == len(own) and s == 0):
                    best = max(best, n)
        return best

    for options in ({}, {"block_bytes": 200}):
        for r in contamination(docs(spark, data), bench, window=6, **options).collect():
            w = words_of(texts[r.doc_id] or "")
            lengths = [reach(w, p) for p in range(len(w))]
            assert r.longest == max(lengths, default=0) and r.longest_start == (lengths.index(r.longest) if r.longest else None)
            if r.longest_item is not None:
                own = tests[[str(i) for i, _ in items].index(r.longest_item)]
                assert own[r.longest_item_start : r.longest_item_start + r.longest] == w[r.longest_start : r.longest_start + r.longest]
    found = {}
    for r in longest_matches(docs(spark, data), bench, 6).collect():
        found.setdefault(r.doc_id, []).append((r.doc_start, r.n_words))
    for i, t in enumerate(texts):
        w = words_of(t or "")
        spans = [(p, n) for p in range(len(w)) if (n := max((k for k in [reach(w, p)] if k >= 6), default=0))]
        assert sorted(found.get(i, [])) == [s for k, s in enumerate(spans) if not any(sum(o) >= sum(s) for o in spans[:k])]


def test_license_scan(spark):
    from weftmap.llm.license_scan import TEMPLATES, bands_for, scan_licenses, shingles, words_of

    texts = [*TEMPLATES.values(), "Text. " + TEMPLATES["GPL-3.0"].upper() + " more", TEMPLATES["MIT"] * 3, "released under the mit", TEMPLATES["BSD"].replace("source", "sauce")]
    data = [*rows(), *((200 + i, f"before it {t} after it", *[None] * 8) for i, t in enumerate(texts))]
    expected = []
    for i, t, *_ in data:
        sh = shingles(words_of(t or "")) if len(words_of(t or "")) >= 5 else []
        for name, text in TEMPLATES.items() if sh else ():
            own = set(shingles(words_of(text)))
            step = max(1, len(own) // 2)
            size = len(own) + step
            starts = [k * step for k in range(max(0, math.ceil((len(sh) - size) / step)) + 1)]
            shares = [(len(own & set(sh[s : s + size])) / len(own), -s) for s in starts]
            if some := [x for x in shares if x[0] >= 0.8]:
                expected.append([i, name, len(some), max(some)[0], -max(some)[1]])
    assert len({e[1] for e in expected}) == len(TEMPLATES)
    assert by_id(scan_licenses(docs(spark, data)), "doc_id", "license", "n_windows", "containment", "start_word") == order(expected)
    assert scan_licenses(docs(spark, [])).collect() == [] and scan_licenses(docs(spark), {}).collect() == []
    assert all(bands_for(s) < 128 for s in range(1, 200))


def test_token_counts(spark, byte_ids):
    from weftmap.llm.token_counts import count_tokens

    expected = [[i, len((t or "").encode()), len(ids), len(ids) > 1024] for (i, t, *_), (_, ids) in zip(rows(), byte_ids)]
    assert by_id(count_tokens(docs(spark), BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == order(expected)
    assert count_tokens(docs(spark, []), BYTE).collect() == []


def test_token_counts_of_runs_of_blanks(spark):
    from tokenizers import Tokenizer

    from weftmap.llm.token_counts import count_tokens

    texts = [(t or "").replace(" ", blank) for t in TEXTS for blank in ("  ", " \n", "\n ", "\t", " \x0b ")]
    texts += [" " * 20_000, "a" + " " * 20_000 + "b", "x  <|endoftext|>  y <|endoftext|>\n z", " \n" * 500]
    data = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    library = Tokenizer.from_file(BYTE)
    found = by_id(count_tokens(docs(spark, data), BYTE), "doc_id", "n_tokens")
    assert found == [[i, len(library.encode(t, add_special_tokens=False).ids)] for i, t in enumerate(texts)]


def test_other_tokenizer_files_are_used_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    from weftmap.llm._tokens import ChunkEncoder

    with open(BYTE) as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    own, library = ChunkEncoder(str(path)), Tokenizer.from_file(str(path))
    assert not own.cuts
    for text, ids in zip(TEXTS[:12], own.encode([t or "" for t in TEXTS[:12]])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_language_model_scores(spark, byte_ids, monkeypatch):
    from weftmap.llm import lm_score

    grams = lambda t, n: [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]

    def scores(texts, order):
        count = {n: Counter(g for _, t in texts for g in grams(t, n)) for n in range(1, order + 1)}
        corpus = sum(count[1].values())
        out = []
        for d, t in texts:
            own = {n: Counter(grams(t, n)) for n in count}
            c = lambda g, own=own: count[len(g)][g] - own[len(g)][g]

            def one(context, w):
                if not context:
                    return math.log(max(1, c((w,))) / corpus)
                return math.log(c((*context, w)) / c(context)) if c((*context, w)) else math.log(0.4) + one(context[1:], w)

            out.append([d, len(t), sum(one(tuple(t[max(0, i - order + 1) : i]), w) for i, w in enumerate(t))])
        return out

    for order_of, slice_bytes in ((3, 6_000_000), (3, 2000), (2, 2000), (1, 2000)):
        monkeypatch.setattr(lm_score, "SLICE_BYTES", slice_bytes)
        found = by_id(lm_score.lm_scores(docs(spark), BYTE, order=order_of), "doc_id", "n_tokens", "log_score")
        for got, want in zip(found, order(scores(byte_ids, order_of))):
            assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-6 * max(1, abs(want[2]))
    assert lm_score.lm_scores(docs(spark, []), BYTE).collect() == []
    with pytest.raises(ValueError):
        lm_score.lm_scores(docs(spark), BYTE, order=5)


def test_quality(spark):
    from weftmap.llm.quality import keep_quality, kth_largest, quality_scores, threshold

    rng = np.random.default_rng(8)
    good = ["the of and a to in " + " ".join(f"w{rng.integers(9999)} the of" for _ in range(60)) for _ in range(120)]
    bad = [" ".join(f"w{rng.integers(9999)} %%%" for _ in range(60)) for _ in range(60)]
    data = [(1000 + i, t, *[None] * 8) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(1000 + i, int(i < 120), 0) for i in range(0, 180, 2)] + [(None, 1, 0), (1001, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [*rows(), *data])
    found = {r.doc_id: r for r in quality_scores(frame, labels).collect()}
    held_out = [i for i in range(180) if i % 2]
    assert sum(found[1000 + i].kept == (i < 120) for i in held_out) == len(held_out)
    assert found[3].score is None and not found[3].kept and not found[4].kept
    kept = keep_quality(frame, labels)
    assert kept.columns == frame.columns and kept.where("doc_id >= 1000").count() == 120
    assert quality_scores(docs(spark, []), labels).collect() == []
    assert all(r.kept == (r.n_features > 0) for r in quality_scores(docs(spark), labels.limit(0)).collect())
    assert threshold(np.array([1.0, 2.0]), np.array([-3.0])) == -1.0
    values = spark.createDataFrame([(float(x),) for x in [*rng.normal(size=500), *[0.5] * 40]], "x double")
    ranked = sorted((r.x for r in values.collect()), reverse=True)
    for k in (1, 2, 100, 160, 300, 539, 540, 600):
        assert kth_largest(values, "x", k) == ranked[min(k, 540) - 1]
