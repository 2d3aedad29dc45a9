"""Personal data found by anchors: an Aho-Corasick automaton finds them, local parsers expand and validate.

One pass of the automaton over a text gives the places of at-signs, plus signs, digits, schemes and
identifier cues. From each anchor a parser walks to both sides and settles the boundaries; it reads the text only
around the anchor. The four base kinds come out as leftmost non-overlapping matches of their patterns; what
fails its check is dropped and not retried. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import slices, texts_of
from ._rows import by_position

#: Kinds in the order in which spans with one start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_TOKEN = _ALNUM | frozenset("_-+/=.")
_URL_END = frozenset(" \t\n\r\f\v\"'<>`")

_SEPARATORS = " \t:=#\"'"
_SCHEMES = ("http://", "https://", "ftp://")
#: Cues of account and document numbers, and of secrets, in letters of either case.
_ACCOUNT_CUES = ("iban", "account number", "account no", "passport", "ssn", "tax id")
#: Words that may stand between an account cue and its number.
_LINKS = frozenset(("no", "nr", "num", "number", "id", "code", "is", "was", "are", "of", "the", "my", "your"))
_SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "akia")

#: A-Z to lower case; lower() would move the places of other letters.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for d in "0123456789":
            a.add_word(d, ("digit", 1))
        for kind, cues in (("scheme", _SCHEMES), ("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
            for cue in cues:
                a.add_word(cue, (kind, len(cue)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def _run(text: str, i: int, kind: frozenset[str]) -> int:
    """End of the run of characters of a kind that starts at i."""
    n = len(text)
    while i < n and text[i] in kind:
        i += 1
    return i


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """The address around an at-sign; ``free`` is where the last one ended."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in _LABEL:
        end = _run(text, end + 1, _LABEL)
        dots += 1
    return (start, end) if dots else None


def _ip(text: str, start: int) -> tuple[int, int, bool] | None:
    """Four runs of digits joined by dots from ``start`` on, and whether all are at most 255."""
    ok, i = True, start
    for k in range(4):
        if k:
            if i >= len(text) or text[i] != ".":
                return None
            i += 1
        end = _run(text, i, _DIGITS)
        if end == i:
            return None
        part = text[i:end].lstrip("0")
        ok = ok and len(part) <= 3 and int(part or "0") <= 255
        i = end
    return start, i, ok


def _card(text: str, start: int) -> tuple[int, int, bool]:
    """Digits with single blanks or hyphens between from ``start`` on, and whether 14 to 19 pass the Luhn check."""
    i, n, digits = start, len(text), []
    while i < n:
        if text[i] in _DIGITS:
            digits.append(text[i])
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _DIGITS:
            i += 1
        else:
            break
    return start, i, 14 <= len(digits) <= 19 and _luhn("".join(digits))


def _phone(text: str, plus: int) -> tuple[int, int, bool] | None:
    """From a plus sign to the last digit of what may stand in a number, and whether it has 10 to 15 digits."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return plus, end, 10 <= sum(c in _DIGITS for c in text[plus:end]) <= 15


def _word_before(text: str, i: int) -> bool:
    return i > 0 and (text[i - 1].isalnum() or text[i - 1] == "_")


def _url(text: str, start: int, end: int) -> tuple[int, int] | None:
    if _word_before(text, start):
        return None
    i = end
    while i < len(text) and text[i] not in _URL_END:
        i += 1
    while i > end and text[i - 1] in ".,;:!?)]}":
        i -= 1
    return (start, i) if i > end and text[end] in _ALNUM else None


class _Tokens:
    """Runs of token characters of one text; the last run is remembered, so that cues inside it do not read it again."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.digit = text, 0, 0, -1

    def at(self, j: int) -> tuple[int, bool]:
        """End of the token that starts at j, without trailing stops, and whether it holds a digit."""
        if not self.start <= j < self.end:
            self.start = j
            last = end = _run(self.text, j, _TOKEN)
            while end > j and self.text[end - 1] in ".-=":
                end -= 1
            self.stop, self.digit = end, end - 1
            while self.digit >= j and self.text[self.digit] not in _DIGITS:
                self.digit -= 1
            self.end = last
        return max(j, self.stop), self.digit >= j


def _gap(text: str, i: int, kind: str = _SEPARATORS) -> int:
    """End of a separator of at most 8 characters."""
    j = i
    while j < len(text) and j - i < 8 and text[j] in kind:
        j += 1
    return j


def _value(text: str, i: int, least: int, tokens: _Tokens) -> tuple[int, int] | None:
    """A value after a cue: a separator, perhaps a quote, then a token of at least ``least`` characters with a digit in it."""
    j = _gap(text, i)
    if j == i:
        return None
    end, digit = tokens.at(j)
    return (j, end) if end - j >= least and digit else None


def _iban(text: str, start: int) -> int | None:
    """End of an account number with valid check digits that starts here, its groups apart or not."""
    n, i, plain, best = len(text), start, "", None
    while i < n and len(plain) < 34:
        if text[i] in _ALNUM:
            plain += text[i].upper()
            i += 1
            if len(plain) >= 15 and (i == n or text[i] not in _ALNUM):
                if plain[:2].isalpha() and plain[2:4].isdigit() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                    best = i
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _ALNUM:
            i += 1
        else:
            break
    return best


def _account(text: str, i: int, tokens: _Tokens) -> tuple[int, int] | None:
    """A number after a cue and perhaps linking words: with IBAN check digits, or a token of six characters or more with a digit, or groups of digits."""
    j = _gap(text, i, _SEPARATORS + "." if text[max(0, i - 2) : i].lower() == "no" else _SEPARATORS)
    while j > i:  # linking words, each with a separator after it
        end = _run(text, j, _ALNUM) if j < len(text) and text[j] in _ALNUM and text[j] not in _DIGITS else j
        if end == j or end - j > 6 or text[j:end].lower() not in _LINKS:
            break
        i, j = end, _gap(text, end, _SEPARATORS + ".")
    if j == i:
        return None
    if end := _iban(text, j):
        return j, end
    end, digit = tokens.at(j)
    if not digit:
        return None
    if all(c in _DIGITS or c == "-" for c in text[j:end]):  # more groups, of short ones or up to a long one
        size = sum(c in _DIGITS for c in text[j:end])
        while size < 34 and end + 1 < len(text) and text[end] == " " and text[end + 1] in _DIGITS:
            stop = _run(text, end + 1, _DIGITS)
            more = stop - end - 1
            if more < 2 or size + more > 34 or (stop < len(text) and (text[stop].isalnum() or text[stop] == "_")) or (more < 6 and _longest(text[j:end]) > 5):
                break
            end, size = stop, size + more
    return (j, end) if end - j >= 6 else None


def _longest(groups: str) -> int:
    return max(len(g) for g in groups.replace("-", " ").split(" "))


def _secret(text: str, start: int, end: int, tokens: _Tokens) -> tuple[int, int] | None:
    if text[start:end] == "AKIA":  # a key's own beginning
        stop = _run(text, end, _ALNUM)
        return (start, stop) if stop - start == 20 and not _word_before(text, start) and text[start:stop].isupper() else None
    return None if _word_before(text, start) else _value(text, end, 12, tokens)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in a text, by start and then kind."""
    spans: list[tuple[int, int, str]] = []
    end_of = dict.fromkeys(KINDS, 0)
    tokens = _Tokens(text)

    def keep(kind: str, found: tuple | None) -> None:
        if found is not None:
            end_of[kind] = found[1]
            if len(found) == 2 or found[2]:
                spans.append((found[0], found[1], kind))

    ip_seen = 0
    for last, (anchor, size) in _automaton().iter(text.encode().translate(_LOWER).decode()):
        start = last - size + 1
        if anchor == "digit":
            # Only a run's first digit, or the first after a match, can begin a match.
            if start >= end_of["card"]:
                if start + 1 < len(text) and (text[start + 1] in _DIGITS or text[start + 1] in " -"):
                    found = _card(text, start)
                    if found[1] > start + 1:
                        keep("card", found)
            if start >= end_of["ip"] and start >= ip_seen:
                found = _ip(text, start)
                keep("ip", found)
                ip_seen = found[1] if found else _run(text, start, _DIGITS)
        elif anchor == "at":
            keep("email", _email(text, start, end_of["email"]))
        elif anchor == "plus":
            if start >= end_of["phone"]:
                keep("phone", _phone(text, start))
        elif anchor == "scheme":
            if start >= end_of["url"]:
                keep("url", _url(text, start, last + 1))
        elif anchor == "account":
            if start >= end_of["account"] and not _word_before(text, start):
                keep("account", _account(text, last + 1, tokens))
        elif start >= end_of["secret"]:
            keep("secret", _secret(text, start, last + 1, tokens))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` joins kind:start:end of all spans by commas, base_sha256 is the SHA-256 of the base kinds' alone. A null or
    empty text has none. Repeated rows and null ids give a row each; other columns are ignored; an empty table gives no row.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "t"):
                found = [find_spans(t) for t in texts_of(piece, "t")]
                base = [[s for s in spans if s[2] in BASE] for spans in found]
                counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *counts, pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]), pa.array([_joined(s) for s in found])],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(search, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in find_spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced by placeholders, and the length column, if there is one, set anew where the text changed.
    A null text stays null; all other columns stay as they are; an empty table stays empty."""
    has_length = length_col in docs.columns
    return by_position(docs, lambda rows, text, length=None: _redacted(rows, text, length), text_col, *([length_col] if has_length else []))


def _redacted(docs: DataFrame, text_col: str, length_col: str | None) -> DataFrame:
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_col):
                at = piece.schema.get_field_index(text_col)
                old = piece.column(at).to_pylist()
                new = [t if t is None else redact(t) for t in old]
                piece = piece.set_column(at, piece.schema.field(at), pa.array(new, piece.schema.field(at).type))
                if length_col is not None:
                    at = piece.schema.get_field_index(length_col)
                    sizes = [n if a == b else len(b) for n, a, b in zip(piece.column(at).to_pylist(), old, new)]
                    piece = piece.set_column(at, piece.schema.field(at), pa.array(sizes, piece.schema.field(at).type))
                yield piece

    return docs.mapInArrow(change, docs.schema)
