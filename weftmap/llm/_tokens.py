"""Exact subword encoding with the ``tokenizers`` library, working on each distinct text chunk once.

Both vocabularies in use cut a text into pre-tokens before any merge. Some boundaries of that cut can be
seen without running the pre-tokenizer:

* byte-level vocabularies never join a space to what stands before it when a non-blank follows, and give the
  blanks before that space the same pre-tokens whether or not it follows;
* word-end vocabularies drop white space altogether.

A text may therefore be split at those places, each *distinct* chunk encoded by the library, and the
ids put together again with the very result of encoding the whole text. Special strings hold no blank, so they stay
inside one chunk and are treated by the library's own default; as they end a run of blanks before them, a chunk with one is not parted
from such a run. This holds for the two settings below only; a file with any other normaliser or pre-tokenizer is encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct strings remembered by one worker; past this only those of the latest texts are kept.
CACHE_ENTRIES = 500_000

#: Characters whose case, composition and letter class are the same in every Unicode version.
_PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u00ac\u00ae-\u012f\u0132-\u017e]*")
_STOPS = frozenset(".,;:!?")
#: Where a byte-level text may be cut, and the spaces where it may not.
_EDGE, _RUN = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
#: The pre-token patterns of the two vocabularies.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The settings of a tokenizer file under which the cuts here are the library's.
_BYTE_SETTING = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
_WORD_SETTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_END}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}],
    },
}


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stays, the others follow from U+0100 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


def _setting(path: str) -> str | None:
    """``byte`` or ``word`` if the file cuts texts as this module does, else None."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k != "trim_offsets"}
        return [plain(v) for v in x] if isinstance(x, list) else x

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    added = whole.get("added_tokens") or []
    if not added or whole["model"].get("type") != "BPE" or any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")) or any(any(c.isspace() for c in t["content"]) for t in added):
        return None
    own = plain({k: whole.get(k) for k in ("normalizer", "pre_tokenizer")})
    return "byte" if own == _BYTE_SETTING else "word" if own == _WORD_SETTING else None


class ChunkEncoder:
    """Encodes texts to ids; ``drops_space`` tells that the vocabulary ignores white space."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        setting = _setting(path)
        self.cuts, self.drops_space = setting is not None, setting == "word"
        self._mark = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self._cut = regex.compile(_WORD_END if self.drops_space else _BYTE_LEVEL).findall
        self._model = self.tokenizer.model
        self._bytes = _byte_alphabet()
        self._blank = self._bytes[0x20]
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> array:
        """The library's ids of a text."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the library's merges."""
        if piece.isascii() and piece.isprintable():
            as_bytes = piece.replace(" ", self._blank)
        else:
            as_bytes = piece.encode().decode("latin-1").translate(self._bytes)
        ids = array("I", [t.id for t in self._model.tokenize(as_bytes)]).tobytes()
        self._pieces[piece] = ids
        return ids

    def _ids(self, chunk: str, lead: str = "") -> bytes:
        """Ids of a chunk that follows ``lead``."""
        if not self.cuts or self._mark in chunk or not (chunk.isascii() and chunk.isprintable() or _PLAIN.fullmatch(chunk)):
            return self.whole(lead + chunk).tobytes()
        if self.drops_space:
            chunk = chunk.lower()
        known = self._pieces
        if chunk.isalpha():
            piece = lead + chunk
            return known.get(piece) or self._piece(piece)
        if chunk[-1:] in _STOPS and chunk[:-1].isalpha():
            piece, stop = lead + chunk[:-1], chunk[-1]
            return (known.get(piece) or self._piece(piece)) + (known.get(stop) or self._piece(stop))
        return b"".join([known.get(p) or self._piece(p) for p in self._cut(lead + chunk)])

    def _chunks_of(self, text: str) -> list[str]:
        """Chunks of a text at boundaries the pre-tokenizer keeps; in byte-level texts a space stood before each but the first."""
        if not self.cuts:
            return [text]
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        chunks = text.split(" ") if _RUN.search(text) is None else _EDGE.split(text)
        if self._mark in text:
            out = chunks[:1]
            for c in chunks[1:]:  # a special string would end the run of blanks before it
                if self._mark in c and (not out[-1] or out[-1][-1].isspace()):
                    out[-1] += " " + c
                else:
                    out.append(c)
            return out
        return chunks

    def split(self, text: str) -> list[str]:
        """Chunks of a text, their spaces included."""
        chunks = self._chunks_of(text)
        return chunks if self.drops_space else [chunks[0], *[" " + c for c in chunks[1:]]]

    def pre_tokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; one that the pattern here is not sure to cut as the library does stays whole."""
        if not self.cuts or self._mark in chunk or not (chunk.isascii() and chunk.isprintable() or _PLAIN.fullmatch(chunk)):
            return [chunk]
        if self.drops_space:
            chunk = chunk.lower()
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [body] if self.drops_space else [chunk]
        if body[-1:] in _STOPS and body[:-1].isalpha():
            return [(body if self.drops_space else chunk)[:-1], body[-1]]
        return self._cut(chunk)

    def pieces(self, pre_token: str) -> int:
        """How many ids the library gives a pre-token."""
        return len(self._ids(pre_token)) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self._chunks_of(t) for t in texts]
        lead, known = "" if self.drops_space else " ", self._chunks
        here: set[str] = set()
        for chunks in cut:
            here.update(chunks if self.drops_space else chunks[1:])
        for c in here - known.keys():
            known[c] = self._ids(c, lead)
        get = known.__getitem__
        if self.drops_space:
            out = [b"".join(map(get, chunks)) for chunks in cut]
        else:
            out = [self._ids(chunks[0]) + b"".join(map(get, chunks[1:])) for chunks in cut]
        if len(known) > CACHE_ENTRIES:
            self._chunks = {c: known[c] for c in here}
        if len(self._pieces) > CACHE_ENTRIES:
            self._pieces = {}
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Free what this worker's encoders remember, before steps that do not encode."""
    _ENCODERS.clear()
