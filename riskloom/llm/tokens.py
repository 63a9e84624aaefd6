"""Token ids of whole texts by a public tokenizer, with every distinct word encoded once per batch."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa

from riskloom.llm.words import Words, as_large, ranges

DEFAULT_TOKENIZER = "word_bpe_49k.json"

# How the default tokenizer prepares and splits a text.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of printable Latin letters and signs: composed already, with plain lower-case forms.
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+")
_SIGNS = b".,;:!?"
#: Words, and parts of words, whose ids are remembered by a worker process; some 100 MB each when full.
CACHED_WORDS = 700_000


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible_bytes() -> str:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class WordEncoder:
    """Ids of words. White space always separates in the default tokenizer, so a text is its words' ids."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str())
        steps = [s["type"] for s in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == _NORMALIZERS and cuts[0].get("pattern", {}).get("Regex") == _SPLIT
        self.special = tuple(t["content"] for t in parts.get("added_tokens", []))
        self.cut = regex.compile(_SPLIT)
        self.shown = _visible_bytes()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of one lower-case part, remembered."""
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin1").translate(self.shown)
            ids = self.parts[part] = array("i", [t.id for t in self.whole.model.tokenize(shown)]).tobytes()
        return ids

    def _ids(self, word: bytes) -> bytes:
        # Letters, or letters before one sign: most words, and their parts are plain to see.
        if word.isalpha():
            return self._part(word.lower().decode())
        if word[-1] in _SIGNS and word[:-1].isalpha():
            return self._part(word[:-1].lower().decode()) + self._part(chr(word[-1]))
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        return b"".join(map(self._part, self.cut.findall(text.lower())))

    def words(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the bounds of each word in them."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if len(self.parts) > CACHED_WORDS:
            self.parts.clear()
        known, out = self.known, []
        for word in distinct:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._ids(word)
            out.append(ids)
        lengths = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), np.int32), np.concatenate(([0], np.cumsum(lengths)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the bounds of each text; a null text has none."""
        if not self.by_word:
            found = [e.ids for e in self.whole.encode_batch(as_large(texts).to_pylist(), add_special_tokens=False)]
            lengths = np.array([len(x) for x in found], np.int64)
            flat = np.array([i for x in found for i in x], np.int32)
            return flat, np.concatenate(([0], np.cumsum(lengths)))
        words = Words(texts)
        flat, bounds = self.words(words.distinct)
        lengths = np.diff(bounds)[words.codes]
        ids = flat[ranges(bounds[:-1][words.codes], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return ids, ends[words.bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, one per worker process."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free the encoders and all words they remember: Spark gives the same worker processes other work."""
    _ENCODERS.clear()


def pieces_of(enc: WordEncoder, texts: pa.Array, window: int, end_id: int | None):
    """Ids of all documents and the pieces of at most ``window`` ids they are cut into.

    Returns flat ids (each document closed by ``end_id`` unless that is None) and,
    per piece, the document's row, first id in the document, length, first id in
    the flat ids, and the document's number of ids. Nothing is lost: a document's
    pieces, one after the other, are its ids. A document without ids has no piece.
    """
    ids, bounds = enc.texts(texts)
    n = len(bounds) - 1
    if end_id is not None:
        closed = np.empty(len(ids) + n, np.int32)
        bounds = bounds + np.arange(n + 1)
        last = np.zeros(len(closed), bool)
        last[bounds[1:] - 1] = True
        closed[last], closed[~last] = end_id, ids
        ids = closed
    sizes = np.diff(bounds)
    counts = -(-sizes // window)
    row = np.repeat(np.arange(n), counts)
    start = ranges(np.zeros(n, np.int64), counts) * window
    length = np.minimum(window, sizes[row] - start)
    return ids, row, start, length, bounds[:-1][row] + start, sizes[row]
