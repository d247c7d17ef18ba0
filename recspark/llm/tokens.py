"""Token ids of texts with a public tokenizer, through a bounded cache of words per Python worker.

The tokenizers this is meant for drop white space and never look across it, so the ids of a text are
the ids of its words in order, and each distinct word is encoded once per worker. Whether that holds
is read from the tokenizer's own description; otherwise whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import tokenizers

# Bytes of words and ids that a generation of a worker's cache may hold, by ``ENTRY_BYTES`` above the
# bytes of each entry. A worker keeps two generations: words that a whole one did not meet are dropped.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 140
# Unknown words that are encoded as one text, and bytes of text that are looked up at once.
ENCODE_WORDS = 256
STEP_BYTES = 2 << 20

# Lower-case Latin letters in UTF-8, then punctuation that no contraction or special token starts
# with: two pieces that normalisation leaves alone.
_SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-&(-/:;=?@\[-`{}~]*)").fullmatch
_SPACE = re.compile(rb"[ \t-\r]")
_MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
# Byte-level models write byte b of a non-ASCII letter as one character: itself, or 256 and up in order
# for the bytes that print nothing.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_LATIN = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_open: dict[str, "TextEncoder"] = {}


def public_path(name: str) -> str:
    """Place of an installed public vocabulary file on the machine that calls this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(vocabulary: str) -> "TextEncoder":
    """The worker's encoder for a vocabulary: a file path, or the name of a public one."""
    if vocabulary not in _open:
        path = vocabulary if "/" in vocabulary else public_path(vocabulary)
        _open[vocabulary] = TextEncoder(path)
    return _open[vocabulary]


def _drops_space(spec: dict) -> bool:
    """Whether white space only separates: it is removed before merging and nothing else is split
    on or joined across it."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    kept = first.get("type") == "Split" and first.get("invert") and first.get(
        "behavior") == "Removed"
    classes = [c for c in re.findall(r"\[(\^?)([^\]]*)\]", pattern)]
    outside = re.sub(r"\[[^\]]*\]", "", pattern)
    no_space = kept and not re.search(r"\\s|\.|\s", outside) and all(
        (r"\s" in body) if negated else not re.search(r"\s|\\s", body) for negated, body in classes)
    later = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and
                not s.get("use_regex") for s in steps[1:])
    added = spec.get("added_tokens") or []
    plain = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or
                    t["single_word"] for t in added)
    return bool(no_space and later and plain and spec.get("post_processor") is None)


def _lowers(spec: dict) -> bool:
    norm = spec.get("normalizer") or {}
    steps = norm.get("normalizers", [norm])
    return [s.get("type") for s in steps][-1:] == ["Lowercase"] and {
        s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}


def _parts(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + STEP_BYTES)
        end = end.start() if end else len(raw)
        yield raw[at:end]
        at = end


def _ids(values: list[int]) -> bytes:
    ids = array("I", values)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.by_word = _drops_space(spec)
        # Lower-casing A-Z early makes fewer distinct words. It is left out where special tokens
        # could be written in capitals or a combining mark could meet the letter.
        special = "".join(t["content"] for t in spec.get("added_tokens") or [])
        self.lower = self.by_word and _lowers(spec) and special == special.lower() and bool(
            special.isascii())
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.pieces = self.tokenizer.model.tokenize
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return _ids(ids)

    def _turn(self) -> None:
        """Start a new generation when the present one is full; the one before is dropped."""
        if self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {}, 0

    def _letters(self, raw: bytes) -> bytes:
        """Ids of one piece that the cache does not hold, straight from the tokenizer's model."""
        piece = raw.decode() if raw.isascii() else "".join(map(_LATIN.__getitem__, raw))
        return _ids([t.id for t in self.pieces(piece)])

    def _learn(self, words: set[bytes]) -> None:
        """Put words into the present generation that it does not hold."""
        cache, older, letters = self.cache, self.older, self._letters
        odd, size, before = [], 0, len(cache)
        for w in words:
            ids = older.get(w)
            if ids is None:
                m = _SIMPLE(w) if self.lower else None
                if m is None:
                    odd.append(w)
                    continue
                ids, n = b"", m.end(1)
                for piece in (w,) if n == len(w) or not n else (w[:n], w[n:]):
                    known = cache.get(piece) or older.get(piece)
                    if known is None:
                        known = letters(piece)
                        cache[piece] = known
                        size += len(piece) + len(known)
                    ids += known
            cache[w] = ids
            size += len(w) + len(ids)
        for k in range(0, len(odd), ENCODE_WORDS):
            part = odd[k:k + ENCODE_WORDS]
            texts = [w.decode("utf-8", "replace") for w in part]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for w, e in zip(part, found, strict=True):
                cache[w] = ids = _ids(e.ids)
                size += len(w) + len(ids)
        self.held += size + ENTRY_BYTES * (len(cache) - before)

    def _raw(self, text: str) -> bytes:
        """Bytes of a text, A-Z lower-cased where that changes no id."""
        raw = text.encode("utf-8", "replace")
        if self.lower and not (b"\xcc" in raw and _MARK.search(text)) and (
                text.isascii() or not _MARK.search(text)):
            low = raw.lower()
            # A special token spelt in capitals is ordinary text and must stay so.
            if not any(s in low and low.count(s) != raw.count(s) for s in self.special):
                return low
        return raw

    def _encoded(self, parts: list[list[bytes]]) -> list[bytes]:
        """Ids of lists of words."""
        unknown = set(chain.from_iterable(parts)).difference(self.cache)
        if unknown:
            self._learn(unknown)
        get = self.cache.__getitem__
        out = [b"".join(map(get, words)) for words in parts]
        self._turn()
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of some texts; a long text goes through in parts that end at white space."""
        if not self.by_word:
            return [self._plain(t) if t else b"" for t in texts]
        out: list[bytes] = []
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            raw = self._raw(text) if text else b""
            if len(raw) > STEP_BYTES:
                out += self._encoded(held)
                out.append(b"".join(self._encoded([part.split()])[0] for part in _parts(raw)))
                held, size = [], 0
                continue
            held.append(raw.split())
            size += len(raw)
            if size > STEP_BYTES:
                out += self._encoded(held)
                held, size = [], 0
        return out + self._encoded(held)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]
