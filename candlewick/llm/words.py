"""Token ids of whole texts for word tokenizers that drop white space: each distinct word is encoded once.

Such a tokenizer (its pre-tokenizer keeps only matches that hold no white space) encodes the words
between white space independently of each other, so a text may be cut there and the parts' ids joined.
"""

from __future__ import annotations

import json
import os
import re
from struct import pack

import numpy as np

from .common import held

#: Python's split() also cuts at these four, which regular expression libraries do not call white space.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_DIGIT = re.compile(r"(?<=[0-9])(?=[ -~])|(?<=[ -~])(?=[0-9])")


def load(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut(text: str) -> list[str]:
    """The words of a text."""
    if any(c in text for c in _ODD):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def safe_pieces(word: str, limit: int) -> list[str]:
    """A long word in pieces of at least `limit` characters, cut beside ASCII digits, which are always tokens of their own.

    With no digit in it, it stays whole.
    """
    out, start = [], 0
    for m in _DIGIT.finditer(word):
        if m.start() - start >= limit:
            out.append(word[start : m.start()])
            start = m.start()
    out.append(word[start:])
    return out


#: Characters that no normalisation but lower-casing changes and whose classes are settled: up to U+024F.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]+")
_LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: What often follows a word and is a part of its own.
_ENDS = frozenset(".,;:!?)")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def weight(words) -> int:
    """About the bytes that a table of these words takes: entries, words, and a number for each few characters."""
    return 200 * len(words) + 4 * sum(map(len, words))


class WordEncoder:
    """Ids of each word, kept in a table of bounded size.

    Words of plain characters are lower-cased and split as the vocabulary's pattern does. To be counted, the distinct
    parts go to the library joined by spaces, and the ids are parted where a token ends a word; all other words go
    to it by themselves. limit: bytes of words kept, about; batch_bytes: about so many bytes go to the library
    at once, so that batches are even whatever the words' lengths and letters.
    """

    def __init__(self, json_text: str, limit: int = 380_000_000, batch_bytes: int = 50_000, piece: int = 20_000):
        self.tokenizer, self.limit, self.batch_bytes, self.piece = load(json_text), limit, batch_bytes, piece
        spec = json.loads(json_text)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.mark = os.path.commonprefix(self.specials)  # every special string holds it
        self.suffix = spec["model"].get("end_of_word_suffix")
        pattern = json.dumps(spec["pre_tokenizer"])
        if not self.suffix or '"ByteLevel"' not in pattern or "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" not in pattern or "Removed" not in pattern:
            raise ValueError("not a word vocabulary that drops white space")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(self.suffix)
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.held = 0
        self.ids = _Ids(self)

    def _batches(self, items: list[str]):
        """Lists of items balanced by size."""
        batch, held = [], 0
        for x in items:
            batch.append(x)
            held += len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
            if held >= self.batch_bytes:
                yield batch
                batch, held = [], 0
        if batch:
            yield batch

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts_of(self, word: str) -> list[str] | None:
        """The lower-cased parts that the pattern splits a word of plain characters into; none for other words."""
        if word.isascii():
            if word.isalpha():
                return [word.lower()]
            if word[-1] in _ENDS and word[:-1].isalpha():
                return [word[:-1].lower(), word[-1]]
        if _PLAIN.fullmatch(word) and (self.mark not in word or not any(s in word for s in self.specials)):
            return _PARTS.findall(word.lower())
        return None

    def odd(self, word: str) -> list[list[int]]:
        """The ids of a word that is not plain: whole, or, if very long, by its safe pieces."""
        pieces = [word] if len(word) <= 2 * self.piece else safe_pieces(word, self.piece)
        return [ids for b in self._batches(pieces) for ids in self._encode(b)]

    def _encode_parts(self, parts: list[str]):
        """(part, number of ids) for words that the splitter leaves whole."""
        for batch in self._batches(parts):
            ids = np.array(self._encode([" ".join(batch)])[0], "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(batch) or ends[-1] != len(ids):
                yield from zip(batch, map(len, self._encode(batch)), strict=True)
            else:
                yield from zip(batch, np.diff(ends, prepend=0).tolist(), strict=True)

    def _fill(self, words: set[str]) -> dict[str, int]:
        """The table of lengths with all of `words` in it."""
        known, parts = self.known, self.parts
        if self.held > self.limit:
            known = self.known = {w: known[w] for w in words if w in known}
            parts.clear()
            self.held = weight(known)
        split, odd = {}, []
        for w in words.difference(known):
            own = self.parts_of(w)
            if own is None:
                odd.append(w)
            else:
                split[w] = own
        missing = set().union(*split.values()).difference(parts)
        self.held += weight(missing) + weight(split) + weight(odd)
        parts.update(self._encode_parts(list(missing)))
        get = parts.__getitem__
        for w, x in split.items():
            known[w] = get(x[0]) if len(x) == 1 else sum(map(get, x))
        for batch in self._batches([w for w in odd if len(w) <= 2 * self.piece]):
            known.update(zip(batch, map(len, self._encode(batch)), strict=True))
        for w in (w for w in odd if len(w) > 2 * self.piece):
            known[w] = sum(map(len, self.odd(w)))
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        self.ids.trim()
        get = self.ids.__getitem__
        return [b"".join(map(get, cut(t))) for t in texts]

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text; the ids themselves are dropped at once."""
        cuts = [cut(t) for t in texts]
        get = self._fill(set().union(*cuts)).__getitem__
        return [sum(map(get, x)) for x in cuts]


class _Ids(dict):
    """The ids of words as little-endian 32-bit integers, each word encoded when it is met first.

    A plain part needs no step of the library before its merges but the spelling of its bytes in the vocabulary's letters.
    """

    def __init__(self, encoder: WordEncoder):
        super().__init__()
        self.encoder, self.tokenize, self.parts = encoder, encoder.tokenizer.model.tokenize, {}
        self.held = self.of_parts = 0  # bytes, about: of all, and of the parts
        self.letters = {b: c for c, b in byte_letters().items()}

    def trim(self) -> None:
        """Beyond the limit words go; their parts stay up to a third of it."""
        if self.held > self.encoder.limit:
            self.clear()
            if 3 * self.of_parts > self.encoder.limit:
                self.parts.clear()
                self.of_parts = 0
            self.held = self.of_parts

    def part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            letters = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
            ids = [t.id for t in self.tokenize(letters)]
            got = self.parts[p] = pack(f"<{len(ids)}I", *ids)
            self.held += 200 + 4 * len(p)
            self.of_parts += 200 + 4 * len(p)
        return got

    def __missing__(self, word: str) -> bytes:
        parts = self.encoder.parts_of(word)
        if parts is None:
            ids = b"".join([np.array(x, "<u4").tobytes() for x in self.encoder.odd(word)])
        else:
            ids = self.part(parts[0]) if len(parts) == 1 else b"".join(map(self.part, parts))
        self[word] = ids
        self.held += 200 + 4 * len(word)
        return ids


def encoder(json_text: str) -> WordEncoder:
    return held("words", hash(json_text), lambda: WordEncoder(json_text))


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
