"""Byte-level BPE by prefix-sharing trie traversal.

The BPE encoding of a byte string ends in one token, and what stands before that token is the BPE
encoding of the string without it. So each node of a trie of words (a prefix of some word) needs only its
last token: the one token that is a suffix of the prefix and is compatible with the last token of the node
where it begins, that is, BPE encodes the two tokens' joined bytes as just these two. Distinct words are
laid out in byte order, which is a trie's depth-first order: the states of the prefix that a word shares
with its predecessor are kept on a stack and not computed again.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

from pyspark.sql import DataFrame

from . import words
from .common import arrow, held, text_pieces

#: The published pattern of byte-level BPE vocabularies that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters only are split by the pattern here; others, whose classes depend on a
#: library's Unicode version, by the tokenizers library's own splitter.
_PLAIN = re.compile("[\t\n\r -~\xa0-ɏ‐-‧€]*")
_DOUBLE = re.compile(r" \s|\s$")
_CUT = re.compile(r" (?=\S)")


class TrieBPE:
    """Encodes words with a byte-level BPE vocabulary given as a tokenizers file's text.

    limit: bytes of words and their ids that are kept, about; beyond it only those in use stay, so memory is bounded.
    """

    def __init__(self, json_text: str, limit: int = 120_000_000):
        import regex

        spec = json.loads(json_text)
        model, letters = spec["model"], words.byte_letters()
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.rank = {(self.id_of[as_bytes(a)], self.id_of[as_bytes(b)]): (k, self.id_of[as_bytes(a + b)]) for k, (a, b) in enumerate(merges)}
        #: The rank of the merge that makes a token (-1: a byte) and the two tokens it joins.
        self.made = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for pair, (k, i) in self.rank.items():
            if self.made[i] < 0:
                self.made[i], self.halves[i] = k, pair
        self.pairs: dict[int, bool] = {}
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        #: An automaton over the tokens that their own merges make (no other token appears in an encoding): a
        #: state is a beginning of a token, the longest one that the prefix read so far ends with.
        self.token_of = {b: i for b, i in self.id_of.items() if self.made[i] < 0 or self.own(i)}
        self.begins = [b"", *sorted({b[:k] for b in self.token_of for k in range(1, len(b) + 1)})]
        self.state_of = {b: k for k, b in enumerate(self.begins)}
        self.steps: dict[int, int] = {}
        #: (length, token) of the tokens that a state's prefix ends with, from the longest; filled as states are met.
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.begins)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.names = {i: str(i) for i in self.bytes_of}
        self.pattern, self.library, self.json_text = regex.compile(PATTERN), None, json_text
        self.limit = limit
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE, by the merges in order of rank; used only for short strings, to judge tokens and pairs of tokens."""
        ids = [self.id_of[bytes([b])] for b in data]
        while True:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                return ids
            pair = ids[best[1]], ids[best[1] + 1]
            made, out, i = self.rank[pair][1], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def own(self, token: int) -> bool:
        """Whether BPE encodes the token's bytes as that token."""
        return self.merged(self.bytes_of[token]) == [token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE encodes the joined bytes of two tokens as these two.

        Undoes, latest first, the merges at the seam; a merge across the seam that comes before the merge
        just undone would have come first. Of equal merges the left one comes first.
        """
        rank, made, halves = self.rank, self.made, self.halves
        limit = len(rank) + 1
        while True:
            across = rank.get((left, right))
            if across is not None and across[0] < limit:
                return False
            l, r = made[left], made[right]
            if l > r:
                limit, left = l, halves[left][1]
            elif r >= 0:
                limit, right = r + 1, halves[right][0]
            else:
                return True

    def _step(self, key: int) -> int:
        """The state after a state (key >> 8) and a byte (key & 255)."""
        text = self.begins[key >> 8] + bytes([key & 255])
        while text not in self.state_of:
            text = text[1:]
        state = self.steps[key] = self.state_of[text]
        if self.ends[state] is None:
            tails = (text[k:] for k in range(len(text)))
            self.ends[state] = tuple((len(t), self.token_of[t]) for t in tails if t in self.token_of)
        return state

    def encode_words(self, distinct: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each word, by one depth-first walk over the trie of all of them.

        The last token of a node: of the tokens that its prefix ends with, from the longest, the first that
        fits the last token of the node where it begins. last[k], at[k]: that of the node at depth k, and the
        automaton's state there.
        """
        out: dict[bytes, tuple[int, ...]] = {}
        before, last, at, ends, lengths = b"", [-1], [0], self.ends, self.lengths
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        if len(self.steps) > 600_000:
            self.steps.clear()
        pairs, steps = self.pairs, self.steps
        for word in sorted(set(distinct)):
            size, shared = len(word), 0
            most = min(len(before), size)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], at[shared + 1 :]
            state, depth = at[shared], shared
            for byte in word[shared:]:
                depth += 1
                key = state << 8 | byte
                state = steps.get(key)
                if state is None:
                    state = self._step(key)
                for length, token in ends[state]:
                    if length == depth:
                        break
                    key = last[depth - length] << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(key >> 20, token)
                    if fits:
                        break
                last.append(token)
                at.append(state)
            ids = []
            while depth:
                ids.append(last[depth])
                depth -= lengths[last[depth]]
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    def _split(self, piece: str) -> list[str]:
        """The words of a piece of text without special strings."""
        if _PLAIN.fullmatch(piece):
            return self.pattern.findall(piece)
        if self.library is None:
            self.library = words.load(self.json_text)
        return [piece[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def _cut(self, text: str) -> list[str]:
        """A text in pieces that are split independently: before a space that a character other than white space follows."""
        if not _PLAIN.fullmatch(text):
            found = [text]
        else:
            found = _CUT.split(text) if _DOUBLE.search(text) else text.split(" ")
        return [found[0], *[" " + x for x in found[1:]]] if found[0] else [" " + x for x in found[1:]]

    def _known(self, distinct: set[str]) -> None:
        if self.held > self.limit:
            self.pieces = {p: self.pieces[p] for p in distinct if p in self.pieces}
            self.held = words.weight(self.pieces)
        # A space or none and letters: one word. The others are split.
        whole, split = [], {}
        for p in distinct.difference(self.pieces):
            if p.isascii() and (p.isalpha() or p[0] == " " and p[1:].isalpha()):
                whole.append(p)
            else:
                split[p] = self._split(p)
        self.held += words.weight(whole) + words.weight(split)
        encoded = self.encode_words([w.encode() for w in {*whole, *chain.from_iterable(split.values())}])
        for p in whole:
            self.pieces[p] = encoded[p.encode()]
        for p, x in split.items():
            self.pieces[p] = encoded[p.encode()] if len(x) == 1 else tuple(chain.from_iterable([encoded[w.encode()] for w in x]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each whole text. Special strings in a text become their ids."""
        parts: list[list[list[str] | int]] = []
        for text in texts:
            if not text:
                parts.append([])
            elif self.specials is None or not self.specials.search(text):
                parts.append([self._cut(text)])
            else:
                own, at = [], 0
                for m in self.specials.finditer(text):
                    own += [self._cut(text[at : m.start()])] if m.start() > at else []
                    own.append(self.special[m[0]])
                    at = m.end()
                parts.append(own + ([self._cut(text[at:])] if at < len(text) else []))
        self._known(set().union(*(p for x in parts for p in x if not isinstance(p, int))))
        get = self.pieces.__getitem__
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(get, p)) for p in x)) for x in parts]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids that the vocabulary lacks are left out."""
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join(self.bytes_of[i] for i in ids if i in self.bytes_of)
        return data.decode("utf-8", "replace")


def codec(json_text: str) -> TrieBPE:
    return held("bpe", hash(json_text), lambda: TrieBPE(json_text))


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded][, carried columns]) for each row of docs.

    path: a byte-level BPE file of the tokenizers library. Null and empty texts have no ids and decode to
    the empty text; repeated rows give repeated results; a null id stays null; an empty table gives an empty
    result; other columns, whatever their names, are not read. No shuffle: a row's result depends on that row only.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(words.vocabulary(path))

    def run(batches):
        own = codec(vocabulary.value)
        for b in text_pieces(batches):
            n, hashes, back, all_ids, texts = [], [], [], [], []
            for ids in own.encode([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                text = own.decode(ids)
                back.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    texts.append(text)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            columns, names = columns + b.columns[2:], names + list(carry)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(docs.dtypes)
    kind, more = kinds[id_col], ", ids array<int>, decoded string" if keep_ids else ""
    more += "".join(f", `{c}` {kinds[c]}" for c in carry)
    return docs.select(id_col, text_col, *carry).transform(arrow, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
