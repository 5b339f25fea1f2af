"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, URL schemes, digits and cue words of
identifiers. A deterministic local parser expands each anchor to both sides, to a bounded match, and
validates it. Parsers look at the characters round the anchor only, and no parser goes over the same characters
again for a later anchor of its kind, so a text costs its length plus its matches.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, held, plainly_named, text_pieces

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = 4

#: Words before an identifier.
CUES = ("account", "acct", "iban", "passport", "ssn", "kontonummer", "cuenta", "compte")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"[ ().0-9-]+[0-9]")
_USER = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s]*)?")
#: Runs of blanks are possessive: given back, they would be tried again at each place.
_CODE = re.compile(r"(?:[ \t]*+(?:no|nr|number)\b\.?)?[ \t]*+[:#=]?[ \t]*+([A-Za-z0-9][A-Za-z0-9-]{5,33})(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return bool(_IBAN.fullmatch(code)) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """Spans of one text at a time; one for each worker, as the automaton is built once."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, anchors in (("email", "@"), ("phone", "+"), ("digit", "0123456789"), ("url", SCHEMES), ("cue", [f(x) for x in CUES for f in (str, str.capitalize, str.upper)])):
            for a in anchors:
                self.automaton.add_word(a, (kind, len(a)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans of a text, by start, then in the order of KINDS. Offsets are code points, ends exclusive."""
        out: list[Span] = []
        done = {"email": 0, "ip": 0, "card": 0, "url": 0}
        for last, (kind, size) in self.automaton.iter(text):
            if kind == "digit":
                if last >= done["card"]:
                    self._card(text, last, done, out)
                if last >= done["ip"]:
                    self._ip(text, last, done, out)
            elif kind == "email":
                self._email(text, last, done, out)
            elif kind == "phone":
                self._phone(text, last, out)
            elif kind == "url":
                if last >= done["url"] and (m := _USER.match(text, last + 1)):
                    out.append(("url", last + 1 - size, m.end()))
                    done["url"] = m.end()
            else:
                self._account(text, last + 1, size, out)
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))

    @staticmethod
    def _email(text: str, at: int, done: dict, out: list[Span]) -> None:
        """Expands an at-sign: left over the local part, but not into the match before, right over two or more labels."""
        m = _DOMAIN.match(text, at + 1)
        if not m:
            return
        start, least = at, done["email"]
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            done["email"] = m.end()

    @staticmethod
    def _ip(text: str, first: int, done: dict, out: list[Span]) -> None:
        """Expands the first digit of a dotted run: each four parts of it are an address if none is over 255."""
        m = _DOTTED.match(text, first)
        parts, at = m[0].split("."), first
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
        done["ip"] = m.end()

    @staticmethod
    def _card(text: str, first: int, done: dict, out: list[Span]) -> None:
        """Expands the first digit of a run of digits with at most one blank or hyphen between two of them."""
        m = _CARD.match(text, first)
        if m:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", first, m.end()))
        done["card"] = m.end() if m else first + 1

    @staticmethod
    def _phone(text: str, plus: int, out: list[Span]) -> None:
        if "0" <= text[plus + 1 : plus + 2] <= "9" and (m := _PHONE.match(text, plus + 2)):
            if 9 <= 1 + sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", plus, m.end()))

    @staticmethod
    def _account(text: str, end: int, size: int, out: list[Span]) -> None:
        """Expands a cue word to the identifier after it: an IBAN by its check digits, else a code of six digits or more."""
        start = end - size
        if start and text[start - 1].isalnum():
            return
        m = _CODE.match(text, end)
        if not m or m.start(1) == end:
            return
        code = m[1]
        if iban(code.replace("-", "").upper()):
            out.append(("iban", m.start(1), m.end(1)))
        elif sum("0" <= c <= "9" for c in code) >= 6:
            out.append(("account", m.start(1), m.end(1)))


def finder() -> Finder:
    return held("pii", None, Finder)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for each row of docs.

    Null and empty texts have no spans; repeated rows give repeated results; a null id stays null; an empty
    table gives an empty result; other columns, whatever their names, are not read. No shuffle: a row's result
    depends on that row only, and takes time in proportion to its text.
    """
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        own = finder()
        for b in text_pieces(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in own.spans(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], names=[id_col, "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).transform(arrow, run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text, from find_pii's rows."""
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:BASE]))
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:BASE]]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with all spans in the text replaced by <KIND>, and the length (in code points) brought up to date.

    A null text stays null, an empty one empty; repeated rows stay as many; an empty table gives an empty result;
    other columns, whatever their names and types, stay as they are.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, _ = plainly_named(docs)
    at, length = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        own = finder()
        for b in text_pieces(batches):
            texts = [redacted(t, s) if t and (s := own.spans(t)) else t for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pc.if_else(pc.is_null(columns[at]), columns[length], pc.utf8_length(columns[at]).cast(columns[length].type))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return rows.transform(arrow, run, rows.schema).toDF(*docs.columns)
