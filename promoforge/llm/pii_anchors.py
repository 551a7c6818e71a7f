"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds the anchors: at-signs, plus signs, digits, scheme separators and the cues of
accounts and secrets. At each anchor a local parser expands to the left and right, checks the result, and
remembers where its kind ended, so that spans of a kind do not overlap. Four kinds are fixed by patterns (email, ip, card,
phone); two are added: ``account`` (a value after a cue such as ``password =``, a cloud access key, an IBAN with valid check
digits) and ``address`` (a web address that carries user information).

Defined cases: null and empty texts hold nothing; rows are judged one by one; ties cannot occur, as spans of a kind
are disjoint; empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")
# Words that announce a secret or an account, in any mixture of cases.
CUES = ("password", "passwd", "pwd", "passphrase", "api_key", "apikey", "api-key", "secret", "token", "access_key", "accesskey", "access-key", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_VALUE = re.compile(r"""[A-Za-z0-9_-]{0,16}["']?\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9+/_.~-]{8,})""")
_ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_AUTHORITY = re.compile(r"[^\s/?#@\"'<>]+@[^\s/?#@\"'<>]+[^\s\"'<>]*")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = {"@": "@", "+": "+", "://": "://", "akia": "key", "iban": "iban"} | {d: "digit" for d in "0123456789"}
    found |= dict.fromkeys(CUES, "cue")
    out = ahocorasick.Automaton()
    for word, what in found.items():
        out.add_word(word, (len(word), what))
    out.make_automaton()
    return out


def find_pii(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)

    def take(kind: str, start: int, end: int, good: bool = True) -> None:
        done[kind] = end
        if good:
            out[kind].append((start, end))

    # Only A-Z change, so places stay the same.
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for last, (length, what) in _automaton().iter(lower):
        start, end = last + 1 - length, last + 1
        if what == "digit":
            if start and "0" <= text[start - 1] <= "9":
                continue
            if start >= done["ip"] and (m := _IP.match(text, start)):
                take("ip", start, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in m[0].split(".")))
            if start >= done["card"] and (m := _CARD.match(text, start)):
                digits = _NOT_DIGIT.sub("", m[0])
                take("card", start, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif what == "@":
            left = start
            while left > done["email"] and text[left - 1] in LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, end)):
                take("email", left, m.end())
        elif what == "+":
            if start >= done["phone"] and (m := _PHONE.match(text, start)):
                take("phone", start, m.end(), 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
        elif what == "://":
            left = start
            while left > done["address"] and text[left - 1].isascii() and text[left - 1].isalpha():
                left -= 1
            if left < start and (m := _AUTHORITY.match(text, end)):
                take("address", left, m.end())
        elif what == "cue":
            if (m := _VALUE.match(text, end)) and m.start(1) >= done["account"] and any(c.isdigit() for c in m[1]):
                take("account", *m.span(1))
        elif what == "key":
            if start >= done["account"] and not (start and text[start - 1].isalnum()) and (m := _ACCESS_KEY.match(text, start)):
                take("account", *m.span())
        elif m := _IBAN.search(text, end, end + 48):
            if m.start() >= done["account"]:
                # The pattern may run on into the next words: the longest valid number counts.
                for stop in range(m.end(), m.start() + 14, -1):
                    if text[stop - 1] != " " and not text[stop:stop + 1].isalnum() and iban_valid(text[m.start():stop]):
                        take("account", m.start(), stop)
                        break
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_pii(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id and ``spans`` (kind, start, end)."""
    text = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return text.mapInArrow(_found, f"id {text.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
