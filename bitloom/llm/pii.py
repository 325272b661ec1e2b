"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before a digit, digits that touch (at once or
over one separator), scheme marks, identifier cues and cues of secrets. From each, a deterministic parser walks left and
right to the boundaries of the item and validates it. An anchor inside an item already taken is passed over, and the
end of a run of signs is remembered for the anchors that follow in it, so a text costs time linear in its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = LETTERS | DIGITS | frozenset("+.-")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
TRIM = frozenset(".,;:!?)]")
#: Cues before an account or identity number.
CUES = ("account", "acct", "a/c", "iban", "ssn", "passport", "customer id", "user id", "member id", "tax id", "policy", "license no", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "auth key", "auth_key", "private key", "private_key")
#: How an access key's id begins, and its length.
KEY_IDS, KEY_ID = ("AKIA", "ASIA"), 20
FILLER = ("number", "no.", "no", "nr.", "nr", "id", "#", ":", "=", "is", " ")

Span = tuple[int, int]


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", "email")
    out.add_word("://", "url")
    for a in "0123456789":
        out.add_word("+" + a, "phone")
        for b in "0123456789":
            for between, kind in (("", "card"), (" ", "card"), ("-", "card"), (".", "ip")):
                out.add_word(a + between + b, kind)
    for kind, cues in (("account", CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.title(), cue.upper()):
                out.add_word(form, (kind, cue))
    for begin in KEY_IDS:
        out.add_word(begin, "key id")
    out.make_automaton()
    return out


def walk(text: str, i: int, allowed: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def back(text: str, i: int, allowed: frozenset, floor: int = 0) -> int:
    while i > floor and text[i - 1] in allowed:
        i -= 1
    return i


def email(text: str, at: int, floor: int) -> Span | None:
    start = back(text, at, LOCAL, floor)
    end = walk(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dotted = end
    while dotted < len(text) and text[dotted] == "." and (more := walk(text, dotted + 1, LABEL)) > dotted + 1:
        dotted = more
    return (start, dotted) if dotted > end else None


def addresses(text: str, dot: int) -> tuple[list[Span], int]:
    """IP addresses of the run of dotted numbers around a dot, four numbers each from the left; and the run's end."""
    start = dot
    while (left := back(text, start, DIGITS)) < start:
        start = left
        if start > 1 and text[start - 1] == "." and text[start - 2] in DIGITS:
            start -= 1
        else:
            break
    parts, i = [], start
    while (end := walk(text, i, DIGITS)) > i:
        parts.append((i, end))
        if end >= len(text) or text[end] != ".":
            break
        i = end + 1
    fours = [parts[k : k + 4] for k in range(0, len(parts) - 3, 4)]
    return [(f[0][0], f[3][1]) for f in fours if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or "0") <= 255 for a, b in f)], parts[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def number_run(text: str, i: int) -> Span:
    """The longest run of digits with at most one space or hyphen between two, around digit i."""
    n, start, end = len(text), i, i + 1
    while start > 0:
        if text[start - 1] in DIGITS:
            start -= 1
        elif start > 1 and text[start - 1] in " -" and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def card(text: str, span: Span) -> bool:
    digits = [c for c in text[span[0] : span[1]] if c in DIGITS]
    return 13 <= len(digits) <= 19 and luhn("".join(digits))


def phone(text: str, plus: int) -> Span | None:
    end = walk(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return (plus, end) if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


class Ends:
    """Where the run of signs around a place ends; the last run asked for is remembered."""

    def __init__(self, text: str, inside):
        self.text, self.inside, self.begin, self.end = text, inside, 0, 0

    def of(self, i: int) -> int:
        if not self.begin <= i < self.end:
            end, n = i, len(self.text)
            while end < n and self.inside(self.text[end]):
                end += 1
            self.begin, self.end = i, end
        return self.end


def url(text: str, mark: int, ends: Ends, floor: int) -> Span | None:
    start = back(text, mark, SCHEME, floor)
    while start < mark and text[start] not in LETTERS:
        start += 1
    host = walk(text, mark + 3, LABEL | {"."})
    if start == mark or "." not in text[mark + 3 : host].strip("."):
        return None
    end = ends.of(mark + 3)
    while text[end - 1] in TRIM:
        end -= 1
    return (start, end) if end > mark + 3 else None


def iban(code: str) -> bool:
    """Whether a code has the form of an international account number and its check digits hold (remainder 1 by 97)."""
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit() and code.isascii() and code.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def social(code: str) -> bool:
    """Nine digits in groups of 3, 2 and 4 that can have been given out: no group of zeros, no area 666 or from 900."""
    digits = code.replace("-", "")
    return len(digits) == 9 and digits.isdigit() and code.count("-") in (0, 2) and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def account(text: str, after: int, cue: str, ends: Ends) -> Span | None:
    """An identifier of 6 to 34 signs with at least 4 digits behind a cue and its filler words, valid for its cue: check
    digits of an IBAN (behind that cue, or in its form), groups of a social security number."""
    i, moved = after, True
    low = text[after : after + 32].lower()
    while moved and i - after < 20:
        moved = False
        for f in FILLER:
            if low.startswith(f, i - after):
                i, moved = i + len(f), True
                break
    if i == after or i >= len(text) or text[i] not in LABEL:
        return None
    end = ends.of(i)
    if end - i > 60:
        return None
    while end > i and text[end - 1] == "-":
        end -= 1
    code = text[i:end]
    if not (6 <= len(code) <= 34 and sum(c in DIGITS for c in code) >= 4):
        return None
    if cue == "ssn":
        return (i, end) if social(code) else None
    formed = len(code) >= 15 and code[:2].isalpha() and code[:2].isupper() and code[2:4].isdigit()
    return (i, end) if not (cue == "iban" or formed) or iban(code) else None


def secret(text: str, after: int, ends: Ends) -> Span | None:
    """A value of 8 signs or more with a letter and a digit, behind a cue and an equals sign or colon, quoted or not."""
    i = walk(text, after, frozenset("\"'")) if after < len(text) and text[after] in "\"'" else after
    i = min(walk(text, i, frozenset(" ")), i + 4)
    if i >= len(text) or text[i] not in "=:":
        return None
    i = min(walk(text, i + 1, frozenset(" \"'")), i + 5)
    if i >= len(text) or text[i] in URL_END:
        return None
    end = ends.of(i)
    while end > i and text[end - 1] in TRIM:
        end -= 1
    head = text[i : min(end, i + 512)]
    return (i, end) if end - i >= 8 and not DIGITS.isdisjoint(head) and not LETTERS.isdisjoint(head) else None


def key_id(text: str, start: int) -> Span | None:
    end = start + KEY_ID
    body = text[start:end]
    whole = len(body) == KEY_ID and body.isascii() and body.isalnum() and body.upper() == body
    return (start, end) if whole and (end == len(text) or text[end] not in LABEL) and (start == 0 or text[start - 1] not in LABEL) else None


def find(text: str, machine: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans of each kind in code points, end exclusive, by start; those of a kind don't overlap."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    links, names, values = Ends(text, lambda c: c not in URL_END), Ends(text, LABEL.__contains__), Ends(text, lambda c: c not in URL_END)
    for last, found in machine.iter(text):
        kind, cue = found if isinstance(found, tuple) else (found, "")
        if last < done["secret" if kind == "key id" else kind]:
            continue
        if kind == "email":
            span = email(text, last, done["email"])
        elif kind == "phone":
            span = phone(text, last - 1)
        elif kind == "url":
            span = url(text, last - 2, links, done["url"])
        elif kind == "account":
            span = account(text, last + 1, cue, names)
        elif kind == "secret":
            span = secret(text, last + 1, values)
        elif kind == "key id":
            kind, span = "secret", key_id(text, last - 3)
        elif kind == "ip":
            spans, done["ip"] = addresses(text, last - 1)
            out["ip"] += spans
            continue
        else:
            span = number_run(text, last)
            done["card"] = span[1]
            if card(text, span):
                out["card"].append(span)
            continue
        if span and span[0] >= done[kind]:
            out[kind].append(span)
            done[kind] = span[1]
    return out


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


#: Kinds that make a text private; addresses of pages don't.
PRIVATE = ("email", "ip", "card", "phone", "account", "secret")


def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    empty = find("", machine)
    for batch in it:
        rows = [find(t, machine) if t else empty for t in batch.column(1).to_pylist()]
        counts = [pa.array([len(f[k]) for f in rows], pa.int64()) for k in KINDS]
        total = pa.array([sum(len(f[k]) for k in PRIVATE) for f in rows], pa.int64())
        sha = [hashlib.sha256(listed(f, KINDS[:4]).encode()).hexdigest() for f in rows]
        columns = [batch.column(0), *counts[:4], pa.array(sha), pa.array([listed(f, KINDS) for f in rows], pa.string()), *counts[4:], total]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:]), "n_private"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account, n_secret, n_private (all but pages'
    addresses) of each row of docs (doc_id, text).

    The hash is that of the base kinds; spans lists all kinds as kind:start:end. Null texts are empty; null ids and
    repeated rows stay; an empty table gives no rows. Very long texts are scanned whole, in linear time. Of spans of one
    kind that would overlap the first stands. Other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long, n_secret long, n_private long")


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in square brackets; overlapping spans become the first's.

    Null texts stay null, empty ones empty, and other columns, repeated rows and null ids as they are; an empty table
    gives no rows. Very long texts are masked whole.
    """
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in it:
            out, at = [], batch.schema.get_field_index("text")
            for t in batch.column(at).to_pylist():
                parts, end = [], 0
                for s, e, k in sorted((s, e, k) for k, spans in find(t or "", machine).items() for s, e in spans):
                    if s >= end:
                        parts += [t[end:s], f"[{k}]"]
                        end = e
                out.append(t if t is None else "".join([*parts, t[end:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)
