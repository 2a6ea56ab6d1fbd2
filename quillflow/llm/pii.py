"""Operator 3: personal data and secrets by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text, whose ASCII letters are lower-cased for it:
at-signs, schemes, plus signs, colons, digits and identifier cues. At each anchor a deterministic parser of that kind
expands to both sides, finds the bounds and validates: label rules for hosts and addresses, octets for IPv4, groups for
IPv6, Luhn for payment cards, mod 97 for IBANs, area rules for social security numbers, lengths for phone and account
numbers. No regular expressions, no backtracking; where several anchors lie in one run of characters the run's end is
looked for once (Runs), so the work is linear in the text.

Of overlapping finds the one that starts first stays, but an address or URL replaces what lies inside it. start and end
count characters, end excluded. An address's local part and a URL may be of any length; a host has 253 characters at
most, or it is none. Defined results: null and empty texts give no rows; repeated rows give their finds again; a null
doc_id stays null. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import spread
from .textcore import map_batches

DIGITS = frozenset("0123456789")
_SCHEMES = frozenset({"http", "https", "ftp", "ftps", "sftp", "ws", "wss"})
_SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")
_ACCOUNT_CUES = ("account", "acct")
_LOCAL = frozenset("._%+-'")
_SECRET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=.~")
_URL_STOP = frozenset("<>\"{}|\\^`")
_HEX = frozenset("0123456789abcdefABCDEF:.")
_AUTHORITY = 512  # a user and a host have no more characters together
_LOWER = {c: c + 32 for c in range(65, 91)}
_OPEN = {")": "(", "]": "["}

Find = tuple[int, int, str]


#: Anchors in lower case, and their kinds.
ANCHORS: dict[str, str] = {
    "@": "@", "://": "://", "www.": "www", "+": "+", ":": ":", **dict.fromkeys(DIGITS, "digit"),
    **dict.fromkeys(_SECRET_CUES, "secret"), **dict.fromkeys(_ACCOUNT_CUES, "account"), "passport": "passport",
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


class Runs:
    """Ends of the runs of characters that parsers have looked through in a text, so that none is looked for twice."""

    def __init__(self) -> None:
        self.url = self.name = self.hexa = (0, 0)
        self.secret = (0, 0, 0)
        self.tried = -1

    def url_end(self, t: str, at: int) -> int:
        if not self.url[0] <= at < self.url[1]:
            b = at
            while b < len(t) and not t[b].isspace() and t[b] not in _URL_STOP:
                b += 1
            self.url = at, b
        return self.url[1]

    def name_end(self, t: str, at: int) -> int:
        """Where the identifier that a cue is part of ends."""
        if not self.name[0] <= at < self.name[1]:
            b = at
            while b < len(t) and (t[b].isascii() and t[b].isalnum() or t[b] in "_-"):
                b += 1
            self.name = at, b
        return self.name[1]

    def secret_end(self, t: str, at: int) -> tuple[int, int]:
        """Where a run of a secret's characters ends, and its last digit; -1 if it has none."""
        if not self.secret[0] <= at < self.secret[1]:
            b, digit = at, -1
            while b < len(t) and t[b] in _SECRET:
                if t[b] in DIGITS:
                    digit = b
                b += 1
            self.secret = at, b, digit
        return self.secret[1:]


def _host(t: str) -> bool:
    """Whether a string is a host name: two labels or more, the last of letters (or punycode)."""
    labels = t.split(".")
    if len(labels) < 2 or len(t) > 253:
        return False
    for x in labels:
        if not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" or not all(c.isalnum() or c == "-" for c in x):
            return False
    return len(labels[-1]) >= 2 and (labels[-1].isalpha() or labels[-1].startswith("xn--"))


def email(t: str, at: int) -> Find | None:
    a, b, n = at, at + 1, len(t)
    while a and (t[a - 1].isalnum() or t[a - 1] in _LOCAL):
        a -= 1
    while a < at and not t[a].isalnum():
        a += 1
    while b < n and (t[b].isalnum() or t[b] in "-."):
        b += 1
    while b > at + 1 and t[b - 1] in "-.":
        b -= 1
    local = t[a:at]
    if not local or local[-1] == "." or ".." in local or not _host(t[at + 1 : b]):
        return None
    return a, b, "email"


def _octets(t: str) -> bool:
    parts = t.split(".")
    return len(parts) == 4 and all(0 < len(x) < 4 and DIGITS.issuperset(x) and int(x) < 256 and (x == "0" or x[0] != "0") for x in parts)


def _authority(t: str, at: int, end: int) -> bool:
    """Whether a host, with user and port if any, begins at a place. What follows it isn't looked at."""
    b = at
    while b < end and t[b] not in "/?#":
        b += 1
        if b - at > _AUTHORITY:
            return False
    host, _, port = t[at:b].rstrip(".,;:!?'*$&%)]").rpartition("@")[2].partition(":")
    return (not port or len(port) < 6 and DIGITS.issuperset(port) and int(port) < 65536) and (_host(host) or _octets(host) or host == "localhost")


def _url_end(t: str, first: int, b: int) -> int:
    """The end without the punctuation, and the brackets that nothing in it opens, that follow a URL in a sentence."""
    excess = {c: t.count(c, first, b) - t.count(o, first, b) for c, o in _OPEN.items()}
    while b > first and (t[b - 1] in ".,;:!?'*#$&%" or excess.get(t[b - 1], 0) > 0):
        b -= 1
        if t[b] in excess:
            excess[t[b]] -= 1
    return b


def url(t: str, at: int, runs: Runs) -> Find | None:
    """at: the colon of ://."""
    a = at
    while a and at - a < 6 and t[a - 1].isascii() and t[a - 1].isalnum():
        a -= 1
    while a < at and t[a:at].lower() not in _SCHEMES:
        a += 1
    if a == at:
        return None
    end = runs.url_end(t, at)
    return (a, _url_end(t, at + 3, end), "url") if _authority(t, at + 3, end) else None


def www(t: str, at: int, runs: Runs) -> Find | None:
    if at and (t[at - 1].isalnum() or t[at - 1] in "/.@-"):
        return None
    end = runs.url_end(t, at)
    return (at, _url_end(t, at + 4, end), "url") if _authority(t, at, end) else None


def ipv4(t: str, at: int) -> Find | None:
    if at and (t[at - 1].isalnum() or t[at - 1] in "-."):
        return None
    b, n = at, len(t)
    for group in range(4):
        a = b
        while b < n and b - a < 4 and t[b] in DIGITS:
            b += 1
        if group < 3:
            if b >= n or t[b] != ".":
                return None
            b += 1
    if b < n and (t[b].isalnum() or t[b] == "-") or b + 1 < n and t[b] == "." and t[b + 1] in DIGITS:
        return None
    return (at, b, "ipv4") if _octets(t[at:b]) else None


def ipv6(t: str, at: int, runs: Runs) -> Find | None:
    """at: a colon. Eight groups, or fewer with a double colon, of six characters with a digit at least."""
    if runs.hexa[0] <= at < runs.hexa[1]:
        return None
    a = b = at
    while a and t[a - 1] in _HEX:
        a -= 1
    while b < len(t) and t[b] in _HEX:
        b += 1
    runs.hexa = at, b
    if a and (t[a - 1].isalnum() or t[a - 1] in "_-") or b < len(t) and (t[b].isalnum() or t[b] in "_-"):
        return None
    while b > a and (t[b - 1] == "." or t[b - 1] == ":" and t[b - 2 : b] != "::"):
        b -= 1
    if not 6 <= b - a <= 45 or DIGITS.isdisjoint(t[a:b]):
        return None
    try:
        IPv6Address(t[a:b])
    except AddressValueError:
        return None
    return a, b, "ipv6"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _groups(t: str, at: int, seps: str, most: int) -> list[tuple[int, int]]:
    """Bounds of digit groups from at on, one separator of seps apart."""
    found, n = [], len(t)
    while len(found) < most:
        b = at
        while b < n and t[b] in DIGITS:
            b += 1
        if b == at:
            break
        found.append((at, b))
        if b >= n or t[b] not in seps:
            break
        at = b + 1
    return found


def card(t: str, at: int) -> Find | None:
    if at and (t[at - 1].isalnum() or t[at - 1] in "+-."):
        return None
    found = _groups(t, at, " -", 5)
    for k in range(len(found), 0, -1):
        size = [b - a for a, b in found[:k]]
        if k == 1 and 13 <= size[0] <= 19 or size in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3]):
            b = found[k - 1][1]
            if (b == len(t) or not t[b].isalnum()) and luhn(digits := "".join(t[x:y] for x, y in found[:k])) and digits.strip("0"):
                return at, b, "card"
    return None


def ssn(t: str, at: int) -> Find | None:
    x = t[at : at + 11]
    if len(x) != 11 or x[3] != "-" or x[6] != "-" or not DIGITS.issuperset(x[:3] + x[4:6] + x[7:]):
        return None
    if at and (t[at - 1].isalnum() or t[at - 1] == "-") or at + 11 < len(t) and (t[at + 11].isalnum() or t[at + 11] == "-"):
        return None
    return None if x[:3] in ("000", "666") or x[0] == "9" or x[4:6] == "00" or x[7:] == "0000" else (at, at + 11, "ssn")


def phone(t: str, at: int) -> Find | None:
    """An international number from its plus sign, or a North American one of area code, exchange and line."""
    plus, n = t[at] == "+", len(t)
    if at and t[at - 1].isalnum():
        return None
    if not plus and at and t[at - 1] == "(":
        at -= 1
    count, b, end, sizes, inside = 0, at + plus, 0, [], 0
    most = 11 if plus and t[at + 1 : at + 2] == "1" else 15 if plus else 10
    while b < n:
        c = t[b]
        if c in DIGITS:
            a = b
            while b < n and t[b] in DIGITS:
                b += 1
            if count + b - a > most:
                break
            count, end = count + b - a, b
            sizes.append(b - a)
            if count == most:
                break
        elif c == "(" and not inside and count <= 3:
            inside, b = 1, b + 1
        elif c == ")" and inside == 1:
            inside, b = 2, b + 1
        elif c in " -." and b + 1 < n and (t[b + 1] in DIGITS or t[b + 1] == "(") or c == " " and inside == 2 and t[b - 1] == ")":
            b += 1
        else:
            break
    if inside == 1 or end == 0 or end < n and t[end].isalnum():
        return None
    if plus:
        return (at, end, "phone") if (count == 11 if most == 11 else 8 <= count <= 15) else None
    return (at, end, "phone") if sizes == [3, 3, 4] and (t[at] == "(" or t[at + 3] in "-.") else None


def iban(t: str, at: int) -> Find | None:
    """at: the first of the check digits, after the country's two letters."""
    a = at - 2
    if a < 0 or not (t[a:at].isascii() and t[a:at].isalpha() and t[a:at].isupper()) or a and t[a - 1].isalnum():
        return None
    b, n, value, ends = a, len(t), "", []
    while b < n and len(value) < 34:
        if t[b].isascii() and (t[b] in DIGITS or t[b].isupper()):
            value += t[b]
            b += 1
            if b == n or not t[b].isalnum():
                ends.append((b, value))
        elif t[b] == " " and len(value) % 4 == 0:
            b += 1
        else:
            break
    for b, value in reversed(ends):
        if 15 <= len(value) <= 34 and DIGITS.issuperset(value[2:4]) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return a, b, "iban"
    return None


def _after_cue(t: str, b: int, skip: tuple[str, ...] = ()) -> int:
    """Where a value begins after a cue: past spaces, given words, one of : = #, and an opening quote."""
    n = len(t)
    while b < n and t[b] == " ":
        b += 1
    for word in skip:
        if t[b : b + len(word)].lower() == word:
            b += len(word)
            break
    marked = 0
    while b < n and (t[b] == " " or t[b] in ":=#\"'" and marked < 4):
        marked += t[b] != " "
        b += 1
    return b


def secret(t: str, b: int, runs: Runs) -> Find | None:
    """b: the end of the cue, which an identifier may go on from, as in SECRET_KEY."""
    a = _after_cue(t, b)
    if not any(c in ":=" for c in t[b:a]):
        b = runs.name_end(t, b)
        if b == runs.tried:  # an earlier cue in the same identifier came to nothing
            return None
        runs.tried = b
        a = _after_cue(t, b)
        if not any(c in ":=" for c in t[b:a]):
            return None
    b, digit = runs.secret_end(t, a)
    while b > a and t[b - 1] == ".":
        b -= 1
    return (a, b, "secret") if b - a >= 8 and digit >= a else None


def account(t: str, b: int) -> Find | None:
    a = _after_cue(t, b, ("number", "num", "no.", "no", "nr", "id"))
    found = _groups(t, a, "-", 6)
    if a == b or not found:
        return None
    b = found[-1][1]
    return (a, b, "account") if 6 <= sum(y - x for x, y in found) <= 20 and (b == len(t) or not t[b].isalnum()) else None


def passport(t: str, b: int) -> Find | None:
    a = _after_cue(t, b, ("number", "no.", "no", "nr"))
    b = a
    while b < len(t) and b - a < 10 and t[b].isascii() and (t[b] in DIGITS or t[b].isupper()):
        b += 1
    value = t[a:b]
    return (a, b, "passport") if 6 <= len(value) <= 9 and sum(c in DIGITS for c in value) >= 5 and (b == len(t) or not t[b].isalnum()) else None


def parse(t: str, kind: str, at: int, end: int, runs: Runs) -> Find | None:
    """What an anchor of a kind from at to end expands to."""
    if kind == "digit":
        return ipv4(t, at) or ssn(t, at) or card(t, at) or phone(t, at) or iban(t, at)
    if kind == "@":
        return email(t, at)
    if kind == "://":
        return url(t, at, runs)
    if kind == "www":
        return www(t, at, runs)
    if kind == "+":
        return phone(t, at)
    if kind == ":":
        return ipv6(t, at, runs)
    if kind == "secret":
        return secret(t, end, runs)
    return account(t, end) if kind == "account" else passport(t, end)


def find(t: str) -> list[Find]:
    """All finds of a text in order, none overlapping another."""
    found: list[Find] = []
    runs = Runs()
    done = run = 0
    for last, (kind, size) in automaton().iter(t.lower() if t.isascii() else t.translate(_LOWER)):
        at = last - size + 1
        if at < done:
            continue
        if kind == "digit":  # a number begins with the first digit of a run
            if at < run:
                continue
            run = at + 1
            while run < len(t) and t[run] in DIGITS:
                run += 1
        if got := parse(t, kind, at, last + 1, runs):
            while found and got[0] < found[-1][1]:  # only kinds that expand to the left reach back
                found.pop()
            found.append(got)
            done = got[1]
    return found


def _rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out: tuple[list, ...] = ([], [], [], [], [])
    for doc, text in zip(batch.column(0), batch.column(1), strict=True):
        t = text.as_py()
        if t:
            for a, b, kind in find(t):
                for column, value in zip(out, (doc.as_py(), kind, a, b, t[a:b]), strict=True):
                    column.append(value)
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "kind", "start", "end", "value"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value) of every find."""
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    return map_batches(rows, _rows, "doc_id long, kind string, start int, end int, value string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
