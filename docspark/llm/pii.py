"""PII: format-preserving pseudonyms by a keyed Feistel network.

Validated values are replaced within their own format: e-mail addresses (letters and digits of the
local part, of any script and length), IPv4 addresses, North American phone numbers (with or without
separators), social security numbers, card numbers of 13 to 19 digits that pass the Luhn check (as do
their pseudonyms), IBANs (with right check digits) and calendar dates from 1900 to 2099. Each kind has
its own permutation of its own domain: a Feistel network over the bits of the value, walked until the
value lies in the domain. So equal values have equal pseudonyms in all documents, different values
different ones, and whoever has the key can invert them. A value is what is meant, not how it is
written: one day has one pseudonym in every form of date, one phone number or card in every spacing.

Defined cases: a null text stays null with no findings, an empty one empty; texts of any length are read
whole, in time that grows with their length. An empty table gives no rows. Candidates that fail their check
(an octet over 255, an impossible date, a wrong check digit) stay as they are, and so do local parts
without a letter or digit that could be exchanged; neither is counted. Dates with day and month in doubt
count as day first. A card number or IBAN may stand
beside other digits or words: each start is tried with every end at the edge of a group, and the longest
that passes its check counts; after a failed check the search goes on right behind the start. Other columns, ties and repeated rows pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm._common import fresh

DEFAULT_KEY = "docspark example key"
ROUNDS, PIECE = 8, 32
#: The alphabets within which a character of a local part is replaced.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "àáâäçèéêëíîïñóôöùúûüß"]
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days

NUMBERS = re.compile(
    r"(?<!\w)(?<!\d[.+-])(?:"
    r"(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?\d)"
    r"|(?P<ymd>\d{4}([-/.])\d{1,2}\3\d{1,2})(?!\d)"
    r"|(?P<dmy>\d{1,2}([-/.])\d{1,2}\5\d{4})(?!\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![-\d])"
    r"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?[2-9]\d{9})(?!\d)"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?!\d)"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r")"
)
#: The kinds with several ends, for a start whose first kind or first end fails its check.
ENDS = {"card": re.compile(r"\d(?:[ -]?\d){12,18}"), "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")}
LONGEST = 48
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """The image of ``x`` under the keyed permutation of range(size)."""
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    a, b = bits // 2, bits - bits // 2
    low = (1 << b) - 1

    def mix(k: int, half: int, width: int) -> int:
        h = blake2b(f"{tweak}|{size}|{k}|{half}".encode(), key=key[:64], digest_size=32).digest()
        return int.from_bytes(h, "big") % (1 << width)

    while True:
        left, right = x >> b, x & low
        for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):  # the halves keep their widths
            if k % 2:
                right ^= mix(k, left, b)
            else:
                left ^= mix(k, right, a)
        x = left << b | right
        if x < size:
            return x


def _digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _luhn(digits: str) -> int:
    """The check digit behind ``digits``."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


Permute = Callable[[int, int, str], int]


def _ip(text: str, p: Permute) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(str(x) != y for x, y in zip(parts, text.split("."), strict=True)):
        return None
    x = p(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(text: str, p: Permute) -> str | None:
    parts = re.split("[-/.]", text)
    year_first = len(parts[0]) == 4
    a, m, b = map(int, parts)
    orders = [(a, m, b)] if year_first else [(b, m, a), (b, a, m)]
    for k, ymd in enumerate(orders):
        try:
            day = date(*ymd)
        except ValueError:
            continue
        n = (day - FIRST_DAY).days
        if not 0 <= n < DAYS:
            return None
        # Days to the 12th stay such days, and later ones later, so that a pseudonym is read in the order of
        # day and month in which its date was, and every form of a date has the same one.
        while True:
            n = p(n, DAYS, "date")
            new = FIRST_DAY + timedelta(days=n)
            if (new.day > 12) == (day.day > 12):
                break
        width = 1 if min(map(len, parts)) == 1 else 2
        x, y = (f"{v:0{width}d}" for v in ((new.month, new.day) if year_first or k else (new.day, new.month)))
        return _separated([f"{new.year}", x, y] if year_first else [x, y, f"{new.year}"], text)
    return None


def _separated(parts: list[str], like: str) -> str:
    sep = next(c for c in like if not c.isdigit())
    return sep.join(parts)


def _ssn(text: str, p: Permute) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, p: Permute) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    head, own = digits[:-10], digits[-10:]
    # A number that could be dialled becomes another one: its area and exchange begin with 2 to 9, neither ends in 11.
    plain = lambda d: d[0] >= "2" and d[3] >= "2" and "11" not in (d[1:3], d[4:6])
    if len(text) == len(digits) and not plain(own):
        return None
    new = own
    while True:
        new = f"{p(int(new), 10**10, 'phone'):010d}"
        if plain(new) == plain(own):
            return _digits(text, head + new)


def _card(text: str, p: Permute) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if int(digits[-1]) != _luhn(digits[:-1]):
        return None
    n = len(digits) - 1
    body = f"{p(int(digits[:-1]), 10**n, 'card'):0{n}d}"
    return _digits(text, body + str(_luhn(body)))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(text: str, p: Permute) -> str | None:
    plain = text.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != _iban_check(country, body):
        return None
    body = _by_alphabet(body, p, f"iban{country}") or body
    out = iter(f"{country}{_iban_check(country, body):02d}{body}")
    return "".join(c if c == " " else next(out) for c in text)


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters that may stand for ``c``: of its fixed alphabet, else the letters or digits of its kind among
    the 128 code points around it; empty for all other characters."""
    for a in ALPHABETS:
        if c in a:
            return a
    if category(c) not in ("Ll", "Lu", "Lo", "Nd"):
        return ""
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(max(first, 128), first + 128)) if category(x) == category(c) and not any(x in a for a in ALPHABETS))


def _by_alphabet(text: str, p: Permute, tweak: str) -> str | None:
    """Each character stays in its alphabet; characters of no alphabet stay. None if all do.

    A long text goes in pieces of PIECE characters, each permuted under what stands before it.
    """
    out, changed = [], False
    for lo in range(0, len(text), PIECE):
        piece = text[lo : lo + PIECE]
        kinds = [_alphabet(c) for c in piece]
        x, size = 0, 1
        for c, a in zip(piece, kinds, strict=True):
            if a:
                x, size = x * len(a) + a.index(c), size * len(a)
        if size > 1:
            shape = "".join(f"<{a[0]}>" if a else c for c, a in zip(piece, kinds, strict=True))
            before = blake2b(text[:lo].encode(), digest_size=16).hexdigest() if lo else ""
            x, changed = p(x, size, f"{tweak}{shape}{before}"), True
        new = []
        for c, a in zip(reversed(piece), reversed(kinds), strict=True):
            if a:
                x, d = divmod(x, len(a))
                c = a[d]
            new.append(c)
        out += reversed(new)
    return "".join(out) if changed else None


VALUES: dict[str, Callable[[str, Permute], str | None]] = {"ip": _ip, "ymd": _date, "dmy": _date, "ssn": _ssn, "phone": _phone, "card": _card, "iban": _iban}


def _locals(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the local parts of e-mail addresses, each read once from its @ backwards."""
    at, last = text.find("@"), 0
    while at >= 0:
        a = at
        while a > last and (text[a - 1].isalnum() or text[a - 1] in "_%+.-'"):
            a -= 1
        while a < at and text[a] in ".-'":
            a += 1
        if a < at and text[at - 1] != "." and DOMAIN.match(text, at + 1):
            yield a, at
        last, at = at + 1, text.find("@", at + 1)


def _spans(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """(kind, end) to try for the start of ``m``, longest first: the kind it matched, and cards and IBANs."""
    a = m.start()
    out = [] if m.lastgroup in ENDS else [(m.lastgroup, m.end())]
    for kind, shape in ENDS.items():
        if shape.match(text, a):
            out += [(kind, b) for b in range(min(len(text), a + LONGEST), a + 12, -1) if text[b - 1].isalnum() and not text[b : b + 1].isalnum() and shape.fullmatch(text, a, b)]
    yield from sorted(out, key=lambda x: -x[1])


def pseudonymize(text: str, key: bytes, found: list | None = None) -> str:
    """``text`` with pseudonyms; ``found`` gets (kind, start, end) of each value replaced, by the input's positions."""

    def p(x: int, size: int, tweak: str) -> int:
        return permute(x, size, key, tweak)

    edits: list[tuple[int, int, str]] = []
    for a, b in _locals(text):
        new = _by_alphabet(text[a:b], p, "mail")
        if new is not None:
            edits.append((a, b, new))
            if found is not None:
                found.append(("email", a, b))
    taken, at = [(a, b) for a, b, _ in edits], 0
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k < 0 or taken[k][1] <= a

    while m := NUMBERS.search(text, at):
        a, at = m.start(), m.start() + 1
        for kind, b in _spans(text, m):
            new = VALUES[kind](text[a:b], p) if free(a, b) else None
            if new is not None:
                edits.append((a, b, new))
                if found is not None:
                    found.append((kind, a, b))
                at = b
                break
    out, at = [], 0
    for a, b, new in sorted(edits):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _udf(key: str):
    secret = key.encode()

    @F.arrow_udf("struct<text:string,n_values:int,kinds:array<string>>")
    def run(text: pa.Array) -> pa.Array:
        texts, counts, kinds = [], [], []
        for t in text.to_pylist():
            found: list = []
            texts.append(None if t is None else pseudonymize(t, secret, found))
            counts.append(len(found))
            kinds.append(sorted({k for k, _, _ in found}))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=["text", "n_values", "kinds"])

    return run


def pseudonymize_table(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text column; all other columns as they are."""
    (p,) = fresh(docs, "pseudonymized")
    out = docs.withColumn(p, _udf(key)(F.col(text_col)))
    return out.select(*(F.col(f"{p}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op10(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(doc_id, text with pseudonyms, n_values replaced, kinds) for each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _udf(key)(F.col("text")).alias("p")).select("doc_id", "p.text", "p.n_values", "p.kinds")
