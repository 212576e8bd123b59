"""PII (operator 9): format-preserving Feistel pseudonyms.

Validated values are permuted within their own format by a keyed Feistel network (8 rounds of
keyed BLAKE2b in counter mode, cycle-walking back into the domain), so that equal values get equal
pseudonyms in every document and no table of values is kept: no shuffle, no state, recomputed
alike anywhere. The key is a parameter; the query takes it from spark.tessera.pii.key.

Formats: payment cards (13 to 19 digits with a right check digit, which stays right), IBANs (right check
digits, which stay right), IPv4 addresses, calendar dates (the day number from 1900 to 2099, one
pseudonym in any notation), US social security numbers (with hyphens; after their name also with
spaces or plain), phone numbers (a plus sign, an area code in parentheses, or groups of 3, 3 and 4;
10 to 15 digits; the country's code stays), the local part of e-mail addresses, and hexadecimal
secrets after token, key, secret or password. Separators, signs and case stay as they were. A day
or month written without a leading zero is written without one again, so 5/3/2020 may become 19/6/1988:
equal dates stay linked across notations, which a fixed width would not allow.

Defined cases: a null text stays null with 0 found; texts and values of any length are read whole
(the local part of an address is permuted in pieces of PIECE characters, all others as one number);
a value that fails its validation is no value, but a shorter or later one in the same place may be;
overlapping values go to the format listed first, and later ones are searched in the stretches
left; a date that reads both ways is taken as day before month; repeated rows come out alike; an
empty table stays empty; all columns stay, but a column named n_pii is replaced by the count of
pseudonyms.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import buffers

KEY_NAME, NO_KEY = "spark.tessera.pii.key", "not a secret: for tests only"
ROUNDS = 8
PIECE = 256  # characters of a spelled value permuted as one number
DIGEST = 64
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def stream(data: bytes, size: int, key: bytes, person: bytes) -> int:
    """`size` keyed bytes: one digest up to DIGEST bytes, beyond that digests of the first one and a counter."""
    first = blake2b(data, digest_size=min(DIGEST, max(8, size)), key=key[:64], person=person).digest()
    if size > DIGEST:
        first = b"".join(blake2b(first + i.to_bytes(8, "big"), digest_size=DIGEST, key=key[:64], person=person).digest() for i in range(-(-size // DIGEST)))
    return int.from_bytes(first, "big")


def feistel(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (stream(right.to_bytes(width, "big"), width, key, f"{r}{tweak}".encode()[:16]) & mask)
        x = left << half | right
        if x < size:
            return x


def walk(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool]) -> int:
    """The permutation, repeated until it meets a valid value again: a permutation of the valid ones."""
    while True:
        x = feistel(x, size, key, tweak)
        if valid(x):
            return x


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn(body: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(body)))
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    same = int("1" * n)
    body = str(walk(int(digits[:-1]), 10**n, key, f"card{n}", lambda x: x % same != 0 or x > 9 * same)).zfill(n)
    return refill(text, body + luhn(body))


def date(text: str, key: bytes) -> str | None:
    a, b, c = re.findall(r"\d+", text)
    orders = [(0, 1, 2)] if len(a) == 4 else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        y, m, d = ((a, b, c)[i] for i in order)
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue
        if not FIRST <= day <= LAST:
            return None
        new = datetime.date.fromordinal(FIRST + feistel(day - FIRST, LAST - FIRST + 1, key, "date"))
        width = 1 if len(m) == 1 or len(d) == 1 else 2
        fields = [""] * 3
        for place, value, digits in zip(order, (new.year, new.month, new.day), (4, width, width), strict=True):
            fields[place] = str(value).zfill(digits)
        return re.sub(r"\d+", "{}", text).format(*fields)
    return None


# Country calling codes of one and of two digits; all others have three.
CALLING_1 = ["1", "7"]
CALLING_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    keep = 0
    if text.startswith("+"):
        keep = 1 if digits[:1] in CALLING_1 else 2 if digits[:2] in CALLING_2 else 3
    if not 10 <= len(digits) <= 15:
        return None
    n = len(digits) - keep
    return refill(text, digits[:keep] + str(feistel(int(digits[keep:]), 10**n, key, f"phone{n}")).zfill(n))


def checked97(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return str(98 - number % 97).zfill(2)


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if checked97(country, body) != check:
        return None
    n = sum(c.isdigit() for c in body)
    digits = "".join(c for c in body if c.isdigit())
    body = refill(body, str(feistel(int(digits), 10**n, key, f"iban{n}")).zfill(n)) if n else body
    it = iter(country + checked97(country, body) + body)
    return "".join(c if c == " " else next(it) for c in text)


def ssn(text: str, key: bytes) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    lead, value = re.fullmatch(r"(?s)(.*?)([0-9][0-9 -]*)", text).groups()
    x = int(re.sub(r"\D", "", value))
    return lead + refill(value, str(walk(x, 10**9, key, "ssn", valid)).zfill(9)) if valid(x) else None


def address(text: str, key: bytes) -> str | None:
    octets = [int(o) for o in text.split(".")]
    if max(octets) > 255:
        return None
    x = feistel(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
    return ".".join(str(o) for o in x.to_bytes(4, "big"))


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def spelled(text: str, key: bytes, tweak: str) -> str:
    """Permutes letters within letters (a value and its capitals stay linked) and digits within digits."""
    x, size = 0, 1
    kinds = [LOWER if c.lower() in LOWER else DIGITS if c in DIGITS else "" for c in text]
    for c, kind in zip(text.lower(), kinds, strict=True):
        if kind:
            x, size = x * len(kind) + kind.index(c), size * len(kind)
    x = feistel(x, size, key, f"{tweak}{size % 99991}")
    out = []
    for c, kind in zip(reversed(text), reversed(kinds), strict=True):
        if kind:
            x, i = divmod(x, len(kind))
            c = kind[i].upper() if c.isupper() else kind[i]
        out.append(c)
    return "".join(reversed(out))


def mail(text: str, key: bytes) -> str | None:
    local, _, domain = text.rpartition("@")
    new = "".join(spelled(local[i : i + PIECE], key, f"mail{i or ''}") for i in range(0, len(local), PIECE))
    return f"{new}@{domain}" if any(c.lower() in LOWER or c in DIGITS for c in local) else None


def secret(text: str, key: bytes) -> str | None:
    lead, value = re.fullmatch(r"(?s)(.*?)([0-9a-fA-F]+)", text).groups()
    n = len(value)
    new = f"{feistel(int(value, 16), 16**n, key, f'hex{n}'):0{n}x}"
    return lead + (new.upper() if value.isupper() else new)


#: In the order in which a place is tried; all on ASCII digits. The third is what must follow.
FORMATS: list[tuple[str, str, str, Callable[[str, bytes], str | None]]] = [
    ("mail", r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "", mail),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"\b", iban),
    ("card", r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}", r"(?![\w-])", card),
    ("address", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"(?!\w|\.[0-9])", address),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})", r"(?![\w/-])", date),
    ("ssn", r"(?:(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}|(?i:\b(?:ssn|social security(?: number| no\.?)?)\b)\s*[:=#]?\s*[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4})", r"(?![\w-])", ssn),
    ("phone", r"(?:(?<![\w.+/-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}|(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)(?:[ .-]?[0-9]{2,4}){1,4}|(?<![\w.+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5})", r"(?![\w-])", phone),
    ("secret", r"(?i:\b(?:token|key|secret|password)\b)\s*[:=]\s*[\"']?[0-9a-fA-F]{16,}", r"(?![0-9a-zA-Z])", secret),
]
#: Formats whose validation may fail for what a match holds beyond the value.
LOOSE = {"iban", "card", "phone"}


def pseudonymiser(key: bytes) -> Callable[[str], tuple[str, int]]:
    compiled = [(name, re.compile(body + tail), re.compile(body), re.compile(tail), lru_cache(100_000)(lambda t, f=f: f(t, key))) for name, body, tail, f in FORMATS]

    def values(text: str, name: str, whole: re.Pattern, body: re.Pattern, tail: re.Pattern, f: Callable[[str], str | None]) -> Iterator[tuple[int, int, str]]:
        at = 0
        while m := whole.search(text, at):
            start, end = m.span()
            at = start + 1
            for e in range(end, start, -1) if name in LOOSE else (end,):
                if (e == end or (tail.match(text, e) and body.fullmatch(text, start, e))) and (new := f(text[start:e])) is not None:
                    yield start, e, new
                    at = e
                    break

    def run(text: str) -> tuple[str, int]:
        taken: list[tuple[int, int, str]] = []
        for name, *patterns, f in compiled:
            if name == "mail" and "@" not in text:
                continue
            free = zip([0, *(b for _, b, _ in taken)], [*(a for a, _, _ in taken), len(text)], strict=True)
            found = [(a + start, a + end, new) for a, b in free for start, end, new in values(text[a:b], name, *patterns, f)]
            if found:
                taken = sorted(taken + found)
        if not taken:
            return text, 0
        out, at = [], 0
        for a, b, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), len(taken)

    return run


LEADS = ("token", "key", "secret", "password")


def led(text: str) -> bool:
    """Whether a secret's lead word may be in the text."""
    low = text.lower()
    return any(w in low for w in LEADS)


def rewritten(key: bytes, column: int, schema: T.StructType, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pseudonymiser(key)
        for whole in batches:
            for batch in common.slices(whole, column):
                texts = batch.column(column)
                raw, off = buffers(texts)
                marked = np.flatnonzero((raw >= 48) & (raw <= 57) | (raw == 64))
                some = np.diff(np.searchsorted(marked, off)) > 0
                counts, values, changed = np.zeros(len(texts), np.int32), texts.to_pylist(), False
                for r, text in enumerate(values):
                    # Every value has a digit or an at sign, or is a secret of letters alone after its lead word.
                    if text and (some[r] or led(text)):
                        new, n = one(text)
                        if n:
                            values[r], counts[r], changed = new, n, True
                if changed:
                    texts = pa.array(values, texts.type)
                columns = [texts if i == column else batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(counts)] if counted else [])], names=[f.name for f in schema])

    return common.releasing(run)


def with_string_text(docs: DataFrame) -> DataFrame:
    return common.small_batches(docs).select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns, with the text's personal values permuted under the key."""
    docs = with_string_text(docs)
    return docs.mapInArrow(rewritten(key, docs.columns.index("text"), docs.schema, False), docs.schema)


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """The same with n_pii, the count of values."""
    docs = with_string_text(docs.drop("n_pii"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_pii", T.IntegerType())])
    return docs.mapInArrow(rewritten(key, docs.columns.index("text"), schema, True), schema)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names; without one a fixed key that protects nothing."""
    return spark.conf.get(KEY_NAME, NO_KEY).encode()


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(common.table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
