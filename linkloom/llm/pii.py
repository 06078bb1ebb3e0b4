"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted, under a key, within their own format by a Feistel network;
equal values get equal pseudonyms in every document, so links survive, and the mapping can be
undone with the key only.  What is kept of each kind:

* card (13 to 19 digits that pass Luhn's test, unparted, or parted by single spaces or hyphens as 4-4-4-n or 4-6-n):
  length, separators and a valid check digit;
* iban (country, valid check digits): country, length, character classes, valid check digits;
* ssn (ddd-dd-dddd within the issued ranges): the form, and the issued ranges;
* phone (an area code with its number, or an international form, of 10 to 15 digits): everything but the digits, and the country code;
* ip (four numbers up to 255, or an IPv6 address, whole or with :: for zeros and two groups or more, one with a digit): the form; pseudonyms are valid addresses;
* date (a day that exists, years 1900 to 2099, as y-m-d, d.m.y, d/m/y or m/d/y): the form; pseudonyms exist;
* email: letters and digits of the local part keep their class; the domain stays.

What fails its kind's test stays as it is.

Defined cases: a null text stays null and has no span; an empty text stays; repeated rows are each treated;
values that differ in their digits differ in their pseudonyms, within a kind and length; without a key nothing runs; a document id and
other columns are never changed.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tokens import map_texts

KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")


@dataclass(frozen=True)
class Pseudonyms:
    """key: the deployment's own secret; who has it can undo the pseudonyms."""

    key: bytes
    rounds: int = 10

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("pseudonyms need a key")


KEY_SETTING = "spark.linkloom.pii.key"


_made: dict[str, bytes] = {}


def from_session(spark: SparkSession, make: bool = False) -> Pseudonyms:
    """The key in the session's setting; an error without one, or, if asked for, a random secret that the application's later calls share.

    With such a secret equal values are linked within the application's results and nobody can undo it; set the key to link those of several.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key and not make:
        raise ValueError(f"set {KEY_SETTING} to the deployment's secret")
    return Pseudonyms(key.encode() if key else _made.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32)))


def feistel(value: int, size: int, tweak: str, p: Pseudonyms, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced-as-can-be Feistel network over a * b >= size, walked until it falls in range."""
    if size < 2:
        return value
    a = max(1, int(size**0.5))
    while a * a < size:
        a += 1
    b = -(-size // a)
    label = f"{tweak}:{size}".encode()

    def f(k: int, x: int) -> int:
        h = hashlib.blake2b(b"%d:%d:" % (k, x) + label, key=p.key[:64], digest_size=16)
        return int.from_bytes(h.digest(), "big")

    while True:
        left, right = divmod(value, b)
        for k in reversed(range(p.rounds)) if back else range(p.rounds):
            shift = -1 if back else 1
            if k % 2:
                right = (right + shift * f(k, left)) % b
            else:
                left = (left + shift * f(k, right)) % a
        value = left * b + right
        if value < size:
            return value


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _permute_digits(digits: str, tweak: str, p: Pseudonyms, back: bool) -> str:
    """A permutation of the digit strings of one length, which keeps a leading 0 or its absence."""
    if not digits:
        return digits
    n = len(digits)
    if digits[0] == "0":
        return "0" + (str(feistel(int(digits[1:]), 10 ** (n - 1), tweak + "0", p, back)).zfill(n - 1) if n > 1 else "")
    low = 10 ** (n - 1)
    return str(low + feistel(int(digits) - low, 9 * low, tweak, p, back))


def _card(m: str, p: Pseudonyms, back: bool) -> str | None:
    d = _digits(m)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or not luhn(d):
        return None
    body = _permute_digits(d[:-1], "card", p, back)
    return _refill(m, body + luhn_digit(body))


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(m: str, p: Pseudonyms, back: bool) -> str | None:
    """A number that is followed by a word in capitals is found without it."""
    flat = m.replace(" ", "")
    if " " in m and (not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]):
        head, _, last = m.rpartition(" ")
        short = _iban(head, p, back) if len(last) < 4 else None
        return None if short is None else f"{short} {last}"
    if not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    body = _by_class(flat[4:], "iban", p, back)
    out = iter(flat[:2] + _iban_check(flat[:2], body) + body)
    return "".join(c if c == " " else next(out) for c in m)


def _by_class(text: str, tweak: str, p: Pseudonyms, back: bool) -> str:
    """ASCII letters and digits permuted together, each within its class; other characters stay."""
    classes = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = [next((c for c in classes if x in c), None) for x in text]
    value, size = 0, 1
    for x, c in zip(text, of):
        if c:
            value, size = value * len(c) + c.index(x), size * len(c)
    value = feistel(value, size, tweak + "".join("dlu"[classes.index(c)] if c else x for x, c in zip(text, of)), p, back)
    out = []
    for x, c in zip(reversed(text), reversed(of)):
        if c:
            value, k = divmod(value, len(c))
            x = c[k]
        out.append(x)
    return "".join(reversed(out))


def _ssn(m: str, p: Pseudonyms, back: bool) -> str | None:
    area, group, serial = map(int, m.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898
    at = area - 1 - (area > 666)
    v = feistel((at * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999, "ssn", p, back)
    v, serial = divmod(v, 9999)
    at, group = divmod(v, 99)
    area = at + 1 + (at >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: str, p: Pseudonyms, back: bool) -> str | None:
    d = _digits(m)
    if not 10 <= len(d) <= 15:
        return None
    lead = re.match(r"\+(\d{1,3})(?=[ .(-])", m)
    keep = len(lead[1]) if lead else (1 if m.startswith("+") else 0)
    rest = d[keep:]
    return _refill(m, d[:keep] + str(feistel(int(rest), 10 ** len(rest), f"phone{d[:keep]}", p, back)).zfill(len(rest)))


def _ip(m: str, p: Pseudonyms, back: bool) -> str | None:
    try:
        a = ipaddress.ip_address(m)
    except ValueError:
        return None
    size = 1 << a.max_prefixlen
    v = feistel(int(a), size, f"ip{a.version}", p, back)
    if a.version == 4:
        return str(ipaddress.IPv4Address(v))
    if "::" in m:  # the groups that are written are permuted together
        before, after = (x.split(":") if x else [] for x in m.split("::"))
        k = len(before) + len(after)
        if k < 2 or not re.search(r"\d", m):
            return None
        v = feistel(int("".join(g.zfill(4) for g in before + after), 16), 1 << 16 * k, f"ip6:{len(before)}", p, back)
        new = [f"{v >> 16 * (k - 1 - i) & 0xFFFF:x}" for i in range(k)]
        return ":".join(new[: len(before)]) + "::" + ":".join(new[len(before) :])
    wide = all(len(g) == 4 for g in m.split(":"))
    return ":".join(g if wide else f"{int(g, 16):x}" for g in ipaddress.IPv6Address(v).exploded.split(":"))


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _date(m: str, p: Pseudonyms, back: bool) -> str | None:
    parts = re.fullmatch(r"(\d{1,4})([-./])(\d{1,2})\2(\d{1,4})", m)
    if not parts:
        return None
    x, y, z = parts[1], parts[3], parts[4]
    forms = ["ymd"] if len(x) == 4 else ["dmy", "mdy"] if len(z) == 4 else []
    for form in forms:
        v = dict(zip(form, (x, y, z)))
        try:
            day = datetime.date(int(v["y"]), int(v["m"]), int(v["d"]))
        except ValueError:
            continue
        if not 1900 <= day.year < 2100:
            continue
        # Days that read as one form must not come back as the other: d.m.y is permuted among days above 12 and among the others apart.
        late = day.day > 12
        group = None if form == "ymd" else late
        days = _days(group)
        new = days[feistel(_index(group)[day], len(days), f"date{form if late or form == 'ymd' else 'dmy'}", p, back)]
        wide = len(v["d"]) == 2 and len(v["m"]) == 2
        w = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide or len(v["m"]) == 2 else str(new.month), "d": f"{new.day:02d}" if wide or len(v["d"]) == 2 else str(new.day)}
        return parts[2].join(w[k] for k in form)
    return None


@lru_cache(None)
def _days(late: bool | None) -> list[datetime.date]:
    every = [_FIRST + datetime.timedelta(i) for i in range(_DAYS)]
    return every if late is None else [d for d in every if (d.day > 12) == late]


@lru_cache(None)
def _index(late: bool | None) -> dict[datetime.date, int]:
    return {d: i for i, d in enumerate(_days(late))}


def _email(m: str, p: Pseudonyms, back: bool) -> str | None:
    local, _, domain = m.rpartition("@")
    return f"{_by_class(local, 'email', p, back)}@{domain}"


FIND: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{3,5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|\+[0-9]{10,15})(?![0-9A-Za-z])",
}
MAP: dict[str, Callable[[str, Pseudonyms, bool], str | None]] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
_COMPILED = {k: re.compile(v, re.A) for k, v in FIND.items()}
# Every pattern's match holds a digit or an @; texts are first cut to what lies around those.
_SEED = re.compile(r"[0-9@]")


def replacements(text: str, p: Pseudonyms, back: bool = False, memo: dict | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, replacement) of the personal data in a text, without overlaps; earlier kinds go first."""
    if not _SEED.search(text):
        return []
    memo = {} if memo is None else memo
    digits = any(c in text for c in "0123456789")
    taken: list[tuple[int, int, str, str]] = []
    left = text  # with a mark for each character that an earlier kind took
    for kind in KINDS:
        if not ("@" in text if kind == "email" else digits):
            continue
        own = []
        at = 0
        while m := _COMPILED[kind].search(left, at):
            value = (kind, m[0])
            if value not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[value] = MAP[kind](m[0], p, back)
            at = m.end() if memo[value] is not None else m.start() + 1  # a match that fails may hide a true one
            if memo[value] is not None:
                own.append((m.start(), m.end(), kind, memo[value]))
        if own:
            parts, at = [], 0
            for start, end, *_ in own:
                parts += [left[at:start], "\uffff" * (end - start)]
                at = end
            left = "".join([*parts, left[at:]])
            taken += own
    return sorted(taken)


def pseudonymise(text: str, p: Pseudonyms, back: bool = False, memo: dict | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    found = replacements(text, p, back, memo)
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]) if found else text, found


def with_pseudonyms(docs: DataFrame, p: Pseudonyms, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with its text pseudonymised, and a column of what was found: spans of the given text and their kinds."""
    names = docs.columns
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    memo: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = batch.column(text).cast(pa.large_string())
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        seeded = pc.fill_null(pc.match_substring_regex(given, _SEED.pattern), False)  # only these become Python strings
        at = np.flatnonzero(seeded.to_numpy(zero_copy_only=False))
        texts = []
        for k, t in zip(at, given.take(pa.array(at)).to_pylist()):
            new, found = pseudonymise(t, p, False, memo)
            texts.append(new)
            spans[k] = [{"start": s, "end": e, "kind": kind} for s, e, kind, _ in found]
        new = pc.replace_with_mask(given, seeded, pa.array(texts, pa.large_string())).cast(pa.string())
        columns = [new if n == text else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], names=[*names, out])

    return map_texts(docs, run, f"{head}, `{out}` array<struct<start:int,end:int,kind:string>>", text)


def pii_report(docs: DataFrame, p: Pseudonyms) -> DataFrame:
    """doc_id, text (pseudonymised), n_found, spans as kind:start:end by start, and the count of each kind."""
    x = with_pseudonyms(docs.select("doc_id", "text"), p)
    n = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return x.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), listed.alias("spans"), *[n(k) for k in KINDS])


def mask_documents(docs: DataFrame, p: Pseudonyms) -> DataFrame:
    """docs, with pseudonyms in its texts."""
    columns = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    done = with_pseudonyms(plain, p, f"_{columns.index('text')}", "_pii")
    return done.select(*plain.columns).toDF(*columns)
