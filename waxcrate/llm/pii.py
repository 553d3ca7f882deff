"""Format-preserving pseudonyms for personal data.

Each value found is validated (check digits, octets, calendar), then permuted under a key within its own format by a Feistel
network over its digits or letters, walking on until the result is valid too. Being permutations, they keep different values
apart and give equal values equal pseudonyms, in all documents and in all spellings of one value. The key is a parameter without a
default: who holds it can undo them.

Formats: e-mail addresses (the local part, without regard to case; the domain stays), 13 to 19-digit card numbers with a valid check
digit (the pseudonym has one too), phone numbers (the country code stays; with or without blanks and brackets a number has one
pseudonym, and North American ones also without their country code), IPv4 and IPv6 addresses, IBANs (country and form stay, check
digits fit), dates (ISO, or with / and the year last; the years 1900 to 2099 are permuted as days, those up to the 12th and
those after it each among themselves: so a date is the same day in every form, and one written day first stays apart from those
written month first), US social security numbers, access keys of the form AKIA and 16 letters or digits, values of password= and the like in
any case, also at the end of compound names (a quoted value up to its closing quote; after a colon, a plain word counts only where the name begins a line or an entry,
and never for secret and token, so prose stays), and quoted runs of 40 hex digits of either case (which stays).
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("email", "card", "phone", "ipv4", "date", "ssn", "access_key", "password", "hex_secret", "ipv6", "iban")
ROUNDS = 8
#: Part of every permutation: pseudonyms of another version are others, under the same key too.
VERSION = 3
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Country codes of telephone numbers with one and with two digits; all others have three (fixed values).
_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
#: A name ends with one of these words; anything may stand before it in a compound name, as in DB_PASSWORD or userToken.
_SECRET_NAME = r"(?=[PSTApsta\u017f])(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)(?:[_-]?(?:access[_-]?)?(?:key|token))?)[\"']?\s?"
_PLAIN_NAME = r"(?m:^\s*|[{,;(]\s*)[\"']?[\w.-]*(?i:password|passwd|pwd|(?:api|access|private)[_-]?key)[\"']?\s?"
_SECRET = rf"(?P<password>{_SECRET_NAME}[=:]\s?(?![\"'][0-9A-Fa-f]{{40}}[\"']))(?:(?P<quote>[\"'])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n]){{6,}})(?P=quote)|[\"']?(?P<secret>[^\s\"',;]{{6,}}))"
#: No value but a named secret begins inside a word; saying so once, first, spares trying each form there.
_OTHERS = (
    r"(?<!\w)(?:(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<access_key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?P<hex_secret>(?<=[\"'])[0-9A-Fa-f]{40}(?=[\"']))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?!\w))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])[2-9]\d\d(?P<dash>[.-])\d{3}(?P=dash)\d{4}(?![\w-]|\.\d))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\w/-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<space>[ -])\d{6}(?P=space)\d{5})(?![\w-])))"
)
#: Texts without a named secret are searched without its form, which is tried at every character.
_FOUND, _UNNAMED = re.compile(f"{_SECRET}|{_OTHERS}"), re.compile(_OTHERS)
#: Where a text has none of these, it holds no value: cheap searches first.
_MARK, _NAMED, _QUOTED = re.compile("[0-9@=]"), re.compile(f"{_SECRET_NAME}[=:]"), re.compile("[\"'][A-Fa-f]{40}[\"']")
_PLAIN = re.compile(rf"{_PLAIN_NAME}:\s?\Z")


def may_hold(text: str) -> bool:
    """False only where text holds no value of any kind."""
    return bool(_MARK.search(text) or names_secret(text) or _QUOTED.search(text))


def names_secret(text: str) -> bool:
    return ("=" in text or ":" in text) and bool(_NAMED.search(text))


class Permutation:
    """Keyed permutations of numbers below a bound and of strings over an alphabet."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _part(self, tweak: str, at: int, value: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{VERSION}|{tweak}|{at}|{value}".encode(), key=self.key, digest_size=32).digest(), "big")

    def number(self, value: int, bound: int, tweak: str) -> int:
        """Another number below bound: rounds over its two halves a * n + b, and on until it is below bound."""
        n = math.isqrt(bound - 1) + 1
        while True:
            a, b = divmod(value, n)
            for r in range(0, ROUNDS, 2):
                a = (a + self._part(tweak, r, b)) % n
                b = (b + self._part(tweak, r + 1, a)) % n
            value = a * n + b
            if value < bound:
                return value

    def text(self, value: str, alphabet: str, tweak: str) -> str:
        """Another string of as many characters of the alphabet."""
        size, number = len(alphabet), 0
        for c in value:
            number = number * size + alphabet.index(c)
        number = self.number(number, size ** len(value), f"{tweak}|{size}|{len(value)}") if value else 0
        out = []
        for _ in value:
            number, i = divmod(number, size)
            out.append(alphabet[i])
        return "".join(reversed(out))

    def shape(self, value: str, tweak: str, alphabets: tuple[str, ...] = (LOWER, UPPER, DIGITS)) -> str:
        """The letters and digits of value permuted, each kind within itself; other characters stay."""
        made = {a: iter(self.text("".join(c for c in value if c in a), a, tweak)) for a in alphabets}
        return "".join(next((next(made[a]) for a in made if c in a), c) for c in value)


def check_digit(digits: str) -> str:
    """Makes digits + check digit valid by the card numbers' rule."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    """The check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def _fill(pattern: str, digits: str) -> str:
    """pattern with its digits replaced."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in pattern)


def hex_form(secret: str) -> str | None:
    """lower (or digits alone), upper, mixed (of 40 digits only), or None: secrets are permuted within their form."""
    forms = {"lower": "[0-9a-f]+", "upper": "[0-9A-F]+", "mixed": "[0-9A-Fa-f]{40}"}
    return next((k for k, x in forms.items() if re.fullmatch(x, secret)), None)


_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def pseudonym(kind: str, value: str, p: Permutation) -> str | None:
    """The pseudonym of a value of that kind; None if the value isn't valid."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        made = p.shape(local.lower(), "email")
        return "".join(m.upper() if c.isupper() else m for m, c in zip(made, local, strict=True)) + "@" + domain
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if check_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        new = p.text(digits[:-1], DIGITS, "card")
        return _fill(value, new + check_digit(new))
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        code = _CODES.match(digits)[0] if value[0] == "+" and _CODES.match(digits) else "" if value[0] == "+" else "1"
        own = digits[len(code) :] if value[0] == "+" else digits
        if not 7 <= len(code + own) <= 15 or len(own) < 4:
            return None
        kept = lambda d: [d[0] != "0", *([d[0] in "23456789", d[3] in "23456789"] if code == "1" and len(d) == 10 else [])]
        form = kept(own)
        while True:
            own = p.text(own, DIGITS, f"phone|{code}")
            if kept(own) == form:
                return _fill(value, digits[: len(digits) - len(own)] + own)
    if kind == "ipv6":
        if not re.search(r"\d", value) or len(value) < 6:
            return None
        try:
            return str(ipaddress.IPv6Address(p.number(int(ipaddress.IPv6Address(value)), 1 << 128, "ipv6")))
        except ipaddress.AddressValueError:
            return None
    if kind == "iban":
        compact = value.replace(" ", "")
        if iban_check(compact[:2], compact[4:]) != compact[2:4]:
            return None
        body = p.shape(compact[4:], f"iban|{compact[:2]}")
        new = iter(compact[:2] + iban_check(compact[:2], body) + body)
        return "".join(c if c == " " else next(new) for c in value)
    if kind == "ipv4":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        number = p.number(int.from_bytes(bytes(octets), "big"), 1 << 32, "ipv4")
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "date":
        iso = value[4] == "-"
        parts = [int(x) for x in re.split("[-/]", value)]
        year, month, day = parts if iso else (parts[2], parts[0], parts[1])
        swapped = not iso and month > 12
        try:
            date = datetime.date(year, *((day, month) if swapped else (month, day)))
        except ValueError:
            return None
        number = date.toordinal() - _FIRST
        while True:
            number = p.number(number, _DAYS, "date")
            new = datetime.date.fromordinal(_FIRST + number)
            if (new.day > 12) == (date.day > 12):  # a day written first stays one that can't be a month
                return new.strftime("%Y-%m-%d" if iso else "%d/%m/%Y" if swapped else "%m/%d/%Y")
    if kind == "ssn":
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = value.replace("-", "")
        if not valid(digits):
            return None
        while True:
            digits = p.text(digits, DIGITS, "ssn")
            if valid(digits):
                return _fill(value, digits)
    if kind == "access_key":
        return value[:4] + p.text(value[4:], UPPER + DIGITS, "access_key")
    form = hex_form(value)
    tweak = "hex" if form and len(value) == 40 else "password"
    while True:
        if form == "mixed":
            value = p.shape(value, tweak, ("abcdef", "ABCDEF", DIGITS))
        else:
            value = p.text(value, DIGITS + ("abcdef" if form == "lower" else "ABCDEF"), tweak) if form else p.shape(value, tweak)
        if hex_form(value) == form:
            return value


def replacer(key: str) -> Callable[[str], tuple[str, list[int]]]:
    """text -> (pseudonymised text, how many values of each kind)."""
    p = Permutation(key)
    of = lru_cache(maxsize=50_000)(lambda kind, value: pseudonym(kind, value, p))

    def replace(text: str) -> tuple[str, list[int]]:
        counts = [0] * len(KINDS)
        if not may_hold(text):
            return text, counts

        def one(m: re.Match) -> str:
            found = m.groupdict()
            kind = next(k for k in KINDS if found.get(k) is not None)
            part = 0 if kind != "password" else "secret" if m["quoted"] is None else "quoted"
            if part == "secret" and m["password"].rstrip().endswith(":") and re.fullmatch(r"[^\W\d_]+[.!?)]*", m["secret"]) and not _PLAIN.search(text, max(0, m.start() - 80), m.start("secret")):
                return m[0]  # a word of prose
            new = of(kind, m[part])
            if new is None:
                return m[0]
            counts[KINDS.index(kind)] += 1
            return text[m.start() : m.start(part)] + new + text[m.end(part) : m.end()]

        return (_FOUND if names_secret(text) else _UNNAMED).sub(one, text), counts

    return replace


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text pseudonymised, and pii_<kind> (int) for each kind: how many values were replaced.

    Numbers that only look like a format (no valid check digit, no such day, an octet over 255) stay. Null texts stay null, with
    counts of 0; empty ones stay empty, and an empty table gives an empty result. Every row is its own; repeated rows give equal
    results. Columns of docs named pii_<kind> are replaced. An empty key is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    small_batches(docs.sparkSession)
    counts = [f"pii_{k}" for k in KINDS]
    names = [c for c in docs.columns if c not in counts]
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.IntegerType()) for c in counts]])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = replacer(key)
        for batch in batches:
            done = [(None, [0] * len(KINDS)) if t is None else replace(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            numbers = [pa.array([n[k] for _, n in done], pa.int32()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*names, *counts])

    return kept.mapInArrow(run, schema)
