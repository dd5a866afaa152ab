"""Format-preserving pseudonyms: validated numbers and dates are permuted by a keyed Feistel network within their format.

A value is a number below the size of its format's domain; the network permutes that domain under a secret key, so equal
values get equal pseudonyms in every document, different values different ones, and the key's holder can undo it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quire.llm.textkit import chunks, tidy

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0..size-1. ``tweak`` separates formats."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.key, self.tweak, self.size = key, tweak.encode(), size
        self.a = max(1, isqrt(size - 1) + 1 if size > 1 else 1)
        self.b = -(-size // self.a)

    def _f(self, turn: int, x: int, modulus: int) -> int:
        text = b"%d|%d|" % (turn, x) + self.tweak
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16).digest(), "big") % modulus

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        sign = -1 if back else 1
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2:
                right = (right + sign * self._f(turn, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(turn, right, self.a)) % self.a
        return left * self.b + right

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:  # the grid a x b is slightly larger than the domain
            x = self._once(x, back)
        return x

    def hide(self, x: int) -> int:
        return self._walk(x, False)

    def show(self, x: int) -> int:
        return self._walk(x, True)


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


#: 1900-01-01 to 2099-12-31
FIRST_DAY, DAYS = date(1900, 1, 1), 73049
#: Where year, month and day stand if the year is last, in the order in which they are tried.
DATE_ORDERS = {"-": ((2, 0, 1), (2, 1, 0)), "/": ((2, 0, 1), (2, 1, 0)), ".": ((2, 1, 0),)}


def date_class(day: date) -> tuple[bool, int]:
    """What a spelling without leading zeros, or with day and month in either order, shows of a date."""
    return day.month > 9, (day.day > 9) + (day.day > 12)


DATE_CLASSES: dict[tuple[bool, int], list[int]] = {}
for _i in range(DAYS):
    DATE_CLASSES.setdefault(date_class(FIRST_DAY + timedelta(days=_i)), []).append(_i)

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?)@([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,})")
NUMBER = re.compile(
    r"(?<![\w+])(?<!\d\.)(?<!\w-)(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)"
    r"|(?P<phone>(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}|(?<!\d )[2-9]\d\d \d{3} \d{4}(?! \d))"
    r"|(?P<abroad>(?:\+|(?<![:,.])00(?=[1-9]\d{0,2}[ .-]))\d(?:[ .-]?\(?\d\)?){6,15})"
    r"|(?P<ip6>[23Ff][0-9A-Fa-f]{3}(?::[0-9A-Fa-f]{1,4}){0,6}(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|:[0-9A-Fa-f]{1,4})(?!:[\w:]))"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"|(?P<ssn>\d{3}(?P<gap>[ -])\d{2}(?P=gap)\d{4})"
    r"|(?P<date>\d{4}(?P<dash>[-/.])\d{2}(?P=dash)\d{2}|\d{1,2}(?P<dot>[/.])\d{1,2}(?P=dot)\d{4}|\d{2}-\d{2}-\d{4})"
    r"|(?P<card>\d{13,19}|\d{4}(?P<sep>[ .-])\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}|\d{4}[ .-]\d{6}[ .-]\d{5})"
    r"|(?P<trunk>(?<!\d )(?:\(0[1-9]\d{1,3}\)|0[1-9]\d{1,3})[ /-]\d{3,4}(?:[ -]?\d{2,4}){1,2}(?! \d))"
    r")(?:(?=T\d{2}:\d{2})|(?!\w|-\w|\.\d))",
    re.ASCII,
)
#: Groups of the pattern, and the kinds that are reported.
KINDS = {"iban": "iban", "phone": "phone", "abroad": "phone", "ip6": "ip", "ip": "ip", "ssn": "ssn", "date": "date", "card": "card", "trunk": "phone"}
#: What every value has: a character of an address, two digits in a row or, in an IP of single digits, a dot between two, or the
#: first group of a longer IP.
MAY_HOLD = r"@|[0-9]{2}|[0-9][./][0-9]|[0-9A-Fa-f]{4}:[0-9A-Fa-f:]"
TRUNK_ZERO = re.compile(r"(?:\+|00)(\d{1,3})[ .-]?\(0\)", re.ASCII)
# Lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


# Country calling codes, from the public numbering plan.
CALLING_CODES = frozenset(
    str(c)
    for part in "1 7 20 27 30-34 36 39 40 41 43-49 51-58 60-66 81 82 84 86 90-95 98 211-213 216 218 220-269 290 291 297-299 350-359 370-389 420 421 423 500-509 590-599 670 672-692 850 852 853 855 856 880 886 960-968 970-979 992-996 998".split()
    for c in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)
)


def iban_valid(value: str) -> bool:
    """Upper case with right check digits. Lower-case words look like groups more often, so there the country's length and a
    half of digits are needed too."""
    plain = value.replace(" ", "")
    if plain[:1].islower() and (len(plain) != IBAN_LENGTHS.get(plain[:2].upper()) or 2 * sum(c.isdigit() for c in plain) < len(plain)):
        return False
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban_in(match: str) -> str | None:
    """The IBAN that ``match`` begins with. The pattern takes words along that look like groups, so all borders of groups are
    tried: first the country's length, then the others from the longest."""
    ends = [i for i, c in enumerate(match) if c == " "] + [len(match)]
    ends.sort(key=lambda e: (len(match[:e].replace(" ", "")) != IBAN_LENGTHS.get(match[:2].upper()), -e))
    return next((match[:e] for e in ends if iban_valid(match[:e])), None)


class Pseudonyms:
    """Pseudonyms of single values under one key; ``back`` undoes them. ``None`` where a value is not valid in its format."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back
        self.of = lru_cache(maxsize=100_000)(self._of)

    def _move(self, tweak: str, size: int, x: int) -> int:
        net = Feistel(self.key, tweak, size)
        return net.show(x) if self.back else net.hide(x)

    def _digits(self, tweak: str, digits: str) -> str:
        return f"{self._move(f'{tweak}{len(digits)}', 10 ** len(digits), int(digits)):0{len(digits)}d}" if digits else ""

    def _of(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _card(self, value: str) -> str | None:
        """13 to 19 digits with a right check digit; the first digit (the network) stays, the check digit is made anew."""
        d = re.sub(r"\D", "", value)
        if luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        new = d[0] + self._digits("card" + d[0], d[1:-1])
        return _refill(value, new + str(luhn_digit(new)))

    def _national(self, ten: str) -> str:
        """Ten digits; those that may begin an area code stay among such numbers, others among others."""
        first, low = (2, 8) if ten[0] >= "2" else (0, 2)
        return f"{first * 10**9 + self._move(f'phone{first}', low * 10**9, int(ten) - first * 10**9):010d}"

    def _phone(self, value: str) -> str | None:
        """The ten national digits; a country code stays."""
        d = re.sub(r"\D", "", value)
        return _refill(value, d[:-10] + self._national(d[-10:]))

    def _abroad(self, value: str) -> str | None:
        """A number of 8 to 15 digits after ``+`` or ``00``, with an assigned country code, which stays, as does a trunk zero in
        brackets after it; one of ten digits in North America is the same there as without a code."""
        trunk = TRUNK_ZERO.match(value)
        shape = value.replace("(0)", "(_)", 1) if trunk and trunk[1] in CALLING_CODES else value
        d = re.sub(r"\D", "", shape)
        d = d if value[0] == "+" else d[2:]
        code = trunk[1] if shape != value else next((d[:n] for n in (1, 2, 3) if d[:n] in CALLING_CODES), None)
        if code is None or not 8 <= len(d) <= 15 or (code == "1" and len(d) != 11):
            return None
        while True:
            rest = d[len(code) :]
            d = code + (self._national(rest) if code == "1" else self._digits("abroad" + code, rest))
            new = _refill(shape, d if value[0] == "+" else "00" + d).replace("(_)", "(0)")
            if shape != value or not TRUNK_ZERO.match(new):  # else a digit in brackets would turn into a trunk zero
                return new

    def _trunk(self, value: str) -> str | None:
        """A national number of 9 to 12 digits with its trunk zero, which stays; what follows it does not begin with a zero."""
        d = re.sub(r"\D", "", value)
        if not 9 <= len(d) <= 12:
            return None
        least = 10 ** (len(d) - 2)
        return _refill(value, f"0{least + self._move(f'trunk{len(d)}', 9 * least, int(d) - least)}")

    def _ip6(self, value: str) -> str | None:
        """An address of the assigned, private or link-local ranges. Its first group stays; digits of the others change to digits,
        letters to letters, and none gets or loses leading zeros, so that all its spellings stay its spellings."""
        try:
            address = IPv6Address(value)
        except AddressValueError:
            return None
        top = int(address) >> 112
        groups = [f"{int(address) >> 16 * i & 0xFFFF:x}" for i in reversed(range(8))]
        if not (top >> 13 == 1 or top >> 9 == 0x7E or top >> 6 == 0x3FA) or not any(int(g, 16) for g in groups[1:]):
            return None
        x, size, places = 0, 1, []
        for i, group in enumerate(groups[1:], 1):
            for j, c in enumerate(group):
                if group != "0":
                    low, base = ("a", 6) if c.isalpha() else ("0", 10) if j else ("1", 9)
                    x, size = x * base + ord(c) - ord(low), size * base
                    places.append((i, j, low, base))
        x, new = self._move("ip6" + groups[0] + ":".join(re.sub("[a-f]", "a", re.sub(r"\d", "0", g)) if g != "0" else "" for g in groups[1:]), size, x), [list(g) for g in groups]
        for i, j, low, base in reversed(places):
            x, r = divmod(x, base)
            new[i][j] = chr(ord(low) + r)
        head, gap, tail = value.partition("::")
        written = [head.split(":") if head else [], tail.split(":") if tail else []]
        for part, first in ((written[0], 0), (written[1], 8 - len(written[1]))):
            for i, old in enumerate(part):
                fresh = "".join(new[first + i]).rjust(len(old), "0")
                part[i] = "".join(c.upper() if o.isupper() else c for o, c in zip(old, fresh, strict=True))
        return ":".join(written[0]) + gap + ":".join(written[1])

    def _ip(self, value: str) -> str | None:
        """An address; the three that name no one (any, this host, all) stay, and are no pseudonyms."""
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        general = lambda x: x in (0, 127 << 24 | 1, (1 << 32) - 1)
        x = int.from_bytes(bytes(parts), "big")
        if general(x):
            return None
        x = self._move("ip", 1 << 32, x)
        while general(x):
            x = self._move("ip", 1 << 32, x)
        return ".".join(str(b) for b in x.to_bytes(4, "big"))

    def _ssn(self, value: str) -> str | None:
        gap = value[3]
        area, group, serial = map(int, value.split(gap))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x = self._move("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}{gap}{group + 1:02d}{gap}{serial + 1:04d}"

    def _date(self, value: str) -> str | None:
        """A date between 1900 and 2099: the year first, day.month.year, or month and day in either order before the year. If both
        orders are dates, the month is first. Dates change among those that are written alike in all of these (one or two
        digits of month and day, day above 12 or not), so that a date in one spelling stays linked with its others."""
        sep = next(c for c in value if not c.isdigit())
        parts = value.split(sep)
        for order in ((0, 1, 2),) if len(parts[0]) == 4 else DATE_ORDERS[sep]:
            try:
                day = date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            if not 0 <= (day - FIRST_DAY).days < DAYS:
                return None
            kind = date_class(day)
            days = DATE_CLASSES[kind]
            place = self._move(f"date{kind}", len(days), bisect_left(days, (day - FIRST_DAY).days))
            new = FIRST_DAY + timedelta(days=days[place])
            fields = [""] * 3
            for at, number in zip(order, (new.year, new.month, new.day), strict=True):
                fields[at] = f"{number:0{len(parts[at])}d}"
            return sep.join(fields)
        return None

    def _iban(self, value: str) -> str | None:
        """Country and letters stay, the digits of the account are permuted, the check digits are made anew."""
        plain = value.replace(" ", "")
        country, rest = plain[:2], plain[4:]
        if not iban_valid(value):
            return None
        shape = re.sub(r"\d", "0", rest)
        new = _refill(rest, self._digits("iban" + country + shape, re.sub(r"\D", "", rest)))
        it = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(it) for c in value)

    def _email(self, value: str) -> str | None:
        """Letters and digits before the @ are permuted as letters and digits, each in its case; the rest stays."""
        local, _, domain = value.partition("@")
        shape = re.sub(r"[a-z]", "a", re.sub(r"\d", "0", local.lower()))
        x, size = 0, 1
        for c in local.lower():
            if c.isascii() and c.isalnum():
                base = 10 if c.isdigit() else 26
                x, size = x * base + (int(c) if base == 10 else ord(c) - 97), size * base
        x, out = self._move("email" + shape + "@" + domain.lower(), size, x), []
        for c in reversed(local):
            if c.isascii() and c.isalnum():
                x, r = divmod(x, 10 if c.isdigit() else 26)
                c = str(r) if c.isdigit() else chr((65 if c.isupper() else 97) + r)
            out.append(c)
        return "".join(reversed(out)) + "@" + domain


def replace_in(text: str, names: Pseudonyms) -> tuple[str, list[str]]:
    """The text with every valid value replaced, and the kinds found."""
    kinds: list[str] = []

    def put(kind: str, value: str) -> str:
        new = names.of(kind, value)
        if new is None:
            return value
        kinds.append(kind)
        return new

    if "@" in text:
        text = EMAIL.sub(lambda m: put("email", m[0]), text)
    out, done, at = [], 0, 0
    while m := NUMBER.search(text, at):
        kind = next(k for k in KINDS if m[k] is not None)
        value, at = m[0], m.end()
        if kind == "iban":
            # What follows the IBAN, or its first four characters if it is none, may hold other values.
            value = iban_in(m[0])
            at = m.start() + (len(value) if value else 4)
            if value is None:
                continue
            new = names.of("iban", value)
            while iban_in(new + m[0][len(value) :]) != new:  # undoing has to find the same place
                new = names.of("iban", new)
            kinds.append("iban")
        else:
            new = names.of(kind, value)
            if new is None:
                # What looks like one kind and isn't valid may begin with a sign or a number that another value follows.
                at = m.start() + next((i for i, c in enumerate(value) if not c.isdigit() and i), len(value)) if kind == "abroad" else at
                continue
            kinds.append(KINDS[kind])
        out += (text[done : m.start()], new)
        done = at
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds_col: str = "pii_kinds", back: bool = False) -> DataFrame:
    """``docs`` with the text replaced and a column of the kinds found, in order of the kind's pass and then of the text.

    All columns and rows stay (a clashing ``kinds_col`` is replaced). A null text stays null and an empty one empty, with
    no kinds. Values that are not valid in their format stay as they are. Texts of any length are read whole; repeated rows
    stay, all with the same pseudonyms, and an empty table gives no rows. Values that overlap are taken from the left. National
    numbers without a separator, or in pairs of digits, and dates in words stay. ``key`` must be secret and at most 64 bytes; ``back=True`` undoes the pseudonyms.
    """
    keep = [c for c in docs.columns if c != kinds_col]
    at = keep.index(text_col)
    schema = docs.select(*keep).schema.add(kinds_col, ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in (b.slice(first, past - first) for b in batches for first, past, _, _ in chunks(b.column(at))):
            column = batch.column(at)
            kinds: list[list[str]] = [[] for _ in range(batch.num_rows)]
            rows = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, MAY_HOLD), False)).to_pylist()
            if rows:
                texts = column.to_pylist()
                for i in rows:
                    texts[i], kinds[i] = replace_in(texts[i], names)
                column = pa.array(texts, column.type)
            columns = [*batch.columns[:at], column, *batch.columns[at + 1 :], pa.array(kinds, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, kinds_col])

    return docs.select(*keep).mapInArrow(tidy(run), schema)


def counted(found: DataFrame, kinds_col: str = "pii_kinds") -> DataFrame:
    """The audit: how many values of each kind there are, and in how many rows."""
    each = found.select(F.explode(F.array_distinct(kinds_col)).alias("kind"), F.col(kinds_col).alias("k"))
    return each.groupBy("kind").agg(F.sum(F.size(F.filter("k", lambda x: x == F.col("kind")))).alias("n_values"), F.count("*").alias("n_rows"))
