"""Format-preserving pseudonyms for personal data.

Each value that passes the validation of its kind (check digits, calendar, ranges) is mapped by a keyed permutation of the set
of values with the same format, so a pseudonym is again a valid value of that format and equal values get equal pseudonyms in
every document. The permutation is a balanced Feistel network with cycle walking; without the key it cannot be undone, with it
`Permuter.invert` gives the value back.

Defined results: a null text stays null and an empty one empty; rows are treated one by one, so repeated rows, null ids and ties
change nothing; other columns pass through, except one named like the count column, which is replaced.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitefold.llm.common import map_columns, texts

ROUNDS = 8
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


class Permuter:
    """Keyed permutations of range(n), one for every (n, tweak)."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, i: int, tweak: str, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        said = b"%d|%d|" % (i, bits) + tweak.encode() + b"|" + half.to_bytes(size, "big")
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=min(64, size + 8)).digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: str, back: bool) -> int:
        mask = (1 << bits) - 1
        a, b = x >> bits, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = b ^ self._round(i, tweak, a, bits), a
            else:
                a, b = b, a ^ self._round(i, tweak, b, bits)
        return (a << bits) | b

    def permute(self, x: int, n: int, tweak: str = "", back: bool = False) -> int:
        """The image of x; the walk leaves the power of four around n until it is below n again."""
        if n <= 1:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak, back)
            if x < n:
                return x

    def invert(self, x: int, n: int, tweak: str = "") -> int:
        return self.permute(x, n, tweak, back=True)

    def spell(self, s: str, alphabet: str, tweak: str) -> str:
        """A string over `alphabet` as another of the same length."""
        if not s:
            return s
        base, x = len(alphabet), 0
        for c in s:
            x = x * base + alphabet.index(c)
        x, out = self.permute(x, base ** len(s), tweak), []
        for _ in s:
            x, r = divmod(x, base)
            out.append(alphabet[r])
        return "".join(reversed(out))

    def by_class(self, s: str, tweak: str) -> str:
        """Digits, capitals and small letters permuted each as one word; other characters and all places stay."""
        for alphabet in (DIGITS, UPPER, LOWER):
            new = iter(self.spell("".join(c for c in s if c in alphabet), alphabet, f"{tweak}{len(s)}"))
            s = "".join(next(new) if c in alphabet else c for c in s)
        return s


def _places(value: str, digits: str) -> str:
    """`digits` put where `value` has digits, with its separators."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in value)


def _luhn(digits: str) -> int:
    """What the check digit adds to: 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(p: Permuter, v: str) -> str | None:
    d = "".join(c for c in v if c in DIGITS)
    if not 13 <= len(d) <= 19 or _luhn(d) or len(set(d)) == 1 or d[0] == "0":
        return None
    body = d[0] + p.spell(d[1:-1], DIGITS, "card" + d[0])
    return _places(v, body + str(-_luhn(body + "0") % 10))


def phone(p: Permuter, v: str) -> str | None:
    """A number of the North American plan: area and exchange codes start with 2 to 9, and do so afterwards."""
    d = "".join(c for c in v if c in DIGITS)
    head, d = d[:-10], d[-10:]
    if len(d) < 10 or head not in ("", "1") or d[0] < "2" or d[3] < "2":
        return None
    while True:
        d = p.spell(d, DIGITS, "phone")
        if d[0] >= "2" and d[3] >= "2":
            return _places(v, head + d)


def foreign_phone(p: Permuter, v: str) -> str | None:
    """An international number: two digits of the country code stay."""
    d = "".join(c for c in v if c in DIGITS)
    return _places(v, d[:2] + p.spell(d[2:], DIGITS, f"tel{len(d)}")) if 8 <= len(d) <= 15 else None


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(p: Permuter, v: str) -> str | None:
    d = v.replace("-", "")
    if not _ssn_ok(d):
        return None
    while True:
        d = p.spell(d, DIGITS, "ssn")
        if _ssn_ok(d):
            return _places(v, d)


def ip(p: Permuter, v: str) -> str | None:
    octets = [int(x) for x in v.split(".")]
    ok = lambda o: max(o) < 256 and 0 < o[0] < 224 and o[0] != 127
    if not ok(octets):
        return None
    x = int.from_bytes(bytes(octets), "big")
    while True:
        x = p.permute(x, 1 << 32, "ip")
        if ok(o := list(x.to_bytes(4, "big"))):
            return ".".join(map(str, o))


def _iban_mod(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def iban(p: Permuter, v: str) -> str | None:
    s = v.replace(" ", "")
    country, check, body = s[:2], s[2:4], s[4:]
    if not 11 <= len(body) <= 30 or _iban_mod(country, check, body) != 1:
        return None
    body = p.by_class(body, "iban" + country)
    new = iter(country + f"{98 - _iban_mod(country, '00', body):02d}" + body)
    return "".join(c if c == " " else next(new) for c in v)


# Characters of an IBAN by country.
IBAN_SIZES = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                                 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
                                 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}


def iban_ends(v: str) -> list[int]:
    """Where an IBAN at the begin of `v` may end: at its country's length, or at the end; of an unknown country also at the other ends of words."""
    ends = [m.end() for m in re.finditer(r"[0-9A-Z]\b", v)][::-1]
    size = IBAN_SIZES.get(v[:2])
    own = [e for e in ends if len(v[:e].replace(" ", "")) == size]
    return own + [e for e in (ends[:1] if size else ends) if e not in own]


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _day(p: Permuter, y: int, m: int, d: int) -> datetime.date | None:
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    x = datetime.date(y, m, d).toordinal() - FIRST_DAY
    return datetime.date.fromordinal(FIRST_DAY + p.permute(x, LAST_DAY - FIRST_DAY + 1, "date"))


def date(p: Permuter, v: str) -> str | None:
    """A calendar date in either order; the same day is linked across formats. Where day and month can be told apart neither
    way, day comes first."""
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", v).groups()
    if len(a) == 4:
        new = _day(p, int(a), int(b), int(c))
        return new and f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    if new := _day(p, int(c), int(b), int(a)):
        return f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year:04d}"
    new = _day(p, int(c), int(a), int(b))
    return new and f"{new.month:02d}{sep}{new.day:02d}{sep}{new.year:04d}"


def email(p: Permuter, v: str) -> str | None:
    name, _, host = v.rpartition("@")
    return f"{p.by_class(name, 'email')}@{host}"


def access_key(p: Permuter, v: str) -> str | None:
    return v[:4] + p.spell(v[4:], DIGITS + UPPER, "access")


def secret(p: Permuter, v: str) -> str | None:
    """The value after `password=`, `token:` and the like: over hexadecimal digits if it has no others, else class by class."""
    head, value = re.fullmatch(r"(.*?[=:]\s*[\"']?)([^\s\"']+)", v, re.S).groups()
    return head + (p.spell(value, HEX, f"hex{len(value)}") if set(value) <= set(HEX) else p.by_class(value, "secret"))


# Kind -> (pattern, validated pseudonym or None). The first kind whose pattern matches at a place gets it.
KINDS = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    "secret": (r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9_+/.~-]{8,}", secret),
    "access_key": (r"\bA(?:KIA|SIA)[0-9A-Z]{16}\b", access_key),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]){11,30}\b", iban),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", ip),
    "date": (r"(?<![\d.,/-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-]|\.\d)", date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    "phone": (r"(?<![\d(+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+1\d{10}(?!\d)", phone),
    "foreign_phone": (r"\+(?!1[ (.-])\d{1,3}(?:[ .-]?\d){7,12}(?!\d)", foreign_phone),
    "card": (r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", card),
}
_MAY_HOLD = re.compile(r"[0-9@]|(?i:pass|pwd|token|secret|key)\s*[=:]")


def _compiled() -> list[tuple[str, re.Pattern, object]]:
    return [(k, re.compile(pattern), fn) for k, (pattern, fn) in KINDS.items()]


@lru_cache(maxsize=4)
def _worker(key: bytes):
    p, kinds = Permuter(key), _compiled()

    def one(text: str) -> tuple[str, dict[str, int]]:
        """Values are looked for kind by kind in what the kinds before have left over, and put in together at the end."""
        if not _MAY_HOLD.search(text):
            return text, {}
        found: list[tuple[int, int, str, str]] = []
        for kind, pattern, fn in kinds:
            at = 0
            while m := pattern.search(text, at):
                a, at = m.start(), m.end()
                # what follows an IBAN may look like more of it, or be the next one
                for b in [a + e for e in iban_ends(m[0])] if kind == "iban" else [m.end()]:
                    if any(a < y and x < b for x, y, _, _ in found):
                        continue
                    if (new := fn(p, text[a:b])) is not None:
                        found.append((a, b, kind, new))
                        at = b
                        break
                else:
                    at = a + 1 if kind == "iban" else at
        counts: dict[str, int] = {}
        out, at = [], 0
        for a, b, kind, new in sorted(found):
            out += [text[at:a], new]
            at = b
            counts[kind] = counts.get(kind, 0) + 1
        return "".join(out) + text[at:], counts

    return one


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str = "n_pii", kinds_col: str = "pii_kinds") -> DataFrame:
    """`docs` with every value of KINDS replaced in `text_col`, the number replaced, and how many of each kind (`email:2,ip:1`)."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        one = _worker(key)
        made = [(None, {}) if t is None else one(t) for t in texts(batch, text_col)]
        return {text_col: pa.array([t for t, _ in made], pa.string()), count_col: pa.array([sum(c.values()) for _, c in made], pa.int64()),
                kinds_col: pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for _, c in made], pa.string())}

    return map_columns(docs, run, [T.StructField(text_col, T.StringType()), T.StructField(count_col, T.LongType()), T.StructField(kinds_col, T.StringType())])
