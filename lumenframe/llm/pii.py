"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their validation, e-mail addresses and secrets are
replaced by keyed permutations of their format: a Feistel network permutes the
whole numbers below a power of two, and cycle-walking confines it to the values
that are valid in the format. The permutation depends on the key and the kind
alone, so equal values stay equal across documents, and the key's owner can
invert it.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import small_batches
from lumenframe.session import table

ROUNDS = 10
#: The setting that names the secret key of the registered queries.
KEY_SETTING = "spark.lumenframe.pii.key"
#: The registered queries' key where the setting is unset, so that they run anywhere: it protects nothing.
DEMONSTRATION_KEY = b"lumenframe demonstration key"

DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
LARGE = SMALL.upper()
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]}{'|t' if m == 'September' else ''})?" for m in MONTHS) + ")"
_NTH = "(?:st|nd|rd|th)?"

#: Lengths of IBANs by country; fixed values.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        pair.split(":")
        for pair in "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split()
    )
    for country in countries.split(",")
}

#: Patterns of the kinds, in order of precedence where matches start together; fixed values.
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+(?<![.-])"),
    ("aws_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("password", r"(?i:(?<!\w)(?:password|passwd|pwd|secret|api_key|token)[ \t]?[=:][ \t]?[\"']?)(?P<password_value>[A-Za-z0-9]{8,128})(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"),
    ("date", r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}(?P<date_a>[-/.])[0-9]{1,2}(?P=date_a)[0-9]{1,2}|[0-9]{1,2}(?P<date_b>[-/.])[0-9]{1,2}(?P=date_b)[0-9]{4})(?!(?!T[0-9]{2})[0-9A-Za-z]|[/.-][0-9])"),
    ("date_named", rf"(?<![0-9A-Za-z/.-])(?=[0-9JFMASONDjfmasond])(?:[0-9]{{1,2}}{_NTH}(?:[ -]| of ){_MONTH}\.?,?[ -]|{_MONTH}\.?[ -][0-9]{{1,2}}{_NTH},?[ -])[0-9]{{4}}(?![0-9A-Za-z]|[/.-][0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
    ("phone_abroad", r"(?<![0-9A-Za-z+])\+(?!1[ .(-])[0-9]{1,3}(?:[ .-]?[0-9]){7,12}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<card_mark>[ -])[0-9]{4}(?P=card_mark)[0-9]{4}(?P=card_mark)[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"),
)
#: A text without any of these has nothing to replace.
MAY_HOLD = re.compile(r"[0-9@=:]")
SCANNER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))


class Feistel:
    """A keyed permutation of the whole numbers below n, for any n."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = blake2b(key, digest_size=32).digest(), kind.encode()[:16]

    def _round(self, turn: int, value: int, half: int) -> int:
        size = (half + 7) // 8
        need, digest, part = size, b"", 0
        while len(digest) < need:
            digest += blake2b(bytes([turn]) + part.to_bytes(4, "big") + half.to_bytes(4, "big") + value.to_bytes(size, "big"), key=self.key, person=self.kind).digest()
            part += 1
        return int.from_bytes(digest[:need], "big") & ((1 << half) - 1)

    def _once(self, value: int, half: int, back: bool) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        if back:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ self._round(turn, left, half), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ self._round(turn, right, half)
        return left << half | right

    def permute(self, value: int, n: int, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """The pseudonym of value among those below n that are valid; value must be one of them.

        The kind's permutation is walked until it meets a valid value again,
        which is a permutation of the valid ones, and back=True inverts it.
        """
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            value = self._once(value, half, back)
            if value < n and (valid is None or valid(value)):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _fill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    own = iter(digits)
    return "".join(next(own) if c in DIGITS else c for c in text)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _numbers(feistel: Feistel, text: str, valid: Callable[[str], bool], back: bool) -> str | None:
    digits = _only_digits(text)
    if not valid(digits):
        return None
    size = len(digits)
    return _fill(text, str(feistel.permute(int(digits), 10**size, lambda v: valid(f"{v:0{size}d}"), back)).zfill(size))


def _classes(feistel: Feistel, text: str, back: bool, alphabets: tuple[str, ...] = (DIGITS, SMALL, LARGE), valid: Callable[[str], bool] | None = None) -> str:
    """Each character permuted within its own alphabet, all of them at once; others stay.

    With `valid`, of which text must be one, only among the texts that are valid.
    """
    value, n = 0, 1
    held = [next((a for a in alphabets if c in a), None) for c in text]
    for c, a in zip(text, held, strict=True):
        if a:
            value, n = value * len(a) + a.index(c), n * len(a)
    if n == 1:
        return text

    def spelled(value: int) -> str:
        out = []
        for c, a in zip(reversed(text), reversed(held), strict=True):
            if a:
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    return spelled(feistel.permute(value, n, None if valid is None else lambda v: valid(spelled(v)), back))


def _email(feistel: Feistel, text: str, back: bool) -> str:
    stem, _, top = text.rpartition(".")
    return _classes(feistel, stem, back) + "." + top


def _ip(feistel: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, None, back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(feistel: Feistel, text: str, back: bool) -> str | None:
    """Year first, else day before month where that is a date, else month before day."""
    mark = re.search(r"[-/.]", text)[0]
    a, b, c = text.split(mark)
    short = min(map(len, (a, b, c))) == 1
    for order, (y, m, d) in ((("ymd", (a, b, c)),) if len(a) == 4 else (("dmy", (c, b, a)), ("mdy", (c, a, b)))):
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            continue

        def readable(new: datetime.date, order: str = order, m: str = m, d: str = d) -> bool:
            if short and not (_padded_alike(m, new.month) and _padded_alike(d, new.day)):
                return False
            return order in ("ymd", "dmy") or new.day > 12  # a month-first date stays one

        new = _permuted_day(feistel, day, readable, back)
        if new is None:
            return None
        fields = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(m)}d}", "d": f"{new.day:0{len(d)}d}"}
        return mark.join(fields[f] for f in order)
    return None


def _padded_alike(field: str, number: int) -> bool:
    """Whether a number takes as many digits without zeros in front as the field does."""
    return (int(field) < 10) == (number < 10)


def _permuted_day(feistel: Feistel, day: int, readable: Callable[[datetime.date], bool], back: bool) -> datetime.date | None:
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    date = lambda v: datetime.date.fromordinal(FIRST_DAY + v)
    return date(feistel.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, lambda v: readable(date(v)), back))


def _date_named(feistel: Feistel, text: str, back: bool) -> str | None:
    """A date with the month's name; names stay whole or short ("May" is whole), days of one digit stay so."""
    name, year, d = re.search(_MONTH, text)[0], text[-4:], re.search(r"[0-9]{1,2}", text)[0]
    whole, nth = name.capitalize() in MONTHS, re.search(r"[0-9](st|nd|rd|th)", text)
    try:
        day = datetime.date(int(year), [m[:3] for m in MONTHS].index(name[:3].capitalize()) + 1, int(d)).toordinal()
    except ValueError:
        return None
    new = _permuted_day(feistel, day, lambda new: _padded_alike(d, new.day) and (whole or new.month != 5), back)
    if new is None:
        return None
    month = MONTHS[new.month - 1][: None if whole else 3]
    month = month.upper() if name.isupper() else month.lower() if name.islower() else month
    suffix = "" if not nth else "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
    made = re.sub(_MONTH, month, text[:-4], count=1)
    return re.sub(r"[0-9]{1,2}" + _NTH, f"{new.day:0{len(d)}d}{suffix}", made, count=1) + f"{new.year:04d}"


def _ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(feistel: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    # Check digits are 02 to 98: 00, 01 and 99 would fit the same bodies as 97, 98 and 02.
    if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or _iban_rest(plain) != 1:
        return None
    body = _classes(feistel, plain[4:], back)
    made = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
    own = iter(made)
    return "".join(c if c == " " else next(own) for c in text)


def _phone(feistel: Feistel, text: str, back: bool) -> str | None:
    """The ten national digits; numbers of valid area and exchange stay such, others stay others."""
    country = "+1" if text.startswith("+1") else ""
    own = _only_digits(text[len(country) :])
    usual = lambda d: d[0] in "23456789" and d[3] in "23456789"
    kind = usual(own)
    made = _numbers(feistel, text[len(country) :], lambda d: usual(d) == kind, back)
    return country + made


def _phone_abroad(feistel: Feistel, text: str, back: bool) -> str | None:
    """All digits but the first, whose value and number stay."""
    head, tail = text[:2], text[2:]
    return head + _numbers(feistel, tail, lambda d: True, back)


@dataclass(frozen=True)
class Pseudonyms:
    """Replaces what SCANNER finds; back=True turns pseudonyms back into values."""

    key: bytes

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if the value is not valid for its kind."""
        feistel = Feistel(self.key, kind)
        if kind == "email":
            return _email(feistel, text, back)
        if kind == "aws_key":
            return text[:4] + _classes(feistel, text[4:], back, (LARGE + DIGITS,))
        if kind == "hex":
            return _classes(feistel, text, back, (DIGITS + "abcdef",))
        if kind == "password":
            # Texts of hexadecimal digits alone stay such, and all others others, so no two meet in one pseudonym.
            if re.fullmatch(r"[0-9a-f]+", text):
                return _classes(feistel, text, back, (DIGITS + "abcdef",))
            return _classes(feistel, text, back, valid=lambda t: not re.fullmatch(r"[0-9a-f]+", t))
        if kind == "iban":
            return _iban(feistel, text, back)
        if kind == "ip":
            return _ip(feistel, text, back)
        if kind == "date":
            return _date(feistel, text, back)
        if kind == "date_named":
            return _date_named(Feistel(self.key, "date"), text, back)
        if kind == "ssn":
            return _numbers(feistel, text, _ssn_valid, back)
        if kind == "phone":
            return _phone(feistel, text, back)
        if kind == "phone_abroad":
            return _phone_abroad(feistel, text, back)
        if kind == "card":
            return _numbers(feistel, text, lambda d: d.strip("0") != "" and luhn(d), back)
        raise ValueError(kind)

    def _iban_within(self, text: str, start: int, end: int, back: bool) -> tuple[int, str | None]:
        """(end, pseudonym) of the IBAN that a match begins with: of its country's length, or else the longest."""
        ends = [end, *[at for at in range(end - 1, start, -1) if text[at] == " "]]
        due = IBAN_LENGTHS.get(text[start : start + 2])
        for own in sorted(ends, key=lambda at: len(text[start:at].replace(" ", "")) != due):
            made = self.value("iban", text[start:own], back)
            if made is not None:
                return own, made
        return end, None

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """(text with pseudonyms, (kind, start, end) of each in the text given)."""
        if not MAY_HOLD.search(text):
            return text, []
        out, spans, at, done = [], [], 0, 0
        while match := SCANNER.search(text, at):
            kind = match.lastgroup if match.lastgroup in _KINDS else next(name for name in _KINDS if match.group(name) is not None)
            group = "password_value" if kind == "password" else kind
            start, end = match.span(group)
            if kind == "iban":
                end, made = self._iban_within(text, start, end, back)
            else:
                made = self.value(kind, text[start:end], back)
            if made is None:
                at = _next_start(text, match.start())
                continue
            out += [text[done:start], made]
            spans.append(("date" if kind == "date_named" else kind, start, end))
            at = done = end
        return "".join([*out, text[done:]]), spans


_KINDS = tuple(name for name, _ in PATTERNS)


def _next_start(text: str, start: int) -> int:
    """Behind a match that wasn't valid: the next run of letters or digits."""
    while start < len(text) and not text[start].isalnum():
        start += 1
    while start < len(text) and text[start].isalnum():
        start += 1
    return start


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def key_of(spark: SparkSession) -> bytes:
    """The secret of the registered queries and the pipeline: KEY_SETTING, else DEMONSTRATION_KEY."""
    named = spark.conf.get(KEY_SETTING, "")
    return named.encode() if named else DEMONSTRATION_KEY


def pseudonymize(docs: DataFrame, key: bytes, spans: str | None = "pii_spans") -> DataFrame:
    """docs with pseudonyms in `text`, and a last column of spans if it is named.

    Whoever has the key can invert the pseudonyms, so it has no default. An empty
    key is an error.
    Spans are (kind, start, end) in characters of the text given. Where docs has
    n_chars, it is the length of the new text. Null texts stay null, with no
    spans; empty texts stay empty. Rows are independent: repeated rows stay
    equal. A column that already has the spans' name is an error. Dates outside
    1900 to 2099, and numbers that fail their check digits, are not touched.
    """
    if not key:
        raise ValueError("the key must not be empty")
    if spans in docs.columns:
        raise ValueError(f"docs already has a column {spans}; name another")
    names, at = docs.columns, docs.columns.index("text")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + ([T.StructField(spans, SPANS)] if spans else []))
    counted = names.index("n_chars") if "n_chars" in names else None
    own = Pseudonyms(key)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def replaced(batches):
        for batch in small_batches(batches):
            columns = list(batch.columns)
            done = [(None, []) if t is None else own.text(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array([t for t, _ in done], columns[at].type)
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t, _ in done]).cast(columns[counted].type)
            if spans:
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], span_type))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.mapInArrow(replaced, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymize(docs, key_of(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"]))), ",")
    return found.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"), kinds.alias("kinds"))
