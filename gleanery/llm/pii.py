"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions alone.

PATTERN finds candidates; a candidate that its kind's rules accept is replaced, and anything
else stays as it is. Kinds and rules: e-mail addresses; secrets after a name such as token, of 16
hexadecimal digits or 8 characters with a letter and a digit, quoted or not; access key ids; IBANs
(check digits); telephone numbers of ten digits, or of 8 to 15 after a plus sign; card numbers (13
to 19 digits, known first digits, Luhn); IPv6 and IPv4 addresses; dates that exist, from 1800 to
2199; US social security numbers (valid areas, groups and serials). Each kind has its own
boundaries, so a value next to another one or to a slash is found.

A value is taken as a pair (left, right) of residues, or of strings, and ROUNDS rounds add a
keyed hash of one half to the other. Each round can be undone, so equal values get equal
pseudonyms in every document and different values different ones. Moduli are those of the
format (10**k for digits, 65536 for two parts of an address, 189 and 773 for the 146097 days of
400 years), so no pseudonym has to be drawn again and each is valid in its kind: cards keep
their first two digits and get a new check digit, letters stay letters, separators stay.
Telephone numbers, dates, IBANs and addresses map alike in each way of writing them; IPv6 addresses
get eight groups. A date with slashes has its month first unless only the other order exists.

The key is the caller's. key_of() takes it from the session's setting spark.gleanery.pii.key; where that is
unset, a random key of this driver is used, so that pseudonyms cannot be undone by its readers.

Cases. Null or empty text stays. Repeated rows are each returned. Empty table: empty result.
Documents are scanned whole; those without a digit, @ or colon are not searched. No part of PATTERN
repeats a group without bound, so long runs of any character need no deep stack.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import prefixed

ROUNDS = 10
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773  # 189 * 773 days are 400 years
AREAS, GROUPS, SERIALS = 898, 99, 9999
_OPEN, _CLOSE = r"(?<![0-9])(?<![0-9][.,])", r"(?![0-9])(?![.,][0-9])"  # a number that is no part of a longer one
_WORD, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
SECRET_NAME = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?"
_VALUE, _NUMBERS = r"[A-Za-z0-9_+/~-]", r"[0-9_+/~-]"
#: A value of numbers alone is left to the other kinds, unless it is 16 digits or more without separators.
SECRET = SECRET_NAME + rf"(?![0-9]{{0,15}}(?:(?!{_VALUE})|[_+/~-]{_NUMBERS}*(?!{_VALUE}))){_VALUE}{{8,}}"
ACCESS_KEY = _WORD + r"(?:AKIA|ASIA)[0-9A-Z]{16}" + _END
IBAN = _WORD + r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _END
FOREIGN_PHONE = r"\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,5}(?![0-9])"
AREA_PHONE = r"(?:\+?[0-9]{1,3}[ -])?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
PLAIN_PHONE = r"(?<![0-9])(?<![0-9][.,/-])(?:1[ .-])?(?:[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})(?![0-9])(?![.,/-][0-9])"
CARD = _OPEN + r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _CLOSE
IPV6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"
IPV4 = r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
DATE = (
    r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9])"
    r"|(?<![0-9])(?<![0-9]\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])(?!\.[0-9])|(?<![0-9])(?<![0-9]/)[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])(?!/[0-9])"
)
SOCIAL = r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])"
PATTERN = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, FOREIGN_PHONE, AREA_PHONE, PLAIN_PHONE, CARD, IPV6, IPV4, DATE, SOCIAL))
LIKELY = "[0-9@:]"
#: What each candidate is told by; whole candidates, so no boundaries are needed.
IS_SECRET, IS_ACCESS_KEY, IS_IBAN = "^" + SECRET_NAME, "^A[KS]IA[0-9A-Z]{16}$", "^[A-Z]{2}[0-9]{2}[ A-Z0-9]{11,}$"
IS_PHONE = r"^\+|\(|^(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"
IS_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"
IS_IPV4 = r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$"
IS_SOCIAL = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
_OWN_KEY: list[str] = []


def key_of(spark: SparkSession) -> str:
    """The session's key, or else a random one of this driver."""
    if not _OWN_KEY:
        _OWN_KEY.append(secrets.token_hex(32))
    return spark.conf.get("spark.gleanery.pii.key", _OWN_KEY[0])


def keyed_hash(key: str, kind: str, turn: Column, value: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), bits)


def hashed_number(key: str, kind: str, turn: Column, value: Column) -> Column:
    """60 bits of the keyed hash."""
    return F.conv(F.substring(keyed_hash(key, kind, turn, value, 256), 1, 15), 16, 10).cast("long")


def network(left: Column, left_mod: Column, right: Column, right_mod: Column, kind: str, key: str) -> Column:
    """The struct (l, r) after all rounds, of two residues."""

    def turn(s: Column, i: Column) -> Column:
        l, r = s["l"], s["r"]
        even = F.struct(((l + hashed_number(key, kind, i, r)) % left_mod).alias("l"), r.alias("r"))
        odd = F.struct(l.alias("l"), ((r + hashed_number(key, kind, i, l)) % right_mod).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def moved(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Each letter and digit moved within its own kind by a byte of the stream."""

    def char(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(stream, (j % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), (F.instr(F.lit("0123456789abcdef"), c) - 1 + by) % 16 + 1, F.lit(1))
        code, out = F.ascii(c), c
        for first, n in ((48, 10), (65, 26), (97, 26)):
            out = F.when(code.between(first, first + n - 1), F.char((code - first + by) % n + first)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), char), "")


def text_network(text: Column, kind: str, key: str, hexadecimal: bool = False) -> Column:
    """A string of which each letter and digit is replaced by one of its kind."""

    def turn(s: Column, i: Column) -> Column:
        a, b = s["l"], s["r"]
        even = F.struct(moved(a, keyed_hash(key, kind, i, F.lower(b), 512), hexadecimal).alias("l"), b.alias("r"))
        odd = F.struct(a.alias("l"), moved(b, keyed_hash(key, kind, i, F.lower(a), 512), hexadecimal).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    cut = F.floor((F.length(text) + 1) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("l"), F.substring(text, cut + 1, F.length(text)).alias("r"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(end["l"], end["r"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refilled(form: Column, new: Column) -> Column:
    """The form with its digits replaced, in order, by the new ones."""
    step = lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["text"], F.substring(new, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))
    ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("next")), step)["text"]


def luhn(number: Column) -> Column:
    """The Luhn sum modulo ten; zero for a valid number."""
    value = lambda c, i: F.when(i % 2 == 0, c).when(c > 4, c * 2 - 9).otherwise(c * 2)
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def digit_network(number: Column, kind: str, key: str) -> Column:
    """A permutation of the numbers of up to 18 digits with the same length."""
    n = F.length(number)
    a = F.floor(n / 2).cast("int")
    power = lambda k: F.element_at(F.array(*(F.lit(10**e) for e in range(10))), k + 1).cast("long")
    end = network(F.substring(number, F.lit(1), a).cast("long"), power(a), F.substring(number, a + 1, n).cast("long"), power(n - a), kind, key)
    return F.concat(F.lpad(end["l"].cast("string"), a, F.lit("0")), F.lpad(end["r"].cast("string"), n - a, F.lit("0")))


def one(value: Column, f) -> Column:
    """f of a value that it needs several times and that is computed once."""
    return F.transform(F.array(value), f)[0]


def card(m: Column, key: str) -> tuple[Column, Column]:
    d = digits(m)
    valid = m.rlike(IS_CARD) & d.rlike("^(?:[3-6]|2[2-7])") & (luhn(d) == 0)
    body = F.concat(F.substring(d, 1, 2), digit_network(F.substring(d, F.lit(3), F.length(d) - 3), "card", key))
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    return valid, refilled(m, F.concat(body, check.cast("string")))


def phone(m: Column, key: str) -> tuple[Column, Column]:
    """All digits but the country's are permuted; ten digits alike with and without a country."""
    d = digits(m)
    n = F.length(d)
    country = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]*)", 1))).otherwise(n - 10)
    return m.rlike(IS_PHONE) & n.between(8, 15), refilled(m, F.concat(F.substring(d, F.lit(1), country), digit_network(F.substring(d, country + 1, n - country), "phone", key)))


def remainder(account: Column) -> Column:
    """A number with letters as 10 to 35, modulo 97."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    return F.aggregate(F.split(account, ""), F.lit(0), step)


def bank_account(m: Column, key: str) -> tuple[Column, Column]:
    """An IBAN; of one with spaces, the last word or two may not belong to it."""
    checked = lambda c: F.when(F.length(c).between(15, 34) & (remainder(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1), c)
    cut = lambda k: F.regexp_replace(m, f"(?: [A-Z0-9]+){{{k}}}$", "")
    tries = [F.when(m.rlike(IS_IBAN), F.when(checked(F.replace(cut(k), F.lit(" "))).isNotNull(), cut(k))) for k in range(3)]
    account = F.coalesce(*tries)

    def new(form: Column) -> Column:
        plain = F.replace(form, F.lit(" "))
        country, body = F.substring(plain, 1, 2), text_network(F.substring(plain, F.lit(5), F.length(plain)), "account", key)
        check = F.lpad((98 - remainder(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
        done = F.concat(country, check, body)
        # spaces go back to where they were
        spaced = F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("next")), lambda s, c: F.when(
            c == " ", F.struct(F.concat(s["text"], F.lit(" ")).alias("text"), s["next"].alias("next"))
        ).otherwise(F.struct(F.concat(s["text"], F.substring(done, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))))["text"]
        return spaced

    return account.isNotNull(), F.concat(one(account, new), F.substring(m, F.length(account) + 1, F.length(m)))


def wide_address(m: Column, key: str) -> tuple[Column, Column]:
    """IPv6: eight groups, or fewer around one '::' with a group of three digits or more."""
    sides = F.split(m, "::", 2)
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = groups(sides[0]), F.when(F.size(sides) > 1, groups(F.get(sides, 1))).otherwise(F.array().cast("array<string>"))
    whole = (F.array_join(left, ":") == sides[0]) & F.coalesce(F.array_join(right, ":") == F.get(sides, 1), F.lit(True))
    n = F.size(left) + F.size(right)
    short = (F.size(sides) == 2) & (n <= 7) & m.rlike("[0-9A-Fa-f]{3}")
    full = F.array_join(F.transform(F.concat(left, F.array_repeat(F.lit("0"), 8 - n), right), lambda g: F.lpad(F.lower(g), 4, "0")), "")
    valid = m.rlike("^[0-9A-Fa-f:]+$") & m.contains(":") & whole & (short | ((F.size(sides) == 1) & (n == 8)))
    form = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(h, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    return valid, one(text_network(full, "wide address", key, hexadecimal=True), form)


def address(m: Column, key: str) -> tuple[Column, Column]:
    part = lambda k: F.element_at(F.split(m, r"\."), k).cast("int")
    valid = m.rlike(IS_IPV4) & F.forall(F.split(m, r"\."), lambda p: p.cast("int") <= 255)
    end = network(part(1) * 256 + part(2), F.lit(65536), part(3) * 256 + part(4), F.lit(65536), "address", key)
    high = lambda x: F.floor(x / 256).cast("string")
    low = lambda x: (x % 256).cast("string")
    return valid, one(end, lambda e: F.concat_ws(".", high(e["l"]), low(e["l"]), high(e["r"]), low(e["r"])))


def date(m: Column, key: str) -> tuple[Column, Column]:
    """Separators, the order and whether short numbers have a zero stay as they are."""
    shape = m.rlike("^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})$")
    part = lambda k: F.lpad(F.get(F.split(m, "[-./]"), k), 2, "0")
    year_first, dotted = m.rlike("^[0-9]{4}"), m.contains(".")
    iso = lambda *order: F.concat_ws("-", *(F.get(F.split(m, "[-./]"), k) if k == 2 else part(k) for k in order)).try_cast("date")
    by_month, by_day = iso(2, 0, 1), iso(2, 1, 0)
    value = F.when(year_first, F.regexp_replace(m, "/", "-").try_cast("date")).when(dotted, by_day).otherwise(F.coalesce(by_month, by_day))
    day = F.date_diff(F.when(shape, value), F.lit(FIRST_DAY).cast("date"))
    valid = F.coalesce(day.between(0, DAYS_LEFT * DAYS_RIGHT - 1), F.lit(False))
    end = network(F.floor(day / DAYS_RIGHT), F.lit(DAYS_LEFT), day % DAYS_RIGHT, F.lit(DAYS_RIGHT), "date", key)
    padded = m.rlike("^[0-9]{2}[./][0-9]{2}[./]")

    def form(d: Column) -> Column:
        f = lambda p: F.date_format(d, p)
        by = F.when(dotted, F.when(padded, f("dd.MM.yyyy")).otherwise(f("d.M.yyyy"))).when(by_month.isNotNull(), F.when(padded, f("MM/dd/yyyy")).otherwise(f("M/d/yyyy")))
        return F.when(year_first, F.when(m.contains("-"), f("yyyy-MM-dd")).otherwise(f("yyyy/MM/dd"))).otherwise(F.coalesce(by, F.when(padded, f("dd/MM/yyyy")).otherwise(f("d/M/yyyy"))))

    return valid, one(one(end, lambda e: (e["l"] * DAYS_RIGHT + e["r"]).cast("int")), lambda k: form(F.date_add(F.lit(FIRST_DAY).cast("date"), k)))


def social(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = m.rlike(IS_SOCIAL) & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area < 666, area - 1).otherwise(area - 2)
    end = network(index * GROUPS + group - 1, F.lit(AREAS * GROUPS), serial - 1, F.lit(SERIALS), "social", key)

    def form(e: Column) -> Column:
        k = F.floor(e["l"] / GROUPS)
        three = F.when(k < 665, k + 1).otherwise(k + 2)
        return F.concat_ws("-", F.lpad(three.cast("string"), 3, "0"), F.lpad((e["l"] % GROUPS + 1).cast("string"), 2, "0"), F.lpad((e["r"] + 1).cast("string"), 4, "0"))

    return valid, one(end, form)


def secret(m: Column, key: str) -> tuple[Column, Column]:
    name = F.regexp_extract(m, IS_SECRET, 0)
    plain = F.substring(m, F.length(name) + 1, F.length(m))
    hexadecimal = plain.rlike("^[0-9A-Fa-f]{16,}$")
    coded = text_network(F.lower(plain), "secret", key, hexadecimal=True)
    new = F.when(hexadecimal, F.when(plain == F.upper(plain), F.upper(coded)).otherwise(coded)).otherwise(text_network(plain, "secret", key))
    return m.rlike(IS_SECRET) & (hexadecimal | (plain.rlike("[0-9]") & plain.rlike("[A-Za-z]"))), F.concat(name, new)


def pseudonym(m: Column, key: str) -> Column:
    """What replaces one candidate: itself where no kind accepts it."""
    tld = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    email = F.concat(text_network(F.substring(m, F.lit(1), F.length(m) - F.length(tld)), "email", key), tld)
    access = F.concat(F.substring(m, 1, 4), text_network(F.substring(m, 5, 16), "access key", key))
    out = F.when(m.contains("@"), email).when(m.rlike(IS_ACCESS_KEY), access)
    for kind in (secret, bank_account, phone, card, wide_address, address, date, social):
        valid, new = kind(m, key)
        out = out.when(valid, new)
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the text replaced and the number of replaced values (a long); that column's name."""
    own = prefixed(docs, "n_pseudonyms", "__found", "__new")
    found, new = F.col(own["__found"]), F.col(own["__new"])
    out = docs.withColumn(own["__found"], F.when(F.col(text).rlike(LIKELY), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(own["__new"], F.transform(found, lambda m: pseudonym(m, key)))
    pieces = F.split(F.col(text), PATTERN, -1)
    changed = F.array_join(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    count = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).cast("long")
    out = out.withColumn(text, F.when(F.size(found) > 0, changed).otherwise(F.col(text))).withColumn(own["n_pseudonyms"], count)
    return out.select(*docs.columns, own["n_pseudonyms"]), own["n_pseudonyms"]
