"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

A candidate is validated (Luhn, octet range, calendar, number ranges, mod 97)
before it takes its text, so an invalid one hides no valid value inside or beside
it.  Octets, calendar and number ranges are part of the pattern.  Cards and IBANs
are looked for at every start and with every end at a group border; those that
pass are added to the row's pattern as they stand.  A valid number or date is
permuted by a keyed Feistel network on its own format's domain, so the result
is again valid, equal values get equal pseudonyms in every document, and
different values stay different.  E-mail addresses and secrets, which have no
numeric domain, get a keyed hash in the same shape; a secret is taken to its end.
Letters in an IBAN's account stay where they are.  Invalid candidates stay.

Round function: 60 bits of SHA-256 over key, domain, round and the other half.
The network adds it modulo ``a`` and ``b`` in turn, a permutation of [0, a*b).

Cases: null text stays null with no findings; texts are searched whole; equal
rows give equal output; an empty table gives an empty result; other columns
are not read.  Overlapping valid candidates: the leftmost, then the first kind,
then the longest wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import computed, let, table

KEY = "pseudonym-key-1"
ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
SECRET = (r"(?i:\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)\b[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)"
          r"[A-Za-z0-9_+/-]{16}[A-Za-z0-9_+/.~-]*(?<![.~])={0,2}")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]\d\d|\d{1,2})"
IP = rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_YEAR = r"(?:1[89]|2[01])\d{2}"
_LEAP = r"(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"
_DAYS = ((r"(?:0[13578]|1[02])", r"(?:0[1-9]|[12]\d|3[01])"), (r"(?:0[469]|11)", r"(?:0[1-9]|[12]\d|30)"), ("02", r"(?:0[1-9]|1\d|2[0-8])"))


def _year_last(sep: str) -> list[str]:
    """Dates 1800-2199 with the year last, month and day in either order."""
    both = [f"{a}{sep}{b}" for m, d in _DAYS for a, b in ((m, d), (d, m))]
    return [f"(?:{'|'.join(both)}){sep}{_YEAR}", f"(?:02{sep}29|29{sep}02){sep}{_LEAP}"]


_YEAR_FIRST = [f"{_YEAR}-{m}-{d}" for m, d in _DAYS] + [f"{_LEAP}-02-29"]
DATE = r"(?=\d\d[\d./])(?<![\d./-])(?:" + "|".join(_YEAR_FIRST + _year_last("/") + _year_last(r"\.")) + r")(?![./-]?\d)"
SSN = r"(?=\d)(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = (r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
         r"|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)")
# The patterns before, between and after a row's valid IBANs and cards.
_PARTS = ("|".join((EMAIL, SECRET)), "|".join((IP, DATE, SSN)), PHONE)
KINDS = ("email", "secret", "iban", "ip", "date", "ssn", "card", "phone")


def _prf(key: str, domain: str | Column, r: Column, x: Column) -> Column:
    dom = F.lit(domain) if isinstance(domain, str) else domain
    text = F.concat_ws("|", F.lit(key), dom, r.cast("string"), x.cast("string"))
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, domain, key: str = KEY, rounds: int = ROUNDS) -> Column:
    """struct<x, y>: keyed permutation of the pairs with 0 <= x < a and 0 <= y < b."""
    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(F.pmod(s["x"] + _prf(key, domain, r, s["y"]), a).alias("x"), s["y"].alias("y"))) \
            .otherwise(F.struct(s["x"].alias("x"), F.pmod(s["y"] + _prf(key, domain, r, s["x"]), b).alias("y")))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def feistel_digits(d: Column, domain: str, key: str = KEY) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 36)."""
    n = F.length(d)
    u = (n / 2).cast("int")
    v = n - u
    out = feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1, v), _ten(u), _ten(v),
                  F.concat(F.lit(domain), n.cast("string")), key)
    return let(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), u, "0"), F.lpad(s["y"].cast("string"), v, "0")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _fill(m: Column, d: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``d``."""
    def put(c: Column, i: Column) -> Column:
        before = F.length(_digits(F.substr(m, F.lit(1), i + 1)))
        return F.when(c.rlike(r"^\d$"), F.substr(d, before, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(m, ""), put), "")


def _luhn_sum(d: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    def add(acc, x):
        return acc + F.when((x["i"] % 2 == 1) & (x["v"] * 2 > 9), x["v"] * 2 - 9).when(x["i"] % 2 == 1, x["v"] * 2).otherwise(x["v"])
    back = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.struct(c.cast("int").alias("v"), i.alias("i")))
    return F.aggregate(back, F.lit(0), add)


def _mod97(text: Column) -> Column:
    """IBAN check: letters as 10..35, modulo 97."""
    s = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    num = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + num(c)) % 97).otherwise((a * 100 + num(c)) % 97))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("int"))


def _iso(m: Column) -> Column:
    """The date of a match, null if it is no calendar date in 1800-2199."""
    y_first = m.rlike(r"^\d{4}-")
    y = F.when(y_first, F.substr(m, F.lit(1), F.lit(4))).otherwise(F.substr(m, F.lit(7), F.lit(4)))
    p = F.when(y_first, F.substr(m, F.lit(6), F.lit(2))).otherwise(F.substr(m, F.lit(1), F.lit(2)))
    q = F.when(y_first, F.substr(m, F.lit(9), F.lit(2))).otherwise(F.substr(m, F.lit(4), F.lit(2)))
    d = F.coalesce(F.when(~y_first, F.try_to_date(F.concat_ws("-", y, q, p), "yyyy-MM-dd")),
                   F.try_to_date(F.concat_ws("-", y, p, q), "yyyy-MM-dd"))
    return F.when(F.year(d).between(1800, 2199), d)


def _shift_date(m: Column, key: str) -> Column:
    """A date permuted among the 146,097 = 189 x 773 days of 1800-2199."""
    d = _iso(m)
    n = F.datediff(d, F.lit("1800-01-01").cast("date"))
    out = feistel((n / 773).cast("long"), n % 773, F.lit(189), F.lit(773), "date", key)
    new = let(out, lambda s: F.date_add(F.lit("1800-01-01").cast("date"), (s["x"] * 773 + s["y"]).cast("int")))
    month_first = m.rlike(r"^\d{2}[/.]") & F.try_to_date(
        F.concat_ws("-", F.substr(m, F.lit(7)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))), "yyyy-MM-dd").isNull()
    sep = F.substr(m, F.lit(3), F.lit(1))
    dd, mm, yy = F.date_format(new, "dd"), F.date_format(new, "MM"), F.date_format(new, "yyyy")
    return F.when(m.rlike(r"^\d{4}-"), F.date_format(new, "yyyy-MM-dd")) \
        .when(month_first, F.concat(mm, sep, dd, sep, yy)).otherwise(F.concat(dd, sep, mm, sep, yy))


def _ip(m: Column, key: str) -> Column:
    o = _octets(m)
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ip", key)
    return let(out, lambda s: F.concat_ws(".", *(x.cast("int").cast("string") for x in (
        F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256))))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    area = F.substr(m, F.lit(1), F.lit(3)).cast("int")
    x = (F.when(area > 666, area - 2).otherwise(area - 1)) * 99 + F.substr(m, F.lit(5), F.lit(2)).cast("int") - 1
    out = feistel(x, F.substr(m, F.lit(8)).cast("int") - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)

    def text(s: Column) -> Column:
        k = F.floor(s["x"] / 99)
        area2 = F.when(k >= 665, k + 2).otherwise(k + 1)
        return F.concat_ws("-", F.lpad(area2.cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((s["y"] + 1).cast("string"), 4, "0"))
    return let(out, text)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        return let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _fill(m, let(_digits(m), new))


def _iban(m: Column, key: str) -> Column:
    """An IBAN with the digits of its account permuted, its letters in place."""
    plain = F.replace(m, F.lit(" "), F.lit(""))

    def new(s: Column) -> Column:
        body = F.substr(s, F.lit(5))

        def checked(d: Column) -> Column:
            zero = F.concat(F.substr(s, F.lit(1), F.lit(2)), F.lit("00"), _fill(body, d))
            return F.concat(F.lpad((98 - _mod97(zero)).cast("string"), 2, "0"), d)
        return let(feistel_digits(_digits(body), "iban", key), checked)
    return F.concat(F.substr(m, F.lit(1), F.lit(2)), _fill(F.substr(m, F.lit(3)), let(plain, new)))


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:\+\d{1,3}(?=[ .(-])|\+)?", 0)
    rest = F.substr(m, F.length(head) + 1)
    return F.concat(head, _fill(rest, feistel_digits(_digits(rest), "phone", key)))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), F.lit(1), F.lit(12)),
                    F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9_+/-]{16}[A-Za-z0-9_+/.~-]*={0,2})$", 1)
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value), 256)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), F.substr(F.repeat(h, (F.length(value) / 64).cast("int") + 1), F.lit(1), F.length(value)))


def _valid_iban(m: Column) -> Column:
    """15 to 34 characters, two digits or more after the check digits, and mod 97."""
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.length(s).between(15, 34) & (F.length(_digits(s)) >= 4) & (_mod97(s) == 1))


def _valid_card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(13, 19) & (_luhn_sum(d) % 10 == 0))


def _to_borders(run: Column) -> Column:
    """``run`` and its beginnings that end before a space or hyphen."""
    def upto(groups: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(groups)), lambda j: F.substr(run, F.lit(1), F.aggregate(
            F.slice(groups, F.lit(1), j), F.lit(-1), lambda n, g: n + F.length(g) + 1)))
    return let(F.split(run, "[ -]"), upto)


def _valid(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Distinct valid values at any start in ``text``, the longest first."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)))
    hits = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.filter(_to_borders(r), valid))))
    by_length = F.sort_array(F.transform(hits, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.transform(by_length, lambda s: s["x"])


def _pattern(ibans: Column, cards: Column) -> Column:
    """The pattern of a row with these valid IBANs and cards; each of its matches is valid."""
    def literal(before: str, values: Column, after: str) -> Column:
        some = F.concat(F.lit(f"|{before}(?:"), F.array_join(values, "|"), F.lit(f"){after}|"))
        return F.when(F.size(values) > 0, some).otherwise("|")
    return F.concat(F.lit(_PARTS[0]), literal("(?<![A-Za-z0-9])", ibans, "(?![A-Za-z0-9])"), F.lit(_PARTS[1]),
                    literal(r"(?<![\d.])", cards, r"(?!\d)"), F.lit(_PARTS[2]))


def kind_of(m: Column) -> Column:
    """Kind of a match of a row's pattern."""
    whole = lambda p: m.rlike("^(?:" + p + ")$")
    return (F.when(whole(EMAIL), "email")
            .when(whole(SECRET), "secret")
            .when(whole(IBAN), "iban")
            .when(whole(IP), "ip")
            .when(whole(DATE), "date")
            .when(whole(SSN), "ssn")
            .when(whole(CARD), "card")
            .when(whole(PHONE), "phone"))


def pseudonym(kind: Column, m: Column, key: str = KEY) -> Column:
    out = m
    for name, f in (("email", _email), ("secret", _secret), ("iban", _iban), ("ip", _ip), ("date", _shift_date),
                    ("ssn", _ssn), ("card", _card), ("phone", _phone)):
        out = F.when(kind == name, f(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """(doc_id, text, findings): the rewritten text, and kind, match and pseudonym of each finding."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.col("text")
    valid = computed(src, "doc_id", "text", _valid(text, IBAN, _valid_iban).alias("ibans"), _valid(text, CARD, _valid_card).alias("cards"))
    pattern = computed(valid, "doc_id", "text", _pattern(F.col("ibans"), F.col("cards")).alias("p"))
    found = computed(pattern, "doc_id", "text", F.regexp_extract_all("text", F.col("p"), F.lit(0)).alias("m"),
                     F.split("text", F.col("p"), -1).alias("gaps"))
    kinds = computed(found, "doc_id", "text", "gaps", F.transform("m", lambda x: F.struct(x.alias("match"), kind_of(x).alias("kind"))).alias("m"))
    new = computed(kinds, "doc_id", "text", "gaps", F.transform("m", lambda x: F.struct(
        x["kind"].alias("kind"), x["match"].alias("match"), pseudonym(x["kind"], x["match"], key).alias("pseudonym"))).alias("m"))
    joined = F.array_join(F.zip_with("gaps", "m", lambda g, x: F.concat(g, F.coalesce(x["pseudonym"], F.lit("")))), "")
    return computed(new, "doc_id", F.when(F.size("m") > 0, joined).otherwise(F.col("text")).alias("text"),
                    F.filter("m", lambda x: x["kind"].isNotNull()).alias("findings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    found = F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_found")
    return out.select("doc_id", found, *map(count, KINDS), "text")
