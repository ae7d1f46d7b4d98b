"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Personal values found in a text are validated and replaced by keyed permutations of themselves within
their own format, so that equal values get equal pseudonyms in every document and two values of a kind
never get the same one:

* card numbers (13 to 19 digits, bare or in fours, that pass the Luhn test): all digits but the last are
  permuted, the last is the new check digit; other bare numbers stay;
* phone numbers: their digits are permuted, signs and spaces stay, and so does the country code behind a
  plus sign;
* IPv4 addresses whose parts are 0 to 255: permuted within the 32 bits, again four parts of 0 to 255;
* dates (ISO order or day, month, year with one separator, 1900 to 2099) that exist: permuted within the
  existing dates of those two centuries, in the same layout;
* e-mail addresses: the letters and digits of the local part and of the host's first label are permuted
  class by class, the rest of the host stays;
* secrets (``key|token|secret|password`` and a quoted or bare value of 16 hexadecimal digits or more):
  the value's hexadecimal digits are permuted.

The Feistel network alternates two halves over ``ROUNDS`` rounds with a keyed SHA-256 round function. The
result is a projection of the scan: no shuffle, no state, the same in every executor.

Edge cases: null text stays null and counts 0; empty text stays empty; values that fail validation (a
date such as 2021-02-30, an address part of 300, a number that fails the Luhn test) stay as they are; overlapping candidates go to the
leftmost, then to the kind named first in ``KINDS``. Further columns of any name pass through. A text is
scanned in time in proportion to its length, whatever it holds: runs are tried from their start only, and
no part of the pattern gives back what it has read.

The key is a parameter without a default. Whoever has it can undo the pseudonyms, and Spark writes it into
plans and event logs like any literal, so those need the protection that the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import fresh

ROUNDS = 8

#: One alternative for each kind, tried in this order at every position.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?:(?i)\b(?:key|token|secret|password)\b[ \t]*+[=:][ \t]*+)[\"']?+[0-9A-Fa-f]{16,}+[\"']?+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "number": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# fixed values: country codes of one and two digits (ITU E.164); the others have three
COUNTRY = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
DATE_FIRST, DATE_DAYS = "1900-01-01", 73049
#: Sides of the date domain's Feistel square, which has a few more cells than there are days.
DATE_SIDES = (271, 270)
#: A walk leaves the surplus cells with this many steps but for a chance below 2**-500.
DATE_WALK = 64


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _prf(key: str, tag: Column, half: Column) -> Column:
    """A keyed 60-bit number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _feistel(a: Column, b: Column, size_a: Column, size_b: Column, tag: Column, key: str) -> Column:
    """Struct (a, b): a keyed permutation of [0, size_a) x [0, size_b); the number of rounds is even."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own = F.concat_ws(":", tag, i.cast("string"))
        new_a = F.when(even, F.pmod(s["a"] + F.pmod(_prf(key, own, s["b"]), size_a), size_a)).otherwise(s["a"])
        new_b = F.when(even, s["b"]).otherwise(F.pmod(s["b"] + F.pmod(_prf(key, own, s["a"]), size_b), size_b))
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(s: Column, tag: str, key: str) -> Column:
    """Permutes a string of 2 to 36 decimal digits within its length; one digit is shifted by a secret."""
    n = F.length(s)
    left = F.floor(n / 2).cast("int")
    right = n - left
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    mixed = _feistel(s.substr(F.lit(1), left), s.substr(left + 1, right), ten(left), ten(right), F.concat_ws(":", F.lit(tag), n.cast("string")), key)
    two = _let(mixed, lambda m: F.concat(F.lpad(m["a"].cast("string"), left, "0"), F.lpad(m["b"].cast("string"), right, "0")))
    one = F.pmod(s.cast("bigint") + _prf(key, F.lit(tag), F.lit("1")), F.lit(10)).cast("string")
    return F.when(n >= 2, two).when(n == 1, one).otherwise(s)


def _luhn_sum(s: Column, doubled_parity: int) -> Column:
    """Luhn sum; digits at an odd distance (or even, for a number without its check digit) count double."""
    digits = F.split(F.reverse(s), "")
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == doubled_parity, F.pmod(2 * d.cast("int") - 1, F.lit(9)) + F.when(d == "0", -8).otherwise(1)).otherwise(d.cast("int"))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )


def luhn_valid(s: Column) -> Column:
    return F.length(s).between(13, 19) & (F.pmod(_luhn_sum(s, 1), F.lit(10)) == 0)


def _fill(layout: Column, digits: Column) -> Column:
    """Puts ``digits`` one by one in the place of the digits of ``layout``."""
    parts = F.transform(F.split(F.regexp_replace(layout, "[0-9]", "\u0001#"), "\u0001"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(digits.substr(i, F.lit(1)), p.substr(F.lit(2), F.length(p)))))
    return F.array_join(parts, "")


def _number(s: Column, key: str) -> Column:
    def by_digits(d: Column) -> Column:
        body = d.substr(F.lit(1), F.length(d) - 1)
        card = _let(_digits(body, "card", key), lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 0), F.lit(10)).cast("string")))
        return F.when(luhn_valid(d), card).otherwise(d)

    return _let(F.regexp_replace(s, "[^0-9]", ""), lambda d: _fill(s, by_digits(d)))


def _phone(s: Column, key: str) -> Column:
    marked = F.regexp_extract(s, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    prefix = F.when(F.length(marked) > 0, marked).otherwise(F.regexp_extract(s, COUNTRY, 0))
    rest = s.substr(F.length(prefix) + 1, F.length(s))
    return F.concat(prefix, _let(rest, lambda r: _fill(r, _digits(F.regexp_replace(r, "[^0-9]", ""), "phone", key))))


def _ip(s: Column, key: str) -> Column:
    def put(p: Column) -> Column:
        byte = lambda i: p[i].cast("int")
        ok = (byte(0) <= 255) & (byte(1) <= 255) & (byte(2) <= 255) & (byte(3) <= 255)
        mixed = _feistel(byte(0) * 256 + byte(1), byte(2) * 256 + byte(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
        text = _let(
            mixed,
            lambda m: F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (F.floor(m["a"] / 256), m["a"] % 256, F.floor(m["b"] / 256), m["b"] % 256)]),
        )
        return F.when(ok, text).otherwise(s)

    return _let(F.split(s, r"\."), put)


def _date(s: Column, key: str) -> Column:
    iso = s.rlike("^[0-9]{4}")
    y = F.when(iso, s.substr(1, 4)).otherwise(s.substr(7, 4))
    m = F.when(iso, s.substr(6, 2)).otherwise(s.substr(4, 2))
    d = F.when(iso, s.substr(9, 2)).otherwise(s.substr(1, 2))
    sep = F.when(iso, s.substr(5, 1)).otherwise(s.substr(3, 1))
    day = F.datediff(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"), F.to_date(F.lit(DATE_FIRST)))
    a, b = DATE_SIDES

    def walk(x: Column, i: Column) -> Column:
        cell = _let(_feistel(F.floor(x["n"] / b), x["n"] % b, F.lit(a), F.lit(b), F.lit("date"), key), lambda c: c["a"] * b + c["b"])
        more = (i == 0) | (x["n"] >= DATE_DAYS)
        return F.when(more, F.struct(cell.alias("n"))).otherwise(x)

    def put(n: Column) -> Column:
        new = F.aggregate(F.sequence(F.lit(0), F.lit(DATE_WALK)), F.struct(n.cast("bigint").alias("n")), walk)["n"]
        out = F.date_add(F.to_date(F.lit(DATE_FIRST)), new.cast("int"))
        text = _let(
            out,
            lambda o: F.when(iso, F.concat_ws("", F.date_format(o, "yyyy"), sep, F.date_format(o, "MM"), sep, F.date_format(o, "dd"))).otherwise(
                F.concat_ws("", F.date_format(o, "dd"), sep, F.date_format(o, "MM"), sep, F.date_format(o, "yyyy"))
            ),
        )
        return F.when(n.between(0, DATE_DAYS - 1), text).otherwise(s)

    return _let(day, put)


def _by_class(s: Column, tag: str, alphabet: str, key: str) -> Column:
    """Permutes each character within its class: a Feistel network on the two halves of the string.

    In each of four rounds the characters of one half are shifted within their class by keyed hashes of
    the other half's digest; characters of no class stay.
    """
    classes = {"hex": ("0123456789abcdef",), "upper_hex": ("0123456789ABCDEF",), "word": ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}[alphabet]

    def shift(part: Column, by: Column, own: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            k = _prf(key, F.concat_ws(":", F.lit(tag), own, i.cast("string")), by)
            out = c
            for chars in classes:
                at = F.instr(F.lit(chars), c)
                out = F.when((at > 0) & (F.length(c) == 1), F.lit(chars).substr(F.pmod(at - 1 + k, F.lit(len(chars))).cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(part, ""), one), "")

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("a"), s.substr(half + 1, F.length(s)).alias("b"))

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        own = i.cast("string")
        other = F.sha2(F.when(even, x["b"]).otherwise(x["a"]), 256)
        return _let(
            other,
            lambda h: F.struct(F.when(even, shift(x["a"], h, own)).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(shift(x["b"], h, own)).alias("b")),
        )

    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step), lambda x: F.concat(x["a"], x["b"]))


def _email(s: Column, key: str) -> Column:
    local = F.regexp_extract(s, r"^([^@]+)@([A-Za-z0-9-]+)", 1)
    host = F.regexp_extract(s, r"^([^@]+)@([A-Za-z0-9-]+)", 2)
    rest = s.substr(F.length(local) + F.length(host) + 2, F.length(s))
    return F.concat(_by_class(local, "email", "word", key), F.lit("@"), _by_class(host, "host", "word", key), rest)


def _secret(s: Column, key: str) -> Column:
    value = F.regexp_extract(s, "([0-9A-Fa-f]{16,})[\"']?$", 1)
    quote = F.regexp_extract(s, "[0-9A-Fa-f]{16,}([\"']?)$", 1)
    head = s.substr(F.lit(1), F.length(s) - F.length(value) - F.length(quote))
    new = (
        F.when(value.rlike("^[0-9a-f]+$"), _by_class(value, "secret", "hex", key))
        .when(value.rlike("^[0-9A-F]+$"), _by_class(value, "secret", "upper_hex", key))
        .otherwise(_by_class(value, "secret", "word", key))
    )
    return F.concat(head, new, quote)


def kind_of(s: Column) -> Column:
    out = F.lit("number")
    for name in ("phone", "number", "date", "ip", "secret", "email"):
        out = F.when(s.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(s: Column, key: str) -> Column:
    """The replacement of one found value."""
    make = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "phone": _phone}
    return _let(
        kind_of(s),
        lambda k: F.when(k == "email", make["email"](s, key))
        .when(k == "secret", make["secret"](s, key))
        .when(k == "ip", make["ip"](s, key))
        .when(k == "date", make["date"](s, key))
        .when(k == "phone", make["phone"](s, key))
        .otherwise(_number(s, key)),
    )


def replaced(text: Column, key: str) -> Column:
    """``text`` with the pseudonyms in place, and the number of values that changed."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def swap(hits: Column) -> Column:
        parts = F.split(text, PATTERN, -1)
        new = F.transform(hits, lambda s: pseudonym(s, key))
        return _let(
            F.struct(parts.alias("p"), new.alias("n")),
            lambda x: F.struct(
                F.array_join(F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.get(x["n"], i), F.lit("")))), "").alias("text"),
                F.size(F.filter(F.arrays_zip(hits.alias("old"), x["n"].alias("new")), lambda z: z["old"] != z["new"])).cast("long").alias("n"),
            ),
        )

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    likely = text.rlike("[0-9]|@")
    return F.when(likely, _let(found, lambda hits: F.when(F.size(hits) > 0, swap(hits)).otherwise(plain))).otherwise(plain)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonymised texts, same columns; ``n_chars``, if there, is counted anew."""
    name = fresh("pii", docs.columns)
    inner = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], replaced(F.col("text"), key).alias(name))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col(f"{name}.n") > 0, F.length(F.col(f"{name}.text")).cast(kind)).otherwise(F.col("n_chars"))
    return inner.select(*[v.alias(c) for c, v in out.items()])


def pseudonym_table(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text and n_replaced for every document."""
    inner = docs.select("doc_id", replaced(F.col("text"), key).alias("r"))
    return inner.select("doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("n_replaced"))
