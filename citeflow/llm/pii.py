"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel network, so the same value has the
same pseudonym in every document and a pseudonym is again a valid value. The domain of each kind is a product of two
ranges ``Z_a x Z_b``; rounds add a keyed hash of one half to the other, modulo that half's range. This is a bijection
for any ``a`` and ``b``, so no cycle walking is needed. E-mail names are permuted letter by letter in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: What may be personal data, most specific first; none can start or end inside a longer word or number. An address has
#: at most 1024 characters before the @ (the mail standard says 64; longer ones are masked as well, but not without bound, as
#: a name is permuted letter by letter) and 127 labels after it, as the name standard says; so no repetition of a group is
#: unbounded, which Java's matcher would follow by recursion.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,1023}+@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "card": r"(?<![\w-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w-])",
}
ANY = "|".join(KINDS.values())
#: Days from 1800-01-01 to 2199-12-31, one cycle of the calendar: 189 x 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Those of them after the 12th of a month, in 4800 months: 9 x 9833.
LATE_DAYS, MONTHS = (9, 9833), 4800
_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _hash(key: Column, *parts: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column | int, b: Column | int, key: Column, rounds: int = ROUNDS, back: bool = False) -> Column:
    """A keyed permutation of ``Z_a x Z_b`` applied to (x, y), or undone: a struct of x and y."""
    a, b = (F.lit(v) if isinstance(v, int) else v for v in (a, b))
    sign = -1 if back else 1

    def one(acc: Column, r: Column) -> Column:
        left = F.pmod(acc["x"] + sign * F.pmod(_hash(key, r, acc["y"]), acc["a"]), acc["a"])
        right = F.pmod(acc["y"] + sign * F.pmod(_hash(key, r, acc["x"]), acc["b"]), acc["b"])
        even = r % 2 == 0
        return F.struct(F.when(even, left).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise(right).alias("y"), acc["a"].alias("a"), acc["b"].alias("b"))

    order = list(range(rounds))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(r) for r in (order[::-1] if back else order)]), start, one)


def _bind(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _digits(s: Column, key: Column, back: bool) -> Column:
    """Permute a string of 2 to 18 digits among those of its length."""
    n = F.length(s)
    half = F.floor(n / 2).cast("int")
    tens = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    both = feistel(F.substring(s, F.lit(1), half).cast("long"), F.substring(s, half + 1, n).cast("long"), tens(half), tens(n - half), F.concat(key, n.cast("string")), back=back)
    return _bind(both, lambda z: F.concat(F.lpad(z["x"].cast("string"), half, "0"), F.lpad(z["y"].cast("string"), n - half, "0")))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda t, d: t + F.coalesce(d, F.lit(0)))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        own = c.rlike(r"^\d$")
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + own.cast("int")).alias("at"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, put)["out"]


def _card(s: Column, key: Column, back: bool) -> Column:
    body = F.substring(only_digits(s), F.lit(1), F.length(only_digits(s)) - 1)

    def checked(d: Column) -> Column:
        return F.concat(d, F.pmod(-luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)).cast("string"))

    return _bind(_bind(_digits(body, key, back), checked), lambda d: _refill(s, d))


def _phone(s: Column, key: Column, back: bool) -> Column:
    """Area codes and exchanges below 200 stay below, others stay from 200 on; a country code stays."""
    national = F.substring(only_digits(s), -10, 10)
    prefix = F.substring(only_digits(s), F.lit(1), F.length(only_digits(s)) - 10)

    def moved(v: Column) -> Column:
        low = [F.when(v[h] < 200, 0).otherwise(200) for h in ("area", "exchange")]
        size = [F.when(v[h] < 200, 200).otherwise(800) for h in ("area", "exchange")]
        x, y = v["area"] - low[0], (v["exchange"] - low[1]) * 10_000 + v["line"]
        shown = lambda z: F.concat(prefix, F.format_string("%03d%03d%04d", z["x"] + low[0], F.floor(z["y"] / 10_000) + low[1], z["y"] % 10_000))
        return _bind(feistel(x, y, size[0], size[1] * 10_000, key, back=back), shown)

    part = lambda at, n, name: F.substring(national, at, n).cast("long").alias(name)
    return _bind(_bind(F.struct(part(1, 3, "area"), part(4, 3, "exchange"), part(7, 4, "line")), moved), lambda d: _refill(s, d))


def _ip(s: Column, key: Column, back: bool) -> Column:
    o = F.transform(F.split(s, r"\."), lambda c: c.cast("long"))
    shown = lambda z: F.concat_ws(".", *[F.floor(z[h] / d) % 256 for h in ("x", "y") for d in (256, 1)])
    return _bind(o, lambda v: _bind(feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], 65_536, 65_536, key, back=back), shown))


def _ssn(s: Column, key: Column, back: bool) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area = F.substring(s, 1, 3).cast("long")
    x = area - F.when(area > 666, 2).otherwise(1)
    y = (F.substring(s, 5, 2).cast("long") - 1) * 9_999 + F.substring(s, 8, 4).cast("long") - 1

    def shown(z: Column) -> Column:
        a = z["x"] + F.when(z["x"] >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", a, F.floor(z["y"] / 9_999) + 1, z["y"] % 9_999 + 1)

    return _bind(feistel(x, y, 898, 99 * 9_999, key, back=back), shown)


def _make_date(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), zero, zero, zero).cast("date")


def _is_iso(s: Column) -> Column:
    return F.substring(s, 5, 1) == "-"


def _day_first(s: Column) -> Column:
    """The date of a match with the year first, or with the day before the month."""
    parts, iso = F.split(s, r"[-/.]"), _is_iso(s)
    return F.when(iso, _make_date(parts[0], parts[1], parts[2])).otherwise(_make_date(parts[2], parts[1], parts[0]))


def as_date(s: Column) -> Column:
    """The date that a match names, or null if there is none. Where the year comes last the day is before the month, or
    after it where that is no date."""
    parts = F.split(s, r"[-/.]")
    return F.coalesce(_day_first(s), F.when(~_is_iso(s), _make_date(parts[2], parts[0], parts[1])))


def _late_rank(day: Column) -> Column:
    """The place of a day after the 12th among such days."""
    first = F.lit(FIRST_DAY).cast("date")
    months = (F.year(day) - F.year(first)) * 12 + F.month(day)
    return F.datediff(day, first) - 12 * months


def _late_day(rank: Column) -> Column:
    """The day at a place among those after the 12th."""
    first = F.lit(FIRST_DAY).cast("date")
    before = lambda m: F.datediff(F.add_months(first, m.cast("int")), first) - 12 * m
    near = F.floor(rank * MONTHS / (LATE_DAYS[0] * LATE_DAYS[1]))
    month = F.array_max(F.filter(F.array(near - 1, near, near + 1), lambda m: (m >= 0) & (m < MONTHS) & (before(m) <= rank)))
    return _bind(month, lambda m: F.date_add(F.add_months(first, m.cast("int")), (rank - before(m) + 12).cast("int")))


def _date(s: Column, key: Column, back: bool) -> Column:
    """Dates with the month first, whose day is after the 12th, are permuted among themselves."""
    first = F.lit(FIRST_DAY).cast("date")

    def written(new: Column, *order: str) -> Column:
        parts = [F.date_format(new, p) for p in order]
        return F.when(F.contains(s, F.lit("/")), F.concat_ws("/", *parts)).otherwise(F.concat_ws(".", *parts))

    def moved(n: Column, domain: tuple[int, int], own: Column) -> Column:
        a, b = domain
        return _bind(n, lambda d: _bind(feistel(F.floor(d / b), d % b, a, b, own, back=back), lambda z: z["x"] * b + z["y"]))

    def shown(new: Column) -> Column:
        return F.when(_is_iso(s), F.date_format(new, "yyyy-MM-dd")).otherwise(written(new, "dd", "MM", "yyyy"))

    usual = _bind(moved(F.datediff(_day_first(s), first), DAYS, key), lambda n: _bind(F.date_add(first, n.cast("int")), shown))
    late = _bind(moved(_late_rank(as_date(s)), LATE_DAYS, F.concat(key, F.lit("late"))), lambda n: _bind(_late_day(n), lambda d: written(d, "MM", "dd", "yyyy")))
    return F.when(_day_first(s).isNotNull(), usual).otherwise(late)


def _email(s: Column, key: Column, back: bool) -> Column:
    """The name before the @ is permuted among the names of its shape: letters stay letters, digits digits."""
    name, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    sign = -1 if back else 1

    def moved(part: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = _hash(key, r, other, i)
            out = c
            for letters in _LETTERS:
                at = F.instr(F.lit(letters), c)
                out = F.when(at > 0, F.substring(F.lit(letters), (F.pmod(at - 1 + sign * F.pmod(shift, F.lit(len(letters))), F.lit(len(letters))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")

    def one(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, moved(acc["x"], acc["y"], r)).otherwise(acc["x"]).alias("x"), F.when(even, acc["y"]).otherwise(moved(acc["y"], acc["x"], r)).alias("y"))

    half = F.ceil(F.length(name) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), half).alias("x"), F.substring(name, half + 1, F.length(name)).alias("y"))
    rounds = list(range(ROUNDS))
    both = F.aggregate(F.array(*[F.lit(r) for r in (rounds[::-1] if back else rounds)]), start, one)
    return F.concat(_bind(both, lambda z: F.concat(z["x"], z["y"])), F.lit("@"), host)


def kind_of(s: Column) -> Column:
    """The kind of a match after validation, or null: cards need a Luhn sum of 0, dates a real day of 1800 to 2199."""
    day = as_date(s)
    valid = {
        "card": (luhn_sum(only_digits(s)) % 10 == 0) & ~only_digits(s).rlike("^0+$"),
        "date": day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        is_kind = s.rlike(f"^(?:{KINDS[kind]})$")
        out = F.when(is_kind, F.when(valid[kind], F.lit(kind)) if kind in valid else F.lit(kind)).otherwise(out)
    return out


def pseudonym(s: Column, kind: Column, key: Column, back: bool = False) -> Column:
    """The value that stands for ``s``, of the same kind and format; ``back`` recovers ``s``. Dates are written with
    two-digit days and months."""
    how = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}
    out = s
    for k, f in how.items():
        out = F.when(kind == k, f(s, F.concat(key, F.lit(k)), back)).otherwise(out)
    return out


def mask(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """One row per document: doc_id, text (with pseudonyms), n_private, found (array of kind and pseudonym, in order).

    ``key`` is a secret of the caller's. A null text stays null; texts without personal data are unchanged; numbers
    and dates that don't validate stay. Repeated rows get a row each, other columns are not read, an empty table gives
    no rows. Narrow: no shuffle and no Python. A text is worked on whole by its task; memory grows with its length and
    its number of matches, and no match is longer than some thousand characters.
    """
    k = F.lit(key)
    text = F.col("text").cast("string")
    some = docs.select("doc_id", text.alias("text"), F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).alias("hits"))
    kinds = some.withColumn("kinds", F.transform("hits", kind_of))
    new = kinds.withColumn("new", F.zip_with("hits", "kinds", lambda s, q: pseudonym(s, q, k, back)))
    gaps = F.split("text", ANY)
    woven = F.array_join(F.zip_with(gaps, "new", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    found = F.filter(F.zip_with("kinds", "new", lambda q, s: F.struct(q.alias("kind"), s.alias("pseudonym"))), lambda z: z["kind"].isNotNull())
    any_hit = F.coalesce(F.size("hits"), F.lit(0)) > 0
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    out = new.select("doc_id", F.when(any_hit, woven).otherwise(F.col("text")).alias("text"), F.when(any_hit, found).otherwise(empty).alias("found"))
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_private"), "found")
