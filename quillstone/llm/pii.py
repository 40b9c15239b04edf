"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame expressions.

Found and validated: payment-card numbers (Luhn), IBANs (mod 97), social
security numbers, telephone numbers, IPv4 addresses and dates; e-mail addresses
get a keyed pseudonym of the local part.  A value is read as a pair (a, b) with
a < m and b < n; rounds add a keyed hash of one half to the other, modulo its
size, which permutes all pairs.  Walking repeats the permutation until the value
is valid again.  Check digits are computed anew, separators stay.  Equal values
have equal pseudonyms in every document, whatever their separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of the IBANs of countries.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_NATIONAL = "|".join(c for names in IBAN_SIZES.values() for c in names.split())
#: What a group of a card number or an IBAN must not begin: a value of another kind stands there.
_NEXT = r"(?!(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9])|(?:" + _NATIONAL + r")[0-9]{2} ?[A-Z0-9]{4})"
_IBAN_GROUP = f"(?: {_NEXT}[A-Z0-9]{{4}}|[A-Z0-9]{{4}})"


def _national(size: int, names: str) -> str:
    groups, left = divmod(size - 4, 4)
    return f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{left}}}" if left else "")


#: The shapes of what is looked for.  Groups of four digits are found as whole runs, in which cards() looks.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?){1,8}",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(_national(n, c) for n, c in IBAN_SIZES.items()) + "|[A-Z]{2}[0-9]{2}" + _IBAN_GROUP + "{2,7}(?: " + _NEXT + "[A-Z0-9]{1,3}|[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{8,15}|\+[0-9]{1,3}(?:[ .-]\(?[0-9]{2,4}\)?){2,4})(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: " + _NEXT + r"[0-9]{4}){2,}(?: " + _NEXT + r"[0-9]{1,3})?|[0-9]{4}(?:-[0-9]{4}){2,}(?:-[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Days that dates are permuted among: from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = "1900-01-01", 73_049


def _hash(key: str, tweak: str, round_: Column, half: Column) -> Column:
    text = F.concat(F.lit(f"{key}\x1f{tweak}\x1f"), round_.cast("string"), F.lit("\x1f"), half.cast("string"))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the pairs a < m, b < n, as a struct (a, b)."""

    def step(acc: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(((acc["a"] + _hash(key, tweak, i, acc["b"])) % m).alias("a"), acc["b"].alias("b")),
        ).otherwise(F.struct(acc["a"].alias("a"), ((acc["b"] + _hash(key, tweak, i, acc["a"])) % n).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """2 to 34 digits permuted among the strings of as many digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    halves = F.struct(digits.substr(F.lit(1), u).cast("long").alias("a"), digits.substr(u + 1, v).cast("long").alias("b"), u.alias("u"), v.alias("v"))
    walked = F.transform(F.array(halves), lambda h: F.struct(feistel(h["a"], h["b"], _power(h["u"]), _power(h["v"]), key, tweak).alias("p"), h["u"].alias("u"), h["v"].alias("v")))
    return F.transform(walked, lambda w: F.concat(F.lpad(w["p"]["a"].cast("string"), w["u"], "0"), F.lpad(w["p"]["b"].cast("string"), w["v"], "0")))[0]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def walk(start: Column, move, valid, most: int = 64) -> Column:
    """``move`` once, then again while the value is not ``valid``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), move(start), lambda acc, _: F.when(valid(acc), acc).otherwise(move(acc)))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def pour(layout: Column, digits: Column) -> Column:
    """The digits, in order, put where the layout has digits."""
    place = F.sequence(F.lit(1), F.length(layout))
    return F.array_join(
        F.transform(place, lambda i: F.when(layout.substr(i, F.lit(1)).rlike("[0-9]"), digits.substr(F.length(only_digits(layout.substr(F.lit(1), i))), F.lit(1))).otherwise(layout.substr(i, F.lit(1)))), ""
    )


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; the digit at distance d from the end is doubled if d % 2 == doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def valid_card(x: Column) -> Column:
    d = only_digits(x)
    return F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0)


def card(x: Column, key: str) -> Column:
    d = only_digits(x)
    body = permute_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card")
    return let(body, lambda p: pour(x, F.concat(p, ((10 - luhn_sum(p, 0) % 10) % 10).cast("string"))))


def _mod97(text: Column) -> Column:
    """An alphanumeric string, letters as 10 to 35, modulo 97."""

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(text.substr(i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _compact(x: Column) -> Column:
    return F.regexp_replace(x, " ", "")


def valid_iban(x: Column) -> Column:
    c = _compact(x)
    return F.length(c).between(15, 34) & (_mod97(F.concat(c.substr(F.lit(5), F.length(c)), c.substr(1, 4))) == 1) & (F.length(only_digits(c)) >= 4)


def iban(x: Column, key: str) -> Column:
    """The digits of the account part are permuted; check digits are computed anew."""

    def build(c: Column) -> Column:
        account = c.substr(F.lit(5), F.length(c))
        fresh = F.when(F.length(only_digits(account)) >= 2, pour(account, permute_digits(only_digits(account), key, "iban"))).otherwise(account)
        return let(fresh, lambda a: F.concat(c.substr(1, 2), F.lpad((98 - _mod97(F.concat(a, c.substr(1, 2), F.lit("00")))).cast("string"), 2, "0"), a))

    def spaced(whole: Column) -> Column:
        place = F.sequence(F.lit(1), F.length(x))
        return F.array_join(F.transform(place, lambda i: F.when(x.substr(i, F.lit(1)) == " ", F.lit(" ")).otherwise(whole.substr(F.length(_compact(x.substr(F.lit(1), i))), F.lit(1)))), "")

    return let(let(_compact(x), build), spaced)


def valid_ssn(d: Column) -> Column:
    return ~d.substr(1, 3).isin("000", "666") & (d.substr(1, 1) != "9") & (d.substr(4, 2) != "00") & (d.substr(6, 4) != "0000")


def ssn(x: Column, key: str) -> Column:
    return let(walk(only_digits(x), lambda d: permute_digits(d, key, "ssn"), valid_ssn), lambda p: pour(x, p))


def phone(x: Column, key: str) -> Column:
    """The last ten digits are permuted, or all but the first of a shorter international number."""
    d = only_digits(x)
    n = F.length(d)
    moved = F.when(x.startswith("+"), F.least(F.lit(10), n - 1)).otherwise(n)
    return let(permute_digits(d.substr(n - moved + 1, moved), key, "phone"), lambda p: pour(x, F.concat(d.substr(F.lit(1), n - moved), p)))


def valid_ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | (o.substr(1, 1) != "0")))


def ip(x: Column, key: str) -> Column:
    o = F.split(x, r"\.")
    pair = feistel(o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), F.lit(65536), F.lit(65536), key, "ip")
    return let(pair, lambda p: F.concat_ws(".", *[F.shiftright(p[h], s).bitwiseAND(F.lit(255)).cast("string") for h in "ab" for s in (8, 0)]))


#: The date shapes that are tried, in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")


def _date_at(x: Column, fmt: str) -> Column:
    """The date that ``x`` writes in a format; null where the shape or the calendar says no."""
    order = {"yyyy-MM-dd": (1, 6, 9), "MM/dd/yyyy": (7, 1, 4), "dd/MM/yyyy": (7, 4, 1), "dd.MM.yyyy": (7, 4, 1)}[fmt]
    mark = {"-": F.lit(5), "/": F.lit(3), ".": F.lit(3)}[next(c for c in fmt if not c.isalpha())]
    text = F.concat_ws("-", x.substr(order[0], 4), x.substr(order[1], 2), x.substr(order[2], 2))
    return F.when(x.substr(mark, F.lit(1)) == next(c for c in fmt if not c.isalpha()), F.try_to_date(text, "yyyy-MM-dd"))


def date_read(x: Column) -> Column:
    """(days since FIRST_DAY, shape) where ``x`` is a date that is permuted, else null days."""
    tries = [F.struct(F.datediff(_date_at(x, f), F.lit(FIRST_DAY).cast("date")).alias("days"), F.lit(i).alias("shape")) for i, f in enumerate(DATE_FORMATS)]
    return F.get(F.filter(F.array(*tries), lambda t: t["days"].between(0, DAYS - 1)), F.lit(0))


def date(x: Column, key: str) -> Column:
    m, n = 271, 270  # m * n is the least such product over DAYS

    def move(day: Column) -> Column:
        return let(feistel(F.floor(day / n), day % n, F.lit(m), F.lit(n), key, "date"), lambda p: p["a"] * n + p["b"])

    def written(t: Column) -> Column:
        fresh = walk(t["days"].cast("long"), move, lambda d: d < DAYS)
        iso = F.date_add(F.lit(FIRST_DAY).cast("date"), fresh.cast("int")).cast("string")

        def shaped(s: Column) -> Column:
            y, mm, d = s.substr(1, 4), s.substr(6, 2), s.substr(9, 2)
            return F.when(t["shape"] == 0, s).when(t["shape"] == 1, F.concat_ws("/", mm, d, y)).when(t["shape"] == 2, F.concat_ws("/", d, mm, y)).otherwise(F.concat_ws(".", d, mm, y))

        return let(iso, shaped)

    return let(date_read(x), written)


def email(x: Column, key: str) -> Column:
    """A keyed pseudonym of the local part, at the same domain."""
    at = F.instr(x, "@")
    return F.concat(F.lit("user."), F.substring(F.sha2(F.encode(F.concat(F.lit(f"{key}\x1femail\x1f"), F.lower(x)), "UTF-8"), 256), 1, 16), x.substr(at, F.length(x)))


def kind(x: Column) -> Column:
    """Which validated kind a found string is; null: none, it stays as it is."""
    full = {k: x.rlike(f"^(?:{p})$") for k, p in SHAPES.items()}
    return (
        F.when(F.instr(x, "@") > 0, "email")
        .when(full["ip"] & valid_ip(x), "ip")
        .when(full["date"] & date_read(x)["days"].isNotNull(), "date")
        .when(full["ssn"] & valid_ssn(only_digits(x)), "ssn")
        .when(full["card"] & valid_card(x), "card")
        .when(full["phone"] & F.length(only_digits(x)).between(8, 15), "phone")
        .when(full["iban"] & valid_iban(x), "iban")
    )


def pseudonym(x: Column, of: Column, key: str) -> Column:
    made = {"email": email, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone, "iban": iban}
    out = x
    for k, f in made.items():
        out = F.when(of == k, f(x, key)).otherwise(out)
    return out


#: What a found string may begin with, the longest first.
CARD_STARTS = [f"^[0-9]{{4}}(?:{m}[0-9]{{4}}){{{n}}}{t}(?![0-9A-Za-z])" for n, tail in ((3, True), (3, False), (2, True)) for m in " -" for t in [f"{m}[0-9]{{1,3}}" if tail else ""]]
IBAN_STARTS = [f"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{t}(?![A-Za-z0-9])" for n in range(7, 1, -1) for t in (" ?[A-Z0-9]{1,3}", "")]


def _start(x: Column, shapes: list[str], valid) -> Column:
    """The longest valid value that ``x`` begins with; null: none."""
    tries = F.array(*[F.regexp_extract(x, p, 0) for p in shapes])
    return F.get(F.filter(tries, lambda t: (t != "") & valid(t)), F.lit(0))


def cards(x: Column, key: str) -> Column:
    """(kinds, value) of a run of groups of digits: at each group the longest valid card number, else the group stays."""
    nothing = F.struct(x.alias("rest"), F.lit("").alias("value"), F.array().cast("array<string>").alias("kinds"))

    def step(acc: Column, _: Column) -> Column:
        def moved(found: Column) -> Column:
            n = F.length(found)
            plain = F.regexp_extract(acc["rest"], "^(?:[0-9]+|[ -])", 0)
            hit = F.struct(acc["rest"].substr(n + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["value"], card(found, key)).alias("value"), F.concat(acc["kinds"], F.array(F.lit("card"))).alias("kinds"))
            miss = F.struct(acc["rest"].substr(F.length(plain) + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["value"], plain).alias("value"), acc["kinds"].alias("kinds"))
            return F.when(n > 0, hit).otherwise(miss)

        return let(_start(acc["rest"], CARD_STARTS, valid_card), moved)

    places = F.sequence(F.lit(1), F.length(F.regexp_replace(x, "[0-9]", "")) * 2 + 1)
    return F.aggregate(places, nothing, step, lambda acc: F.struct(acc["kinds"].alias("kinds"), acc["value"].alias("value")))


def rewritten(x: Column, key: str) -> Column:
    """(kinds, value) of a found string; where it is not valid as a whole, of the valid values in it."""

    def whole(k: Column) -> Column:
        begun = let(_start(x, IBAN_STARTS, valid_iban), lambda b: F.struct(F.when(b.isNotNull(), F.array(F.lit("iban"))).otherwise(F.array().cast("array<string>")).alias("kinds"), F.when(b.isNotNull(), F.concat(iban(b, key), x.substr(F.length(b) + 1, F.length(x)))).otherwise(x).alias("value")))
        return (
            F.when(k.isNotNull(), F.struct(F.array(k).alias("kinds"), pseudonym(x, k, key).alias("value")))
            .when(x.rlike("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"), cards(x, key))
            .when(x.rlike("^[A-Z]{2}[0-9]{2}"), begun)
            .otherwise(F.struct(F.array().cast("array<string>").alias("kinds"), x.alias("value")))
        )

    return let(kind(x), whole)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` rewritten and one more column, ``pii_kinds`` (array of kinds found).

    A null text stays null with no kinds; an empty one stays empty.  Other
    columns are passed on untouched: where ``docs`` has a ``pii_kinds`` already,
    the new column's name gets underscores until it is free.  Repeated rows are
    rewritten alike.
    """

    def free(name: str) -> str:
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        return name

    staging, kinds = free("values"), free("pii_kinds")
    text = F.col(column)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    values = F.transform(found, lambda x: rewritten(x, key))
    staged = docs.withColumn(staging, F.when(F.size(found) > 0, values))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(staging), lambda piece, v: F.concat(piece, F.coalesce(v["value"], F.lit("")))), "")
    return (
        staged.withColumn(kinds, F.coalesce(F.flatten(F.transform(staging, lambda v: v["kinds"])), F.array().cast("array<string>")))
        .withColumn(column, F.when(F.size(kinds) > 0, joined).otherwise(text))
        .drop(staging)
    )
