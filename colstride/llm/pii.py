"""Private data replaced by format-preserving pseudonyms: validated numbers and dates are permuted within
their format by a keyed Feistel network, so that equal values stay linked across documents.

DataFrame functions only. A network splits a value into two parts and adds, in turn, a keyed hash of one
part to the other, modulo that part's range; every step can be undone, so different values never meet.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

#: Rounds of the network.
ROUNDS = 8
#: First day and number of days of the calendar in which dates are permuted: 800 years, of which the
#: days are 378 * 773 in the Gregorian calendar.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1600-01-01", 378, 773
#: Most steps of a walk through a permutation until it is back among the values of the right kind; at
#: least a third of all are, so it is never that long.
WALK = 100
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Patterns by kind, tried in this order at each place. Java and Python syntax, no capturing groups. Each
#: starts at a boundary or has a bounded length, so that long runs of one kind of character cost no more
#: than others, and no unbounded repetition of a group may give back what it took: Java would recurse.
_YEAR, _MONTH, _DAY = r"(?:1[6-9]|2[0-3])\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_NAME = r"(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "September" else "Sep(?:t|tember)?" for m in MONTHS) + r")"
_YMD = rf"(?<![\d-]){_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])|(?<![\d/]){_YEAR}/{_MONTH}/{_DAY}(?![\d/])"
_DMY = rf"(?<![\d.]){_DAY}\.{_MONTH}\.{_YEAR}(?!\d|\.\d)"
_MIXED = rf"(?<![\d/]){_DAY}/{_DAY}/{_YEAR}(?![\d/])|(?<![\d-]){_DAY}-{_DAY}-{_YEAR}(?![\d-])"
_NAMED = rf"\b{_NAME}\.? {_DAY},? {_YEAR}(?!\d)|(?<!\d){_DAY}\.? {_NAME}\.?,? {_YEAR}(?!\d)"
_SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])|(?<![\d-])(?<!\d )(?!000|666|9)\d{3} (?!00)\d\d (?!0000)\d{4}(?![\d-]| \d)"
_PHONE = r"(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
#: A card's digits in its usual groups.
_GROUPS = r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?!\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63}(?![A-Za-z])",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b[\"']?\s*+[=:]\s*+(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"']{6,}))",
    "iban": r"\b[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": _IP,
    "ymd": _YMD,
    "dmy": _DMY,
    "mixed": _MIXED,
    "named": _NAMED,
    "ssn": _SSN,
    # A whole run of digits; it ends before a value of another kind, and doesn't begin with a phone number before a card.
    "card": rf"(?<!\d)(?!{_PHONE}[ -]{_GROUPS})\d(?:(?:[ -](?!{_IP}|{_YMD}|{_SSN}|{_PHONE}))?\d){{12,}}+",
    "phone": rf"(?<![\w+])(?:\+\d{{1,3}}[ .-]?)?{_PHONE}|(?<![\w+])(?<!\d )[2-9]\d\d [2-9]\d\d \d{{4}}(?!\d| \d)|" r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
}
#: All of them, each in a group of its own.
ANY = "|".join(f"({p})" for p in PATTERNS.values())
#: What every match contains: texts without it are passed on as they are.
HINT = rf"\d[ ./-]?\d|\d\.? {_NAME}|@|AKIA|(?i:password|passwd|pwd|secret|token|api_?key)"
#: Stands between the parts of a text while they are apart.
MARK = "\x01"


@dataclass(frozen=True)
class Key:
    """A secret; the same key gives the same pseudonyms in every run. Whoever has it can undo them."""

    secret: str = field(repr=False)

    def __post_init__(self):
        if len(self.secret) < 16:
            raise ValueError("a key needs 16 characters or more")

    def number(self, *parts: Column) -> Column:
        """A keyed hash of the parts as a number below 2 ** 60."""
        text = F.concat_ws("|", F.lit(self.secret), *[p.cast("string") for p in parts])
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def hex(self, *parts: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.secret), *[p.cast("string") for p in parts]), 256)


#: Where a session holds its key; random keys of applications without one.
KEY_SETTING = "spark.colstride.pii.key"
_random: dict[str, Key] = {}


def session_key(spark: SparkSession) -> Key:
    """The key that the session names, or a random one for the application, which links no further than it."""
    known = spark.conf.get(KEY_SETTING, None)
    return Key(known) if known else _random.setdefault(spark.sparkContext.applicationId, Key(secrets.token_hex(32)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(left: Column, right: Column, left_range: Column, right_range: Column, key: Key, tweak: Column) -> Column:
    """The pair (a: left, b: right) permuted within its two ranges.

    The rounds run inside one aggregate over their numbers, so the expression stays small.
    """
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def step(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        a = F.when(odd, state["a"]).otherwise(F.pmod(state["a"] + key.number(tweak, i, state["b"]), left_range))
        b = F.when(odd, F.pmod(state["b"] + key.number(tweak, i, state["a"]), right_range)).otherwise(state["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _ten_to(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(digits: Column, key: Key, tweak: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length; shorter ones stay."""

    def halves(s: Column) -> Column:
        cut, n = s["cut"], s["n"]
        left, right = F.substr(s["d"], F.lit(1), cut).cast("long"), F.substr(s["d"], cut + 1).cast("long")
        done = feistel(left, right, _ten_to(cut), _ten_to(n - cut), key, F.concat(F.lit(tweak + "|"), n.cast("string")))
        return let(done, lambda x: F.concat(F.lpad(x["a"].cast("string"), cut, "0"), F.lpad(x["b"].cast("string"), n - cut, "0")))

    parts = lambda d: F.struct(d.alias("d"), F.char_length(d).alias("n"), F.floor(F.char_length(d) / 2).cast("int").alias("cut"))
    return let(digits, lambda d: F.when(F.char_length(d) < 2, d).otherwise(let(parts(d), halves)))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Sum of the Luhn rule; ``doubled_last``: for digits that lack their check digit."""

    def total(x: Column) -> Column:
        value = lambda d, twice: F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        one = lambda s, c: F.struct((s["sum"] + value(c.cast("int"), s["twice"])).alias("sum"), (~s["twice"]).alias("twice"))
        start = F.struct(F.lit(0).alias("sum"), F.lit(doubled_last).alias("twice"))
        return F.aggregate(F.filter(F.split(F.reverse(x), ""), lambda c: c != ""), start, one, lambda s: s["sum"])

    return let(digits, total)


def refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by those of ``digits``, in order."""
    is_digit = lambda c: (c >= "0") & (c <= "9") & (F.char_length(c) == 1)

    def put(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        one = lambda s, c: F.when(is_digit(c), F.struct(F.concat(s["out"], F.substr(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
        return F.aggregate(F.split(shape, ""), start, one, lambda s: s["out"])

    return let(digits, put)


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def card(value: Column, key: Key) -> Column:
    """A number of 13 to 19 digits that passes the Luhn rule becomes another that does, written the same way."""
    digits = only_digits(value)
    body = let(digits, lambda d: permuted_digits(F.substr(d, F.lit(1), F.char_length(d) - 1), key, "card"))
    check = lambda b: F.pmod(10 - F.pmod(luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")
    return refilled(value, let(body, lambda b: F.concat(b, check(b))))


def is_card(digits: Column) -> Column:
    return F.char_length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0)


def cards(value: Column, key: Key) -> Column:
    """(text, number of values replaced) of a run of at most ``SHORT_RUN`` digits in which cards may have
    numbers beside them.

    Cards begin and end at the run's blanks and hyphens. Those in usual groups go first, then the whole
    run, then what is left without its first or last number, or in groups of three digits or more.
    """
    group, sign = F.split(value, "[ -]"), F.regexp_extract_all(value, F.lit("[ -]"), F.lit(0))
    run = F.struct(group.alias("group"), sign.alias("sign"), F.size(group).alias("n"))

    def within(r: Column) -> Column:
        def window(i: Column, k: Column) -> Column:
            own = F.slice(r["group"], i + 1, k)
            return F.struct(i.alias("i"), k.alias("k"), F.array_join(own, "").alias("digits"), F.array_join(F.transform(own, lambda g: F.char_length(g)), "-").alias("sizes"))

        rim = F.array(*[window(F.lit(a), F.greatest(r["n"] - F.lit(a + b), F.lit(0))) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))])
        rim = F.when(r["n"] > 2, rim).otherwise(F.slice(rim, 1, 1))
        large = F.filter(F.sequence(F.lit(0), r["n"] - 1), lambda i: F.char_length(F.get(r["group"], i)) >= 3)
        some = F.flatten(F.transform(large, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(6), r["n"] - i)), lambda k: window(i, k))))
        some = F.filter(some, lambda w: ~F.concat(F.lit("-"), w["sizes"], F.lit("-")).rlike("-[12]-"))
        valid = F.filter(F.concat(rim, some), lambda w: is_card(w["digits"]))
        usual = lambda w: w["sizes"].rlike("^(?:4-4-4-4|4-6-[45]|1[3-9])$")
        rank = lambda w: F.when(usual(w), 0).when(w["k"] == r["n"], 1).otherwise(2)
        length = lambda w: F.when(usual(w), 0).otherwise(-F.char_length(w["digits"]))
        ranks = lambda v: F.array_sort(F.transform(v, lambda w: F.struct(rank(w).alias("rank"), length(w).alias("length"), w["i"].alias("i"), w["k"].alias("k"))))
        apart = lambda a, b: (a["i"] + a["k"] <= b["i"]) | (b["i"] + b["k"] <= a["i"])
        chosen_of = lambda ranked: F.aggregate(ranked, F.slice(ranked, 1, 0), lambda s, w: F.when(F.forall(s, lambda x: apart(x, w)), F.concat(s, F.array(w))).otherwise(s))
        # Each group and the sign after it; a card's stand together at its first.
        joined = lambda i, k: F.array_join(F.zip_with(F.slice(r["group"], i + 1, k), F.slice(r["sign"], i + 1, k - 1), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")

        def put(chosen: Column) -> Column:
            def piece(i: Column) -> Column:
                own = F.filter(chosen, lambda w: (w["i"] <= i) & (i < w["i"] + w["k"]))
                first = F.filter(own, lambda w: w["i"] == i)
                done = F.transform(first, lambda w: F.concat(card(joined(w["i"], w["k"]), key), F.coalesce(F.get(r["sign"], i + w["k"] - 1), F.lit(""))))
                return F.when(F.size(own) == 0, F.concat(F.get(r["group"], i), F.coalesce(F.get(r["sign"], i), F.lit("")))).otherwise(F.coalesce(F.get(done, F.lit(0)), F.lit("")))

            text = F.array_join(F.transform(F.sequence(F.lit(0), r["n"] - 1), piece), "")
            return F.struct(text.alias("text"), F.size(chosen).alias("n"))

        none = F.struct(value.alias("text"), F.lit(0).alias("n"))
        return let(valid, lambda v: F.when(F.size(v) == 0, none).otherwise(let(let(ranks(v), chosen_of), put)))

    return let(run, within)


#: Digits of a run whose windows are all weighed against each other.
SHORT_RUN = 60
#: Groups of a longer run that are joined at a time.
STRETCH = 256


def many_cards(value: Column, key: Key) -> Column:
    """(text, number of values replaced) of a longer run, from left to right in time that grows with it.

    At each group the card that begins there is taken: in usual groups if there is one, else the longest
    of groups of three digits or more, unless one in usual groups begins within it.
    """
    group, sign = F.split(value, "[ -]"), F.concat(F.regexp_extract_all(value, F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    run = F.struct(group.alias("group"), sign.alias("sign"), F.size(group).alias("n"))

    def within(r: Column) -> Column:
        def window(i: Column, k: Column) -> Column:
            own = F.slice(r["group"], i + 1, k)
            sizes = F.array_join(F.transform(own, lambda g: F.char_length(g)), "-")
            usual = sizes.rlike("^(?:4-4-4-4|4-6-[45]|1[3-9])$")
            return F.struct(usual.alias("usual"), k.alias("k"), F.array_join(own, "").alias("digits"), sizes.alias("sizes"))

        def valid(i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(6), r["n"] - i))
            return F.filter(F.transform(sizes, lambda k: window(i, k)), lambda w: ~F.concat(F.lit("-"), w["sizes"], F.lit("-")).rlike("-[12]-") & is_card(w["digits"]))

        def best(i: Column) -> Column:
            """Groups of the card that begins at i; null without one."""
            found = F.array_max(F.transform(valid(i), lambda w: F.struct(w["usual"].alias("usual"), w["k"].alias("k"))))
            inside = lambda w: F.exists(F.sequence(F.lit(1), w["k"] - 1), lambda j: F.exists(valid(i + j), lambda x: x["usual"]))
            return let(found, lambda w: F.when(w["usual"] | (w["k"] == 1) | ~inside(w), w["k"]))

        def put(state: Column, i: Column) -> Column:
            plain = F.struct(F.concat(state["out"], F.get(r["group"], i), F.get(r["sign"], i)).alias("out"), F.lit(0).alias("skip"), state["n"].alias("n"))

            def taken(k: Column) -> Column:
                last = F.get(r["sign"], i + k - 1)
                parts = F.zip_with(F.slice(r["group"], i + 1, k), F.concat(F.slice(r["sign"], i + 1, k - 1), F.array(F.lit(""))), lambda g, s: F.concat(g, s))
                return F.struct(F.concat(state["out"], card(F.array_join(parts, ""), key), last).alias("out"), (k - 1).alias("skip"), (state["n"] + 1).alias("n"))

            held = F.struct(state["out"].alias("out"), (state["skip"] - 1).alias("skip"), state["n"].alias("n"))
            some = let(best(i), lambda k: F.when(k.isNull(), plain).otherwise(taken(k)))
            return F.when(state["skip"] > 0, held).when(F.char_length(F.get(r["group"], i)) < 3, plain).otherwise(some)

        def stretch(state: Column, a: Column) -> Column:
            """Some groups on their own, so that only their text is copied step by step."""
            own = F.struct(F.lit("").alias("out"), state["skip"].alias("skip"), state["n"].alias("n"))
            done = F.aggregate(F.sequence(a, F.least(a + STRETCH, r["n"]) - 1), own, put)
            return let(done, lambda d: F.struct(F.concat(state["out"], d["out"]).alias("out"), d["skip"].alias("skip"), d["n"].alias("n")))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), r["n"] - 1, F.lit(STRETCH)), start, stretch, lambda s: F.struct(s["out"].alias("text"), s["n"].alias("n")))

    return let(run, within)


def walked(value: Column, step, right) -> Column:
    """``step`` again and again from ``value`` until ``right`` holds: a permutation of the values for which it does."""
    on = lambda s, i: F.when((i > 1) & right(s), s).otherwise(step(s))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), value, on)


def phone(value: Column, key: Key) -> Column:
    """The last 10 digits (all, where fewer) are permuted; a country code before them stays.

    Numbers as the North American plan has them, whose area and office begin with 2 to 9, are permuted
    among themselves, and so are the others.
    """
    def moved(last: Column) -> Column:
        planned = lambda d: d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
        part = lambda i, n: F.substring(last, i, n).cast("long")
        inside = feistel(part(1, 3) - 200, part(4, 7) - 2_000_000, F.lit(800), F.lit(8_000_000), key, F.lit("phone"))
        inside = let(inside, lambda x: F.concat((x["a"] + 200).cast("string"), (x["b"] + 2_000_000).cast("string")))
        return F.when(planned(last), inside).otherwise(walked(last, lambda d: permuted_digits(d, key, "phone"), lambda d: ~planned(d)))

    def whole(digits: Column) -> Column:
        own = F.least(F.char_length(digits), F.lit(10))
        return F.concat(F.substr(digits, F.lit(1), F.char_length(digits) - own), let(F.right(digits, own), moved))

    return refilled(value, let(only_digits(value), whole))


def ssn(value: Column, key: Key) -> Column:
    """Area (001 to 899 but for 666), group and serial number stay within what is ever given out."""
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def written(x: Column) -> Column:
        area = F.floor(x["a"] / 99)
        return F.concat(two(area + F.when(area >= 665, 2).otherwise(1), 3), two(F.pmod(x["a"], F.lit(99)) + 1, 2), two(x["b"] + 1, 4))

    def moved(digits: Column) -> Column:
        part = lambda i, n: F.substring(digits, i, n).cast("long")
        area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
        return let(feistel(area * 99 + part(4, 2) - 1, part(6, 4) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn")), written)

    return refilled(value, let(only_digits(value), moved))


def iban_rest(text: Column) -> Column:
    """The number that an account stands for modulo 97, its first four characters last; 1 if it is valid."""
    moved = F.split(F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4)), "")
    digit = lambda c: F.conv(c, 36, 10).cast("long")
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: F.pmod(s * F.when(digit(c) > 9, 100).otherwise(10) + digit(c), F.lit(97)))


def iban(value: Column, key: Key) -> Column:
    """The digits of a valid account are permuted, its letters stay, and its check digits follow."""
    def whole(plain: Column) -> Column:
        body = F.substr(plain, F.lit(5))
        check = lambda moved: F.lpad((98 - iban_rest(F.concat(F.substring(plain, 1, 2), F.lit("00"), refilled(body, moved)))).cast("string"), 2, "0")
        new = let(permuted_digits(only_digits(body), key, "iban"), lambda moved: F.concat(check(moved), moved))
        return F.when(iban_rest(plain) == 1, refilled(value, new)).otherwise(value)

    return let(F.replace(value, F.lit(" "), F.lit("")), whole)


def ip(value: Column, key: Key) -> Column:
    part = F.split(value, r"\.")
    number = lambda i: F.get(part, F.lit(i)).cast("long")
    half = F.lit(65536)
    text = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    done = feistel(number(0) * 256 + number(1), number(2) * 256 + number(3), half, half, key, F.lit("ip"))
    return let(done, lambda x: F.concat_ws(".", text(x["a"]), text(x["b"])))


def moved_day(day: Column, key: Key) -> Column:
    """The day (a number from ``FIRST_DAY``) that stands for another."""
    done = feistel(F.floor(day / DAYS_RIGHT), F.pmod(day, F.lit(DAYS_RIGHT)), F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key, F.lit("date"))
    return let(done, lambda x: x["a"] * DAYS_RIGHT + x["b"])


def _day_of(year: Column, month: Column, day: Column) -> Column:
    """Number of a day; null if there is none."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _date_of(day: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))


def _numeric_date(order: str):
    """Dates in digits, written as before: with leading zeros if all their short numbers had two digits."""

    def date(value: Column, key: Key) -> Column:
        def whole(p: Column) -> Column:
            part = lambda i: F.get(p["parts"], F.lit(i))

            def written(at: dict[str, int], walk: bool) -> Column:
                wide = (F.char_length(part(at["m"])) == 2) & (F.char_length(part(at["d"])) == 2)

                def text(new: Column) -> Column:
                    number = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
                    out = {at["y"]: F.year(new).cast("string"), at["m"]: number(F.month(new)), at["d"]: number(F.dayofmonth(new))}
                    return F.concat(out[0], F.get(p["signs"], F.lit(1)), out[1], F.get(p["signs"], F.lit(2)), out[2])

                def moved(day: Column) -> Column:
                    # A day that comes first may not pass for a month.
                    step = lambda d: moved_day(d, key)
                    return walked(day, step, lambda d: F.dayofmonth(_date_of(d)) > 12) if walk else step(day)

                day = _day_of(part(at["y"]), part(at["m"]), part(at["d"]))
                return let(day, lambda d: F.when(d.isNull(), value).otherwise(let(_date_of(moved(d)), text)))

            if order != "mixed":
                return written({c: k for k, c in enumerate(order)}, False)
            return F.when(part(0).cast("int") <= 12, written({"m": 0, "d": 1, "y": 2}, False)).otherwise(written({"d": 0, "m": 1, "y": 2}, True))

        return let(F.struct(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)).alias("parts"), F.split(value, "[0-9]+").alias("signs")), whole)

    return date


def named_date(value: Column, key: Key) -> Column:
    """Dates with an English name of a month, in full or by three letters, in the case it had."""
    name, numbers = F.regexp_extract(value, "[A-Za-z]+", 0), F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    months = F.array(*[F.lit(m) for m in MONTHS])

    def whole(p: Column) -> Column:
        month = F.array_position(F.transform(months, lambda m: F.lower(F.substring(m, 1, 3))), F.lower(F.substring(p["name"], 1, 3)))
        first = F.get(p["numbers"], F.lit(0))

        def text(moved: Column) -> Column:
            full = F.get(months, F.month(moved) - 1)
            new = F.when(F.lower(p["name"]).isin([m.lower() for m in MONTHS]), full).otherwise(F.substring(full, 1, 3))
            new = let(new, lambda x: F.when(p["name"] == F.upper(p["name"]), F.upper(x)).when(p["name"] == F.lower(p["name"]), F.lower(x)).otherwise(x))
            number = F.dayofmonth(moved).cast("string")
            number = F.when(first.startswith("0"), F.lpad(number, 2, "0")).otherwise(number)
            put = lambda x: F.when(x.rlike("^[A-Za-z]"), new).when(F.char_length(x) == 4, F.year(moved).cast("string")).otherwise(number)
            parts, signs = F.regexp_extract_all(value, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.split(value, "[A-Za-z]+|[0-9]+")
            return F.array_join(F.zip_with(signs, F.transform(parts, put), lambda s, x: F.concat(s, F.coalesce(x, F.lit("")))), "")

        day = _day_of(F.get(p["numbers"], F.lit(1)), month.cast("string"), first)
        return let(day, lambda d: F.when(d.isNull(), value).otherwise(let(_date_of(moved_day(d, key)), text)))

    return let(F.struct(name.alias("name"), numbers.alias("numbers")), whole)


def email(value: Column, key: Key) -> Column:
    """Keyed names for the address and its domain, so that both stay linked."""
    domain = F.lower(F.substring_index(value, "@", -1))
    user = F.substr(key.hex(F.lit("email"), F.lower(value)), F.lit(1), F.lit(12))
    return F.concat(F.lit("user-"), user, F.lit("@host-"), F.substr(key.hex(F.lit("domain"), domain), F.lit(1), F.lit(8)), F.lit(".invalid"))


def secret(value: Column, key: Key) -> Column:
    """The name before the sign stays, the value becomes a keyed name."""
    name = F.regexp_extract(value, r"^(?!AKIA)([A-Za-z_]+[\"']?\s*[=:]\s*[\"']?)", 1)
    quote = F.regexp_extract(value, r"([\"'])$", 1)
    hidden = F.regexp_replace(F.substr(value, F.char_length(name) + 1), r"[\"']$", "")
    return F.concat(name, F.lit("<secret-"), F.substr(key.hex(F.lit("secret"), hidden), F.lit(1), F.lit(12)), F.lit(">"), quote)


KINDS = {
    "email": email, "secret": secret, "iban": iban, "ip": ip, "ymd": _numeric_date("ymd"), "dmy": _numeric_date("dmy"), "mixed": _numeric_date("mixed"), "named": named_date,
    "ssn": ssn, "card": None, "phone": phone,
}


def pseudonym(value: Column, kind: str, key: Key) -> Column:
    """(text, number of values replaced) of a match of a kind; one that its kind finds invalid stays."""
    if kind == "card":
        return F.when(F.char_length(only_digits(value)) <= SHORT_RUN, cards(value, key)).otherwise(many_cards(value, key))
    return let(KINDS[kind](value, key), lambda new: F.struct(new.alias("text"), (new != value).cast("int").alias("n")))


def pseudonymise(docs: DataFrame, key: Key, text: str = "text", count: str | None = "n_private") -> DataFrame:
    """``docs`` with every private value in ``text`` replaced by its pseudonym.

    ``count`` names an added column with the number of values replaced (None: no column); one of that
    name is replaced. Null texts stay null, texts without private data stay as they are, byte for byte;
    equal values get equal pseudonyms in all rows; other columns pass through; an empty table gives an
    empty result. The key is part of the plan: restrict who sees plans and event logs.
    """
    t = F.col(f"`{text}`")
    parts_, new_ = S.fresh(docs, "parts"), S.fresh(docs, "new")
    # A text that holds the mark itself gets one with its own digest, which it can't hold.
    mark = F.when(t.contains(MARK), F.concat(F.lit(MARK), F.md5(t.cast("binary")))).otherwise(F.lit(MARK))
    fields = F.concat(mark, *[F.concat(F.lit(f"${k + 1}"), mark) for k in range(len(KINDS))])
    # One pass: each match becomes one part for every kind, of which its own is not empty, so that a
    # part's number tells its kind, and those between matches are plain text.
    parts = F.split(F.regexp_replace(t, F.lit(ANY), fields), mark)
    one = docs.withColumn(parts_, F.when(t.rlike(HINT), parts))
    every = len(KINDS) + 1

    def part(x: Column, i: Column) -> Column:
        out = F.struct(x.alias("text"), F.lit(0).alias("n"))
        for k, kind in enumerate(KINDS):
            out = F.when((F.pmod(i, F.lit(every)) == k + 1) & (x != ""), pseudonym(x, kind, key)).otherwise(out)
        return out

    one = one.withColumn(new_, F.when(F.size(parts_) > 1, F.transform(parts_, part)))
    changed = F.when(F.col(new_).isNotNull(), F.array_join(F.transform(new_, lambda x: x["text"]), "")).otherwise(t)
    n = F.coalesce(F.aggregate(new_, F.lit(0).cast("long"), lambda s, v: s + v["n"]), F.lit(0).cast("long"))
    columns = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return one.select(*columns, *([n.alias(count)] if count else []))


def redacted(docs: DataFrame, key: Key) -> DataFrame:
    """``pseudonymise`` for tables with a column ``n_chars``, which follows the text."""
    out = pseudonymise(docs, key, count=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
