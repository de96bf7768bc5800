"""Pseudonyms for personal numbers, dates and mail addresses that keep their format and stay linked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of what is looked for; each find is validated before it is changed. Every repetition of a group is
#: bounded or possessive, so no text makes the matcher nest deeply or start over at each character of a long run.
EMAIL = r"[\p{IsLatin}0-9][\p{IsLatin}\p{M}0-9._%+'-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
IPV6 = r"(?<!:)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?!:)"
#: Brackets or a country code mark a phone number whatever its digits; without them area and exchange begin with 2 to 9.
MARKED = r"(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]\d{4}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}"
PHONE = rf"(?:{MARKED}|(?:\+?1[ .-]?)?\(?[2-9]\d{{2}}\)?[ .-]?[2-9]\d{{2}}[ .-]\d{{4}})"
#: Other country codes: 8 to 15 digits, each after at most one separator.
ABROAD = r"\+[2-9](?:[ .-]?\d){7,14}"
#: Country codes of two digits; 7 has one digit, all others three.
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
IBAN = r"[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})"
CARD = r"\d(?:[ -]?\d){12,18}"
SSN = r"\d{3}-\d{2}-\d{4}"
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}|(?:{MONTH}) \d{{1,2}}, \d{{4}}|\d{{1,2}} (?:{MONTH}) \d{{4}}"
#: Where a find ends.
END = r"(?![\w-]|\.\w)"
AMEX = r"\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5}"


def _fours(separator: str, after: str) -> str:
    """Groups of four, and three more digits at the end, that are not the beginning of another format."""
    more = rf"(?:{separator}(?!(?:{AMEX}|{PHONE}){END})\d{{4}}{after})*+"
    return rf"\d{{4}}(?:{separator}\d{{4}}){{3}}{more}(?:{separator}(?!{PHONE}{END})\d{{3}})?"


FOURS = f"{_fours(' ', END)}|{_fours('-', '')}"
FIXED = rf"{DATE}|{SSN}|{FOURS}|{AMEX}|\d{{13,19}}|{PHONE}"
#: Other groups of a card number; none of them begins a value of a fixed format.
LOOSE = rf"\d(?:(?:[ -](?!(?:{FIXED}){END}))?\d){{12,18}}"
FINDS = rf"(?<![\w.+-])(?:(?<!\p{{IsLatin}}){EMAIL}|{DATE}|{IPV4}|{IPV6}|{IBAN}|{SSN}|(?:{FOURS}|{AMEX}|\d{{13,19}}){END}|{PHONE}|{ABROAD}|{LOOSE}){END}"
#: Texts without this have nothing to find.
HINT = r"\d{2}|\d\.\d|@|[0-9A-Fa-f]:[0-9A-Fa-f]"

ROUNDS = 10
#: Days are permuted within eras of 400 years from 1900 on: those up to the 12th of a month (DAYS x MONTHS of them), and the others.
FIRST_YEAR, ERA_MONTHS, EARLY, LATE = 1900, 4800, (240, 240), (9, 9833)
#: Years whose dates count as valid.
YEARS = (1500, 9899)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """Replaces validated personal numbers, dates and mail addresses in a text column by keyed pseudonyms.

    Payment card numbers (13 to 19 digits whose Luhn sum is right) stay numbers whose Luhn sum is right, IBANs ones whose check
    digits are right, with their country; IPv4 addresses (octets up to 255), IPv6 addresses of eight groups, social security
    numbers (no 000, 666 or 9xx area, no zero group or serial), phone numbers (North American, or with a country code, which stays)
    and existing calendar dates stay such; the local part of a mail address keeps its length and kinds of characters, while
    the domain stays. Separators stay. Each is a Feistel network over the value's positions: two halves in
    turn add, position by position and modulo what the position may hold, a keyed hash of the other half (and, for mail, of the
    domain). So it is a permutation of the values of a format, the same in all documents: equal values stay equal and
    different ones different. Whatever fails its validation is left as it is.

    A number in a fixed format (card as one run of digits, in fours or in 4-6-5, phone, SSN, date) is told from other
    numbers beside it; in a longer row of fours each card is the first four groups whose Luhn sum is right. A day gets
    one pseudonym in whatever format it is written (2024-12-31, 31/12/2024, 12/31/2024, 31.12.2024, 5/7/2024, Dec 31, 2024,
    31 December 2024). Numeric dates are day first, or, with slashes or hyphens, month first where that alone makes a date; days after
    the 12th stay such, so both ways of writing stay readable. Other names of months and years outside ``YEARS`` are left.

    Null text stays null, empty text empty. Rows are independent of each other; nothing is shuffled. Extra columns
    stay, whatever their names; ``found_col``, if named, gets the number of values replaced and replaces a column of that name.
    """
    text = F.col(text_col)
    finds = F.regexp_extract_all(text, F.lit(f"({FINDS})"), F.lit(1))
    rest = F.split(text, FINDS, -1)
    pieces = F.flatten(F.zip_with(rest, finds, lambda a, m: F.concat(F.array(_plain(F.coalesce(a, F.lit("")))), F.when(m.isNull(), F.array(_plain(F.lit("")))).otherwise(_inside(m)))))
    held = "_pieces"
    while held in docs.columns:
        held += "_"
    told = F.transform(pieces, lambda x: F.struct(x["t"].alias("t"), F.when(x["find"], _kind(x["t"])).alias("kind")))
    out = docs.withColumn(held, F.when(text.rlike(HINT), told))
    any_found = F.coalesce(F.exists(held, lambda x: x["kind"].isNotNull()), F.lit(False))
    joined = F.array_join(F.transform(held, lambda x: F.when(x["kind"].isNull(), x["t"]).otherwise(_pseudonym(x["t"], x["kind"], key))), "")
    columns = {text_col: F.when(any_found, joined).otherwise(text)}
    if found_col:
        columns[found_col] = F.when(any_found, F.size(F.filter(held, lambda x: x["kind"].isNotNull()))).otherwise(0).cast("long")
    return out.withColumns(columns).drop(held)


def _plain(t: Column) -> Column:
    return F.struct(t.alias("t"), F.lit(False).alias("find"))


def _find(t: Column) -> Column:
    return F.struct(t.alias("t"), F.lit(True).alias("find"))


def _inside(m: Column) -> Column:
    """A find as pieces (t, find): a row of fours that is longer than a card is taken apart by Luhn sums."""
    separator = F.substr(m, F.lit(5), F.lit(1))

    def text(g: Column, first: Column, end: Column) -> Column:
        some = F.slice(g, first + 1, end - first)
        return F.when(separator == " ", F.array_join(some, " ")).otherwise(F.array_join(some, "-"))

    def apart(g: Column) -> Column:
        n = F.size(g)
        fours = F.when(F.length(F.element_at(g, -1)) == 4, n).otherwise(n - 1)
        right = F.filter(F.sequence(F.lit(0), fours - 4), lambda at: _luhn(_numbers(F.array_join(F.slice(g, at + 1, 4), ""))) % 10 == 0)
        # A card begins where none before it is still going on.
        chosen = F.aggregate(
            right,
            F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out")),
            lambda s, at: F.when(at < s["next"], s).otherwise(F.struct((at + 4).alias("next"), F.concat(s["out"], F.array(at)).alias("out"))),
            lambda s: s["out"],
        )

        def cards(starts: Column) -> Column:
            def piece(at: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(starts, i - 1) + 4).otherwise(0)
                lead = F.concat(F.when(i > 0, separator).otherwise(""), F.when(at > before, F.concat(text(g, before, at), separator)).otherwise(""))
                return F.array(_plain(lead), _find(text(g, at, at + 4)))

            end = F.element_at(starts, -1) + 4
            tail = F.when(end < n, F.concat(separator, text(g, end, n))).otherwise("")
            last = F.concat(F.when(fours > 4, F.concat(text(g, F.lit(0), fours - 4), separator)).otherwise(""))
            whole = F.array(_plain(last), _find(text(g, fours - 4, n)))
            return F.when(F.size(starts) > 0, F.concat(F.flatten(F.transform(starts, piece)), F.array(_plain(tail)))).otherwise(whole)

        return let(chosen, cards)

    long_row = (F.length(m) > 19) & m.rlike(r"^\d{4}[ -]\d{4}[ -]") & m.rlike(f"^(?:{FOURS})$")
    return F.when(long_row, let(F.split(m, "[ -]"), apart)).otherwise(F.array(_find(m)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _numbers(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits that ends with its check digit."""

    def total(d: Column) -> Column:
        doubled = F.transform(d, lambda x, i: F.when((F.size(d) - i) % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)

    return let(digits, total)


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _mod97(chars: Column) -> Column:
    """Remainder of an IBAN's characters read as one number, letters as 10 to 35."""
    return F.aggregate(
        chars, F.lit(0), lambda a, c: F.when(_is_digit(c), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    )


def _kind(m: Column) -> Column:
    """What a find is, if it is valid: mail, date, ipv4, ipv6, iban, ssn, card, abroad or phone."""
    octets_right = F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    ssn_right = ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substr(bare, F.lit(1), F.lit(4))), "")
    return (
        F.when(m.contains("@"), F.lit("mail"))
        .when(m.rlike(f"^(?:{DATE})$"), F.when(_day(m).isNotNull(), F.lit("date")))
        .when(m.rlike(f"^{IPV4}$"), F.when(octets_right, F.lit("ipv4")))
        .when(m.contains(":"), F.lit("ipv6"))
        .when(m.rlike("^[A-Z]{2}"), F.when((F.length(bare) <= 34) & (_mod97(turned) == 1), F.lit("iban")))
        .when(m.rlike(f"^{SSN}$"), F.when(ssn_right, F.lit("ssn")))
        .when(m.rlike(r"^\+[2-9]"), F.lit("abroad"))
        .when(m.rlike(f"^{CARD}$") & (_luhn(_numbers(_digits(m))) % 10 == 0), F.lit("card"))
        .when(m.rlike(f"^{PHONE}$"), F.lit("phone"))
    )


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "mail", _mail(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ipv4", F.array_join(_feistel(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), F.array_repeat(F.lit(256), 4), key, "ipv4"), "."))
        .when(kind == "ipv6", _ipv6(m, key))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "card", _card(m, key))
        .when(kind == "abroad", _abroad(m, key))
        .otherwise(_phone(m, key))
    )


def _feistel(values: Column, limits: Column, key: str, kind: str, beside: Column | None = None) -> Column:
    """Permutes an array of integers, each from 0 to its limit - 1; ``beside`` is a text that the hash depends on too."""

    def network(given: Column) -> Column:
        n = F.size(given["v"])
        h = F.floor((n + 1) / 2).cast("int")
        state = F.struct(
            F.slice(given["v"], F.lit(1), h).alias("a"),
            F.slice(given["v"], h + 1, n - h).alias("b"),
            F.slice(given["l"], F.lit(1), h).alias("la"),
            F.slice(given["l"], h + 1, n - h).alias("lb"),
        )

        def step(s: Column, r: Column) -> Column:
            parts = [F.lit(key), F.lit(kind), n.cast("string"), r.cast("string"), F.array_join(s["b"], ",")]
            digest = F.sha2(F.concat_ws("|", *parts, *([given["beside"]] if beside is not None else [])), 256)
            moved = let(
                digest,
                lambda d: F.zip_with(
                    F.transform(s["a"], lambda v, i: v + F.conv(F.substr(d, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")), s["la"], F.pmod
                ),
            )
            return F.struct(s["b"].alias("a"), moved.alias("b"), s["lb"].alias("la"), s["la"].alias("lb"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * (ROUNDS // 2))), state, step, lambda s: F.concat(s["a"], s["b"]))

    extra = [beside.alias("beside")] if beside is not None else []
    return let(F.struct(values.alias("v"), limits.alias("l"), *extra), network)


def _refill(m: Column, digits: Column) -> Column:
    """The find with its digits replaced in turn; other characters stay."""

    def filled(new: Column) -> Column:
        state = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

        def put(s: Column, c: Column) -> Column:
            digit = _is_digit(c)
            return F.struct(
                F.concat(s["out"], F.when(digit, F.element_at(new, s["i"]).cast("string")).otherwise(c)).alias("out"),
                (s["i"] + digit.cast("int")).alias("i"),
            )

        return F.aggregate(F.split(m, ""), state, put, lambda s: s["out"])

    return let(digits, filled)


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        n = F.size(digits)
        body = _feistel(F.slice(digits, F.lit(1), n - 1), F.array_repeat(F.lit(10), n - 1), key, "card")
        return let(body, lambda b: F.concat(b, F.array(F.pmod(-_luhn(F.concat(b, F.array(F.lit(0)))), F.lit(10)))))

    return _refill(m, let(_numbers(_digits(m)), made))


def _phone(m: Column, key: str) -> Column:
    """Area and exchange stay among those that begin with 2 to 9, or among the others, in every format alike."""

    def made(digits: Column) -> Column:
        country = F.size(digits) - 10
        national = F.slice(digits, country + 1, F.lit(10))
        least = F.transform(national, lambda d, i: F.when(i.isin(0, 3) & (d >= 2), 2).otherwise(0))
        limits = F.transform(national, lambda d, i: F.when(~i.isin(0, 3), 10).when(d >= 2, 8).otherwise(2))
        values = F.zip_with(national, least, lambda d, l: d - l)
        new = F.zip_with(_feistel(values, limits, key, "phone"), least, lambda d, l: d + l)
        return F.concat(F.slice(digits, F.lit(1), country), new)

    return _refill(m, let(_numbers(_digits(m)), made))


def _abroad(m: Column, key: str) -> Column:
    """The country code, by its first digits, stays, and numbers of one country are permuted among those of their length."""

    def made(text: Column) -> Column:
        code = F.when(F.substr(text, F.lit(1), F.lit(1)) == "7", 1).when(F.substr(text, F.lit(1), F.lit(2)).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        digits = _numbers(text)
        rest = F.slice(digits, code + 1, F.size(digits) - code)
        new = _feistel(rest, F.array_repeat(F.lit(10), F.size(digits) - code), key, "abroad", F.substr(text, F.lit(1), code))
        return F.concat(F.slice(digits, F.lit(1), code), new)

    return _refill(m, let(_digits(m), made))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666 are 898 values, groups 99, serials 9999."""
    part = F.transform(F.split(m, "-"), lambda p: p.cast("int"))
    area = F.when(part[0] > 666, part[0] - 2).otherwise(part[0] - 1)
    new = _feistel(F.array(area, part[1] - 1, part[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    return let(
        new,
        lambda x: F.concat_ws(
            "-",
            F.lpad(F.when(x[0] >= 665, x[0] + 2).otherwise(x[0] + 1).cast("string"), 3, "0"),
            F.lpad((x[1] + 1).cast("string"), 2, "0"),
            F.lpad((x[2] + 1).cast("string"), 4, "0"),
        ),
    )


def _ipv6(m: Column, key: str) -> Column:
    """Groups of up to four hex digits; lower case, with leading zeros if no group lacks them."""
    parts = F.transform(F.split(m, ":"), lambda p: F.conv(p, 16, 10).cast("int"))
    new = _feistel(parts, F.array_repeat(F.lit(65536), 8), key, "ipv6")
    shown = F.transform(new, lambda x: F.lower(F.conv(x.cast("string"), 10, 16)))
    return F.array_join(F.when(F.length(m) == 39, F.transform(shown, lambda x: F.lpad(x, 4, "0"))).otherwise(shown), ":")


def _iban(m: Column, key: str) -> Column:
    """What follows the check digits is permuted, letters among letters; then the check digits are made anew."""

    def made(chars: Column) -> Column:
        body = F.slice(chars, F.lit(5), F.size(chars) - 4)
        base = lambda c: F.when(_is_digit(c), 48).otherwise(65)
        values = F.transform(body, lambda c: F.ascii(c) - base(c))
        limits = F.transform(body, lambda c: F.when(_is_digit(c), 10).otherwise(26))
        new = _feistel(values, limits, key, "iban", F.array_join(F.slice(chars, F.lit(1), F.lit(2)), ""))
        letters = F.zip_with(body, new, lambda c, v: F.chr(base(c) + v))

        def checked(b: Column) -> Column:
            country = F.slice(chars, F.lit(1), F.lit(2))
            check = F.lpad((98 - _mod97(F.concat(b, country, F.array(F.lit("0"), F.lit("0"))))).cast("string"), 2, "0")
            return F.concat(country, F.split(check, ""), b)

        return let(letters, checked)

    def spaced(new: Column) -> Column:
        state = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

        def put(s: Column, c: Column) -> Column:
            space = c == " "
            return F.struct(F.concat(s["out"], F.when(space, c).otherwise(F.element_at(new, s["i"]))).alias("out"), (s["i"] + (~space).cast("int")).alias("i"))

        return F.aggregate(F.split(m, ""), state, put, lambda s: s["out"])

    return let(let(F.split(F.replace(m, F.lit(" "), F.lit("")), ""), made), spaced)


def _fields(m: Column) -> Column:
    """Day, month and year as they stand in a date: (a, b, y), a named month as its number."""
    named = F.regexp_extract(m, rf"({MONTH})", 1)
    number = (F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(named, 1, 3)) - 1) / 3) + 1).cast("string")
    parts = F.split(m, "[./-]")
    first, year = F.regexp_extract(m, r"(\d{1,2})\b", 1), F.regexp_extract(m, r"(\d{4})$", 1)
    return (
        F.when(named != "", F.struct(first.alias("a"), number.alias("b"), year.alias("y")))
        .when(m.rlike(r"^\d{4}-"), F.struct(F.get(parts, F.lit(2)).alias("a"), F.get(parts, F.lit(1)).alias("b"), F.get(parts, F.lit(0)).alias("y")))
        .otherwise(F.struct(F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b"), F.get(parts, F.lit(2)).alias("y")))
    )


def _as_date(year: Column, month: Column, day: Column) -> Column:
    found = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(found).between(*YEARS), found)


def _day(m: Column) -> Column:
    """The day that a date names: with the day first, or the month first where only that makes a date."""
    swap = m.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$")
    return let(_fields(m), lambda f: F.coalesce(_as_date(f["y"], f["b"], f["a"]), F.when(swap, _as_date(f["y"], f["a"], f["b"]))))


def _month_start(month: Column) -> Column:
    """The first day of a month, counted from January of ``FIRST_YEAR``."""
    return F.add_months(F.lit(f"{FIRST_YEAR}-01-01").cast("date"), month)


def _other_day(day: Column, key: str) -> Column:
    """The pseudonym of a day, in the same 400 years; days after the 12th of a month stay among themselves."""
    month = ((F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1).cast("int")
    era = (F.floor(month / ERA_MONTHS) * ERA_MONTHS).cast("int")
    # Days after the 12th before a month of the era.
    before = lambda n: F.datediff(_month_start(n), _month_start(era)) - 12 * (n - era)

    def early() -> Column:
        rank = (month - era) * 12 + F.dayofmonth(day) - 1
        new = _feistel(F.array((rank / EARLY[1]).cast("int"), rank % EARLY[1]), F.array(*map(F.lit, EARLY)), key, "date")
        return let(new, lambda x: let(x[0] * EARLY[1] + x[1], lambda r: F.date_add(_month_start(era + (r / 12).cast("int")), r % 12)))

    def late() -> Column:
        rank = before(month) + F.dayofmonth(day) - 13
        new = _feistel(F.array((rank / LATE[1]).cast("int"), rank % LATE[1]), F.array(*map(F.lit, LATE)), key, "late date")

        def place(r: Column) -> Column:
            about = (r / 18.436875).cast("int") + era
            months = F.filter(F.array(about - 1, about, about + 1), lambda n: (n >= era) & (before(n) <= r))
            return let(F.array_max(months), lambda n: F.date_add(_month_start(n), r - before(n) + 12))

        return let(let(new, lambda x: x[0] * LATE[1] + x[1]), place)

    return F.when(F.dayofmonth(day) <= 12, early()).otherwise(late())


def _date(m: Column, key: str) -> Column:
    """The pseudonym of a date's day, written as the date is: order, separators, leading zeros, and names of months long or short."""

    def written(d: Column) -> Column:
        named = F.regexp_extract(m, rf"({MONTH})", 1)
        month = F.when(F.length(named) > 3, F.date_format(d, "MMMM")).otherwise(F.date_format(d, "MMM"))
        plain_day, plain_month, year = F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.date_format(d, "yyyy")
        padded = m.rlike(r"^\d\d[./-]\d\d[./-]")
        day_text = F.when(padded, F.lpad(plain_day, 2, "0")).otherwise(plain_day)
        month_text = F.when(padded, F.lpad(plain_month, 2, "0")).otherwise(plain_month)
        separator = F.regexp_extract(m, r"([./-])", 1)
        day_first = let(_fields(m), lambda f: _as_date(f["y"], f["b"], f["a"]).isNotNull())
        numeric = F.when(day_first, F.concat_ws("/", day_text, month_text, year)).otherwise(F.concat_ws("/", month_text, day_text, year))
        return (
            F.when(m.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd"))
            .when((named != "") & m.rlike(r"^\d"), F.concat_ws(" ", plain_day, month, year))
            .when(named != "", F.concat(month, F.lit(" "), plain_day, F.lit(", "), year))
            .otherwise(F.replace(numeric, F.lit("/"), separator))
        )

    return let(let(_day(m), lambda d: _other_day(d, key)), written)


def _mail(m: Column, key: str) -> Column:
    """ASCII letters and digits of the local part are permuted with the domain in the hash; other characters stay."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def base(c: Column) -> Column:
        return F.when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).when(_is_digit(c), 48).otherwise(0)

    def made(chars: Column) -> Column:
        limits = F.transform(chars, lambda c: F.when(base(c) == 0, 1).when(_is_digit(c), 10).otherwise(26))
        values = F.transform(chars, lambda c: F.when(base(c) == 0, 0).otherwise(F.ascii(c) - base(c)))
        new = _feistel(values, limits, key, "mail", F.lower(domain))
        return F.array_join(F.zip_with(chars, new, lambda c, v: F.when(base(c) == 0, c).otherwise(F.chr(base(c) + v))), "")

    return F.concat(let(F.split(local, ""), made), F.lit("@"), domain)
