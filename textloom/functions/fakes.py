"""Made-up values that follow from a seed: the same seed gives the same value on every machine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = ("Ana", "Bo", "Cleo", "Dara", "Edda", "Finn", "Gus"), ("Berg", "Costa", "Dunn", "Ek", "Foss")
STREETS, TOWNS = ("Oak Street", "Mill Road", "Hill Lane", "Lake Avenue"), ("Alby", "Borg", "Calder", "Dale", "Elm")
# Card brands with their first digits and lengths; domains whose addresses are replaced whole.
BRANDS = {
    "visa": (("4",), 16),
    "mastercard": (("51", "52", "53", "54", "55", "2221", "2720"), 16),
    "amex": (("34", "37"), 15),
    "discover": (("6011", "644", "645", "646", "647", "648", "649", "65"), 16),
    "jcb": (("3528", "3589"), 16),
    "diners": (("36", "38"), 14),
    "unionpay": (("62",), 16),
}
PERSONAL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "163.com", "qq.com")


def number(seed: Column) -> Column:
    """The first 32 bits of the seed's SHA-256."""
    return F.conv(F.left(F.sha2(seed, 256), F.lit(8)), 16, 10).cast("long")


def digits(seed: Column) -> Column:
    """64 digits."""
    return F.translate(F.sha2(seed, 256), "abcdef", "012345")


def pick(values: tuple[str, ...], seed: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number(seed) % len(values)).cast("int"))


def named(seed: Column, part: str) -> Column:
    return F.concat(seed, F.lit(f"/{part}"))


def person(seed: Column) -> Column:
    return F.concat(pick(FIRST, named(seed, "first")), F.lit(" "), pick(LAST, named(seed, "last")))


def email(seed: Column, original: Column) -> Column:
    """A new name at the domain of ``original``, unless that is a personal one."""
    domain = F.substring_index(original, "@", -1)
    own = F.exists(F.array(*map(F.lit, PERSONAL)), lambda p: F.contains(F.lower(domain), p)) | ~F.contains(original, F.lit("@"))
    name = F.concat(F.lower(F.replace(person(seed), F.lit(" "), F.lit("."))), (number(seed) % 100).cast("string"))
    return F.concat(name, F.lit("@"), F.when(own, "example.com").otherwise(domain))


def like(seed: Column, original: Column) -> Column:
    """``original`` with other digits, its marks where they were; each 64 characters have digits of their own."""
    chars = F.filter(F.split(original, ""), lambda c: c != "")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.length(original) / 64)).cast("int")), lambda n: digits(F.when(n > 0, F.concat_ws("/", seed, n.cast("string"))).otherwise(seed)))
    return F.array_join(F.zip_with(chars, F.filter(F.split(F.array_join(runs, ""), ""), lambda c: c != ""), lambda c, d: F.when(c.rlike("[0-9]"), d).otherwise(c)), "")


def grammar(value: Column) -> Column:
    """A value's format: ``9`` a digit, ``1`` a digit other than 0 that starts a number, ``A`` and ``a`` letters, all else as it stands.

    So groups, separators, decimals, currencies, signs and percents stay in place.
    """
    lead = F.regexp_replace(value, r"(?<![0-9][.,]|[0-9])[1-9]", "\u0001")
    letters = F.regexp_replace(F.regexp_replace(F.regexp_replace(lead, "[0-9]", "9"), r"\p{Lu}", "A"), r"[\p{L}&&[^\p{Lu}]]", "a")
    return F.replace(letters, F.lit("\u0001"), F.lit("1"))


def refilled(seed: Column, value: Column) -> Column:
    """Another value of the same format: each place of its grammar by the digits of a hash, 32 places a hash.

    A place draws from its kind without the original's character, so none stays.
    """
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), lambda n: F.sha2(F.concat_ws("/", seed, n.cast("string")), 256))
    hexes = F.array_join(runs, "")
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    places = F.zip_with(chars(grammar(value)), chars(value), lambda g, c: F.struct(g.alias("g"), c.alias("c")))

    def drawn(alphabet: str, c: Column, n: Column) -> Column:
        left = F.replace(F.lit(alphabet), c, F.lit(""))
        return F.substr(left, (n % F.length(left) + 1).cast("int"), F.lit(1))

    def one(p: Column, i: Column, h: Column) -> Column:
        n = F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        kinds = {"9": "0123456789", "1": "123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz"}
        out = p["c"]
        for k, alphabet in kinds.items():
            out = F.when(p["g"] == k, drawn(alphabet, p["c"], n)).otherwise(out)
        return out

    return F.array_join(F.get(F.transform(F.array(hexes), lambda h: F.transform(places, lambda p, i: one(p, i, h))), F.lit(0)), "")


def check_digit(head: Column) -> Column:
    """The digit that makes ``head`` a number with a right Luhn sum."""
    ds = F.transform(F.filter(F.split(F.reverse(head), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return ((10 - total % 10) % 10).cast("string")


def card(brand: str, seed: Column) -> Column:
    prefixes, length = BRANDS[brand]
    head = F.left(F.concat(pick(prefixes, named(seed, "prefix")), digits(seed)), F.lit(length - 1))
    return F.concat(head, check_digit(head))


def grouped(number_: Column, mark: str) -> Column:
    return F.regexp_replace(number_, "(.{4})(?=.)", f"$1{mark}")


#: Ways to write a card's number.
FORMATS = {
    "plain": lambda n: n,
    "space_4": lambda n: grouped(n, " "),
    "dash_4": lambda n: grouped(n, "-"),
    "last_4_only": lambda n: F.concat(F.repeat(F.lit("**** "), F.floor((F.length(n) - 1) / 4).cast("int")), F.substr(n, F.floor((F.length(n) - 1) / 4).cast("int") * 4 + 1)),
    "first_6_last_4": lambda n: F.concat(F.left(n, F.lit(6)), F.repeat(F.lit("*"), F.length(n) - 10), F.right(n, F.lit(4))),
    "amex_format": lambda n: F.when(F.length(n) == 15, F.regexp_replace(n, "^(.{4})(.{6})(.{5})$", "$1 $2 $3")).otherwise(grouped(n, " ")),
    "diners_format": lambda n: F.when(F.length(n) == 14, F.regexp_replace(n, "^(.{4})(.{6})(.{4})$", "$1 $2 $3")).otherwise(grouped(n, " ")),
}


def identity(seed: Column) -> dict[str, Column]:
    """Fields of one made-up person."""
    d = digits(seed)
    first, last = pick(FIRST, named(seed, "first")), pick(LAST, named(seed, "last"))
    phone = F.concat(F.lit("("), F.substr(d, F.lit(1), F.lit(3)), F.lit(") 555-"), F.substr(d, F.lit(4), F.lit(4)))
    return {
        "first_name": first,
        "last_name": last,
        "full_name": F.concat(first, F.lit(" "), last),
        "email": F.concat(F.lower(F.concat(first, F.lit("."), last)), F.lit("@example.com")),
        "phone": phone,
        "phone_intl": F.concat(F.lit("+1 "), phone),
        "address": F.concat((number(seed) % 200 + 1).cast("string"), F.lit(" "), pick(STREETS, named(seed, "street")), F.lit(", "), pick(TOWNS, named(seed, "town"))),
        "dob": F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (number(seed) % 18000).cast("int")), "yyyy-MM-dd"),
        "ssn": F.concat(F.lit("9"), F.substr(d, F.lit(8), F.lit(2)), F.lit("-"), F.substr(d, F.lit(10), F.lit(2)), F.lit("-"), F.substr(d, F.lit(12), F.lit(4))),
        "gender": pick(("female", "male"), named(seed, "gender")),
        "credit_card": card("visa", seed),
    }
