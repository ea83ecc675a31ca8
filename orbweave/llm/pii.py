"""Personal data replaced by format-preserving pseudonyms.

Validated numbers (cards, IBANs, phones, social security numbers, IPv4 addresses) and
dates are permuted within their own format by a keyed Feistel network, so that the same
value becomes the same pseudonym in every document and the text keeps its shape.  E-mail
addresses, which are no numbers, get a keyed digest as their name.  Everything is Column
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import cut_by, let

ROUNDS = 8

#: What each kind looks like, in the order in which they are tried.
#: A host has at most 127 labels of at most 63 characters: a repeated group costs stack for each.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
#: A plus and 8 to 15 digits; where the country code says how many digits follow, as many as that.
_PHONE_LENGTHS = {8: "45|47", 9: "31|33|34|41|48|61|351", 10: "[17]|44|52|91", 11: "86"}
_PHONE_KNOWN = [rf"(?:{codes})(?:[ .-]?[()]?[ .-]?[0-9]){{{n}}}" for n, codes in _PHONE_LENGTHS.items()]
_PHONE_NEXT = r"(?:(?:[ .-](?=[0-9]{2}))?[0-9])"
_PHONE_OTHER = [rf"[0-9]{{{c}}}[ .-]?(?:\([0-9]{{1,4}}\){_PHONE_NEXT}{{3,{11 - c}}}|[0-9]{_PHONE_NEXT}{{{7 - c},{14 - c}}})" for c in (3, 2, 1)]
PHONE = r"(?<![0-9A-Za-z+])\+(?:" + "|".join(rf"{p}(?![0-9]|\.[0-9])" for p in [*_PHONE_KNOWN, *_PHONE_OTHER]) + ")"
#: The lengths of IBANs by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "AO|CV|GW|LY|MZ|PT|ST", 26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![0-9A-Za-z])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items()) + ")(?![0-9A-Za-z])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9./-]*[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]*[0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: Groups of digits, 13 digits at least, in which cards are looked for; an address or a date with dots after them is none of them.
RUN = r"(?<![0-9A-Za-z-])(?=(?:[ -]*[0-9]){13})[0-9][0-9 -]*[0-9](?![0-9A-Za-z]|(?:\.[0-9]{1,3}){3}|[./][0-9]{2}[./][0-9]{4})"
ANY = "|".join([EMAIL, PHONE, IBAN, DATE, SSN, IPV4, RUN])
#: 400 years from FIRST_DAY; the number of days is DAYS_LEFT * DAYS_RIGHT.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1800-01-01", 189, 773


def key_of(spark: SparkSession) -> str:
    """The session's key, from ``spark.orbweave.pii.key``; the shared tables are invented and need none."""
    return spark.conf.get("spark.orbweave.pii.key", "invented tables")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the pairs (left < left_size, right < right_size), as a struct(l, r)."""

    def mixed(i: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % size

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + mixed(i, s["r"], left_size)) % left_size).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + mixed(i, s["l"], right_size)) % right_size).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 34 digits as another of the same length."""

    def of(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        return let(
            feistel(d.substr(F.lit(1), a).cast("long"), d.substr(a + 1, b).cast("long"), _power(a), _power(b), key, tag),
            lambda s: F.concat(F.lpad(s["l"].cast("string"), a, "0"), F.lpad(s["r"].cast("string"), b, "0")),
        )

    return let(digits, of)


def _only(text: Column, drop: str) -> Column:
    return F.regexp_replace(text, drop, "")


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def step(digits: Column):
        return lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(s["text"], digits.substr(s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next")))

    return let(digits, lambda d: F.aggregate(F.split(shape, ""), start, step(d), lambda s: s["text"]))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last of which counts once."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d))),
        F.lit(0),
        lambda s, x: s + x,
    )


def _card(x: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body = permuted_digits(d.substr(F.lit(1), n - 1), key, "card")
        new = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return _filled(x, new)

    return let(_only(x, "[ -]"), of)


def _changed(x: Column, new: Column) -> Column:
    return let(new, lambda v: F.struct(v.alias("text"), F.when(v != x, 1).otherwise(0).alias("n")))


#: How many digits cards have, the usual first.
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17)


def _in_run(x: Column, key: str) -> Column:
    """A RUN with its cards replaced, and their number: from each group of digits on, the first of
    CARD_LENGTHS that ends with a group and validates.  Dates and numbers of social security
    after the first group are replaced as elsewhere."""

    def of(groups: Column) -> Column:
        def span(i: Column, n: Column) -> Column:
            return F.regexp_replace(F.array_join(F.slice(groups, i + 1, n), ""), "[ -]+$", "")

        def step(s: Column, i: Column) -> Column:
            def chosen(ahead: Column) -> Column:
                # How many groups, and what they become.
                after = F.coalesce(F.get(groups, i + 2), F.lit(""))
                alone = (i > 0) & ~F.get(groups, i - 1).endswith("-") & ~(after.rlike("-$") & (i + 3 < F.size(groups)))
                three = F.element_at(ahead, F.least(F.lit(3), F.size(ahead)))
                other = F.when(alone & three.rlike(f"^(?:{DATE})$"), _date(three, key)).when(alone & three.rlike(f"^(?:{SSN})$"), _ssn(three, key))
                cards = F.filter(
                    F.transform(ahead, lambda a, k: F.struct(a.alias("text"), (k + 1).alias("n"), F.length(_only(a, "[ -]")).alias("digits"))),
                    lambda c: c["text"].rlike(f"^{CARD}$"),
                )
                sound = F.filter(cards, lambda c: luhn_sum(_only(c["text"], "[ -]")) % 10 == 0)
                ranked = F.array_sort(F.transform(sound, lambda c: F.struct(F.array_position(F.array(*map(F.lit, CARD_LENGTHS)), c["digits"]).alias("rank"), c["n"].alias("n"), c["text"].alias("text"))))
                card = let(F.get(ranked, F.lit(0)), lambda c: F.when(c.isNotNull(), F.struct(c["n"].alias("n"), c["text"].alias("old"), _card(c["text"], key).alias("new"))))
                small = let(other, lambda v: F.when(v.isNotNull(), F.struct(F.lit(3).alias("n"), three.alias("old"), v.alias("new"))))
                return F.coalesce(small, card)

            def replaced(c: Column) -> Column:
                one = F.array(F.struct(i.alias("at"), c["n"].alias("n"), c["old"].alias("old"), c["new"].alias("new")))
                return F.when(c.isNull(), s).otherwise(F.struct(F.concat(s["out"], one).alias("out"), (i + c["n"]).alias("next")))

            ahead = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), lambda n: span(i, n))
            return F.when(i < s["next"], s).otherwise(let(let(ahead, chosen), replaced))

        def told(out: Column) -> Column:
            """The groups between the replaced ones, and these with what follows their digits."""

            def part(r: Column, k: Column) -> Column:
                last = F.get(out, k - 1)
                begin = F.coalesce(last["at"] + last["n"], F.lit(0))
                whole = F.array_join(F.slice(groups, r["at"] + 1, r["n"]), "")
                return F.concat(F.array_join(F.slice(groups, begin + 1, r["at"] - begin), ""), r["new"], whole.substr(F.length(r["old"]) + 1, F.length(whole)))

            last = F.get(out, F.size(out) - 1)
            done = F.coalesce(last["at"] + last["n"], F.lit(0))
            rest = F.array_join(F.slice(groups, done + 1, F.size(groups) - done), "")
            return F.struct(F.concat(F.array_join(F.transform(out, part), ""), rest).alias("text"), F.size(F.filter(out, lambda r: r["new"] != r["old"])).alias("n"))

        none = F.array().cast("array<struct<at:int,n:int,old:string,new:string>>")
        start = F.struct(none.alias("out"), F.lit(0).alias("next"))
        return let(F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: s["out"]), told)

    return let(F.regexp_extract_all(x, F.lit("[0-9]+[ -]*"), 0), of)


def _runs_in(x: Column, key: str) -> Column:
    """What lies in a match that did not validate."""
    before, found = cut_by(x, RUN)

    def of(c: Column) -> Column:
        new = F.transform(c["found"], lambda r: _in_run(r, key))
        taken = F.aggregate(F.zip_with(c["before"], c["found"], lambda b, f: F.length(b) + F.length(f)), F.lit(0), lambda s, v: s + v)
        return let(
            new,
            lambda v: F.struct(
                F.concat(F.array_join(F.zip_with(c["before"], v, lambda b, r: F.concat(b, r["text"])), ""), x.substr(taken + 1, F.length(x))).alias("text"),
                F.aggregate(v, F.lit(0), lambda s, r: s + r["n"]).alias("n"),
            ),
        )

    return let(F.struct(before.alias("before"), found.alias("found")), of)


def _mod97(text: Column) -> Column:
    """The number that an IBAN's letters and digits spell, mod 97."""
    return F.aggregate(
        F.split(text, ""),
        F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(x: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        country, body = d.substr(1, 2), d.substr(F.lit(5), F.length(d) - 4)
        digits = _only(body, "[^0-9]")
        new = F.when(F.length(digits) >= 2, _filled(body, permuted_digits(digits, key, "iban"))).otherwise(body)
        check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
        whole = let(new, lambda b: _filled(x, F.concat(check(b), _only(b, "[^0-9]"))))
        return F.when(_mod97(F.concat(body, country, d.substr(3, 2))) == 1, whole).otherwise(x)

    return let(_only(x, " "), of)


def _phone(x: Column, key: str) -> Column:
    """The country code (the first run of digits) stays."""

    def of(d: Column) -> Column:
        code = F.regexp_extract(x, r"^\+([0-9]{1,3})", 1)
        own = d.substr(F.length(code) + 1, F.length(d))
        new = F.concat(code, permuted_digits(own, key, "phone"))
        return F.when(F.length(d).between(8, 15) & (F.length(own) >= 2), _filled(x, new)).otherwise(x)

    return let(_only(x, "[^0-9]"), of)


def _ssn(x: Column, key: str) -> Column:
    """Areas run from 001 to 899 without 666, groups from 01, serials from 0001: the places of the
    sound numbers among themselves are permuted, so that a pseudonym is sound too."""
    sound = ~x.rlike("^(000|666|9)") & ~x.rlike("^...-00") & ~x.rlike("0000$")
    part = lambda at, n: x.substr(at, n).cast("int")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    new = let(
        feistel(area, (part(5, 2) - 1) * 9999 + part(8, 4) - 1, F.lit(898), F.lit(99 * 9999), key, "ssn"),
        lambda s: F.format_string("%03d-%02d-%04d", s["l"] + F.when(s["l"] > 664, 2).otherwise(1), F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1),
    )
    return F.when(sound, new).otherwise(x)


def _ipv4(x: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i)).try_cast("int")
        new = let(
            feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ipv4"),
            lambda s: F.concat_ws(".", *[F.floor(h / 256).cast("string") if k == 0 else (h % 256).cast("string") for h in (s["l"], s["r"]) for k in (0, 1)]),
        )
        return F.when((part(0) < 256) & (part(1) < 256) & (part(2) < 256) & (part(3) < 256), new).otherwise(x)

    return let(F.split(x, r"\."), of)


def _date(x: Column, key: str) -> Column:
    """Both orders of day and month are one value: the day itself is permuted."""
    iso = x.substr(5, 1) == "-"
    day = F.when(iso, x).otherwise(F.concat_ws("-", x.substr(7, 4), x.substr(4, 2), x.substr(1, 2)))

    def of(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        new = let(
            feistel(F.floor(n / DAYS_RIGHT), n % DAYS_RIGHT, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key, "date"),
            lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS_RIGHT + s["r"]).cast("int")),
        )
        said = let(new, lambda v: F.when(iso, F.date_format(v, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(v, "dd"), x.substr(3, 1), F.date_format(v, "MM"), x.substr(6, 1), F.date_format(v, "yyyy"))))
        return F.when(d.isNotNull() & n.between(0, DAYS_LEFT * DAYS_RIGHT - 1), said).otherwise(x)

    return let(F.try_to_date(day, "yyyy-MM-dd"), of)


def _email(x: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(x)), 256)
    return F.concat(F.lit("p"), F.substring(digest, 1, 12), F.lit("@mail.invalid"))


def pseudonym(x: Column, key: str) -> Column:
    """What one match of ANY becomes, and how many values in it are replaced; what does not validate stays as it is."""
    whole = lambda p: x.rlike(f"^(?:{p})$")
    iban = let(_changed(x, _iban(x, key)), lambda v: F.when(v["n"] > 0, v).otherwise(_runs_in(x, key)))
    return (
        F.when(whole(EMAIL), _changed(x, _email(x, key)))
        .when(whole(PHONE), _changed(x, _phone(x, key)))
        .when(whole(IBAN), iban)
        .when(whole(DATE), _changed(x, _date(x, key)))
        .when(whole(SSN), _changed(x, _ssn(x, key)))
        .when(whole(IPV4), _changed(x, _ipv4(x, key)))
        .when(whole(RUN), _in_run(x, key))
        .otherwise(F.struct(x.alias("text"), F.lit(0).alias("n")))
    )


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every personal value of its text replaced; all other columns stay.

    ``count_col`` names a further column for the number of replaced values.  Null and
    empty texts stay.  Each row is treated alone, so repeated rows give repeated rows.
    Equal values give equal pseudonyms under one ``key``, which is the secret: who has it can
    invert the permutations.
    """
    before, found = cut_by(F.col(text_col), ANY)
    names = [f"__pii_{n}__" for n in ("before", "found", "new")]
    staged = docs.withColumns({names[0]: before, names[1]: found}).withColumn(names[2], F.transform(names[1], lambda x: pseudonym(x, key)))
    b, f, new = (F.col(n) for n in names)
    length = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    rest = F.col(text_col).substr(length(b) + length(f) + 1, F.length(text_col))
    text = F.when(F.size(f) > 0, F.concat(F.array_join(F.zip_with(b, new, lambda p, v: F.concat(p, v["text"])), ""), rest)).otherwise(F.col(text_col))
    n = F.aggregate(new, F.lit(0), lambda s, v: s + v["n"]).cast("long")
    out = staged.withColumns({text_col: text} | ({count_col: F.when(F.size(f) > 0, n).otherwise(F.lit(0)).cast("long")} if count_col else {}))
    return out.drop(*names)
