"""Format-preserving pseudonyms for personal data, as DataFrame expressions.

Candidates are found by one pattern; each is typed and validated (calendar
dates, Luhn check digits, address octets, phone shapes, mailbox names, secret
tokens). A valid candidate is replaced by a keyed permutation of its own
format, so that equal values get equal pseudonyms in every document and
different values of a format stay different:

* The characters that carry the value (digits, or letters and digits) are
  read as one number per half; a balanced Feistel network permutes the pair.
  Each round adds a keyed SHA-256 value of one half to the other, modulo the
  size of that half's domain, which is a bijection whatever the round value.
* Separators, letter case and length stay. A card number keeps its length
  and gets the check digit of its new digits. A date becomes another date of
  the 400 years from 1800-01-01 (146,097 days = 189 * 773, so the network
  never leaves the range). An address becomes another address.
* NN/NN/NNNN and NN.NN.NNNN are read day first, and month first only where
  the day-first reading is no date: 05/06/1990 is the 5th of June, 12/25/1990
  Christmas. The pseudonym is written in the order in which the date was
  read, so a month-first one may look like a day-first one.

Only built-in functions run: pattern functions split a text into candidates
and the rest, higher-order functions map the candidates, and the pieces are
joined again.

Values that stand side by side are read apart: a run of digit groups ends
where a value of another kind starts, and card numbers are sought in it at
every group, so that an expiry month, a security code or any other number
before or after a card does not hide it.

Null text stays NULL and has no pseudonyms; an empty text stays empty;
candidates that fail validation stay as they are; repeated rows give
repeated results; other columns pass through, apart from ``n_pseudonyms``
and ``kinds``, which replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshift.llm.common import let

ROUNDS = 8
FIRST_DAY = "1800-01-01"
DAYS = (189, 773)  # 400 Gregorian years

#: Candidate patterns by kind, in the order in which they are tried (fixed values).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:password|passwd|secret|token|api_key|apikey)[=:][A-Za-z0-9]{8,}"
              r"|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,})(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
            r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
OTHERS = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Groups of digits, 13 digits or more in all, up to a group at which a value of another kind starts.
PATTERNS["card"] = (r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++"
                    rf"(?:[ -](?!{OTHERS})[0-9]++)*+")
CANDIDATE = rf"{OTHERS}|(?:{PATTERNS['card']})"
#: Lengths of the groups of a card number as cards print it.
PRINTED = r"^(?:1[3-9]|4 4 4 4(?: 3)?|4 6 [45])$"
DIGITS = "0123456789"
LOWER = DIGITS + "abcdefghijklmnopqrstuvwxyz"


def _round_value(key: str, tweak: Column, step: Column, half: Column) -> Column:
    """A keyed value below 2**52."""
    text = F.concat_ws("|", F.lit(key), tweak, step.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str,
            rounds: int = ROUNDS) -> Column:
    """Struct ``(l, r)``: a keyed permutation of [0, left_size) x [0, right_size)."""
    def turn(state: Column, step: Column) -> Column:
        even = step % 2 == 0
        l_new = F.when(even, F.pmod(state["l"] + _round_value(key, tweak, step, state["r"]), left_size))
        r_new = F.when(~even, F.pmod(state["r"] + _round_value(key, tweak, step, state["l"]), right_size))
        return F.struct(F.coalesce(l_new, state["l"]).alias("l"), F.coalesce(r_new, state["r"]).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn)


def _power(base: int, exponent: Column) -> Column:
    return F.pow(F.lit(float(base)), exponent).cast("long")


def permute_digits(digits: Column, tweak: Column, key: str) -> Column:
    """Another string of as many digits (1 to 30)."""
    def split(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - half
        left, right = F.substr(d, F.lit(1), half), F.substr(d, half + 1, rest)
        new = feistel(F.when(half == 0, 0).otherwise(F.nullif(left, F.lit("")).cast("long")), right.cast("long"),
                      _power(10, half), _power(10, rest), tweak, key)
        return let(new, lambda s: F.concat(F.when(half == 0, "").otherwise(F.lpad(s["l"].cast("string"), half, "0")),
                                           F.lpad(s["r"].cast("string"), rest, "0")))
    return let(digits, split)


def permute_alnum(text: Column, tweak: Column, key: str) -> Column:
    """``text`` with its letters and digits permuted in blocks of 16, class by class.

    Every letter is replaced by a letter of its case and every digit by a
    digit. A block's shape (which classes stand where) is part of the tweak;
    the values of its characters are one mixed-radix number per half.
    """
    def block(b: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(b, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
        chars = F.filter(F.split(b, ""), lambda c: c != "")

        def radix(c: Column) -> Column:
            return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("long")

        def value(c: Column) -> Column:
            return (F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[a-z]$"), F.ascii(c) - 97)
                    .when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).otherwise(0).cast("long"))

        def number(part: Column) -> Column:
            return F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a * radix(c) + value(c))

        def size(part: Column) -> Column:
            return F.aggregate(part, F.lit(1).cast("long"), lambda a, c: a * radix(c))

        def spell(part: Column, n: Column) -> Column:
            # digits from the last character to the first; a character of another class stays
            def step(state: Column, c: Column) -> Column:
                d = F.pmod(state["n"], radix(c)).cast("int")
                new = (F.when(c.rlike("^[0-9]$"), F.char(d + 48)).when(c.rlike("^[a-z]$"), F.char(d + 97))
                       .when(c.rlike("^[A-Z]$"), F.char(d + 65)).otherwise(c))
                return F.struct(F.expr("1").cast("int").alias("one"),
                                F.floor(state["n"] / radix(c)).cast("long").alias("n"),
                                F.concat(new, state["s"]).alias("s"))
            start = F.struct(F.lit(1).alias("one"), n.alias("n"), F.lit("").alias("s"))
            return F.aggregate(F.reverse(part), start, step, lambda s: s["s"])

        def permuted(c: Column) -> Column:
            half = F.ceil(F.size(c) / 2).cast("int")
            left, right = F.slice(c, F.lit(1), half), F.slice(c, half + 1, F.greatest(F.size(c) - half, F.lit(0)))
            new = feistel(number(left), number(right), size(left), size(right), F.concat(tweak, shape), key)
            return let(new, lambda s: F.concat(spell(left, s["l"]), spell(right, s["r"])))

        return let(chars, permuted)

    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s).{1,16}"), F.lit(0)), lambda b: b != "")
    return F.array_join(F.transform(blocks, lambda b: block(b)), "")


def weave(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""
    gaps = F.split(shape, "[0-9]", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(
        F.when(i > 0, F.substr(digits, i, F.lit(1))).otherwise(""), g)), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def weight(c: Column, i: Column) -> Column:
        d = c.cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, double).otherwise(d)
    return F.aggregate(F.transform(backwards, weight), F.lit(0), lambda a, x: a + x)


def card_pseudonym(value: Column, digits: Column, key: str) -> Column:
    """Another number that passes the Luhn check, in the same shape."""
    def check(body: Column) -> Column:
        digit = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return weave(value, F.concat(body, digit.cast("string")))
    return let(permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("card"), key), check)


def cards_in(value: Column, key: str) -> Column:
    """Struct ``(kind, value, n)``: ``value``, groups of digits, with its card numbers replaced.

    A card number is one or more whole groups, 13 to 19 digits in all, that
    pass the Luhn check. From left to right the longest is taken, one grouped
    as cards are printed before any other that shares a group with it.
    """
    def replaced(groups: Column) -> Column:
        def run(i: Column, k: Column) -> Column:  # groups i to k - 1, the first separator left out
            return F.regexp_replace(F.array_join(F.slice(groups, i + 1, k - i), ""), "^[ -]", "")

        def passes(i: Column, k: Column) -> Column:
            digits = let(F.regexp_replace(run(i, k), "[^0-9]", ""), lambda d: F.when(
                F.length(d).between(13, 19), luhn_sum(d) % 10 == 0).otherwise(False))
            return digits

        def ends(i: Column) -> Column:  # 19 groups hold 19 digits at least; the longest first
            last = F.least(i + 19, F.size(groups))
            return F.filter(F.sequence(last, i + 1, F.lit(-1)), lambda k: passes(i, k))

        def printed(i: Column, k: Column) -> Column:
            sizes = F.transform(F.split(run(i, k), "[ -]"), lambda g: F.length(g).cast("string"))
            return F.array_join(sizes, " ").rlike(PRINTED)

        def scanned(found: Column) -> Column:
            best = F.transform(found, lambda ks, i: F.coalesce(F.get(F.filter(ks, lambda k: printed(i, k)), F.lit(0)),
                                                               F.lit(0)))

            def chosen(best: Column) -> Column:
                def free(i: Column, k: Column) -> Column:
                    return ~F.exists(F.slice(best, i + 2, k - i - 1), lambda b: b > 0)

                return F.transform(best, lambda b, i: F.when(b > 0, b).otherwise(F.coalesce(
                    F.get(F.filter(F.get(found, i), lambda k: free(i, k)), F.lit(0)), F.lit(0))))

            def step(state: Column, i: Column, end: Column) -> Column:
                card = (i >= state["at"]) & (end > 0)
                number = run(i, end)
                sep = F.regexp_extract(F.get(groups, i), "^[ -]", 0)
                made = F.concat(sep, card_pseudonym(number, F.regexp_replace(number, "[^0-9]", ""), key))
                return F.struct(F.when(card, end).otherwise(state["at"]).alias("at"),
                                (state["n"] + F.when(card, 1).otherwise(0)).cast("long").alias("n"),
                                F.concat(state["out"], F.when(card, made).when(i >= state["at"], F.get(groups, i))
                                         .otherwise("")).alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.lit("").alias("out"))
            return let(let(best, chosen), lambda ends_at: F.aggregate(
                F.sequence(F.lit(0), F.size(groups) - 1), start, lambda s, i: step(s, i, F.get(ends_at, i)),
                lambda s: F.struct(F.when(s["n"] > 0, "card").alias("kind"), s["out"].alias("value"), s["n"].alias("n"))))

        return let(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), ends), scanned)

    return let(F.regexp_extract_all(value, F.lit("[ -]?[0-9]+"), F.lit(0)), replaced)


def date_read(value: Column, order: str) -> Column:
    """The date that ``value`` writes with the year first or else in ``order`` (a replacement), or NULL."""
    iso = F.regexp_extract(value, r"^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})$", 0)
    year_first = F.regexp_replace(iso, "/", "-")
    year_last = F.regexp_replace(value, r"^([0-9]{2})[./]([0-9]{2})[./]([0-9]{4})$", order)
    return F.try_to_timestamp(F.when(iso != "", year_first).otherwise(year_last), F.lit("yyyy-MM-dd")).cast("date")


def date_parts(value: Column) -> Column:
    """The date that ``value`` writes, day first where that is a date; or NULL."""
    return F.coalesce(date_read(value, "$3-$2-$1"), date_read(value, "$3-$1-$2"))


def date_pseudonym(value: Column, key: str) -> Column:
    """Another date of the 400 years, written like ``value``; NULL if it is none of them."""
    day = F.date_diff(date_parts(value), F.lit(FIRST_DAY).cast("date"))

    def write(d: Column) -> Column:
        new = feistel(F.floor(d / DAYS[1]), d % DAYS[1], F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"),
                      F.lit("date"), key)
        date = let(new, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")))
        text = F.when(value.rlike("^[0-9]{4}-"), F.date_format(date, "yyyy-MM-dd")).when(
            value.rlike("^[0-9]{4}/"), F.date_format(date, "yyyy/MM/dd")).when(
            date_read(value, "$3-$2-$1").isNull(), F.when(value.contains("/"), F.date_format(date, "MM/dd/yyyy"))
            .otherwise(F.date_format(date, "MM.dd.yyyy"))).when(
            value.rlike("^[0-9]{2}/"), F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))
        return F.when((d >= 0) & (d < DAYS[0] * DAYS[1]), text)
    return let(day, write)


def address_pseudonym(value: Column, key: str) -> Column:
    """Another IPv4 address; NULL if an octet is over 255."""
    def write(octets: Column) -> Column:
        new = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536).cast("long"),
                      F.lit(65536).cast("long"), F.lit("address"), key)
        text = let(new, lambda s: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))
        return F.when(F.array_max(octets) <= 255, text)
    return let(F.transform(F.split(value, r"\."), lambda o: o.cast("long")), write)


def pseudonym(value: Column, key: str) -> Column:
    """Struct ``(kind, value, n)`` for one candidate; kind is NULL and n 0 where validation fails."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def whole(kind: str) -> Column:
        return value.rlike(f"^(?:{PATTERNS[kind]})$")

    prefix = F.regexp_extract(value, r"^(AKIA|[a-z_]+[=:]|gh[pousr]_|sk-)", 1)
    mail = F.split(value, "@")
    made = {
        "email": F.concat(permute_alnum(mail[0], F.lit("mail"), key), F.lit("@"),
                          permute_alnum(F.regexp_replace(mail[1], r"\.[A-Za-z]+$", ""), F.lit("host"), key),
                          F.regexp_extract(mail[1], r"\.[A-Za-z]+$", 0)),
        "secret": F.concat(prefix, permute_alnum(F.substr(value, F.length(prefix) + 1), F.lit("secret"), key)),
        "address": address_pseudonym(value, key),
        "date": date_pseudonym(value, key),
        "phone": F.when(F.length(digits).between(7, 15), weave(value, permute_digits(digits, F.lit("phone"), key))),
        "ssn": F.when(~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^.{3}00") & ~digits.rlike("0000$"),
                      weave(value, permute_digits(digits, F.lit("ssn"), key))),
    }
    one, none = F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n")
    found = [F.when(whole(kind), F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("value"), one)))
             for kind, new in made.items()]
    return F.coalesce(*found, F.when(value.rlike("^[0-9][0-9 -]{12,}$"), cards_in(value, key)),
                      F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"), none))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, ``n_pseudonyms`` and ``kinds`` (sorted, distinct)."""
    text = F.col(text_col).cast("string")
    found = let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
                lambda m: F.transform(m, lambda v: let(v, lambda x: pseudonym(x, key))))

    def made(f: Column) -> Column:
        woven = let(F.split(text, CANDIDATE, -1), lambda g: F.array_join(F.transform(g, lambda s, i: F.concat(
            s, F.coalesce(F.get(f, i)["value"], F.lit("")))), ""))
        kinds = F.filter(F.transform(f, lambda s: s["kind"]), lambda k: k.isNotNull())
        return F.struct(woven.alias("text"), F.aggregate(f, F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n"),
                        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"),
                       F.when(text.rlike(CANDIDATE), let(found, made)).otherwise(none).alias("made"))
    kept = [c for c in docs.columns if c not in ("n_pseudonyms", "kinds")]
    return rows.select(*[F.col("made.text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in kept],
                       F.col("made.n").alias("n_pseudonyms"), F.col("made.kinds").alias("kinds"))
