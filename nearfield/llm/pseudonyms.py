"""Format-preserving pseudonyms by a keyed Feistel network, in Spark SQL expressions.

Found and validated: e-mail addresses, long hexadecimal secrets, payment card numbers (13 to
19 digits with a right Luhn digit), IPv4 addresses (numbers up to 255), telephone numbers and
calendar dates. Each keeps its format: separators, the classes of its characters, its
length (IPv4: four numbers up to 255), a right check digit, a date that exists. Equal values
get equal pseudonyms in all documents; different values of a format get different ones.

The network splits a value's characters into two halves and adds to each character, modulo
the size of its class (10 digits, 26 letters, 6 hexadecimal letters), a number from the
SHA-256 of the key, the round and the other half: a permutation of all values of one format.
A value of one character has no other half; its class is put into the order of keyed digests.
Latin, Greek and Cyrillic letters outside ASCII, in the local part of an e-mail address, move
among the letters of their script and case (``ALPHABETS``). Card numbers permute all digits but the last, which is computed anew. IPv4 addresses permute
their four numbers modulo 256. Dates permute year (of 200, from 1900) and day of a common
year; 29 February maps among leap years.

Cards are looked for between the other values, in every run of digit groups: each part of a run
that begins and ends at a separator or the run's ends is tested, so a number beside a card (an
expiry date, a security code) doesn't hide it. Of parts that overlap the longest counts.

Only rows with a match do more than the search; there is no shuffle and no Python.

n_found counts the validated values, those that their permutation happens to leave alone too.

The key comes from the session's ``spark.nearfield.pseudonym.key``, or as an argument;
``pseudonymised`` has none of its own. The registered query falls back on ``DEMO_KEY``.

Defined cases: null text stays null with n_found 0; an empty table gives an empty table; long
texts are searched whole, with patterns that repeat without a stack, whatever the length of a
host, a number or a run of digits; only the local part of an address is changed, so that any
host will do; of a local part of more than 64 characters the last 64 count; letters of other
scripts end a local part; numbers that fail validation stay; rows may repeat and equal texts
get equal results; further columns are kept as they are, whatever their names, except that a
column n_found is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.storage import spare

KEY_SETTING, DEMO_KEY = "spark.nearfield.pseudonym.key", "nearfield-demo-key"
ROUNDS = 8

#: fixed patterns by kind
EMAIL = r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2})(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9A-Za-z])"
KINDS = [("email", EMAIL), ("secret", SECRET), ("ipv4", IPV4), ("date", DATE), ("phone", PHONE)]
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: a whole run of digit groups, in which cards are looked for; possessive, so that long runs need no stack
RUN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?:[ -][0-9]++(?![A-Za-z]))*+(?![A-Za-z])"
CARD_DIGITS = range(19, 12, -1)

#: letters of a script's blocks outside ASCII, by case
ALPHABETS = ["".join(c for c in map(chr, range(a, b)) if c.isalpha() and c.islower() == low) for a, b in ((0xC0, 0x250), (0x370, 0x400), (0x400, 0x530)) for low in (True, False)]


def _stream(key: str, label: str, r: int, other: Column) -> Column:
    """64 numbers of 32 bits from a round's digests of the other half (eight digests of 64 digits)."""
    text = F.concat_ws("|", F.lit(key), F.lit(label), F.lit(str(r)), other)
    return F.concat(*(F.sha2(F.concat(F.lit(str(i)), text), 256) for i in range(8)))


def _number(hexes: Column, i: Column) -> Column:
    """Number i (from 0) of a stream; characters beyond the stream reuse it from the start."""
    return F.conv(F.substring(hexes, F.pmod(i, F.lit(64)) * 8 + 1, F.lit(8)), 16, 10).cast("long")


def _class(c: Column, hexa: bool = False) -> tuple[Column, Column]:
    """(size, first code) of a character's class; size 0 stays."""
    code = F.ascii(c)
    letters = 6 if hexa else 26
    size = F.when(code.between(48, 57), 10).when(code.between(97, 96 + letters), letters).when(code.between(65, 64 + letters), letters).otherwise(0)
    return size, F.when(code.between(48, 57), 48).when(code.between(97, 122), 97).otherwise(65)


def _shifted(half: Column, stream: Column, hexa: bool, wide: bool) -> Column:
    """Every character moved within its class by its number of the stream."""

    def move(c, i):
        size, base = _class(c, hexa)
        out = F.when(size == 0, c).otherwise(F.chr((base + F.pmod(F.ascii(c) - base + _number(stream, i), F.greatest(size, F.lit(1)))).cast("int")))
        if not wide:
            return out
        far = c
        for letters in ALPHABETS:
            at = F.instr(F.lit(letters), c)
            far = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + _number(stream, i), F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(far)
        return F.when(F.ascii(c) < 128, out).otherwise(far)

    return F.array_join(F.transform(F.split(half, ""), move), "")


def _single(c: Column, key: str, label: str, hexa: bool, wide: bool) -> Column:
    """One character under the keyed order of its class: the n-th letter becomes the n-th by digest."""
    out = c
    for letters in ["0123456789", *(x[: 6 if hexa else 26] for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), *(ALPHABETS if wide else [])]:
        shuffled = "".join(sorted(letters, key=lambda x: hashlib.sha256(f"{key}|{label}|single|{x}".encode()).digest()))
        out = F.when(F.instr(F.lit(letters), c) > 0, F.translate(c, letters, shuffled)).otherwise(out)
    return out


def feistel(value: Column, key: str, label: str, hexa: bool = False, wide: bool = False, rounds: int = ROUNDS) -> Column:
    """A permutation of the strings with the classes of ``value``'s characters."""
    # let-bindings by transform over one-element arrays, so that no expression is repeated inside itself
    n = F.char_length(value)
    state = F.array(F.struct(F.substring(value, F.lit(1), F.floor(n / 2).cast("int")).alias("l"), F.substring(value, F.floor(n / 2).cast("int") + 1, n).alias("r")))
    for k in range(rounds):
        state = F.transform(state, _round(key, label, k, hexa, wide))
    whole = F.get(F.transform(state, lambda s: F.concat(s["l"], s["r"])), F.lit(0))
    return F.when(n == 1, _single(value, key, label, hexa, wide)).otherwise(whole)


def _round(key: str, label: str, k: int, hexa: bool, wide: bool):
    def step(s):
        if k % 2 == 0:
            return F.struct(_move(s["l"], s["r"], key, label, k, hexa, wide).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), _move(s["r"], s["l"], key, label, k, hexa, wide).alias("r"))

    return step


def _move(half: Column, other: Column, key: str, label: str, k: int, hexa: bool, wide: bool) -> Column:
    streams = F.array(_stream(key, label, k, other))
    return F.when(half == "", half).otherwise(F.get(F.transform(streams, lambda t: _shifted(half, t, hexa, wide)), F.lit(0)))


def _luhn(digits: Column, odd: int) -> Column:
    """The Luhn sum; of a whole number with ``odd`` 0, of one without its check digit with 1."""

    def worth(c, i):
        d = c.cast("int")
        twice = F.pmod(i + odd, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def _with_digits(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by others, in order."""
    chars = F.split(template, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _card(m: Column, key: str) -> Column:
    """A validated card number, with any separators, under its pseudonym."""

    def new(digits):
        n = F.char_length(digits)
        body = feistel(F.substring(digits, F.lit(1), n - 1), key, "card")
        return _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(b, 1) % 10, F.lit(10)).cast("string")))

    return _let(F.regexp_replace(m, "[^0-9]", ""), lambda d: _with_digits(m, new(d)))


def _cards_at(tokens: Column) -> Column:
    """(less: minus the number of digits, at) of the cards among a run's digits, each with the separator
    before it: parts between separators with a right Luhn digit, the longest first, then the first."""

    def bound(i):
        return (i == 0) | (i == F.size(tokens)) | (F.char_length(F.get(tokens, i)) == 2)

    def valid(c):
        digits = F.regexp_replace(F.array_join(F.slice(tokens, c["at"] + 1, -c["less"]), ""), "[ -]", "")
        return bound(c["at"] - c["less"]) & (_luhn(digits, 0) % 10 == 0)

    def from_here(i):
        sizes = F.array(*(F.struct(F.lit(-n).alias("less"), i.alias("at")) for n in CARD_DIGITS))
        return F.filter(sizes, lambda c: F.when(c["at"] - c["less"] <= F.size(tokens), valid(c)).otherwise(F.lit(False)))

    starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), bound)
    none = F.array().cast("array<struct<less:int,at:int>>")

    def add(chosen, c):
        met = F.exists(chosen, lambda o: (o["at"] < c["at"] - c["less"]) & (c["at"] < o["at"] - o["less"]))
        return F.when(met, chosen).otherwise(F.concat(chosen, F.array(c)))

    return F.aggregate(F.array_sort(F.flatten(F.transform(starts, from_here))), none, add)


def _run(m: Column, key: str) -> Column:
    """(text, n): a run of digits with its n cards under pseudonyms."""

    def put(tokens):
        by_place = F.array_sort(F.transform(_cards_at(tokens), lambda c: F.struct(c["at"].alias("at"), (-c["less"]).alias("n"))))

        def rebuilt(cards):
            joined = lambda a, n: F.array_join(F.slice(tokens, a + 1, n), "")
            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
            done = F.aggregate(cards, start, lambda s, c: F.struct(F.concat(s["out"], joined(s["at"], c["at"] - s["at"]), _card(joined(c["at"], c["n"]), key)).alias("out"), (c["at"] + c["n"]).alias("at")))
            return _let(done, lambda s: F.struct(F.concat(s["out"], joined(s["at"], F.size(tokens))).alias("text"), F.size(cards).alias("n")))

        return _let(by_place, rebuilt)

    return _let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]"), F.lit(0)), put)


def _with_cards(text: Column, key: str) -> Column:
    """(text, n): a text with its n cards under pseudonyms."""

    def put(runs):
        between = F.split(text, RUN, -1)
        joined = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(runs)), runs, lambda a, b: F.concat(a, b["text"])), ""), F.element_at(between, -1))
        return F.struct(joined.alias("text"), F.aggregate(runs, F.lit(0), lambda a, b: a + b["n"]).alias("n"))

    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda m: _run(m, key))
    return F.when(text.rlike(RUN), _let(runs, put)).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def _ipv4(m: Column, key: str) -> Column:
    """Digits alone could leave the range of 0 to 255, so numbers move modulo 256."""
    state = F.array(F.transform(F.split(m, "[.]"), lambda x: x.cast("long")))

    def turn(k):
        a, b = (0, 2) if k % 2 == 0 else (2, 0)

        def step(s):
            other = F.concat_ws(".", F.get(s, F.lit(b)).cast("string"), F.get(s, F.lit(b + 1)).cast("string"))
            return _let(_stream(key, "ipv4", k, other), lambda t: F.transform(s, lambda x, i: F.when((i == a) | (i == a + 1), F.pmod(x + _number(t, i), F.lit(256))).otherwise(x)))

        return step

    for k in range(ROUNDS):
        state = F.transform(state, turn(k))
    return F.get(F.transform(state, lambda s: F.concat_ws(".", F.transform(s, lambda x: x.cast("string")))), F.lit(0))


def _keyed(key: str, label: str, r: int, other: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), F.lit(str(r)), other), 256), 1, 12), 16, 10).cast("long")


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    day = F.coalesce(F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy")))

    def new(d):
        leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
        # leap years from 1904 to 2096
        turned = F.pmod((F.year(d) - 1904) / 4 + _keyed(key, "leap", 0, F.lit("")), F.lit(49)).cast("int") * 4 + 1904
        state = F.array(F.struct((F.year(d) - 1900).cast("long").alias("y"), F.datediff(F.make_date(F.lit(2001), F.month(d), F.when(leap, 28).otherwise(F.dayofmonth(d))), F.lit("2001-01-01")).cast("long").alias("n")))

        def turn(k):
            def step(s):
                if k % 2 == 0:
                    return F.struct(F.pmod(s["y"] + _keyed(key, "date", k, s["n"].cast("string")), F.lit(200)).alias("y"), s["n"].alias("n"))
                return F.struct(s["y"].alias("y"), F.pmod(s["n"] + _keyed(key, "date", k, s["y"].cast("string")), F.lit(365)).alias("n"))

            return step

        for k in range(ROUNDS):
            state = F.transform(state, turn(k))

        def real(s):
            common = F.date_add(F.lit("2001-01-01").cast("date"), s["n"].cast("int"))
            return F.make_date((s["y"] + 1900).cast("int"), F.month(common), F.dayofmonth(common))

        moved = F.when(leap, F.make_date(turned, F.lit(2), F.lit(29))).otherwise(F.get(F.transform(state, real), F.lit(0)))
        return _let(moved, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "dd.MM.yyyy")))

    return F.when(day.isNull(), m).otherwise(_let(day, new))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel(local, key, "email", wide=True), F.substring(m, F.char_length(local) + 1, F.char_length(m)))


def _phone(m: Column, key: str) -> Column:
    """The country code after + stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ (-])", 0)
    rest = F.substring(m, F.char_length(code) + 1, F.char_length(m))
    return F.concat(code, _with_digits(rest, feistel(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def _real_day(m: Column) -> Column:
    return F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy")).isNotNull()


def pseudonym(m: Column, key: str) -> Column:
    whole = {k: m.rlike(f"^(?:{p})$") for k, p in KINDS}
    out = F.when(whole["email"], _email(m, key)).when(whole["secret"], feistel(m, key, "secret", hexa=True)).when(whole["ipv4"], _ipv4(m, key)).when(whole["date"], _date(m, key)).when(whole["phone"], _phone(m, key))
    return out.otherwise(m)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with validated values in ``text`` replaced, and n_found, how many there were."""
    if not key:
        raise ValueError(f"a key is needed; set {KEY_SETTING}")
    text = F.col("text")
    found, put, between = (spare(docs.columns, c) for c in ("found", "put", "between"))
    marked = docs.withColumn(found, F.when(text.rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    marked = marked.withColumn(put, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))).otherwise(F.col(found)))
    # cards are looked for between the other values
    numbers = text.rlike(RUN)
    pieces = F.split(text, ANY, -1)
    marked = marked.withColumn(between, F.when(numbers, F.transform(pieces, lambda t: _with_cards(t, key))).otherwise(F.transform(pieces, lambda t: F.struct(t.alias("text"), F.lit(0).alias("n")))))
    joined = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(put)), F.col(put), lambda a, b: F.concat(a["text"], b)), ""), F.element_at(between, -1)["text"])
    valid = F.filter(found, lambda m: ~m.rlike(f"^(?:{DATE})$") | _real_day(m))
    n = F.size(valid) + F.aggregate(between, F.lit(0), lambda a, b: a + b["n"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", "n_found")]
    return marked.select(*kept, F.when((F.size(found) > 0) | numbers, joined).otherwise(text).alias("text"), F.coalesce(n, F.lit(0)).cast("long").alias("n_found"))


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymised(docs, spark.conf.get(KEY_SETTING, DEMO_KEY)).select("doc_id", "n_found", "text")


ORACLE_SQL = None
