"""Format-preserving Feistel pseudonyms of personal data, in SQL functions only.

Numbers and dates that pass their check are permuted under a key within their format: a card number stays a
card number with a right check digit, a date a date, an address an address. One value has one pseudonym in
every document and notation (separators, order of a date), so links between documents survive; the values
themselves don't. What fails its check stays.

  card    13 to 19 digits of a right Luhn sum, with single spaces or hyphens between groups; all but the check
          digit, which is made anew. Beside other numbers groups as printed on cards come first, then the longest
  iban    right by mod 97, in one word or in groups of four; letters and digits of the account, check digits
          made anew
  date    1900-01-01 to 2100-01-01 as yyyy-mm-dd, or dd/mm/yyyy (mm/dd/yyyy if only that is a date), also
          with dots; the day's number in that span
  phone   ten digits of North America, with or without +1, and + numbers of 8 to 15 digits
  ssn     area, group and serial within their valid ranges
  ip      four octets
  email   letters and digits of the local part, each within its kind; the domain stays
  token   hexadecimal runs of 32 to 64, each character within its kind

A value is a row of small integers, each with its modulus. Even and odd places take turns: in each round one
half gets, place by place, a keyed hash of the other half added. Each round can be undone, so different
values have different pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm import common

ROUNDS = 8
KEY = "verbatlas"  # a deployment sets its own in spark.verbatlas.pii.key
FIRST_DAY, DAYS = "1900-01-01", (150, 487)  # 150 * 487 = 73050 days

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
# Checks that a regular expression can't make are made before the search: right cards have their digits moved to
# noncharacters and a mark behind them, right IBANs in groups have marks around them. ESCAPE parts these from
# noncharacters that a text itself holds.
MOVED = "".join(map(chr, range(0xFDD0, 0xFDDA)))
CARD_END, IBAN_START, IBAN_END, ESCAPE = "\ufdda", "\ufddb", "\ufddc", "\ufdef"
GROUPED = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9]))"
IBAN = rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9])|{IBAN_START}[A-Z0-9 ]++{IBAN_END}"
TOKEN = r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\1[0-9]{4})(?![0-9]|[/.\-][0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9](?:[ \-]?[0-9]){7,14}(?![0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
RUN = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,}+"
CARD = rf"[{MOVED}](?:[ \-]?[{MOVED}]){{12,18}}{CARD_END}"
# Of groups in a run: as cards are printed or in one piece, then any groups, the longest first; other numbers
# beside a card have a right sum with some of its groups one time in ten.
FORMS = [rf"[0-9]{{4}}([ \-])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{4}}{more}" for more in (r"\2[0-9]{3}", "")]
FORMS += [rf"[0-9]{{4}}([ \-])[0-9]{{6}}\2[0-9]{{{n}}}" for n in (5, 4)] + ["[0-9]{13,19}"]
FORMS += [rf"[0-9](?:[ \-]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]
OTHERS = "|".join((EMAIL, IBAN, TOKEN, DATE, IP, SSN, PHONE))
ANY_RUN, ANY = f"{OTHERS}|{RUN}", f"{OTHERS}|{CARD}"


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def permute(values: Column, mods: Column, tweak: str, key: str) -> Column:
    """values: 0 <= value < modulus at every place; the keyed permutation of the whole row."""

    def turn(row: Column, r: Column) -> Column:
        others = F.array_join(F.filter(row, lambda _, i: i % 2 != r % 2).cast("array<string>"), ",")
        stream = F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), others), 512)

        def add(s: Column) -> Column:
            def at(v: Column, i: Column) -> Column:
                drawn = F.conv(F.substr(s, F.floor(i / 2).cast("int") % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
                return F.when(i % 2 == r % 2, F.pmod(v + drawn, F.element_at(mods, i + 1))).otherwise(v)

            return F.transform(row, at)

        return _let(stream, add)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _digits(s: Column) -> Column:
    return _chars(F.regexp_replace(s, "[^0-9]", "")).cast("array<int>")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced one by one."""
    nth = lambda i: F.length(F.regexp_replace(F.left(shape, i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(shape), lambda c, i: F.when(c.rlike("[0-9]"), F.element_at(digits, nth(i)).cast("string")).otherwise(c)), "")


def _by_kind(s: Column, letters: int, tweak: str, key: str) -> Column:
    """A string with every digit and letter permuted within its kind (letters: how many from a)."""
    chars = _chars(s)
    low = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c)))
    mods = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), letters).otherwise(1))
    values = F.zip_with(chars, low, lambda c, b: F.ascii(c) - b)
    return F.array_join(F.zip_with(permute(values, mods, tweak, key), low, lambda v, b: F.char(v + b)), "")


def luhn(digits: Column) -> Column:
    """Sum of a row of digits whose last is the check digit, mod 10."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _joined(parts: Column, between: Column) -> Column:
    return F.array_join(F.flatten(F.zip_with(parts, F.concat(between, F.array(F.lit(""))), lambda p, m: F.array(p, m))), "")


def _marked_cards(run: Column) -> Column:
    """A run of digit groups with its cards marked: whole groups of a right sum, in the order of FORMS."""

    def of_form(a: Column, pattern: Column) -> Column:
        right = F.filter(F.array_distinct(F.regexp_extract_all(a, pattern, F.lit(1))), lambda c: luhn(_digits(c)) == 0)
        return F.aggregate(right, a, lambda b, c: F.regexp_replace(b, F.concat(F.lit("(?<![0-9])"), c, F.lit("(?![0-9])")), F.concat(F.translate(c, "0123456789", MOVED), F.lit(CARD_END))))

    return F.aggregate(F.array(*(F.lit(rf"(?<![0-9])(?=({form})(?![0-9]))") for form in FORMS)), run, of_form)


def _marked_ibans(text: Column) -> Column:
    """Of each start in groups of four the most groups that are right by mod 97 are marked."""

    def right(c: Column) -> Column:
        groups = F.split(c, " ")
        heads = F.transform(F.sequence(F.size(groups), F.lit(3), F.lit(-1)), lambda n: F.array_join(F.slice(groups, 1, n), " "))
        size = lambda h: F.length(F.regexp_replace(h, " ", ""))
        return F.get(F.filter(heads, lambda h: size(h).between(15, 34) & _let(F.regexp_replace(h, " ", ""), lambda x: mod97(F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4)))) == 1)), F.lit(0))

    found = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(GROUPED), F.lit(1))), right), lambda h: h.isNotNull())
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    mark = lambda a, h: F.regexp_replace(a, F.concat(F.lit(f"(?<![A-Za-z0-9{IBAN_START}])"), h, F.lit("(?![A-Za-z0-9])")), F.concat(F.lit(IBAN_START), h, F.lit(IBAN_END)))
    return F.when(text.rlike("[A-Z]{2}[0-9]{2} [A-Z0-9]{4} [A-Z0-9]{4} "), F.aggregate(longest, text, mark)).otherwise(text)


def _card(found: Column, key: str) -> Column:
    m = F.translate(found, MOVED + CARD_END, "0123456789")

    def valid(d: Column) -> Column:
        body = F.slice(d, 1, F.size(d) - 1)
        new = permute(body, F.transform(body, lambda _: F.lit(10)), "card", key)
        whole = _let(F.concat(new, F.array(F.lit(0))), lambda x: F.concat(F.slice(x, 1, F.size(x) - 1), F.array((10 - luhn(x)) % 10)))
        return F.when(luhn(d) == 0, _let(whole, lambda x: _refill(m, x))).otherwise(m)

    return _let(_digits(m), valid)


def mod97(s: Column) -> Column:
    """Of digits and capitals (10 to 35), read from left to right."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban(found: Column, key: str) -> Column:
    m = F.regexp_replace(found, f"[ {IBAN_START}{IBAN_END}]", "")
    land, account = F.left(m, F.lit(2)), F.substr(m, F.lit(5))
    new = _let(_by_kind(account, 26, "iban", key), lambda a: F.concat(land, F.lpad((98 - mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a))
    shaped = F.when(found.startswith(IBAN_START), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)
    return F.when(mod97(F.concat(account, F.left(m, F.lit(4)))) == 1, shaped).otherwise(m)


def _date(m: Column, key: str) -> Column:
    a, b, y = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2)), F.right(m, F.lit(4))
    iso = m.rlike("^[0-9]{4}")
    day_first = F.try_to_date(F.concat_ws("-", y, b, a), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", y, a, b), "yyyy-MM-dd")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))

    def moved(d: Column) -> Column:
        n = F.date_diff(d, F.to_date(F.lit(FIRST_DAY)))
        row = permute(F.array(F.floor(n / DAYS[1]).cast("int"), n % DAYS[1]), F.array(F.lit(DAYS[0]), F.lit(DAYS[1])), "date", key)
        new = _let(row, lambda x: F.date_add(F.to_date(F.lit(FIRST_DAY)), F.element_at(x, 1) * DAYS[1] + F.element_at(x, 2)))
        mark = F.substr(m, F.lit(3), F.lit(1))
        put = lambda t: F.when(iso, F.date_format(t, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(t, "dd"), mark, F.date_format(t, "MM"), mark, F.date_format(t, "yyyy")))
        put_month = lambda t: F.concat(F.date_format(t, "MM"), mark, F.date_format(t, "dd"), mark, F.date_format(t, "yyyy"))
        text = _let(new, lambda t: F.when(iso | day_first.isNotNull(), put(t)).otherwise(put_month(t)))
        return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), text).otherwise(m)

    return F.coalesce(_let(day, moved), m)


def _phone(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        home = (F.size(d) == 10) | ((F.size(d) == 11) & (F.element_at(d, 1) == 1))
        keep = F.when(home, F.size(d) - 10).otherwise(2)
        rest = F.slice(d, keep + 1, F.size(d) - keep)
        low = F.transform(rest, lambda v, i: F.when(home & i.isin(0, 3) & (v >= 2), 2).otherwise(0))
        mods = F.transform(rest, lambda v, i: F.when(home & i.isin(0, 3), F.when(v >= 2, 8).otherwise(2)).otherwise(10))
        new = F.zip_with(permute(F.zip_with(rest, low, lambda v, b: v - b), mods, "phone", key), low, lambda v, b: v + b)
        return _let(F.concat(F.slice(d, 1, keep), new), lambda x: _refill(m, x))

    return _let(_digits(m), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    row = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)

    def put(x: Column) -> Column:
        a = F.element_at(x, 1)
        parts = ((a + F.when(a >= 665, 2).otherwise(1), 3), (F.element_at(x, 2) + 1, 2), (F.element_at(x, 3) + 1, 4))
        return F.concat_ws("-", *(F.lpad(v.cast("string"), n, "0") for v, n in parts))

    return F.when(valid, _let(permute(row, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key), put)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.split(m, "[.]").cast("array<int>")
    new = F.array_join(permute(octets, F.transform(octets, lambda _: F.lit(256)), "ip", key).cast("array<string>"), ".")
    return F.when(F.array_max(octets) < 256, new).otherwise(m)


def _email(m: Column, key: str) -> Column:
    return F.concat(_by_kind(F.substring_index(m, "@", 1), 26, "email", key), F.lit("@"), F.substring_index(m, "@", -1))


KINDS = [("email", "@", _email), ("token", "^[0-9a-f]{32,64}$", lambda m, k: _by_kind(m, 6, "token", k)), ("iban", f"^[A-Z{IBAN_START}]", _iban), ("date", f"^(?:{DATE})$", _date), ("ip", r"^[0-9]+(?:\.[0-9]+){3}$", _ip), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn), ("phone", f"^(?:{PHONE})$", _phone), ("card", "", _card)]


def pseudonym(m: Column, key: str = KEY) -> Column:
    """Of one found value; the value itself if it fails its check."""
    out = None
    for _, pattern, made in KINDS:
        out = F.when(m.rlike(pattern), made(m, key)) if out is None else out.when(m.rlike(pattern), made(m, key))
    return out.otherwise(m)


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_found, n_replaced) of every row, text with pseudonyms in place of its valid values.

    Null texts are empty. Rows stay as they are, repeated ones and null ids too; other columns are ignored.
    n_found counts a run of digits without a right card as one.
    """
    key = key or docs.sparkSession.conf.get("spark.verbatlas.pii.key", KEY)
    base = common.id_and_text(docs)
    held = F.when(F.col("text").rlike(f"[{MOVED[0]}-{ESCAPE}]"), F.regexp_replace("text", f"([{MOVED[0]}-{ESCAPE}])", f"{ESCAPE}$1")).otherwise(F.col("text"))
    # First pass: runs of digits. Where there are some, a second one over the text with its cards marked.
    first = base.withColumn("_text", _marked_ibans(held)).withColumn("_first", F.regexp_extract_all("_text", F.lit(ANY_RUN), F.lit(0)))
    marked = F.transform("_first", lambda m: F.when(m.rlike(f"^(?:{RUN})$"), _marked_cards(m)).otherwise(m))
    runs = F.filter("_first", lambda m: m.rlike(f"^(?:{RUN})$") & ~m.rlike(f"^(?:{TOKEN})$"))
    second = first.withColumns({"_runs": runs, "_marked": marked})
    again = F.size("_runs") > 0
    second = second.withColumn("_again", F.when(again, _joined(F.split("_text", ANY_RUN, -1), F.col("_marked"))))
    found = second.withColumns({"_found": F.when(again, F.regexp_extract_all("_again", F.lit(ANY), F.lit(0))).otherwise(F.col("_first")), "_parts": F.when(again, F.split("_again", ANY, -1)).otherwise(F.split("_text", ANY_RUN, -1))})
    found = found.withColumn("_made", F.transform("_found", lambda m: pseudonym(m, key)))
    whole = _joined(F.col("_parts"), F.col("_made"))
    text = F.when(whole.contains(ESCAPE), F.regexp_replace(whole, f"{ESCAPE}([{MOVED[0]}-{ESCAPE}])", "$1")).otherwise(whole)
    plain = lambda m: F.translate(m, MOVED + CARD_END + IBAN_START + IBAN_END, "0123456789")
    changed = F.size(F.filter(F.zip_with("_found", "_made", lambda a, b: plain(a) != b), lambda x: x))
    wrong = F.size(F.filter("_runs", lambda m: F.array_contains("_marked", m)))
    n_found = F.size("_found") + wrong
    return found.select("doc_id", F.when(F.size("_found") > 0, text).otherwise(F.col("text")).alias("text"), n_found.alias("n_found"), changed.alias("n_replaced"))


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(common.read(spark, sf_dir, "documents"))
