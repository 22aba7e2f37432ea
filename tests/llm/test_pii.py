import datetime
import hashlib
import re

from pyspark.sql import functions as F

from verbatlas.llm import pii


def feistel(values, mods, tweak, key=pii.KEY):
    """The same permutation in plain Python."""
    row = list(values)
    for r in range(pii.ROUNDS):
        others = ",".join(str(v) for i, v in enumerate(row) if i % 2 != r % 2)
        s = hashlib.sha512(f"{key}|{tweak}|{r}|{others}".encode()).hexdigest()
        row = [(v + int(s[i // 2 % 32 * 4 :][:4], 16)) % mods[i] if i % 2 == r % 2 else v for i, v in enumerate(row)]
    return row


def luhn_ok(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0


def changed(spark, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return [r.text for r in pii.pseudonymize(rows).orderBy("doc_id").collect()]


def test_cards(spark):
    a, b, bad = changed(spark, "pay 4111 1111 1111 1111 now", "4111-1111-1111-1111", "4111111111111112")
    assert bad == "4111111111111112" and a != "pay 4111 1111 1111 1111 now"
    digits = [int(c) for c in re.sub(r"\D", "", a)]
    assert luhn_ok(digits) and digits[:15] == feistel([4] + [1] * 14, [10] * 15, "card")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and re.fullmatch(r"pay \d{4} \d{4} \d{4} \d{4} now", a) and b.count("-") == 3


def test_cards_beside_numbers(spark):
    card = "".join(map(str, feistel([4] + [1] * 14, [10] * 15, "card")))
    card += next(c for c in "0123456789" if luhn_ok([int(x) for x in card + c]))
    four = " ".join(card[k : k + 4] for k in range(0, 16, 4))
    for before, after in (("", " 12/27"), ("", "-2"), ("12 ", ""), ("1234 ", ""), ("1 ", " 12 27")):
        assert changed(spark, f"pay {before}4111 1111 1111 1111{after}")[0] == f"pay {before}{four}{after}", (before, after)
    assert changed(spark, "4111111111111111 123") == [card + " 123"] and changed(spark, "4111-1111-1111-1111 2") == [four.replace(" ", "-") + " 2"]
    assert changed(spark, "4111 1111 1111 1111 4111111111111111 9") == [f"{four} {card} 9"]
    day, phone, slash = changed(spark, "2021-03-09", "743-555-3824", "09/03/2021")
    assert changed(spark, "5 4111 1111 1111 1111 2021-03-09", "4111 1111 1111 1111 743-555-3824", "4111 1111 1111 1111 09/03/2021") == [f"5 {four} {day}", f"{four} {phone}", f"{four} {slash}"]
    assert changed(spark, "\ufdd4\ufdef 4111111111111111 \ufdd1\ufdda\ufddb1\ufddc" + "\ufdd4" * 16 + "\ufdda") == [f"\ufdd4\ufdef {card} \ufdd1\ufdda\ufddb1\ufddc" + "\ufdd4" * 16 + "\ufdda"]
    row = pii.pseudonymize(spark.createDataFrame([(1, "4111 1111 1111 1111 12, 1234 5678 9012 3456 7")], "doc_id bigint, text string")).first()
    assert (row.n_found, row.n_replaced) == (2, 1)
    assert changed(spark, "7" * 50_000 + " 4111111111111111")[0] == "7" * 50_000 + " " + card


def test_ibans_in_groups(spark):
    for land, tail in (("DE89370400440532013000", ""), ("GB82WEST12345698765432", ""), ("AT611904300234573201", " EUR"), ("AT611904300234573201", " 4111 1111 1111 1111")):
        whole, = changed(spark, land)
        groups = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
        rest = changed(spark, tail)[0]
        assert whole != land and changed(spark, f"to {groups(land)}{tail}.", f"AB12 {groups(land)}{tail}") == [f"to {groups(whole)}{rest}.", f"AB12 {groups(whole)}{rest}"]
    assert changed(spark, "DE88 3704 0044 0532 0130 00") == ["DE88 3704 0044 0532 0130 00"]


def test_dates(spark):
    iso, slash, us, dots, no = changed(spark, "on 2021-03-09.", "09/03/2021", "03/29/2021", "09.03.2021", "2021-02-30 99/99/2020")
    day = datetime.date(1900, 1, 1) + datetime.timedelta((lambda n: n[0] * 487 + n[1])(feistel(divmod((datetime.date(2021, 3, 9) - datetime.date(1900, 1, 1)).days, 487), pii.DAYS, "date")))
    assert iso == f"on {day:%Y-%m-%d}." and slash == f"{day:%d/%m/%Y}" and dots == f"{day:%d.%m.%Y}"
    datetime.datetime.strptime(us, "%m/%d/%Y")
    assert no == "2021-02-30 99/99/2020"


def test_other_kinds(spark):
    phone, bare, ip, ssn, mail, token, iban, wrong = changed(spark, "+1 (743) 555-3824", "743-555-3824", "217.94.102.185", "123-45-6789", "jo.doe-7@x.example.com", "11acdfb36bb72224148e6160f674b4be45601bff", "GB82WEST12345698765432", "GB83WEST12345698765432 999.1.1.1 000-12-3456")
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", phone) and re.sub(r"\D", "", phone)[1:] == re.sub(r"\D", "", bare)
    assert all(int(x) < 256 for x in ip.split(".")) and [int(x) for x in ip.split(".")] == feistel([217, 94, 102, 185], [256] * 4, "ip")
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn) and ssn != "123-45-6789"
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}-\d@x\.example\.com", mail) and mail != "jo.doe-7@x.example.com"
    assert re.fullmatch("[0-9a-f]{40}", token) and token != "11acdfb36bb72224148e6160f674b4be45601bff"
    number = int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))
    assert number % 97 == 1 and iban[:2] == "GB" and iban != "GB82WEST12345698765432"
    assert wrong == "GB83WEST12345698765432 999.1.1.1 000-12-3456"


def test_permutes_one_to_one(spark):
    rows = spark.range(150 * 487).select((F.floor(F.col("id") / 487)).cast("int").alias("a"), (F.col("id") % 487).cast("int").alias("b")).limit(4000)
    new = rows.select(pii.permute(F.array("a", "b"), F.array(F.lit(150), F.lit(487)), "date", "k").alias("p"))
    assert new.distinct().count() == 4000 and new.where("p[0] not between 0 and 149 or p[1] not between 0 and 486").count() == 0


def test_odd_rows(odd, repeated, none, odd_texts):
    out = {r.doc_id: r for r in pii.pseudonymize(odd).collect()}
    assert [out[k].text for k in range(len(odd_texts))] == [t or "" for t in odd_texts]
    assert pii.pseudonymize(repeated).count() == 6 and pii.pseudonymize(none).count() == 0
    assert "Python" not in pii.pseudonymize(odd)._jdf.queryExecution().toString()
