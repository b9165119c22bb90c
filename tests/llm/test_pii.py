import re

from helixmark.llm import pii

KEY = b"key"


def test_formats_and_coreference():
    text = "Mr John Smith met Mrs Anna SMITH at 10.1.2.3; 4111 1111 1111 1111, 4111-1111-1111-1111; J.S@Mail7.example.com j.s@mail7.example.com GB82 WEST 1234 5698 7654 32 123-45-6789"
    new, found = pii.replace(text, KEY, {})
    assert [k for *_, k in found] == ["person", "person", "ip", "card", "card", "email", "email", "iban", "ssn"]
    a, b = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", new)
    assert a.replace(" ", "") == b.replace("-", "") != "4111111111111111" and pii.luhn(a.replace(" ", ""))
    assert re.search(r"at 10\.\d+\.\d+\.\d+;", new)
    x, y = re.findall(r"\S+@\S+", new)
    assert x.lower() == y and x != y and x.endswith(".com")
    iban = re.search(r"GB\d\d \w{4} \d{4} \d{4} \d{4} \d\d", new)[0].replace(" ", "")
    assert pii._iban_rest(iban) == 1
    assert re.search(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+) ", new)[2].upper() == re.search(r"Mrs (\w+) (\w+) ", new)[2]


def test_script_and_gender():
    new, found = pii.replace("господин Иван Петров; ٤١١١١١١١١١١١١١١١", KEY, {})
    assert all(pii._script(w) == "cyrillic" for w in new.split(";")[0].split())
    assert all("٠" <= c <= "٩" for c in new.split("; ")[1]) and len(found) == 2
    assert pii.surrogate(KEY, "given-f-latin", "anna").endswith(tuple(pii.PARTS["latin"][1]["f"]))


def test_what_is_no_entity_stays():
    for text in ("version 1.2.3.4.5 of 2024-11-26", "number 9807915762804491 isn't a card", "Dr who", "300.1.2.3", "a @ b"):
        assert pii.replace(text, KEY, {}) == (text, [])


def test_collisions_are_resolved(spark, monkeypatch):
    """With a domain of few surrogates: all distinct, and none an entity."""
    real = pii.surrogate
    rows = [("ssn", f"{i:09d}") for i in range(30)]

    def narrow(key, kind, canon, attempt=0):
        return f"{int(real(key, 'ssn', canon, attempt)) % 200:09d}"

    monkeypatch.setattr(pii, "surrogate", narrow)

    def drawn(df, key):
        got = [(k, c, t, narrow(key, k, c, t)) for k, c, t in df.select("kind", "canon", "attempt").collect()]
        return spark.createDataFrame(got, "kind string, canon string, attempt int, surrogate string")

    monkeypatch.setattr(pii, "_drawn", drawn)
    out = pii.assign(spark.createDataFrame(rows, "kind string, canon string"), KEY).toPandas()
    assert len(out) == 30 and out.surrogate.is_unique and not set(out.surrogate) & set(out.canon) and out.attempt.max() > 0


def test_edge_cases_and_both_paths(edge, nothing):
    a = pii.pseudonymise(edge, KEY).toPandas()
    b = pii.pseudonymise(edge, KEY, max_broadcast=-1).toPandas()
    assert len(a) == edge.count() and sorted(map(str, a.text)) == sorted(map(str, b.text))
    assert pii.pseudonymise(nothing, KEY).count() == 0
    row = a[a.doc_id == 8].iloc[0]
    assert (row.n_email, row.n_phone, row.n_card) == (1, 1, 1) and "555-7713" not in row.text and "4111111111111111" not in row.text
    assert a[a.doc_id == 1].text.isna().all()


def test_no_planted_entity_is_left(documents):
    out = pii.pseudonymise(documents, KEY).toPandas()
    before = documents.toPandas()
    plain = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d+\.\d+\.\d+\.\d+(?![\w.])")
    known = {x for t in before.text for x in plain.findall(t)}
    assert known and not {x for t in out.text for x in plain.findall(t)} & known
    same = before.merge(out, on="doc_id")
    assert (same[same.entities == ""].text_x == same[same.entities == ""].text_y).all()


def test_all_mentions_of_a_person_agree(spark):
    new, _ = pii.replace("Dr Anna Berg came. Later Ms Anna Berg left.", KEY, {})
    a, b = re.findall(r"(?:Dr|Ms) (\w+ \w+)", new)
    assert a == b and a.split()[0].endswith(tuple(pii.PARTS["latin"][1]["f"])) and "Anna" not in new and "Berg" not in new
    new, found = pii.replace("Mr John Smith sang. Then John Smith said so, and SMITH's friend, Smith-Jones, and John. The smith and Johnson stay.", KEY, {})
    given, surname = re.match(r"Mr (\w+) (\w+) sang", new).groups()
    assert new == f"Mr {given} {surname} sang. Then {given} {surname} said so, and {surname.upper()}'s friend, {surname}-Jones, and {given}. The smith and Johnson stay."
    assert [k for *_, k in found] == ["person"] * 5
    rows = [(1, "Dr Anna Berg"), (2, "Ms Anna Berg"), (3, "Prof Kim Berg"), (4, "Mr Kim Berg"), (5, "Mrs Kim Berg")]
    for most in (100, -1):  # the same over all texts, by either path
        out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY, most).toPandas().set_index("doc_id").text
        names = out.str.split(" ", n=1).str[1]
        assert names[1] == names[2] != names[3] == names[4] == names[5]
        assert names[1].split()[0].endswith(tuple(pii.PARTS["latin"][1]["f"])) and names[3].split()[0].endswith(tuple(pii.PARTS["latin"][1]["n"]))


def test_telephone_forms():
    for number in ("+14155552671", "+1 415-555-2671", "+33612345678", "+33 6 12 34 56 78", "+49 (30) 1234 5678-90", "+44/20/7946/0958", "06 12 34 56 78", "06.12.34.56.78", "044 668 18 00", "020 7946 0958", "4155552671", "0612345678", "+1 (017) 555-7713", "(017) 555-7713"):
        new, found = pii.replace(f"Call {number}, or {number}.", KEY, {})
        assert [k for *_, k in found] == ["phone", "phone"], number
        a, b = re.fullmatch(r"Call (.*), or (.*)\.", new).groups()
        assert a == b != number and re.sub(r"\d", "#", a) == re.sub(r"\d", "#", number)
        assert not number.startswith("+") or a.startswith({"1": "+1", "3": "+33", "4": number[:3]}[number[1]])
    new, _ = pii.replace("+33612345678 and +33 6 12 34 56 78", KEY, {})
    a, b = new.split(" and ")
    assert a == b.replace(" ", "")
    for text in ("01-02-2024", "01.02.2024 at 12", "at 1700000000 s", "0.123456789", "id 12345678901234567", "10 20 30 40 50", "x4155552671", "+1 of 3"):
        assert pii.replace(text, KEY, {}) == (text, []), text


def test_small_spaces_are_left_behind(spark):
    """More entities than surrogates of the first attempt: local parts of one letter, a whole small network, names of one letter."""
    greek = "αβγδεζηθικλμνξοπρστυφχψω"
    rows = [("email", f"{c}@x.gr") for c in greek] + [("email", f"{c}@x.com") for c in "abcdefghijklmnopqrstuvwxyzéèà"]
    rows += [("ip", f"169.254.{i // 256}.{i % 256}") for i in range(0, 65536, 2)] + [("surname--thai", c) for c in "กขคงจฉช"]
    out = pii.assign(spark.createDataFrame(rows, "kind string, canon string"), KEY).toPandas()
    assert len(out) == len(rows) and not set(out.surrogate) & {c for _, c in rows}
    assert not out.duplicated(["kind", "surrogate"]).any() and out.attempt.max() < pii.MAX_ATTEMPTS
    assert out[out.kind == "ip"].surrogate.str.startswith(("169.254.", "192.168.", "172.", "10.", "2")).all()


def test_full_private_network_moves_to_the_next_one():
    got = {pii.surrogate(KEY, "ip", "192.168.1.1", k).split(".")[0] for k in range(0, 120)}
    assert {"192", "172", "10"} <= got


def test_names_of_other_scripts():
    for text, script in (("Mr 伟 王 met 王", "cjk"), ("Dr محمد علي", "arabic"), ("Ms שרה כהן", "hebrew"), ("Prof 김 민준", "hangul"), ("السيدة فاطمة حسن", "arabic")):
        new, found = pii.replace(text, KEY, {})
        old_names, names = text.split(" ", 1)[1].split(), new.split(" ", 1)[1].split()
        assert found and found[0][2] == "person" and len(names) >= 2
        assert all(pii._script(n) == script for n in names if n != "met") and not (set(names) - {"met"}) & set(old_names), (text, new)
    new, _ = pii.replace("Mr 伟 王 met 王", KEY, {})
    assert new.split()[2] == new.split()[4]
    new, _ = pii.replace("write x@例え.jp", KEY, {})
    assert pii._script(new.split("@")[1].split(".")[0]) in ("cjk", "hiragana") and new.endswith(".jp")


def test_longer_surrogates_are_written_out():
    assert pii.formatted("phone", "555 1234", ":98765432") == "987 65432" and pii.formatted("ssn", "123-45-6789", "9876543211") == "987-65-43211"


def test_columns_with_dots(spark):
    df = spark.createDataFrame([(1, "a.b@c.example.org", 2)], "doc_id long, text string, `x.y` int")
    out = pii.pseudonymise(df, KEY)
    assert "x.y" in out.columns and out.first()["n_email"] == 1


def test_one_number_in_any_form_has_one_surrogate():
    new, found = pii.replace("(415) 555-2671 and +1 415 555 2671, 4155552671, 1-415-555-2671 or 001 415 555 2671", KEY, {})
    digits = ["".join(c for c in x if c.isdigit())[-10:] for x in new.replace(" and ", "|").replace(", ", "|").replace(" or ", "|").split("|")]
    assert len(found) == 5 and len(set(digits)) == 1 and digits[0] != "4155552671"
    assert new.split(", ")[1].startswith(digits[0]) and "(" + digits[0][:3] + ")" in new and "+1 " in new
    new, found = pii.replace("06 12 34 56 78, +33 6 12 34 56 78 and +33 (0)6 12 34 56 78", KEY, {}, region="33")
    assert len(found) == 3 and new.startswith("0") and "+33 (0)" in new
    parts = [x[-14:].replace(" ", "")[-8:] for x in new.replace(" and ", ", ").split(", ")]
    assert len(set(parts)) == 1
    assert [f[2] for f in pii.find(new, "33")] == ["phone"] * 3


def test_trunk_zero_and_leading_zeros_stay():
    new, _ = pii.replace("06 12 34 56 78", KEY, {})
    assert new[0] == "0" and [f[2] for f in pii.find(new)] == ["phone"]
    new, _ = pii.replace("0612345678", KEY, {})
    assert new[0] == "0" and len(new) == 10 and [f[2] for f in pii.find(new)] == ["phone"]
    new, _ = pii.replace("192.168.001.010 or 192.168.1.10", KEY, {})
    a, b = new.split(" or ")
    assert [int(x) for x in a.split(".")] == [int(x) for x in b.split(".")] and all(len(x) == 3 for x in a.split("."))


def test_numbers_of_other_things_stay():
    for text in ("order 4155552671", "Invoice #4155552671", "version 1.2.3.4", "Release: 10.0.0.1"):
        assert pii.replace(text, KEY, {}) == (text, [])
    assert len(pii.find("call 4155552671 at 10.0.0.1")) == 2


def test_surrogates_of_numbers_are_found_again():
    import random

    rng = random.Random(2)
    for _ in range(300):
        n = f"{rng.randint(2, 9)}{rng.randint(0, 99):02d}{rng.randint(2, 9)}{rng.randint(0, 999999):06d}"
        for text in (n, f"+1{n}", f"({n[:3]}) {n[3:6]}-{n[6:]}", f"0{n[:9]}"):
            new, found = pii.replace(text, KEY, {})
            assert len(found) == 1 and len(new) == len(text) and [f[:3] for f in pii.find(new)] == [(0, len(new), "phone")], (text, new)
