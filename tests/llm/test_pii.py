import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii


def brute(text):
    """The definition, pattern by pattern."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii._luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0125()x%", max_size=60))
def test_plain_equals_definition(text):
    assert pii.plain(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4486733645976649", "4111 1111 1111 1111", " ", "1.2.3.4", ".", "5", "-", "a.b@c.de", "@", "+1 (632) 555-4827", "é", "256"]), max_size=12))
def test_plain_equals_definition_on_identifiers(parts):
    assert pii.plain("".join(parts)) == brute("".join(parts))


def found(text):
    base, every = pii.spans(text)
    assert set(base) <= set(every)
    return base, [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base]


def test_disguises_map_back():
    assert found("write to jane.doe (at) example [dot] com now")[1] == [("email", "jane.doe (at) example [dot] com")]
    assert found("write to jane at mail dot example dot com now")[1] == [("email", "jane at mail dot example dot com")]
    assert found("jаne@exаmple.cоm")[1] == [("email", "jаne@exаmple.cоm")] or found("jаne@exаmple.cоm")[0]
    assert found("call plus one six three two five five five four eight two seven please")[1] == [("phone", "plus one six three two five five five four eight two seven")]
    assert found("at １９２．１６８．１．１ here")[1] == [("ip", "１９２．１６８．１．１")]
    assert found("host one nine two dot one six eight dot one dot one up")[1] == [("ip", "one nine two dot one six eight dot one dot one")]


def test_mixed_disguises_map_back():
    for said in (
        "jane (at) example dot com",
        "jane at example [dot] com",
        "jane@example dot com",
        "jane dot doe at example dot com",
        "jane dot doe (at) mail.example dot com",
        "jane at mail dot example [dot] com",
    ):
        assert found(f"write to {said} now") == ([], [("email", said)])
        assert pii.masked(f"write to {said} now") == "write to [EMAIL] now"
    assert found("me at foo.bar at example dot com now")[1] == [("email", "foo.bar at example dot com")]
    assert found("(at) look at example.com, a dot here") == ([], [])
    for text in ("a dot " * 40_000, "a at b.c " * 30_000 + " dot ", "a@" * 60_000 + " dot ", "." * 100_000 + " dot "):
        pii.spans(text)


def test_clean_texts_stay():
    for text in ("we met at noon. dot the line", "one two buckle my shoe", "the point at hand", "étude für über"):
        assert found(text) == ([], [])


def test_long_texts_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "at " * 60_000, "one " * 50_000):
        pii.spans(text)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x a@b.co y", 3), (3, "x a@b.co y", 3)], "doc_id long, text string, spans int")
    got = sorted(tuple(r) for r in pii.find(docs).select("doc_id", "n_email", "spans").collect())
    assert got == [(1, 0, ""), (2, 0, ""), (3, 1, "email:2:8"), (3, 1, "email:2:8")]
    assert pii.find(docs.limit(0)).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect() if r["text"] is not None) == [(2, ""), (3, "x [EMAIL] y"), (3, "x [EMAIL] y")]


def disguise(rng, kind):
    """(text, the kind, source span) of a made identifier in a made disguise, amid words."""
    name, host, tld = (rng.choice(x) for x in (["jane.doe", "max", "info-desk", "a_b"], ["example", "mail.example", "my-host"], ["com", "org", "de"]))
    digits = [str(rng.randint(0, 9)) for _ in range(10)]
    spelled = "zero one two three four five six seven eight nine".split()
    wide = lambda s: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s)
    if kind == "email":
        at, dot = rng.choice(["@", " (at) ", " [at] ", " at ", "(at)", " {AT} "]), rng.choice([" dot ", " [dot] ", " (dot) ", "[DOT]", "."])
        if at == "@" and dot == "." or at == " at " and dot == ".":
            at = " (at) "
        said = f"{name}{at}{host.replace('.', dot)}{dot}{tld}"
        if rng.random() < 0.2:
            said = f"{name}@{host}.{tld}".replace("a", "а").replace("e", "е")  # Cyrillic
        if said.isascii() is False and not set(said) & set("ае"):
            said = wide(f"{name}@{host}.{tld}")
    elif kind == "phone":
        said = rng.choice([f"plus one {' '.join(spelled[int(x)] for x in digits)}", wide("+1" + "".join(digits)), f"+1 ({''.join(digits[:3])})‑{''.join(digits[3:6])}‑{''.join(digits[6:])}"])
    else:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        said = rng.choice([wide(".".join(parts)), " dot ".join(" ".join(spelled[int(c)] for c in p) for p in parts), "․".join(parts)])
    before, after = rng.choice(["Reach me: ", "write to ", "— "]), rng.choice([" now", ", thanks", ""])
    return before + said + after, (kind, len(before), len(before) + len(said))


def test_recall_on_made_disguises():
    import random

    rng = random.Random(21)
    caught = {}
    for kind in ("email", "phone", "ip"):
        hits = 0
        for _ in range(400):
            text, (want, a, b) = disguise(rng, kind)
            hits += any(k == want and x <= a + 1 and y >= b - 1 for k, x, y in pii.spans(text)[1])
        caught[kind] = hits / 400
    assert min(caught.values()) >= 0.9, caught


def test_the_query(spark, tmp_path):
    import hashlib

    rows = [(1, "mail a.b@c.de, 10.0.0.1 or +1 (632) 555-4827; 4111 1111 1111 1111", "x"), (2, None, "x"), (None, "jane (at) example dot com", "x"), (3, "é" * 2_000_000 + " x@y.zz", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    out = pii.op8_pii(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_email", "bigint"), ("n_ip", "bigint"), ("n_card", "bigint"), ("n_phone", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text, _ in rows:
        base = [s for kind in ("email", "ip", "card", "phone") for s in sorted(brute(text or "")) if s[0] == kind]
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert got[None]["spans"] == "email:0:25"
