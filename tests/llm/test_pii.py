import hashlib
import random
import re

from meshwork.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, spans string, __x int"
KINDS = ("email", "ip", "card", "phone")


def passes(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (2 if i % 2 else 1)
        s += n - 9 if n > 9 else n
    return s % 10 == 0


def base(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and passes(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def card(rng):
    d = [rng.choice("0123456789") for _ in range(rng.choice([12, 15, 16, 18]))]
    for c in "0123456789":
        if passes("".join(d) + c):
            return "".join(d) + c


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    alphabet = "ab9 é.-@+%_0123 ()😀\n1.2.3.45-"
    words = ["the", "of", "él", "x-y", "a.b", "3.14", "99", "😀"]
    bits = [lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))),
            lambda: f"{rng.choice('ab.c')}{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com",
            lambda: "a@b.c.d@e.f", lambda: "a@b.c_x@y.z", lambda: "a@b..c@d.e",
            lambda: ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(3, 9))), lambda: "0001.02.3.004",
            lambda: card(rng), lambda: re.sub(r"(\d{4})(?=\d)", rng.choice([r"\1 ", r"\1-"]), card(rng)),
            lambda: card(rng) + rng.choice(["  ", "- ", " -"]) + card(rng),
            lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", lambda: "+44 20.7946.0958 ",
            lambda: "+1+1 222 333 4444 -.", lambda: "\u0001\u0002", lambda: "2222 4053 4324 8877 " * 2]
    rows = []
    for i in range(n):
        t = "".join(rng.choice([rng.choice(words) + " ", rng.choice(bits)(), rng.choice(["", " ", "\n"])])
                    for _ in range(rng.randint(0, 25)))
        rows.append((i, t, len(t), "s", 1))
    rows += [(1000, None, None, "s", 1), (1001, "", 0, None, 1), (1002, "1 " * 20000, 40000, "s", 1),
             (1003, "a@" + "b." * 20000 + "c", 40003, "s", 1), (1004, "x" * 50000, 50000, "s", 1),
             (1005, "5" * 30000 + " " + "a" * 30000 + "@", 1, "s", 1), (1006, "+1" + "(" * 30000, 1, "s", 1),
             (None, "q@r.st", 6, "s", None), (3, rows[3][1], 1, "s", 1), (3, rows[3][1], 1, "s", 1),
             (1007, "1.2.3.4 " * 3000, 1, "s", 1)]
    return rows


def test_base_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in pii.find_personal_data(df).collect()), key=str)
    want = []
    for r in rows:
        b = base(r[1])
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b)
        want.append((r[0], *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def plain(spans):
    return [tuple(x.split(":")) for x in spans.split(",")] if spans else []


def test_contexts_lead_to_unseen_identifiers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        rows.append((i, f"note {i} call me on +1 ({100 + i}) 555-{1000 + i} today, bye", 0, "", 0))
        rows.append((100 + i, f"it has part number {rng.randint(10**7, 10**8)} in it", 0, "", 0))
    rows += [(200, "please call me on 020-7946-0958 today", 0, "", 0), (201, "he was born in 19840712 or so", 0, "", 0),
             (202, "the old 020-7946-0958 again", 0, "", 0)]
    out = {r.doc_id: plain(r.spans) for r in pii.find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[200] == [("phone", "18", "31")] and out[202] == [("phone", "8", "21")]
    assert all(len(out[i]) == 1 for i in range(40)) and not any(out[100 + i] for i in range(40)) and not out[201]


def test_base_spans_stay_and_redaction_covers_them(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    out = pii.find_personal_data(df).collect()
    for r, row in zip(sorted(out, key=lambda r: (str(r.doc_id), r.spans)), sorted(rows, key=lambda r: str(r[0]))):
        mine = {(KINDS[k], str(s), str(e)) for s, k, e in base(row[1])}
        if row[0] != 3:
            assert mine <= set(plain(r.spans))
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    texts = {r.doc_id: r for r in clean.collect()}
    for row in rows:
        if row[0] not in (3,) and not base(row[1]) and row[0] is not None:
            assert texts[row[0]].text == row[1] or "<" in (texts[row[0]].text or "")
    assert texts[None].text == "<EMAIL>" and texts[None].n_chars == 7 and texts[1000].text is None


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus(6, 5), SCHEMA)
    plan = pii.base_entities(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_personal_data(empty).count() == 0 and pii.redact(empty).count() == 0
