import hashlib
import math
import random
import re
import string
from collections import Counter

import duckdb

from symloom.llm import secrets as S

RULES = {
    "assign": r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def brute(text):
    """All spans (start, kind, end)."""
    text, base = text or "", []
    for m in re.finditer(RULES["assign"], text):
        if len(m[1]) >= 6:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer(RULES["access"], text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(RULES["hex"], text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        s = m[0]
        hexa = re.fullmatch("[0-9a-fA-F]+", s)
        mixed = (re.search("[a-z]", s) and re.search("[A-Z]", s)) or re.search("[+/_=-]", s)
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s) and (hexa or mixed)) or any(re.search(p, s) for p in S.ALLOW):
            continue
        high = []
        for i in range(len(s) - S.WINDOW + 1):
            h = -sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in Counter(s[i : i + S.WINDOW]).values())
            if h >= (S.HEX_BITS if hexa else S.MIXED_BITS):
                high.append(i)
        if high:
            a, b = m.start() + high[0], m.start() + high[-1] + S.WINDOW
            if not any(x < b and a < y for x, _, y in base):
                more.append((a, 3, b))
    return sorted(base), sorted(base + more)


def row(doc, text):
    said = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    base, full = brute(text)
    n = Counter(k for _, k, _ in full)
    return (doc, n[0], n[1], n[2], n[3], hashlib.sha256(said(base).encode()).hexdigest(), said(full))


def texts():
    rng = random.Random(9)
    b64 = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    out = [None, "", "x", 'password = "hunter22"', "TOKEN:abc", "token: token = abcdefgh", "secret=token=abcdef", "Api_Key='a.b/c+d=e_f-g'", "é😀 apikey  :  abcdef", "ſecret=abcdef tKen=abcdefg paſſword=abcdefg"]
    out += ["AKIA" + "Q" * 15 + " AKIA" + "Q" * 16, "XAKIAKIA" + "A1" * 8, "deadbeef" * 3 + "G" + "ab12" * 5 + "c", "😀" + "0123456789abcdef" * 2, "550e8400-e29b-41d4-a716-446655440000"]
    out += [f"key {b64(40)} end", f"é{b64(20)}", f"{b64(300)}", "A" * 60 + b64(24) + "b" * 40, "DEADBEEF0123456789AB" + "CDEF", "some-long-slug-of-words-2024-part-17", "http://a/b/c/d/e/f12345678901234"]
    out += ["token=" + b64(30) + " " + b64(44), "word " * 20000 + b64(32) + " word" * 50, "secret: abcdef " * 200]
    alphabet = "aAfF09:= '\"-_/+tokensecretAKIAé\n"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(150)]
    return list(enumerate(out))


def test_against_brute_force_and_sql(spark):
    rows = texts() + [(3, texts()[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _base int")
    want = sorted(row(*r) for r in rows)
    assert sorted(map(tuple, S.scan(df).collect())) == want
    assert sum(r[4] for r in want) >= 5
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.sql(S.SQL).fetchall()) == want
    assert S.scan(df.limit(0)).count() == 0


def test_redact(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, 0, len(t or "")) for d, t in rows], "doc_id long, text string, _spans int, n_chars long")
    got = {r.doc_id: r for r in S.redact(df).collect()}
    for d, text in rows:
        want, pos = "", 0
        for a, _, b in brute(text)[1]:
            if a >= pos:
                want += (text or "")[pos:a] + "[SECRET]"
            pos = max(pos, b)
        want = None if text is None else want + text[pos:]
        assert got[d].text == want
        assert got[d].n_chars == len(want or "")
    assert S.redact(df).schema.names == df.schema.names


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = S.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tokens_of_one_case(spark):
    rng = random.Random(12)
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n)) + "7g" + letters[0]
    keys = ["9zq7x1mk3v0tw8rb5nyh2jd6", "K5QXG7DLMZ2WY4TPNB3RHJ6V"]
    keys += [token(string.ascii_lowercase + string.digits, n) for n in (24, 40, 300)] + [token(string.ascii_uppercase + "234567", n) for n in (24, 40, 300)]
    keys = [k.upper() if re.search("[A-Z]", k) else k for k in keys]
    plain = ["internationalization2024", "aaaaaaaaaaaaaaaaaaaazz12", "AAAABBBBAAAABBBBAAAAZ123"]
    df = spark.createDataFrame([(i, f"key {k} end") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: r for r in S.scan(df).collect()}
    text = {r.doc_id: r.text for r in S.redact(df).collect()}
    for i, k in enumerate(keys):
        bits = {a: -sum(c / 20 * math.log2(c / 20) for c in Counter(k[a : a + 20]).values()) for a in range(len(k) - 19)}
        high = [a for a, h in bits.items() if h >= (S.LOWER_BITS if k.islower() else S.UPPER_BITS)]
        assert got[i].spans == f"entropy:{4 + high[0]}:{4 + high[-1] + 20}" and k not in text[i]
    assert all(got[len(keys) + i].spans == "" for i in range(len(plain)))


def test_secrets_beside_allowed_parts(spark):
    key = "Ab3dE9kLm2Qw7Rt5Yz8Xc1Vb4Nh6"
    rows = [f"/api/token/{key}", f"//{key}", f"x={key}+dummy", f"EXAMPLE{key}", f"{key}//{key}", f"/data/store/{key}/part/{key}"]
    plain = ["/usr/local/lib2/python3-dist/Config_Loader", "//a/b/c/d/e/f12345678901234", "/some/path/of/words/2024/part17", "your_dummy_example_1234567"]
    df = spark.createDataFrame(list(enumerate(rows + plain)), "doc_id long, text string")
    text = {r.doc_id: r.text for r in S.redact(df).collect()}
    assert all(key not in text[i] and "[SECRET]" in text[i] for i in range(len(rows)))
    assert [text[len(rows) + i] for i in range(len(plain))] == plain
    assert {r.doc_id: r.spans for r in S.scan(df.where("doc_id in (0, 3)")).collect()} == {0: "entropy:11:39", 3: "entropy:7:35"}


def test_many_matches_in_one_text(spark):
    """Blocks of the folds meet without a gap: 300 matches with characters of two bytes between them."""
    parts = [f"token=aB3dE{i:06d}xyzQ9" for i in range(300)]
    df = spark.createDataFrame([(1, " é ".join(parts))], "doc_id long, text string")
    at = [i * (len(parts[0]) + 3) for i in range(300)]
    r = S.scan(df).first()
    assert r.n_assign == 300 and r.spans == ",".join(f"assign:{a}:{a + len(parts[0])}" for a in at)
    assert S.redact(df).first().text == " é ".join(["[SECRET]"] * 300)
