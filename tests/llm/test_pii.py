import hashlib
import random
import re

from revlens.llm.pii import KINDS, find_pii, mask_pii, span_classifier

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(t):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), KINDS.index(k), m.end()))
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in find_pii(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])
    return got


def test_base_spans_against_re(spark):
    r = random.Random(6)
    parts = ["a.b@mail.example.com", "x@y", "a@b.c_d@e.f", "x@y@z.org", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.2.3", "010.020.030.040", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (407) 555-7710", "+49 30 1234567", "+1", "+12 34", "é日本", "word", "12", "007", ".", "@", "+", "-", "(", "\n", "9b0b3c6a43eb78aa99cbd7", "378282246310005"]
    rows = ["".join(r.choice(parts) + r.choice(["", " ", " ", ", ", "."]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    check(spark, [*rows, None, "", "no data", "1 " * 40_000, "a" * 50_000 + "@", "a@" + "b." * 20_000 + "c", "0" * 60_000, "+1" + "(" * 30_000])


def test_added_spans_and_mask(spark):
    r = random.Random(1)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = [f"please call phone {num(3)}-555-{num(4)} or +1 ({num(3)}) 555-{num(4)} today" for _ in range(60)] + [f"mail me: jo.{num(2)}@mail.example.com or jo.{num(2)} [at] mail.example.com" for _ in range(60)] + ["version 1.2.3.400", "invoice 1111111111111"]
    got = check(spark, rows)
    assert sum(len(got[i]["spans"].split(",")) == 2 for i in range(120)) > 100
    assert got[120]["spans"] == "" and got[121]["spans"] == ""
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*rows, None, ""])] + [(None, rows[0], 1)], "doc_id long, text string, row int")
    masked = {(r["doc_id"], r["row"]): r["text"] for r in mask_pii(df).collect()}
    assert len(masked) == len(rows) + 3
    assert masked[0, 0] == masked[None, 1] == "please call phone [PHONE] or [PHONE] today"
    assert masked[120, 120] == rows[120] and masked[122, 122] is None and masked[123, 123] == ""


def test_empty_table_and_classifier(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    p = span_classifier([("0,1,1,1,1,0", 500), ("0,-1,-1,0,-1,0", 300), ("0,-1,1,1,1,0", 20)])
    assert p["0,1,1,1,1,0"] > 0.95 and p["0,-1,-1,0,-1,0"] < 0.05
