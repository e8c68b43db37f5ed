import hashlib
import math
import random
import re
import string

from formline.llm import queries, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ORDER = {k: i for i, k in enumerate([*secrets.BASE, "entropy"])}


def allowed(word):
    patterns = [re.sub(r"\(\?<(\w+)>", r"(?P<\1>", re.sub(r"\\k<(\w+)>", r"(?P=\1)", p)) for p in secrets.unnested(secrets.ALLOW)]
    return any(re.fullmatch(p, word) for p in patterns)


def by_hand(text):
    text = text or ""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = []
    for m in re.finditer(secrets.CANDIDATE, text):
        word = m[0]
        if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)) or allowed(word):
            continue
        _, size, limit = next(c for c in secrets.CLASSES if re.fullmatch(c[0], word))
        hits = []
        for i in range(len(word) - size + 1):
            part = word[i:i + size]
            total = sum(secrets.F_OF[part.count(c)] for c in set(part))
            if total <= math.floor(size * (math.log2(size) * 1e6 - limit)):
                hits.append(i)
        if hits:
            s = ("entropy", m.start() + hits[0], m.start() + hits[-1] + size)
            if not any(b <= s[1] and s[2] <= e for _, b, e in base):
                more.append(s)
    key = lambda s: (s[1], ORDER[s[0]], s[2])
    return sorted(base, key=key), sorted(base + more, key=key)


def texts():
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    pieces = [
        lambda: "password: " + pick(string.ascii_letters, rng.randint(3, 12)), lambda: 'API_KEY = "' + pick("ab.=-/9", 9) + '"',
        lambda: "token: secret: " + pick("abc1", 9), lambda: "AKIA" + pick(string.ascii_uppercase + "0123456789", rng.randint(8, 18)),
        lambda: pick("0123456789abcdef", rng.randint(18, 50)), lambda: pick(string.ascii_letters + string.digits, rng.randint(18, 60)),
        lambda: pick(secrets.ALPHABET, 44), lambda: "é\U0001F600 ñ", lambda: "word " * 3, lambda: "ab12" * 8,
        lambda: "2024-01-02T10-11-12-abcdefgh", lambda: "a1b2c3d4-1111-2222-3333-abcdefabcdef",
        lambda: "0123456789abcdef0123456789ABCDEF", lambda: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1" + pick(secrets.ALPHABET, 30),
        lambda: "AKIAAKIA", lambda: "\n", lambda: "-", lambda: " ",
    ]
    out = ["".join(rng.choice(pieces)() for _ in range(rng.randint(0, 6))) for _ in range(400)]
    return [None, "", "AKIA" * 4000, "f" * 50_000, "secret=" * 900, " x" * 60_000 + pick(secrets.ALPHABET, 40), *out, out[0], out[0]]


def test_spans_equal_brute_force(spark):
    rows = [(i % 50 or None, t, 1, "c") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, base_spans int, Secrets string").repartition(8)
    got = secrets.find(docs)
    assert got.columns == ["doc_id", "text", "base_spans", "secrets"]
    kinds = set()
    for r in got.collect():
        spans = [tuple(s) for s in r.secrets]
        assert spans == by_hand(r.text)[1], r.text[:200]
        kinds |= {s[0] for s in spans}
    assert kinds == {*ORDER}


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_secrets"](spark, sf).collect()
    assert len(rows) == len(docs)
    line = lambda spans: ",".join(f"{k}:{b}:{e}" for k, b, e in spans)
    for r in rows:
        base, every = by_hand(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in secrets.BASE]
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(every)


def test_allow_list_and_limits():
    assert allowed("a1b2c3d4-1111-2222-3333-abcdefabcdef") and allowed("abcd1234" * 5) and allowed("my_example_key_9f8a7b6c5d")
    assert not allowed("aKx93jf8Qz71LmPw02Vb")


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op5_secrets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert secrets.find(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
