"""Operators 11 to 13 against plain Python versions on small inputs with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from offerlake.llm import catalog, op11_prefixes, op12_codes, op13_personal as P

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# -- operator 11 ---------------------------------------------------------------
def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for key, own_members in members.items():
        under = [k for k in members if k[:len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(x[:len(k)] == k and len(x) == len(k) + 1 for x in under)]
        saved = sum((len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) for k in under if k)
        ends = sorted(c for c in own_members if whole[c] == key)
        out.append((min(own_members), len(key), min(members[key[:-1]]) if key else None, len(own_members), len(kids), len(leaves), saved, SHA(",".join(map(str, ends)))))
    return sorted(out, key=str)


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("part", "place", "h1", "depth", "at", "up", "k")])


def trie_rows(seed):
    r = random.Random(seed)
    texts = ["hello", "hello there you", "", None, " \t\n", "a b\x1cc", "é ü", "long " * 50]
    rows = []
    for c in [*range(0, 8), *range(20, 30), 41, 45, 59, 60, 61, 5000, 5001, 9999]:
        for t in range(r.randrange(0, 6)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(70, None, "user", "first"), (70, None, "a", "first"), (70, 3, "user", "x"), (70, 3, "user", "x"), (70, 3, "b", "w"), (71, None, None, None)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(c, t, "user", f"copy {t}") for c in (100, 101, 102, 103, 120, 121) for t in range(9)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = trie_rows(seed)
    got = sorted((tuple(r) for r in op11_prefixes.query(conversations(spark, rows)).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_one_long_conversation_in_many_ranges(spark):
    """One conversation, and a copy of it, hold nearly all rows; ids are hashed in blocks."""
    r = random.Random(5)
    long = [(r.choice("ab"), f"w{r.randrange(5)} x") for _ in range(150)]
    rows = [(c, t, *x) for c in (40, 47, 12000) for t, x in enumerate(long)] + [(c, 0, "u", "hi") for c in range(8000, 8040)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored_turns = op11_prefixes.turns(conversations(spark, rows))
        assert stored_turns.where("conv_id = 47").select(F.shiftright("at", 33)).distinct().count() > 1
        got = sorted((tuple(x) for x in op11_prefixes.query(conversations(spark, rows)).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_a_lone_null(spark):
    assert op11_prefixes.query(conversations(spark, [])).collect() == []
    assert op11_prefixes.query(conversations(spark, [(None, 1, "user", "x")])).collect() == []


def test_fingerprints_are_products(spark):
    """Powers by table equal powers by rule; unequal digests of one turn would fail."""
    n = [0, 1, 255, 256, 65537, (1 << 32) - 1]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    for k, (p, b) in enumerate(op11_prefixes.LANES):
        assert [r[0] for r in df.select(F.expr(op11_prefixes.powers("n", k))).collect()] == [pow(b, x, p) for x in n]


# -- operator 12 ---------------------------------------------------------------
def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts) * parts
    step = width // parts
    kept = [(i, lab, v + [0] * (width - len(v)), v) for i, lab, v in kept]
    first = sorted([k for k in kept if k[0] is not None] or kept, key=lambda k: (k[0] or 0, k[3]))[:entries]
    books = [[k[2][p * step:(p + 1) * step] for k in first] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * step:(p + 1) * step], e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[best(k[2], p)[1] for p in range(parts)] for k in kept]
        books = [[[sum(col) // len(mine) for col in zip(*mine)] if (mine := [k[2][p * step:(p + 1) * step] for k, c in zip(kept, chosen) if c[p] == j]) else e
                  for j, e in enumerate(books[p])] for p in range(parts)]
    out, per = [], Counter()
    for i, lab, v, _ in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        per[lab] += out[-1][3]
    digest = SHA(",".join(str(x) for book in books for e in book for x in e))
    return sorted([(i, code, err, per[lab], digest) for i, lab, code, err in out], key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.select("*", F.lit(1).alias("code"), F.lit("x").alias("v"), F.lit("y").alias("error"), F.lit("z").alias("of"), F.lit("z").alias("reach"))


def vector_rows(n, dims, seed):
    import numpy as np
    r = np.random.default_rng(seed)
    base = r.normal(0, 0.2, (n, dims)).astype("float32")
    base[n // 2:] = base[: n - n // 2]  # a third and more are copies: distances tie
    base[::7] = np.round(base[::7] * 4) / 4
    return [(int(i), [float(x) for x in v], [None, 1, 2][int(i) % 3]) for i, v in enumerate(base)]


@pytest.mark.parametrize("n,dims", [(200, 32), (40, 16)])
def test_codes(spark, n, dims):
    rows = vector_rows(n, dims, n)
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.5, None] * (dims // 2), 1), (902, [nan] * dims, 2), (903, [inf] * dims, None), (904, [-inf] + [0.0] * (dims - 1), None)]
    rows += [rows[3], rows[3], (None, rows[5][1], 2), (5, rows[9][1], 1), (-4, [0.25] * dims, None)]
    got = sorted((tuple(r) for r in op12_codes.query(vectors(spark, rows)).collect()), key=str)
    assert got == plain_codes(rows)


def test_codes_of_uneven_vectors(spark):
    rows = [(i, [((i * k) % 11 - 5) / 7 for k in range(i % 21)], i % 2) for i in range(90)]
    got = sorted((tuple(r) for r in op12_codes.query(vectors(spark, rows)).collect()), key=str)
    assert got == plain_codes(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(None, [0.5] * 16, None)], [(1, [], 1), (2, [], 1)]])
def test_codes_of_little(spark, rows):
    got = sorted((tuple(r) for r in op12_codes.query(vectors(spark, rows)).collect()), key=str)
    assert got == (plain_codes(rows) if got else [])
    assert len(got) == sum(v is not None for _, v, _ in rows)


def test_search_prunes_and_is_exact(spark):
    rows = vector_rows(400, 64, 3)
    out, books = op12_codes.compress(vectors(spark, rows))
    tried = out.agg(F.avg("evaluated")).first()[0] / op12_codes.PARTS
    assert 1 <= tried < 0.8 * books.shape[1]


def test_huge_component_fails(spark):
    with pytest.raises(Exception, match="magnitude"):
        op12_codes.query(vectors(spark, [(1, [3e30] * 16, 1)])).collect()


# -- operator 13 ---------------------------------------------------------------
def plain_base(text):
    """The four formats by plain backtracking expressions."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, m.start(), m.end()) for k, (rule, ok) in enumerate(rules) for m in re.finditer(rule, text or "") if ok(m.group())]


ODD = ["", None, "a@b.c@d.e", "a@b.c_x@d.e", "x@y", "@a.b", "a@@b.c", "..%+-@-.-", "a@b..c", "é@b.co", "ab@c.d.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.1",
       "000255.0.0.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111112", "4111  1111 1111 1111", "4242424242424242", "0" * 13, "0" * 19, "0" * 20,
       "+1 (555) 010-9999", "+1", "+12", "+1 2", "+123456789", "+1234567890123456", "++49 30 1234567", "+1 555 0100 +1 555 0101 000", "🙂 a@b.c 🙂 10.0.0.1",
       "9" * 3000, "a" * 3000, "a" * 3000 + "@", "1." * 500, "+1" * 200, "1 " * 300, "a@" * 300, "a@b." * 300, "x\n+1 (743) 555-3824\n"]


def test_base_spans_equal_the_plain_expressions():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("a1@.+- ()9é") for _ in range(r.randrange(60))) for _ in range(4000)]
    for t in texts:
        assert P.base_spans(t or "") == plain_base(t), repr(t)


def test_long_texts_take_linear_time():
    import time
    start = time.time()
    for t in ("a" * 10 ** 6, "9" * 10 ** 6, "a@" * 300000, "+1" * 300000, "1." * 300000, "x,a@b.co" * 100000, " " * 10 ** 6 + "12345", "1234 " * 100000):
        P.read(t)
    assert time.time() - start < 60


def plain_found(texts, rounds, support, confidence):
    """The graph's rounds over Python sets; (row, kind, start, end) of the found spans."""
    places = [(row, *o) for row, t in enumerate(texts) for o in P.read(t or "")[1]]
    edges = {(i, p) for _, _, _, _, i, ps in places for p in ps}
    size = Counter(p for _, p in edges)
    seeds = {(i, k): 1.0 for _, k, _, _, i, _ in places if k >= 0}
    known = dict(seeds)
    for _ in range(rounds):
        weight, count = Counter(), Counter()
        for i, p in edges:
            for k in range(4):
                if (i, k) in known:
                    weight[p, k] += known[i, k]
                    count[p, k] += 1
        accepted = {pk: round(weight[pk] / size[pk[0]], 9) for pk in count if count[pk] >= support and round(weight[pk] / size[pk[0]], 9) >= confidence}
        doubt = defaultdict(float)
        for i, p in edges:
            for k in range(4):
                if (p, k) in accepted:
                    doubt[i, k] += math.log(max(1e-9, 1 - accepted[p, k]))
        ids = {i for i, _ in seeds}
        known = seeds | {ik: round(1 - math.exp(v), 9) for ik, v in doubt.items() if ik[0] not in ids}
    out = set()
    for row, kind, a, b, i, ps in places:
        good = [(known[i, k], -k) for k in range(4) if kind < 0 and (i, k) in known and any((p, k) in accepted for p in ps)]
        if good:
            out.add((row, -max(good)[1], a, b))
    return out


def personal_texts():
    r = random.Random(9)
    noise = lambda n: " ".join(r.choice(["the", "of", "and", "lorem", "ipsum", "2024", "chapter", "a1b2c3d4"]) for _ in range(n))
    texts = [f"{noise(6)} please call me {'on' if k % 2 else 'at'} +1 (555) 010-{1000 + k} {noise(5)}" for k in range(40)]
    texts += [f"{noise(4)} please call me at 0171/5550{k} {noise(4)}" for k in range(3)]          # no format knows these
    texts += [f"{noise(4)} write to mailbox user{k}@mail.example.org soon {noise(3)}" for k in range(12)]
    texts += [f"{noise(4)} write to mailbox user{k}[at]example2024 soon {noise(3)}" for k in range(2)]
    texts += [f"ring 0171/55501 tonight {noise(3)}", f"order number {k}" if (k := 77123) else "", "order number 88123", None, "", "🙂 please call me at 0171/55509 now"]
    return texts


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_discovery_equals_the_plain_graph(spark, rounds):
    texts = personal_texts()
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, row int").repartition(4)
    got = {(r.doc_id or 0, s.kind, s.start, s.end) for r in P.personal_data(docs, rounds).collect() for s in r.found}
    assert got == plain_found(texts, rounds, P.SUPPORT, P.CONFIDENCE)
    words = Counter(texts[i][a:b].split("/")[0] for i, _, a, b in got)
    assert words["0171"] >= 4 and any("[at]" in w for w in words) and not any(w.startswith(("77", "88", "2024")) for w in words)


def test_personal_query(spark):
    rows = [(i, t) for i, t in enumerate(ODD + personal_texts())] + [(3, ODD[3]), (3, ODD[3]), (None, "mail a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r)[:6] for r in P.query(docs).collect()), key=str)
    want = []
    for i, t in rows:
        base = plain_base(t)
        n = Counter(k for k, _, _ in base)
        want.append((i, n[0], n[1], n[2], n[3], SHA(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base))))
    assert got == sorted(want, key=str)
    for r in P.query(docs).collect():
        base = [x for x in r.spans.split(",") if x and not x.startswith("found_")]
        assert SHA(",".join(base)) == r.base_sha256
    assert P.query(docs.limit(0)).collect() == []


def test_queries_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.op13_personal_data(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].base_sha256 == SHA(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in plain_base(d.text)))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in catalog.op11_prefix_trie(spark, sf).collect()), key=str) == plain_trie(rows)


def test_nearest_page_equals_the_plain_search(spark):
    """Every page against the pages next to it by path in its host, whatever the ranges."""
    import os

    from offerlake.llm import markup, op6_pages
    r = random.Random(6)
    line = lambda: f"line {r.randrange(12)} of the site"
    rows = []
    for i in range(120):
        url = None if i % 40 == 7 else f"http://{r.choice(['a.example', 'B.example', 'c.example'])}/{r.choice('xyz')}/{r.randrange(30)}"
        rows.append((i, url, "".join(f"<p>{line()}</p>" for _ in range(r.randrange(1, 9)))))
    rows += [rows[5], rows[6], (None, rows[8][1], rows[9][2]), (500, "http://alone.example/p", "<p>only one</p>"), (501, "http://empty.example/", None)]
    key = lambda p: (*op6_parts(p[1]), -(1 << 63) if p[0] is None else p[0], p[2] or "")
    want, order = [], sorted(rows, key=lambda p: key(p)[:3])
    for i, page in enumerate(order):
        host, path = key(page)[:2]
        near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and key(order[j])[0] == host]
        near.sort(key=lambda p: -len(os.path.commonprefix([key(p)[1], path])))
        lines = markup.lines(page[2] or "")
        text, shared = op6_pages.main_text(lines, markup.lines(near[0][2] or "") if near else None)
        want.append((page[0], page[1], text, len(lines), shared, near[0][0] if near else None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for ranges in (1, 3, 16):
        got = [tuple(x) for x in op6_pages.extract(df, ranges).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), ranges


def op6_parts(url):
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m.group(1).lower(), m.group(2)) if m else ("", "")
