import copy
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm import (catalog, graph, markup, op1_backoff, op2_substring, op3_chat, op4_templates, op5_tokens, op6_pages, op7_pieces,
                           op8_minhash, op9_suffix, op10_rules, oracle, textops as X)
from tests.llm import plain

SF = "/root/testdata/sf0.001"
CLASH = "block int, bucket int, spans string, n_words string, t string, w string, r string, q string, s string, rep long, sig string"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, copies, repeated rows, odd white space."""
    base = prose(1, 120)
    edited = base.split()
    edited[60] = "Changed"
    passage = prose(2, 70)
    return [
        (1, base), (2, base), (3, " ".join(edited)), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "),
        (7, "one two"), (8, "one two"), (9, "ONE  two"), (10, f"{prose(3, 40)}\n{passage} {prose(4, 30)}"), (11, f"{prose(5, 25)} {passage}"),
        (12, ("same line again\n" * 40) + "end"), (13, "é ü 🙂 ñ" * 30), (14, prose(6, 6000, 30)), (15, "x" * 3000), (16, "a b\x1cc d\u0085e"),
        (None, base), (None, "alone with a null id"), (17, passage), (18, "ab " * 400),
    ]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    df = documents(spark, edge_rows())
    path = op1_backoff.E.checkpoint_dir(spark) + "/llm-edge"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def tuples(df):
    return [tuple(r) for r in df.collect()]


def by(rows):
    return sorted(rows, key=repr)


# -- helpers --------------------------------------------------------------------
def test_words_follow_the_contract():
    texts = [t or "" for _, t in edge_rows()]
    buf, offsets = X.text_buffer(pa.array([t for _, t in edge_rows()]))
    starts, ends, row = X.word_spans(buf, offsets)
    got = [(int(r), bytes(buf[s:e]).decode()) for s, e, r in zip(starts, ends, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in plain.words(t)]


def test_hashes_are_equal_for_equal_words_only(monkeypatch):
    monkeypatch.setattr(X, "SEGMENT", 64)
    monkeypatch.setattr(X, "_POW", X.Cache())
    texts = [prose(7, 300), "y" * 500, "y" * 499 + "z", "y" * 500 + " " + prose(7, 300)]
    buf, offsets = X.text_buffer(pa.array(texts))
    starts, ends, row = X.word_spans(buf, offsets)
    h = X.word_hashes(buf, starts, ends)
    seen = {}
    for s, e, x in zip(starts, ends, h.tolist()):
        assert seen.setdefault(bytes(buf[s:e]), x) == x
    assert len(set(seen.values())) == len(seen)
    keys, at = X.windows(h, row, 7)
    groups = {}
    for k, i in zip(keys.tolist(), at.tolist()):
        w = tuple(bytes(buf[starts[j]:ends[j]]) for j in range(i, i + 7))
        assert groups.setdefault(w, k) == k
    assert len(set(groups.values())) == len(groups)


def test_packing_round_trips():
    import numpy as np
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (X.unpack_sorted(X.pack_sorted(v)) == v).all() and len(X.unpack_sorted(X.pack_sorted(v[:0]))) == 0
    bits = v % np.uint64(3) == 0
    assert (X.unpack_bits(X.pack_bits(bits)) == bits).all()


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 40), (45, 50), (60, 60), (71, 70), (71, 72)] + [(k, 5) for k in range(100, 140)]
    got = dict(tuples(graph.components(spark.createDataFrame(edges, "a long, b long"))))
    want = {i: 0 for i in [*range(31), *range(100, 140)]} | {40: 40, 45: 40, 50: 40, 70: 70, 71: 70, 72: 70}
    assert got == want
    assert tuples(graph.components(spark.createDataFrame([], "a long, b long"))) == []


# -- operators ------------------------------------------------------------------
def test_backoff(docs, empty):
    rows = edge_rows()
    got = by(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in tuples(op1_backoff.backoff_scores(docs)))
    want = [(i, n, None if s is None else round(s, 5), *rest) for (i, _), (n, s, *rest) in zip(rows, plain.backoff([t for _, t in rows]))]
    assert got == by(want)
    assert tuples(op1_backoff.query(empty)) == []


def test_substring(docs, empty):
    got = by(tuples(op2_substring.repeated_windows(docs).select("doc_id", "n_words", "n_removed", "kept_text")))
    assert got == by(plain.substring(edge_rows()))
    spans = {r.doc_id: r.spans for r in op2_substring.repeated_windows(docs).where("doc_id = 2").collect()}
    assert [tuple(s) for s in spans[2]] == [(0, 120)]
    assert tuples(op2_substring.query(empty)) == []


CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "bob", "tie"),
    (2, 0, "system", "alone"), (3, None, "user", "no turn"), (3, 5, "user", ""), (None, 1, "user", "null id"), (None, 2, None, "null role"),
    *[(4, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(200)],
]


def test_chat(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("parts", F.lit(2))
    assert by(tuples(op3_chat.query(df))) == by(plain.rotate(CONVERSATIONS))
    assert tuples(op3_chat.query(df.limit(0))) == []
    assert "Python" not in op3_chat.query(df)._jdf.queryExecution().executedPlan().toString()


def test_chat_hot_pieces_and_context(spark):
    schema = "conv_id long, turn long, role string, text string"
    hot = [(None, k % 8, f"r{k % 3}", f"t{k % 1000}") for k in range(5000)]  # a null conversation of ties
    same = [(1, 5, "ann", "same")] * 2000 + [(1, 70, "bob", "after a hot piece")]
    untimed = [(2, None, "ann" if k % 2 else None, None) for k in range(700)]
    across = [(3, t, "ann" if t % 2 else "bob", "é" * (t % 5)) for t in range(60, 71)] + [(3, -1, "bob", "before"), (3, 0, "system", "rules")]
    edge = [(4, 3, "ann", str(k)) for k in range(256)] + [(4, 64, "ann", "x")] + [(5, 63, "ann", str(k)) for k in range(256)] + [(5, 64, "bob", "y")]
    long = [(6, 1, "ann", "w" * 300_000), (6, 63, "bob", "z" * 200_000), (6, 64, "ann", "end")]
    rows = hot + same + untimed + across + edge + long
    df = spark.createDataFrame(rows, schema).repartition(5).withColumn("at", F.lit(1)).withColumn("part", F.lit("x")).withColumn("n", F.lit(0))
    assert by(tuples(op3_chat.query(df))) == by(plain.rotate(rows))
    ranged = op3_chat.parted(spark.createDataFrame(same, schema).selectExpr("*", "floor(turn / 64) AS piece").where("piece = 0"), 100)
    assert sorted(r["count"] for r in ranged.groupBy("part").count().collect()) == [100] * 20


ITEMS = [
    (1, "When Alice buys 5 apples for 3 dollars and gives 2 km of rope to Bob, how many apples does Alice keep for 7 days here"),
    (2, "short item text"), (3, None), (4, ""), (None, "null item id words that never count for anything at all"), (5, "Der Hund lief 10 km durch den Wald und fand 12 alte Steine am Ufer"),
]
LEAKS = [
    (1, "noise before. " + ITEMS[0][1] + " noise after"),
    (2, "x y " + ITEMS[0][1].replace("Alice", "Carol").replace("5", "9").replace("Bob", "Dan") + " z"),
    (3, "x y " + ITEMS[0][1].replace("Alice buys", "Carol buys").replace("how many apples does Alice", "how many apples does Emma")),
    (4, "a short item text, here"), (5, None), (6, ""), (7, prose(9, 300)), (None, ITEMS[0][1]), (8, ITEMS[5][1].upper()), (9, ITEMS[5][1]), (9, ITEMS[5][1]),
]


def test_templates(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hash", F.lit(1))
    df = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumn("pos", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in op4_templates.leaks(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (8, 5), (9, 5)}  # 3: most of it verbatim; 8: in capitals
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed == 3  # Alice, Bob and the number of apples
    assert got[1, 1].covered == got[1, 1].item_words == got[8, 5].covered + 11
    assert sorted(str(r.doc_id) for r in op4_templates.clean(df, bench).collect()) == sorted(["5", "6", "7", "None"])
    assert tuples(op4_templates.leaks(df.limit(0), bench)) == [] and tuples(op4_templates.leaks(df, bench.limit(0))) == []


def test_templates_of_number_words(spark):
    """Spelled-out numbers are slots like digits, and stand for each other."""
    item = "if three trains leave the station with four wagons and each wagon carries nine crates how many crates leave in all"
    rows = [(1, item.replace("three", "nine").replace("four", "eight").replace("nine crates", "two crates")), (2, item.replace("three", "3").replace("four", "4").replace("nine", "9")),
            (3, item.replace("trains", "carts").replace("wagons", "boxes").replace("crates", "apples").replace("leave", "reach").replace("carries", "takes"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.n_changed for r in op4_templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: 3, 2: 3}


def plain_leaks(docs, items, share=op4_templates.SHARE, width=op4_templates.WIDTH):
    """Every window of a document against every window of an item, alignment by alignment."""
    def tokens(text):
        found = [op4_templates.token(w) for w in plain.words(text)]
        return [(k if k != op4_templates.UNIT or (i and found[i - 1][0] == op4_templates.NUM) else op4_templates.LITERAL, c) for i, (k, c) in enumerate(found)]

    out = {}
    for item, text in items:
        t = tokens(text)
        w = min(width, len(t))
        for doc, body in docs:
            d, lines, covered = tokens(body), {}, set()
            if not t:
                continue
            for i in range(len(t) - w + 1):
                slots = [k for k in range(w) if t[i + k][0] != op4_templates.LITERAL]
                enough = w - len(slots) >= (op4_templates.MIN_LITERAL if w == width else (w + 1) // 2)
                for j in range(len(d) - w + 1):
                    if [c for _, c in t[i:i + w]] == [c for _, c in d[j:j + w]]:
                        covered.update(range(i, i + w))
                    if enough and all(x[0] == y[0] and (x[0] != op4_templates.LITERAL or x[1] == y[1]) for x, y in zip(t[i:i + w], d[j:j + w])):
                        lines.setdefault(j - i, []).append((i, j, slots))
            for line in lines.values():
                votes = {}
                for at, value in {(i + k, t[i + k][1]): d[j + k][1] for i, j, slots in line for k in slots}.items():
                    votes.setdefault(at[1], []).append(value)
                to = {a: max(set(v), key=v.count) for a, v in votes.items()}
                if all(2 * v.count(to[a]) > len(v) for a, v in votes.items()):
                    for i, j, slots in line:
                        if all(to[t[i + k][1]] == d[j + k][1] for k in slots):
                            covered.update(range(i, i + w))
            if len(covered) >= share * len(t):
                out[doc, item] = (len(t), len(covered))
    return out


def test_templates_equal_the_plain_search(spark):
    r = random.Random(12)
    items = [(i, t) for i, t in ITEMS if i is not None and t]
    items += [(10 + k, " ".join(r.choice(["Ann", "Bo", "5", "seven", "km", "runs", "to", "the", "mill", "and", "sees", "old", "red", "ships"]) for _ in range(r.choice([3, 8, 20])))) for k in range(12)]
    docs = [(i, t) for i, t in LEAKS if i is not None and i != 9] + [(9, ITEMS[5][1])]
    for k in range(60):
        words = r.choice(items)[1].split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = r.choice(["Eve", "Bo", "8", "nine", "red", "MILL"])
        docs.append((100 + k, " ".join(["pre", "fix"][: r.randrange(3)] + words + ["and"] * r.randrange(3))))
    found = op4_templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): (x.item_words, x.covered) for x in found.collect()} == plain_leaks(docs, items)


def test_templates_of_dense_items(spark):
    """Items without enough plain words, and copies in another case, are found where they are verbatim."""
    items = [(1, "12 + 7 = 19 and 3 * 4 = 12 and 40 / 8 = 5 7 9 11 13"), (2, "Anna Berg Carl Dahl Emma Falk Gustav Holm Ida Jung"), (3, "Solve All Of These Hard Problems Before Sunday Evening Comes"),
             (4, "ANSWER THE NEXT QUESTION IN ONE WORD ONLY PLEASE"), (5, "Otto Pell"), (6, "the train from Oslo to Bergen passes Finse and Voss before Dale")]
    copies = [(i, f"x y {t} z") for i, t in items]
    lower = [(10 + i, f"x y {t.lower()} z") for i, t in items if i in (2, 3, 6)]
    other = [(20, "12 + 8 = 20 and 3 * 5 = 15 and 40 / 4 = 10 6 8 10 14"), (21, "Nils Berg Olaf Dahl Pia Falk Rolf Holm Siri Jung")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in op4_templates.leaks(spark.createDataFrame(copies + lower + other, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(i, i) for i, _ in items} | {(12, 2), (13, 3), (16, 6)}
    assert all(r.n_changed == 0 for r in got.values())


def test_templates_with_one_altered_value(spark):
    """One altered mention drops its windows only, and two numbers may become equal."""
    one, two, three = (" ".join(f"{k}{chr(97 + i)} then" for i in range(12)) for k in "xyz")
    item = f"the clerk Alice came {one} so Alice went {two} until Alice slept and {three} with 5 coins or 7 stones at hand"
    rows = [(1, item.replace("until Alice", "until Carol")), (2, item.replace("5 coins", "9 coins").replace("7 stones", "9 stones")), (3, item.replace("Alice", "Carol")),
            (4, item.replace("clerk Alice", "clerk Bob").replace("so Alice", "so Carol"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in op4_templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {1, 2, 3, 4} and all(r.item_words > 80 for r in got.values())
    assert [got[i].n_changed for i in (1, 2, 3)] == [0, 2, 1]
    assert got[1].covered < got[3].covered == got[2].covered


def test_template_tokens():
    kinds = [op4_templates.token(w)[0] for w in ("3,500", "$4.20", "(17%)", "km", "Alice,", "The", "apple", "***", "A", "1st")]
    n, u, name, lit = op4_templates.NUM, op4_templates.UNIT, op4_templates.NAME, op4_templates.LITERAL
    assert kinds == [n, n, n, u, name, lit, lit, lit, u, n]


def test_token_counts(docs, empty):
    count = op5_tokens.counter(op5_tokens.VOCABULARY)
    want = [(i, len((t or "").encode()), count([t or ""])[0]) for i, t in edge_rows()]
    assert by(tuples(op5_tokens.token_counts(docs))) == by(want)
    assert tuples(op5_tokens.query(empty)) == []


def test_token_counts_of_special_strings(spark):
    texts = ["a<|endoftext|>b <|startoftext|>", "é é  ﬁ 'S don't ΣΑΣ İstanbul", "4.5!!! 🙂🙂 a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in op5_tokens.token_counts(df).collect()}
    assert got == dict(enumerate(op5_tokens.counter(op5_tokens.VOCABULARY)(texts)))


def test_alignment(monkeypatch):
    r = random.Random(1)
    for cells in (1 << 26, 8):
        monkeypatch.setattr(op6_pages, "CELLS", cells)
        for _ in range(400):
            a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
            got = op6_pages.common(a, b)
            assert len(got) == plain.lcs(a, b) and got == sorted(set(got))
            rest = iter(b)
            assert all(any(x == a[i] for x in rest) for i in got)


def test_markup():
    page = """<!doctype html><head><title>T</title><script>var t="</p><p>x";</script><style>p{}</style></head><body class="home">
    <header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class='x ad-slot'>Buy <b>now</b></div>
    <article><header><h1>Title &amp; more</h1></header><p>One<br>two &lt;3&gt; <p>Th<i>re</i>e <a title="a>b">x</a><div class="comments"><p>Nice!</div>
    <form><input><p>mail</form><section><p>  Last\n\tone </section></article><aside>more</aside><footer>&copy; me"""
    kept = [t for z, t in markup.lines(page) if z == markup.ARTICLE]
    assert kept == ["Title & more", "One two <3>", "Three x", "Last one"]
    plain_page = "<body><nav>Menu</nav><div>Shared line</div><p>Own text</p><div id=comments>c</div>"
    assert [(z == markup.OPEN, t) for z, t in markup.lines(plain_page)] == [(False, "Menu"), (True, "Shared line"), (True, "Own text"), (False, "c")]
    assert markup.lines("") == [] and markup.lines("a < b <") == [(markup.OPEN, "a < b <")]


@pytest.mark.parametrize("page,kept", [
    ("<div class='layout with-sidebar'><article><p>Text</p></article></div>", ["Text"]),
    ("<div class='layout with-sidebar'><p>Text</p></div>", []),
    ("<div id='page-header-fixed'><main><p>Text</p></main></div>", ["Text"]),
    ("<div class='modal page-menu'><article><p>Text</p></article><p>no</p></div>", ["Text"]),
    ("<article><header class='entry-header'><h1>Head</h1></header><p class='notice'>Note</p><div class='search-results'>Found</div>"
     "<section class='related-work'><p>Work</p></section></article>", ["Head", "Note", "Found", "Work"]),
    ("<article><p>Text</p><div class='ad-slot'>Buy</div><div class='comments'><article>Nice</article></div><div class='share'>Share</div></article>", ["Text"]),
    ("<article><p>Text</p></article><div class='related'><article>Other</article></div>", ["Text"]),
    ("<div class='comments'><article>Nice</article></div>", []),
])
def test_markup_of_named_elements(page, kept):
    assert [t for z, t in markup.lines(f"<body>{page}</body>") if z == markup.ARTICLE] == kept
    if "article" not in page and "main" not in page:
        assert markup.lines(page) == [(markup.OPEN, "Text")]


def pages(spark):
    def page(host, path, body):
        return f"https://{host}{path}", f"<body><div>Shared top</div>{body}<div>Shared end</div></body>"

    rows = [(i, *page("a.example", f"/x/{i:03d}?q=1", f"<p>text {i}</p>")) for i in range(40)]
    rows += [(100, *page("b.example", "/only", "<p>single</p>")), (101, None, "<p>no url</p>"), (102, "::bad::", None), (103, "https://c.example", ""),
             (104, "https://d.example/1", "<article><p>same</p></article>"), (105, "https://d.example/2", "<article><p>same</p></article>"), (105, "https://d.example/2", "<article><p>same</p></article>"),
             (None, "https://e.example/", "<p>null id</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("x")).withColumn("k", F.lit(1))


def test_pages(spark):
    df = pages(spark)
    one, many = ({(r.page_id, r.url): r.text for r in op6_pages.extract(df, n).collect()} for n in (1, 9))
    assert one == many and len(one) == 47
    assert all(one[i, f"https://a.example/x/{i:03d}?q=1"] == f"text {i}" for i in range(40))
    assert one[100, "https://b.example/only"] == "Shared top\n\nsingle\n\nShared end"
    assert one[101, None] == "no url" and one[102, "::bad::"] == "" and one[103, "https://c.example"] == ""
    assert one[104, "https://d.example/1"] == one[105, "https://d.example/2"] == "same" and one[None, "https://e.example/"] == "null id"
    assert op6_pages.extract(df, 9).count() == 48
    assert tuples(op6_pages.query(df.limit(0))) == []


def test_nbest():
    lex = op7_pieces.lexicon(op7_pieces.MODEL)
    r = random.Random(3)
    texts = ["hello world", "  a ", "", "x", "der Straße 梦 🙂 ok\n\tfoo", "a  b   c", "the of and"] + ["".join(r.choice("theron ai é🙂") for _ in range(r.randrange(25))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for t, row in zip(texts, op7_pieces._encode_block(lex, batch, 4).to_pylist()):
        want = plain.segmentations(lex, t, 4)
        assert [round(x["score"], 3) for x in row["nbest"]] == [round(s, 3) for s, _ in want]
        assert row["n_pieces"] == len(row["ids"]) and round(row["score"], 3) == round(want[0][0], 3)
        seen = set()
        for x in row["nbest"]:
            ids = list(row["ids"])
            for c in reversed(x["changes"]):
                ids[c["at"]: c["at"] + c["old"]] = c["ids"]
            seen.add(tuple(ids))
        assert len(seen) == len(want)


@pytest.mark.parametrize("text", ["x%%%", "y&&&", "$$$", "a %%% &&& b", "%%%%%%%%%%", "%%% %%% x%%%"])
def test_nbest_of_equal_scores(text):
    """Segmentations as good as the best one are alternatives too, and none is named twice."""
    lex = op7_pieces.lexicon(op7_pieces.MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    row = op7_pieces._encode_block(lex, batch, 4).to_pylist()[0]
    want = plain.segmentations(lex, text, 4)
    assert [x["score"] for x in row["nbest"]] == pytest.approx([s for s, _ in want])
    seen = []
    for x in row["nbest"]:
        ids = list(row["ids"])
        for c in reversed(x["changes"]):
            ids[c["at"]: c["at"] + c["old"]] = c["ids"]
        assert "".join(lex.text[i] for i in ids) == "▁" + text.replace(" ", "▁")
        assert sum(lex.score[i] for i in ids) == pytest.approx(x["score"])
        seen.append(tuple(ids))
    assert len(set(seen)) == len(want)


def test_encoding_round_trip(docs, empty):
    encoded = op7_pieces.encode(docs)
    got = by(tuples(op7_pieces.decode(encoded)))
    assert got == by([(i, t or "") for i, t in edge_rows()])
    assert tuples(op7_pieces.query(empty)) == []


def test_library_encoding(docs):
    encoded = op7_pieces.encode(docs)
    sp = op7_pieces.lexicon(op7_pieces.MODEL).sp
    assert by((r.doc_id, r.library_ids) for r in encoded.collect()) == by((i, sp.encode(t or "", num_threads=1)) for i, t in edge_rows())
    assert by(tuples(op7_pieces.decode(encoded, ids="library_ids"))) == by([(i, t or "") for i, t in edge_rows()])
    lex = op7_pieces.lexicon(op7_pieces.MODEL)
    texts = ["", " ", "  ", "a ", " a", "a  b", "\t\n", "▁x▁", "😀 é 日本語 %%%", "x" * 5000, "\x00a", "a   ", "①ﬁ ﬀ", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    assert [r["library_ids"] for r in op7_pieces._encode_block(lex, batch, 4).to_pylist()] == [sp.encode(t or "", num_threads=1) for t in texts]


def test_kept_chunks_change_nothing(monkeypatch):
    """A worker's later blocks use results of its first one."""
    r = random.Random(5)
    blocks = [pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([" ".join(r.choice("the der un %%% x a1 zebra 梦".split()) + r.choice(["", "s", "%"]) for _ in range(20)) for _ in range(30)])],
                                         names=["doc_id", "text"]) for _ in range(4)]
    model = op7_pieces.MODEL
    for chars in (0, 40, 1 << 20):
        monkeypatch.setattr(op7_pieces, "KEPT_CHARS", chars)
        lex = op7_pieces.Lexicon(model)
        for library in (True, False):
            for block in blocks:
                want = op7_pieces._encode_block(plain_lexicon(lex), block, 4, library)
                got = op7_pieces._encode_block(lex, block, 4, library)
                assert got.drop_columns("score").equals(want.drop_columns("score"))


def test_kept_chunks_grow_with_blocks(monkeypatch):
    """What a later block scored or searched first is not worked out again."""
    scored, searched, score, lattices = [], [], op7_pieces._score, op7_pieces.Lattices
    monkeypatch.setattr(op7_pieces, "_score", lambda lex, chunks: scored.append(chunks) or score(lex, chunks))
    block = lambda *t: pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t, pa.string())], names=["doc_id", "text"])
    first, second = block("the zebra", None, "  a  b"), block("running water", "the zebra", "", " ")
    lex = op7_pieces.Lexicon(op7_pieces.MODEL)
    want = [op7_pieces._encode_block(plain_lexicon(lex), b, 4).to_pylist() for b in (first, second, second)]
    scored.clear()
    lex.searched.clear()
    got = [op7_pieces._encode_block(lex, first, 4).to_pylist(), op7_pieces._encode_block(lex, second, 4).to_pylist()]
    assert [len(c) for c in scored] == [4, 3]
    monkeypatch.setattr(op7_pieces, "Lattices", lambda lex, chunks: searched.append(chunks) or lattices(lex, chunks))
    assert got + [op7_pieces._encode_block(lex, second, 4).to_pylist()] == want
    assert len(scored) == 2 and searched == []


def test_chunks_of_every_kind_of_text():
    split = re.compile("▁*[^▁]+|▁+").findall
    texts = ["a b a", None, "", " ", "  ", " a", "a ", "a  b", "a\tb\n c", "\n", "▁", "x▁y z", "a b", "é 😀 a", "\x00 a", "$ ^", "a\n "]
    for rows in (texts, texts[:1], texts[1:3], texts[3:8], []):
        chunks, occ, sizes = op7_pieces._chunks(pa.array(rows, pa.string()))
        want = [split("▁" + t.replace(" ", "▁")) if t else [] for t in rows]
        assert sizes.tolist() == [len(w) for w in want] and [chunks[i] for i in occ.tolist()] == [c for w in want for c in w]
        assert len(set(chunks)) == len(chunks) and sorted(set(occ.tolist())) == list(range(len(chunks)))


def plain_lexicon(lex):
    fresh = copy.copy(lex)
    fresh.kept = {}
    return fresh


def test_near_duplicates(spark, docs, empty, monkeypatch):
    want = plain.near(edge_rows())
    got = tuples(op8_minhash.near_duplicates(docs))
    assert {i: (n, c) for i, n, c, _ in got if i is not None} == want
    assert all(k == (i == c) for i, _, c, k in got if i is not None)
    assert [(c, k) for i, _, c, k in got if i is None] == [(None, True)] * 2
    assert len(got) == len(edge_rows())
    assert tuples(op8_minhash.query(empty)) == []


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b, c = prose(21, 200), prose(22, 200), prose(23, 200)
    near = lambda t: t.replace(t.split()[90], "changed", 1)
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (8, c), (9, c), (9, prose(24, 90)), (9, None), (7, prose(24, 90)), (None, a)]
    got = sorted(tuple(r)[::2] for r in op8_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 7), (8, 7), (9, 7), (9, 7), (9, 9)]


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicates_of_drifting_copies(spark, monkeypatch, small):
    """A chain of copies, each near its neighbours only, in listed and in blocked buckets."""
    monkeypatch.setattr(op8_minhash, "SMALL", small)
    monkeypatch.setattr(op8_minhash, "BLOCK", 3)
    rows, words = [], prose(11, 200).split()
    for i in range(14):
        rows.append((i, " ".join(words)))
        for k in range(2):
            words[(i * 17 + k * 5) % 200] = f"new{i}{k}"
    rows += [(50 + i, prose(200 + i, 80)) for i in range(6)]
    got = tuples(op8_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    assert {i: (n, c) for i, n, c, _ in got} == plain.near(rows)


def test_posterior_bounds():
    for n, need in op8_minhash.least_matches(85):
        assert 0 < need < n
    assert [m for _, m in op8_minhash.least_matches(85)] == sorted(m for _, m in op8_minhash.least_matches(85))


def test_interval_expansion():
    r = random.Random(0)
    for trial in range(40):
        texts = [bytes(r.choice(b"abc"[: 1 + trial % 3]) for _ in range(r.randrange(12, 60))) for _ in range(r.randrange(1, 12))]
        if trial % 2:
            texts += [texts[0][3:] + b"xyz", texts[0]]
        seen = {}
        for t in texts:
            for i in range(len(t) - 11):
                seen[t[i:i + 12]] = seen.get(t[i:i + 12], 0) + 1
        for t, flags in zip(texts, op9_suffix.repeated_starts(texts, [1] * len(texts), 12)):
            assert list(flags) == [seen[t[i:i + 12]] > 1 for i in range(len(t) - 11)]


@pytest.mark.parametrize("length,batch", [(400, 2 << 20), (60, 2 << 20), (60, 500)])
def test_repeated_strings(docs, empty, monkeypatch, length, batch):
    monkeypatch.setattr(op9_suffix, "BATCH", batch)
    rows = edge_rows()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in op9_suffix.repeated_strings(docs, length).collect()]
    assert by(got) == by((i, *x) for (i, _), x in zip(rows, plain.suffix([t for _, t in rows], length)))
    if length == 400:
        assert tuples(op9_suffix.query(empty)) == []


def test_quality(docs, empty):
    got = by(tuples(op10_rules.query(docs).drop("n_lines", "n_stop_words", "kept")))
    want = []
    for i, t in edge_rows():
        n, chars, symbols, dup, rep = plain.quality(t)
        want.append((i, n, chars, symbols, dup, rep, n < 20 or 100 * rep > 30 * n))
    assert got == by(want)
    assert tuples(op10_rules.query(empty)) == []
    kept = op10_rules.keep(docs)
    assert kept.columns == docs.columns
    assert by(tuples(kept.select("doc_id"))) == by((r.doc_id,) for r in op10_rules.query(docs).collect() if r.kept)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(oracle.SQL[name]).to_arrow_table()
    got = catalog.queries()[name](spark, SF).toArrow()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in cols))))
    assert rows(got) == rows(want)


def test_page_text_of_the_test_table(spark):
    """The tables' pages keep their article in one element: an independent reading of it."""
    import html
    got = {r.page_id: r for r in catalog.queries()["op6_page_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        x = re.sub(r"<script>.*?</script>", "", r.html, flags=re.S)
        x = x[x.index("<article>") + 9: x.index("</article>")].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", y)).split()) for y in re.split(r"</?(?:p|h1)>", x)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
