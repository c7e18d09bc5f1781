"""Each operator against brute force, a round trip or planted cases, and its defined cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyhound.llm import chat, common, components, decontaminate, imatch, line_dedup, packing, quality, simhash, simple8b, token_files, tokens, url_filter, wrappers

DOCS = "doc_id bigint, text string"


def docs(spark, *texts, schema=DOCS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)


def words(rng, n, of=2000):
    return " ".join(f"w{i}" for i in rng.integers(0, of, n))


# -- 1: decontamination


def brute_hits(text, items, window=10):
    split = lambda t: decontaminate.words((t or "").encode())
    w, hit, found = split(text), set(), set()
    for item, t in items:
        x = split(t)
        for i in range(max(1, len(x) - window + 1) if x else 0):
            k = x[i : i + window]
            for j in range(len(w) - len(k) + 1):
                if w[j : j + len(k)] == k:
                    hit |= set(range(j, j + len(k)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [10**9, 4])
def test_decontamination_equals_brute_force(spark, max_windows):
    rng = np.random.default_rng(0)
    items = [(1, words(rng, 14, 50)), (2, "Short One!"), (3, ""), (4, None), (10, words(rng, 12, 50) + " É ü"), (2, "again, other"), (None, "null item")]
    w = items[0][1].split()
    texts = [None, "", "nothing", "x, SHORT-one y", " ".join(w[:10]) + ". tail", " ".join(w[1:9]), "a " + "  ".join(w) + " b " + items[4][1].upper().replace("É", "é"), items[4][1] + " short one", "shorten ones", "again other again other", "é null ITEM"]
    texts.append("pad " * 50_000 + texts[6] + " pad" * 50_000)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, `key` int")
    d = docs(spark, *texts, *texts).withColumn("Decontam", F.lit("mine")).withColumn("mark", F.lit(1)).withColumn("a`b.c", F.lit(2)).withColumn("TEXT_", F.lit(3))
    got = decontaminate.marked(d, bench, name="found", max_windows=max_windows).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        i, t, m = r[0], r[1], r["found"]
        n, hit, found = brute_hits(t, items)
        assert (m.n_words, sum(b - a for a, b in zip(m.hit_from, m.hit_to)), m["items"]) == (n, hit, sorted("" if x == "None" else x for x in found)), t
        for a, b, c, e in zip(m.hit_from, m.hit_to, m.char_from, m.char_to):
            assert decontaminate.words(t[c:e].encode()) == decontaminate.words(t.encode())[a:b]
    kept = decontaminate.decontaminate(d, bench, max_windows=max_windows)
    assert kept.columns == d.columns and kept.dtypes == d.dtypes
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate([*texts, *texts]) if not brute_hits(t, items)[1]]
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(d, bench.limit(0)).count() == 2 * len(texts)


def test_words_of_several_places(monkeypatch):
    monkeypatch.setattr(decontaminate.Automaton, "BASE", 2)
    a = decontaminate.Automaton([(b"a b c", "1"), (b"b d", "2"), (b"e", "3")])
    assert a.width == 3 and a.scan(b"x a b c b d y e".split()) == ([(1, 4), (4, 6), (7, 8)], {"1", "2", "3"})


def test_spans_are_code_points_of_the_original():
    assert decontaminate.spans("É, ab  Cd.".encode(), [(1, 3)]) == [(3, 9)]


# -- 2: token files


@pytest.mark.parametrize("values", [[], [0], [2**64 - 1] * 3, [2**60 - 1, 2**60, 1], [0] * 3000, list(range(5000)), [(7 * i) % 50257 for i in range(3000)], [2 ** (i % 63) for i in range(2000)]])
def test_simple8b_round_trip_and_blocks(values):
    v = np.array(values, dtype=np.uint64)
    w, o = simple8b.encode(v)
    assert (simple8b.decode(w, len(v)) == v).all()
    assert (simple8b.decode_blocks(w, o, len(v)) == v).all()
    for k in range(len(o)):
        assert (simple8b.decode_block(w, o, len(v), k) == v[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


ODD = ["a  b", " a b", "a b ", "a\n b", "", None, "it's  ok 12", "<|endoftext|> a", "\x1c a b", "é  b", "x\ny", "x\n\ny", "x\n\n\ny", "x\n\n", "\n", "don't. dogs' x_. foo_! (a) b), .. é. 3.)", "日本語 テスト。 ok", "\0 a", "a\u00a0b c"]


def test_encoder_equals_the_library():
    import pyarrow as pa

    for limit in (tokens.MAX_BYTES, 1):
        e = tokens.encoding(tokens.vocabulary_path(), limit)
        for _ in range(2):
            ids, at = e.encode(pa.array(ODD))
            want = e.library([t or "" for t in ODD])
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w.tolist() for w in want]
        assert tokens.encoding(tokens.vocabulary_path(), limit) is e and len(common._kept) == 1
    common.vacated()  # as another operator's task begins
    assert not common._kept and e.pieces.nbytes < 2 * tokens.MAX_BYTES


def test_encoder_keeps_many_pieces_and_any_length():
    import pyarrow as pa

    rng = np.random.default_rng(14)
    texts = [" ".join(f"x{i:b}" for i in rng.integers(0, 10**6, 3000)) for _ in range(5)] + ["ab" * 600_000, "é " * 400_000, "a\n" * 300_000]
    e = tokens.Encoder(tokens.vocabulary_path())
    ids, at = e.encode(pa.array(texts))
    want = e.library(texts)
    assert e.pieces.count > 10_000 and all((ids[a:b] == w).all() for a, b, w in zip(at, at[1:], want))


def test_new_pieces_share_texts_and_those_met_again_stay():
    import pyarrow as pa

    e = tokens.Encoder(tokens.vocabulary_path())
    sent, library = [], e._library
    e._library = lambda texts: (sent.extend(texts), library(texts))[1]

    def texts_sent(text):
        sent.clear()
        ids, _ = e.encode(pa.array([text]))
        n = len(sent)
        assert ids.tolist() == e.library([text])[0].tolist()
        return n

    names = [f"w{i:b}" for i in range(3000)]
    assert 0 < texts_sent(" ".join(names) + ",\n\nw\n.") < 300
    assert texts_sent(" ".join(names[:500])) == 0
    e.pieces.max_bytes = 1  # full from now on
    assert texts_sent(" ".join(names[:500])) == 0 and 500 <= e.pieces.count < 600
    assert texts_sent(" ".join(names[:500])) > 0  # nothing but what was met again: begun anew
    e.newline = e.newline + 1  # as where a newline doesn't stand alone
    assert texts_sent(" ".join(names[500:]) + "\nx") > 2500


def test_token_files_hold_all_documents_in_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = [*ODD, *(words(rng, n) for n in (3, 700, 4000))]
    d = spark.createDataFrame([(i * 3 % 1000, t, "x") for i, t in enumerate(texts)], DOCS + ", part string")
    token_files.write(d, str(tmp_path / "t"), segment_ids=500, parts=3)
    got = {r.doc_id: r for r in token_files.documents(spark, str(tmp_path / "t")).collect()}
    lib, start = tokens.Encoder(tokens.vocabulary_path()), 0
    for doc_id, t in sorted((i * 3 % 1000, t) for i, t in enumerate(texts)):
        ids = np.append(lib.library([t or ""])[0], 0).astype("<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write(d.limit(0), str(tmp_path / "e"))
    assert token_files.documents(spark, str(tmp_path / "e")).count() == 0


# -- 3: packing


def check_packing(rows, ids_of, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    for doc_id, ids in ids_of.items():
        at = 0
        for _, start, n, crc, total, *_ in sorted(by_doc[doc_id], key=lambda r: r[1]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_places_every_id_once_without_padding():
    rng = np.random.default_rng(2)
    p, ids_of = packing.Packer(64), {}
    for i, n in enumerate([1, 64, 65, 128, 63, 1, *rng.integers(1, 200, 300)]):
        ids_of[i] = rng.integers(0, 50000, n).astype("<u4")
        for piece in packing.cut_ids(i, ids_of[i], 64):
            p.add(piece)
    p.close()
    rows = p.take()
    assert check_packing([r[:7] for r in rows], ids_of, 64) == 0
    remainders = [r for r in rows if r[7] != "full"]
    assert sum(r[2] for r in remainders if r[7] == "online") > 0.5 * sum(r[2] for r in remainders)


def test_most_remainders_are_placed_online():
    rng = np.random.default_rng(21)
    p = packing.Packer()
    raw = np.zeros(2048, "<u4").tobytes()
    for n in np.minimum(rng.geometric(1 / 400, 20_000), 2047).tolist():
        p.add((0, 0, n, 0, n, raw[: 4 * n]))
    p.close()
    rows = p.take()
    assert sum(r[2] for r in rows if r[7] == "online") > 0.9 * sum(r[2] for r in rows)


def test_an_item_goes_where_the_sum_of_squares_is_least():
    rng = np.random.default_rng(3)
    p = packing.Packer(16)
    for _ in range(200):
        size = int(rng.integers(1, 16))
        level = p.level(size)

        def cost(h):
            n = p.counts.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return (n[1:] ** 2).sum()

        open_ = [0] + [h for h in range(1, 17 - size) if p.counts[h]]
        assert level in open_ and cost(level) == min(map(cost, open_))
        p.add((0, 0, size, 0, size, b""))


def test_packing_a_table(spark):
    d = docs(spark, *ODD, "x " * 5000)
    lib = tokens.Encoder(tokens.vocabulary_path())
    ids = {i: np.append(lib.library([t or ""])[0], 1).astype("<u4") for i, t in enumerate([*ODD, "x " * 5000])}
    for per_task in (packing.PER_TASK, 4):
        rows = packing.pack(d, per_task=per_task).collect()
        assert check_packing([tuple(r)[:7] for r in rows], ids, 2048) == 0
        assert {r.placed for r in rows} <= {"full", "online", "residue"}
    assert packing.pack(d.limit(0)).count() == 0


# -- 4: line dedup


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [f"A line of some length {i}" for i in range(6)] + ["short", "", "Ünïcode LINE with enough letters É", " \t padded line with blanks here \x0b\r"]
    rows = [(i, "\n".join(pool[k] if rng.random() < 0.7 else f"unique line number {i} {k} {rng.random()}" for k in rng.integers(0, len(pool), 5))) for i in range(25)]
    rows += [(25, None), (26, ""), (None, pool[0]), (3, pool[1]), (27, "É line of some LENGTH but other\n" * 3), (28, "é line of some length but other"), (29, "É line of some length but other")]
    rows += [(30, "\n".join(pool[:6] * 3000 + ["own line of document thirty"] * 3000)), (30, pool[2] + "\nother text of thirty, same id"), (30, pool[2])]
    d = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS + ", lost_id string, own int, `a``b.c` int, Text_ int")

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (i is not None and len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        want.append((i, "\n".join(kept) if t is not None else None))
    out = line_dedup.dedup_lines(d)
    assert out.columns == d.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# -- 5: quality


def test_quality_learns_and_stays_calibrated(spark):
    rng = np.random.default_rng(5)
    good = lambda: " ".join(f"{a}{b}" for a, b in zip(rng.choice(["the", "of", "re"], 80), rng.choice(["", "ing", "ed."], 80)))
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! ")) for i in range(400)] + [(400, None), (401, "")]
    d = spark.createDataFrame([(*r, 1.5) for r in rows], DOCS + ", score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(401, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    out = quality.scored(d, model, name="Score")
    assert out.columns == ["doc_id", "text", "score", "Score"]
    s = {r[0]: r[3] for r in out.collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= x <= 1 for x in s.values())
    kept = quality.keep_quality(d, labels)
    assert kept.columns == d.columns and 250 < kept.count() < 280
    assert quality.train(d, labels.limit(0)).score(["x", None]).tolist() == [0.5, 0.5]


# -- 6: wrappers


PAGE = '<html><head><title>T</title></head><body><nav><ul><li><a href="/{0}">m{0}</a></li></ul></nav><div class="ad">buy {0}</div>{1}<div id="comments"><p>nice {0} post indeed</p></div><footer>&copy; {0}</footer></body></html>'


def test_main_text_of_two_hosts(spark):
    a = "<article><h1>Head {0}</h1><p>One &amp; two<br>three {0}<p>Four\n  five.</p>{2}</article>"
    b = '<div class="wrap"><div class="content"><p>Alpha beta gamma delta {0} epsilon zeta eta.</p><p>Theta iota kappa lambda mu nu.</p></div><div class="sidebar">see also {0}</div></div>'
    rows = [(i, "http://a.example/x", PAGE.format(i, a.format(i, 0, "<ul><li>six<li>seven</ul>" if i % 2 else ""))) for i in range(6)]
    rows += [(10 + i, "http://B.example", PAGE.format(i, b.format(i))) for i in range(3)] + [(20, None, None), (21, "x", "bare text &lt;b&gt;"), (22, "http://a.example", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, wrapper int")
    for limit in (wrappers.MAX_BROADCAST, 0):
        got = {r.page_id: r.text for r in wrappers.extract(pages, limit).collect()}
        assert got[0] == "Head 0 One & two three 0 Four five." and got[1] == "Head 1 One & two three 1 Four five. six seven"
        assert got[10] == "Alpha beta gamma delta 0 epsilon zeta eta. Theta iota kappa lambda mu nu."
        assert (got[20], got[21], got[22]) == ("", "bare text <b>", "")
    assert wrappers.extract(pages.limit(0)).count() == 0


def inferred(pages):
    w = None
    for p in pages:
        own = wrappers.wrap(wrappers.parse(p))
        w = own if w is None else wrappers.align(w, own)
    return wrappers.decide(wrappers.unflat(wrappers.flat(w)))


@pytest.mark.parametrize(
    "pages, want",
    [
        (["<div><p>a</p><p>b</p></div>", "<div><h1>t</h1><p>c</p></div>"], "<div>(<h1>#SAME</>)? (<p>#TEXT</>)+</>"),
        (["<ul><li>a</li><li>b</li></ul>", "<ul><li>a</li><li>c</li><li>d</li></ul>", "<ul><li>x</li></ul>"], "<ul>(<li>#TEXT</>)+</>"),
        (["<p>same</p><p>one</p>", "<p>same</p><p>two</p>"], "<p>#SAME</> <p>#TEXT</>"),
        (["<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><h2>f</h2><p>g</p>"], "(<h2>#TEXT</> (<p>#TEXT</>)+)+"),
        (["<div class=x1a>a</div><p>b</p>", "<div class=y>c</div><p>d</p>", "<div class=z>e</div><p>f</p>"], "<div>#TEXT</> <p>#TEXT</>"),
        (["<p>b</p>", "<div class=x>a</div><p>b</p>", "<div class=y>c</div><p>b</p>", "<div class=z>c</div><p>b</p>"], "(<div>#TEXT</>)? <p>#SAME</>"),
    ],
)
def test_alignment_infers_union_free_expressions(pages, want):
    assert wrappers.expression(inferred(pages)) == want


TEXT = "some words of text {0} " * 9 + "end"


@pytest.mark.parametrize(
    "body, want",
    [
        ("<div class=page><h1>Title {0}</h1><p>Lead {0}</p><div class=content><p>{1}</p></div></div>", "Title {0} Lead {0} {1}"),
        ("<div class=page><div class=one><p>{1}</p></div><div class=two><p>half {1}</p></div></div>", "{1} half {1}"),
        ("<main><h1>Title {0}</h1><article><p>{1}</p></article></main><div class=x>far {0}</div>", "Title {0} {1}"),
        ("<div class=x>the same on each</div><div class=y><p>{1}</p></div>", "{1}"),
        ("<div><b>Sale!</b> now on</div><div><p>{1}</p></div>", "{1}"),
        ("<article><h1>T {0}</h1><div>our newsletter</div><p>{1}</p></article>", "T {0} {1}"),
        ("<article><h2>Method</h2><p>{1}</p></article>", "Method {1}"),
        ("<div class=x>see <a href='/'>{1}</a></div><div class=y><p>{1}</p></div>", "{1}"),
        ("<article>see <ul><li><a href='/'>{1}</a></li></ul></article>", "see {1}"),
        ("<header><h1>Site {0}</h1></header><article><header><h1>Own {0}</h1></header><p>{1}</p><footer>by {0}</footer></article>", "Own {0} {1}"),
        *((f'<div class="{x}"><p>{{1}}</p></div>', "{1}") for x in ("post comment-free", "main-content sidebar-right", "article with-sidebar", "entry share", "search-results content", "body legal")),
        ('<div class="share"><p>{1}</p></div>', "{1}"),
        ("<div class=page><div class=sidebar>see {0}</div><div class=cookie-notice>ok {0}</div><section id=comments><p>first! {1}</p></section><p>{1}</p></div>", "{1}"),
        ("<p>a{0}<script>x()</script>b</p><style>p</style><!-- c --><form>name<input></form><p>{1} &lt;i&gt; &eacute;</p>", "a{0}b {1} <i> é"),
    ],
)
def test_main_text_is_decided_by_slots_and_declarations(body, want):
    pages = [PAGE.format(i, body.format(i, TEXT.format(i))) for i in range(10)]
    w = inferred(pages)
    for i, p in enumerate(pages):
        assert wrappers.main_text(p, w) == want.format(i, TEXT.format(i))


def test_a_page_unlike_its_host_and_an_empty_article():
    pages = [f"<html><body><div class=shell><main><div class=a><div class=b><p>text {i} of it</p></div></div></main></div></body></html>" for i in range(5)]
    w = inferred(pages)
    assert wrappers.main_text("<p>hello world body</p>", w) == "hello world body"
    assert wrappers.main_text("<nav>menu</nav><main><p>other form</p></main><div>far</div>", w) == "other form"
    assert wrappers.main_text("<html><body><div class=shell><main></main><p>far</p></div></body></html>", w) == ""
    assert wrappers.main_text(None, w) == "" == wrappers.main_text("", None)


def test_pages_of_any_depth_and_hosts_of_any_names():
    for n in (70, 3000):
        page = f"<body><div class=page><article><p>first</p>{'<div>' * n}deep<nav>menu</nav>{'</div>' * n}<p>last</p></article></div></body>"
        assert wrappers.main_text(page, inferred([page] * 2)) == "first deep last"
        assert wrappers.main_text("<b>" * n + "x" + "</b>" * n, None) == "x"
    pages = [f"<div class=x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}>text {i}</div><p>and {i}</p>" for i in range(600)]
    w = inferred(pages)
    assert len(list(wrappers._all(w))) < 12 and wrappers.main_text(pages[7], w) == "text 7 and 7"


def test_wrappers_merge_in_any_grouping():
    pages = [f"<div><h1>t{i}</h1>{'<p>x</p>' * (i % 4)}{'<h2>s</h2><ul><li>q</li></ul>' * (i % 3)}</div>" for i in range(24)]
    whole = wrappers.expression(inferred(pages))
    parts = [wrappers.wrap(wrappers.parse(p)) for p in pages]
    halves = [parts[0], parts[12]]
    for k in (0, 1):
        for p in parts[12 * k + 1 : 12 * k + 12]:
            wrappers.align(halves[k], p)
    both = wrappers.align(*halves)
    assert both.pages == 24 and wrappers.expression(both).count("h1") == whole.count("h1") == 1
    w = wrappers.decide(both)
    assert all(wrappers.main_text(p, w) == " ".join(wrappers.main_text(p, None).split()) for p in pages)


def test_the_registered_extraction(spark):
    """Repeated rows give repeated rows, and extra columns of clashing names are left out."""
    rows = [(i // 2, "http://h.example/x", PAGE.format(0, "<article>one and two</article>")) for i in range(4)] + [(None, "no scheme", "<p>x"), (7, None, None)]
    pages = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    for limit in (wrappers.MAX_BROADCAST, 0):
        got = sorted(map(tuple, wrappers.extract(pages, limit).select("page_id", "text").collect()), key=repr)
        assert got == sorted([(0, "one and two")] * 2 + [(1, "one and two")] * 2 + [(None, "x"), (7, "")], key=repr)


# -- 7: SimHash


def test_fingerprints_are_majorities():
    text = "A b\tc  d e É f"
    w = "a b c d e É f".split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(4)]
    assert simhash.fingerprint(text.encode()) == [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 4)]
    assert simhash.fingerprint(b"  ") == [0]
    assert simhash.fingerprint(b"One two") == [xxhash.xxh64_intdigest(b"one two", 42)]


def near_rows(rng):
    f = [int(x) for x in rng.integers(0, 2**63, 60)]
    for x in list(f[:20]):
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= 1 << int(b)
            f.append(y)
            x = y if rng.random() < 0.5 else x
    return f


@pytest.mark.parametrize("max_bucket", [1 << 16, 6])
def test_links_and_components_lose_nothing(spark, max_bucket):
    f = near_rows(np.random.default_rng(6))
    n = len(f)
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i in range(n):
            for j in range(n):
                if bin(f[i] ^ f[j]).count("1") <= 4:
                    label[j] = min(label[i], label[j])
        if label == before:
            break
    first = {}
    for i, x in enumerate(f):
        first.setdefault(x, i)
    rows = [(i, int(np.uint64(x).astype(np.int64))) for x, i in first.items()]
    nodes = spark.createDataFrame(rows, "rep bigint, f0 bigint")
    joined = components.components(simhash.links(nodes, 1, 4, max_bucket=max_bucket))
    got = {r.node: r.component for r in joined.collect()}
    assert {i: got.get(i, i) for i in first.values()} == {i: label[i] for i in first.values()}


def test_near_duplicates_and_defined_cases(spark):
    rng = np.random.default_rng(7)
    base = [words(rng, 300) for _ in range(12)]
    edit = lambda t, k: " ".join("zz" if i % k == k - 1 else w for i, w in enumerate(t.split()))
    rows = list(enumerate([*base, base[0], edit(base[1], 150), edit(base[2], 100), None, "", words(rng, 3)])) + [(None, base[3]), (3, base[3])]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS + ", component_id string, lost_id int, TEXT_ int")
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [0, 1, 2, 3, 3, *range(4, 12), 15, 17]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    assert found[12] == 0 and found[16] == 15 and found[None] is None
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, simhash.BLOCK])
def test_near_duplicates_equal_brute_force_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(simhash._verified, "__defaults__", (block,))
    rng = np.random.default_rng(11)
    texts = []
    for n in (8, 9, 13, 60, 104, 304):
        for i in range(12):
            base = words(rng, n, 10**6).split()
            # Edits at the end give up one shingle a word, so similarities lie on both sides of 0.8.
            k = max(1, round((n - 4) * (0.1 + 0.002 * (i - 6))))
            texts += [" ".join(base), " ".join(base[:-k] + words(rng, k, 10**6).split()), " ".join(base[:-1])]
    texts += [" ".join(["again and over and once"] * 40), "again and over and once again and over and"]
    chain = words(rng, 400, 10**6).split()
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 120, 8)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, *texts)).collect()}
    assert kept == {i for i, x in enumerate(label) if i == x}


def test_a_repeated_doc_id_goes_or_stays_by_its_text(spark):
    rng = np.random.default_rng(12)
    a, b = words(rng, 50), words(rng, 50)
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b)], DOCS))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b)]


def test_wide_radii_lose_nothing_and_pivots_discard():
    rng = np.random.default_rng(31)
    f = rng.integers(0, 2**64, (500, 1), dtype=np.uint64)
    for r in (1, 4, 9):
        chosen = simhash._selections(1, r)
        assert len(chosen) == math.comb(r + 2, 2)
        for _ in range(200):
            flipped = set(rng.choice(64, r, replace=False).tolist())
            assert any(flipped.isdisjoint(c.tolist()) for c in chosen)
    pivots = simhash.mix(np.arange(1, simhash.PIVOTS + 1, dtype=np.uint64)).reshape(-1, 1)
    tally = [0, 0, 0]
    assert simhash.forest(f, 4, pivots, tally) == [] and tally[0] == 500 * 499 // 2 and tally[1] < tally[0] / 500


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and len(got) == 303


# -- 8: URL filters


def test_url_rules_against_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/e", "block"), ("org", "", "allow"), ("org", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.b.net/q?x", "http://example.net/en/1", "http://a.example.net/en/1", "http://xexample.net/en/1", "http://z.org#a", "http://z.org/x/y", "ftp://o.com/a?b://c", "http://Ä.NET/é", "http://u@h.net:80/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate([*urls, *urls])], "page_id bigint, url string, verdict string")

    def brute(u):
        host, path = url_filter.split_url(u)
        fits = [(h + p, v, h) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, v, _ = max(fits, key=lambda x: (len(x[0]), len(x[2])), default=(None, "allow", ""))
        return host, path, rule, v

    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)] * 2 + [(1, "http://a.net/x?a"), (1, "http://a.net/x?b")]
    pages = spark.createDataFrame([(*r, "v", "h") for r in rows], "page_id bigint, url string, verdict string, HOST string")
    for limit in (100, 2, 1):
        got = [tuple(r) for r in url_filter.judge(pages, rules, shard_rules=limit).collect()]
        assert sorted(got, key=repr) == sorted(((i, *brute(u)) for i, u in rows), key=repr)
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_a_cascade_is_exact_over_its_universe():
    listed, others = {f"k{i}" for i in range(300)}, {f"o{i}" for i in range(20000)}
    first = url_filter.Bloom(len(listed), 0.05, 0)
    for k in listed:
        first.add(k)
    c = url_filter.Cascade.deepen(first, listed, {k for k in others if k in first})
    assert len(c.levels) > 2 and all(k in c for k in listed) and not any(k in c for k in others)


# -- 9: I-Match


def brute_imatch(texts, min_share, max_share):
    """Fingerprints in plain Python: sets, sorted lists, one sub-lexicon after another."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    terms = lambda t: {xxhash.xxh64_intdigest(w, 0) for w in decontaminate.words(t.encode())}
    df = {}
    for t in texts:
        for h in terms(t):
            df[h] = df.get(h, 0) + 1
    n = len(texts)
    band = {h for h, c in df.items() if max(2, math.ceil(min_share * n)) <= c <= max(2, math.floor(max_share * n))}

    def make(t):
        own = sorted(terms(t))
        h = [x for x in own if x in band]
        if not h:
            return b"\0" + hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in own)).digest()[:8]
        out = b"\1" + xxhash.xxh64_digest(b"".join(x.to_bytes(8, "little") for x in h))
        for level in range(1, imatch.LEVELS + 1):
            for s in range(1, imatch.SUBSETS + 1):
                salt = mix(s * (0x9E3779B97F4A7C15 & (1 << 63) - 1) & m)
                kept = [x for x in h if mix(x ^ salt) < 1 << 64 - 2 * level]
                listed = sum(mix(x + mix(i + 1) & m) for i, x in enumerate(kept)) & m
                out += (1 + mix(listed) % 65535 if kept else 0).to_bytes(2, "little")
        return out

    return make


def test_imatch_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [words(rng, 200, 5000) for _ in range(60)] + [None, "", "é", "one", words(rng, 6000, 5000), "w1 w2 " * 3]
    rows = [(i * 7 % 100, t, 1) for i, t in enumerate(texts)] + [(None, texts[3], 1), (7, texts[5], 1), (7, texts[1], 1), (7, texts[1], 1)]
    d = spark.createDataFrame(rows, DOCS + ", fingerprint int")
    make = brute_imatch([t or "" for _, t, _ in rows], 0.02, 0.2)
    h = {t or "": r for r, t in ((r[0], r[1]) for r in d.select(F.xxhash64(F.coalesce("text", F.lit(""))), "text").collect())}
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]], x[1]))
    want = []
    for (doc_id, t), (_, after) in zip(order, [*order[1:], order[0]]):
        n = len(t) // 4
        e = t[: len(t) - n] + after[:n]
        a, b, c = make(t), make(e), make(after)
        want.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), imatch.likeness(a, b), imatch.likeness(a, c)))
    for parts in ("4", "1"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [tuple(r) for r in imatch.fingerprints(d, 0.02, 0.2).collect()]
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert np.mean([r[5] for r in want if r[1] > 500]) > 0.4 > 0.2 > np.mean([r[6] for r in want if r[1] > 500])
    assert imatch.fingerprints(d.limit(0)).count() == 0
    one = imatch.fingerprints(d.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_the_lexicon_is_a_band_on_both_sides(spark):
    rows = ["often x%d" % i + (" rare" if i < 2 else "") + (" some" if i < 10 else "") for i in range(100)]
    h = lambda w: xxhash.xxh64_intdigest(w, 0)
    assert imatch.lexicon(docs(spark, *rows, None, "some some"), 0.05, 0.5).tolist() == [h(b"some")]


# -- 10: chat


def test_chat_round_trip_mask_and_parts(spark):
    rows = [(1, 0, "user", "a <turn role=\"x\">&lt; </turn>\n\\ <image 0>"), (1, 1, "assistant", "é</turn>\n&amp;"), (1, 2, "assistant", None), (1, 2, None, "tie"), (None, 0, 'r">\n', "x"), (2, None, "assistant", ""), (3, 1, "user", "again"), (3, 1, "user", "again"), (3, 2, "assistant", "long " * 100_000)]
    t = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int, Parts int")
    out = chat.format_chat(t).withColumn("turns", chat.parse(F.col("formatted"), F.col("attachments"))).withColumn("said", chat.learnt(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), chat.said(x).alias("text")))).collect()}
    assert [(x.role, x.text) for x in got[1].turns] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("", "tie"), ("assistant", "")]
    assert got[1].said == rows[1][3] and got[2].said == "" and got[None].turns[0].role == 'r">\n'
    assert [x.text for x in got[3].turns] == ["again", "again", "long " * 100_000] and got[3].said == "long " * 100_000
    assert chat.format_chat(t.limit(0)).count() == 0


def test_parts_become_placeholders_and_parts_again(spark):
    text = lambda x: ("text", x, None, None, None, None, None)
    other = lambda kind, ref, **size: (kind, None, ref, size.get("width"), size.get("height"), size.get("seconds"), size.get("pages"))
    turns = [
        [text("see <b> <image 7>"), other("image", "i.png", width=57, height=28), other("image", "j.png")],
        [other("audio", "k.wav", seconds=1.5), other("o<d>\"d", "o"), (None, "end", None, None, None, None, None), text(None), text(" &amp;")],
        [other("document", "d.pdf", pages=3), other("document", "e.pdf")],
    ]
    t = spark.createDataFrame([(1, i, "user", "unused", p) for i, p in enumerate(turns)] + [(1, 3, "user", "own text", None), (1, 4, "user", "unused", [])], f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    r = chat.format_chat(t, "parts").withColumn("turns", chat.parse(F.col("formatted"), F.col("attachments"))).first()
    assert r.formatted.split("\n")[:2] == ['<turn role="user">see &lt;b> &lt;image 7><image 0><image 1></turn>', '<turn role="user"><audio 2><o&lt;d&gt;&quot;d 3>end &amp;amp;</turn>']
    assert [(a["index"], a.kind, a.part.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 3), (1, "image", "j.png", 1), (2, "audio", "k.wav", 38), (3, 'o<d>"d', "o", 0), (4, "document", "d.pdf", 1536), (5, "document", "e.pdf", 512)]
    want = [turns[0], [*turns[1][:2], text("end &amp;")], turns[2], [text("own text")], []]
    assert [[tuple(p) for p in x.parts] for x in r.turns] == want
