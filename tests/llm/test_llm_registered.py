"""Each registered function on small tables against brute force: nulls, empty and long texts, ties, repeats, clashing names, empty tables."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from keyhound.llm import queries, tokens, url_filter

RNG = np.random.default_rng(41)


def said(n, of=3000):
    return " ".join(f"w{i}" for i in RNG.integers(0, of, n))


LONG = "\n".join(said(40, 10**6) for _ in range(3000))
BASE = said(60)
LINE = "this very line stands in many documents of the table"
ITEM = said(30, 500)
TEXTS = [
    None, "", " ", "one", "One two", BASE, BASE, BASE + " end", "pre " + BASE, LONG, LONG + " more", f"{LINE}\n{said(30)}", f"{said(5)}\n {LINE.upper()} \n{said(20)}", f"{LINE}\n{LINE}",
    f"{said(20)} {ITEM} {said(20)}", ITEM, "É ü " + said(12), "a\n\n\nb\t<|endoftext|> c", said(700), said(2500),
]
#: Repeated rows, a repeated id with another text, null ids, extra columns whose names clash with those of operators.
ROWS = [*enumerate(TEXTS), (5, BASE), (3, "another text of three"), (None, BASE), (None, None)]
EXTRA = {"mark": 1, "Decontam": 2, "own": 3, "gone": 4, "score": 5, "fingerprint": 6, "component_id": 7, "h": 8, "part": 9, "a`b.c": 10}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """A full set of tables, and one of the same tables without rows."""
    out = {}
    for name, take in (("full", None), ("empty", 0)):
        at = tmp_path_factory.mktemp(name)
        ids, texts = zip(*ROWS, strict=True)
        n = len(ROWS)
        docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n), "source": pa.array(["s"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
        docs |= {k: pa.array([v] * n, pa.int32()) for k, v in EXTRA.items()}
        labels = {"doc_id": pa.array([5, 5, 11, 12, 18, 19, 6, None], pa.int64()), "quality": pa.array([1, 0, 1, 0, 1, None, 1, 1], pa.int32()), "toxic": pa.array([0] * 8, pa.int32())}
        bench = {"item_id": pa.array([1, 2, 2, None, 4], pa.int64()), "text": pa.array([ITEM, "One two", None, "é ü", ""])}
        urls = ["http://a.net/x", "HTTP://B.example.NET/en/1?q#f", None, "no scheme", "http://org", "https://x.org/fr/", "http://example.com/de/é" + "x" * 50_000]
        pages = {"page_id": pa.array([0, 1, 2, None, 4, 5, 6, 0, 0], pa.int64()), "url": pa.array([*urls, urls[0], urls[0]]), "html": pa.array(["<p>a", None, "", "x", "<article>b &amp; c</article><footer>d</footer>", "<div>" * 2000 + "deep", "<p>" + "long " * 60_000, "<p>a", "<p>a"]), "text": pa.array(["clash"] * 9), "Host": pa.array(["clash"] * 9)}
        said_ = [(0, 0, "user", "hi <turn>"), (0, 1, "assistant", "é</turn>\n&"), (0, 1, "assistant", "é</turn>\n&"), (0, None, None, None), (None, 0, "assistant", "x" * 300_000), (3, 5, "assistant", "")]
        chats = {"conv_id": pa.array([r[0] for r in said_], pa.int64()), "turn": pa.array([r[1] for r in said_], pa.int64()), "role": pa.array([r[2] for r in said_]), "text": pa.array([r[3] for r in said_]), "Formatted": pa.array([1] * 6)}
        for t, cols in {"documents": docs, "labels": labels, "benchmark": bench, "pages": pages, "conversations": chats}.items():
            pq.write_table(pa.table(cols).slice(0, take), at / f"{t}.parquet", row_group_size=7)
        out[name] = str(at)
    return out


@pytest.fixture(scope="module")
def ids_of():
    """Each row's ids, by the library itself."""
    e = tokens.Encoder(tokens.vocabulary_path())
    return lambda end: [(i, np.append(e.library([t or ""])[0], end).astype("<u4")) for i, t in ROWS]


def rows(spark, folders, name):
    return queries.QUERIES[name](spark, folders["full"]).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, folders, name):
    out = queries.QUERIES[name](spark, folders["empty"]).collect()
    assert [r.conv_id for r in out] == [-7] if name.startswith("op10_") else out == []


def test_op1(spark, folders):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or c.isalnum() else " " for c in t or "").split()
    items = [("1", split(ITEM)), ("2", split("One two")), ("", split("é ü"))]
    want = []
    for i, t in ROWS:
        w, hit, found = split(t), set(), set()
        for item, x in items:
            for k in ([x[j : j + 10] for j in range(max(1, len(x) - 9))]):
                for j in range(len(w) - len(k) + 1):
                    if w[j] == k[0] and w[j : j + len(k)] == k:
                        hit |= {*range(j, j + len(k))}
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(repr, (tuple(r) for r in rows(spark, folders, "op1_benchmark_decontamination")))) == sorted(map(repr, want))


def test_op2(spark, folders, ids_of):
    got = sorted(rows(spark, folders, "op2_simple8b_token_files"), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in ids_of(0))


def test_op3(spark, folders, ids_of):
    got = rows(spark, folders, "op3_sum_of_squares_packing")
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & at - 1 == 0)
    # The pieces of each id, by total and start, are its rows' ids cut somewhere: their checksums say so.
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    wanted = {}
    for i, x in ids_of(1):
        wanted.setdefault((i, len(x)), []).append(x)
    assert set(have) == set(wanted)
    for key, pieces in have.items():
        texts = wanted[key]
        assert sum(n for _, n, _ in pieces) == key[1] * len(texts)
        assert all(any(zlib.crc32(x[s : s + n].tobytes()) == crc for x in texts) for s, n, crc in pieces)


def test_op4(spark, folders):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in ROWS:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in rows(spark, folders, "op4_line_dedup")))) == sorted(map(repr, want))


def test_op5(spark, folders):
    got = rows(spark, folders, "op5_quality_classifier")
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), None if i is None else zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_op6(spark, folders):
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in rows(spark, folders, "op6_wrapper_extraction"))
    texts = [("0", "a")] * 3 + [("1", ""), ("2", ""), ("None", "x"), ("4", "b & c"), ("5", "deep"), ("6", " ".join(["long"] * 60_000))]
    assert got == sorted((i, t, len(t)) for i, t in texts)


def test_op7(spark, folders):
    def brute(t):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], dtype=np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))

    f = [(i, brute(t)) for i, t in ROWS]
    label = {x: min((i for i, y in f if y == x and i is not None), default=None) for x in {x for _, x in f}}
    nodes = {x for x, i in label.items() if i is not None}
    for _ in nodes:
        for x in nodes:
            for y in nodes:
                if (x ^ y).bit_count() <= 4:
                    label[x] = min(label[x], label[y])
    want = [(i, f"{x:016x}", label[x] if i is not None else None) for i, x in f]
    assert sorted(map(repr, (tuple(r) for r in rows(spark, folders, "op7_simhash_near_dedup")))) == sorted(map(repr, want))


def test_op8(spark, folders):
    def brute(u):
        host, path = url_filter.split_url(u)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, "allow"))

    got = rows(spark, folders, "op8_url_bloom_cascade")
    table = pq.read_table(folders["full"] + "/pages.parquet").to_pylist()
    want = [(r["page_id"], *url_filter.split_url(r["url"]), *brute(r["url"])) for r in table]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_op9(spark, folders):
    got = rows(spark, folders, "op9_imatch_fingerprints")
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in ROWS)
    # Equal texts have equal fingerprints, and edited texts those of whoever has that text.
    by_id = {}
    for r in got:
        by_id.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    for i, t in ROWS:
        prints.setdefault(t or "", set()).update(by_id[i, len(t or "")])
    assert all(len(x) == 1 for t, x in prints.items() if t in (BASE, LONG, ""))


def test_op10(spark, folders):
    got = {r.conv_id: r for r in rows(spark, folders, "op10_chat_formatting")}
    turns = {0: [("", ""), ("user", "hi <turn>"), *[("assistant", "é</turn>\n&")] * 2], None: [("assistant", "x" * 300_000)], 3: [("assistant", "")]}
    turns[-7] = [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]
    assert set(got) == set(turns)
    for conv, own in turns.items():
        learnt = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_the_pipeline(spark, folders):
    """Every stage keeps columns of any name; the last gives pieces, or none of an empty table."""
    docs = spark.read.parquet(f"{folders['full']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders["full"])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert corpus_pipeline.packing(spark, docs, folders["full"]).count() > 0
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
