"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import op1_decontaminate as op1
from corpusmill.llm import op2_bpe as op2
from corpusmill.llm import op3_jaccard as op3
from corpusmill.llm import op4_media as op4
from corpusmill.llm import op5_html as op5
from corpusmill.llm import op6_tokens as op6
from corpusmill.llm import op7_substrings as op7
from corpusmill.llm import op8_toxicity as op8
from corpusmill.llm import op9_quality as op9
from corpusmill.llm import op10_pii as op10
from corpusmill.llm.labelled import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w string, spans string, _spans int, row int"


EXTRA = ("x", "y", 1, 2)


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, *EXTRA) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def said(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   ", "a", "<|endoftext|>x", "ß é 😀  x", "A" * 30_000, "word " * 5000, "a", "a"]


# --- 1 --------------------------------------------------------------------------------------


def brute_contamination(texts, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add("" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, names = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("limit", [60_000, 3])
def test_contamination(spark, limit):
    rng = random.Random(1)
    items = [(k, said(rng, 30)) for k in range(6)] + [(7, "Tiny Item"), (None, said(rng, 13)), (9, ""), (10, None), (10, "Σίσυφος ΟΔΟΣ ένα")]
    texts = [*ODD, said(rng, 200), items[0][1], said(rng, 50) + "! " + items[1][1].upper() + " " + said(rng, 400), "x tiny, item y " * 3, items[2][1][:70] + " " + items[3][1], "σίσυφος οδος ένα ΣΊΣΥΦΟΣ", "Σίσυφος.ΟΔΟΣ-ένα"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = op1.benchmark_windows(bench, limit=limit)
    assert windows.small == (limit > 3)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in op1.contamination(docs(spark, texts), windows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)


def test_decontaminate_keeps_and_cuts(spark):
    rng = random.Random(2)
    item, clean = said(rng, 20), said(rng, 500)
    df, bench = docs(spark, [item, clean, f"{clean} {item}.", None]), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = op1.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    rows = op1.decontaminate(df, bench, mode="spans").collect()
    assert all(tuple(r)[5:] == EXTRA for r in rows)
    cut = {r["doc_id"]: r["text"] for r in rows}
    assert cut[1] == clean and cut[0].strip() == "" and cut[2] == f"{clean} " + " " * 19 + "." and cut[3] is None
    assert op1.decontaminate(df, bench.limit(0)).count() == 4 and op1.contamination(df.limit(0), op1.benchmark_windows(bench)).count() == 0


def test_spans_of_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(15)
    items = [said(rng, 20), said(rng, 13), "Tiny Item", said(rng, 40)]
    texts = [*ODD, items[0], f"{items[1]} {items[0]}, {said(rng, 30)}", f"x tiny, ITEM y {items[3][:150]}! {items[2]}", said(rng, 300), items[0]]
    df, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda: {r["doc_id"]: tuple(r) for r in op1.decontaminate(df, bench, mode="spans").collect()}
    small, real = rows(), op1.benchmark_windows
    monkeypatch.setattr(op1, "benchmark_windows", lambda b: real(b, limit=3))
    assert rows() == small and len(small) == len(texts) and sum(small[i][1] != t for i, t in enumerate(texts)) == 4


def test_large_benchmark_documents(spark, monkeypatch):
    rng = random.Random(36)
    items = [said(rng, n) for n in (40, 20, 13, 2, 60)]
    texts = [*ODD, *items, f"{items[0]} {said(rng, 900)}", f"{said(rng, 5)} {items[4][:200]}", said(rng, 100)]
    df, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {i for i, x in enumerate(brute_contamination(texts, list(enumerate(items)))) if not x[4]}
    real = op1.benchmark_windows
    for limit in (60_000, 9):
        monkeypatch.setattr(op1, "benchmark_windows", lambda b, n=limit: real(b, limit=n))
        kept = op1.decontaminate(df, bench)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == want


def test_many_hits_in_one_text(spark):
    rng = random.Random(37)
    item = said(rng, 13, 10**6)
    text = f"é {item}, z. " * 5000
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = op1.decontaminate(docs(spark, [text]), bench, mode="spans").collect()[0]["text"]
    assert cut == ("é " + " " * 12 + ", z. ") * 5000


# --- 2 --------------------------------------------------------------------------------------


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op2.default_vocabulary())
    rng = random.Random(3)
    texts = [*ODD, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x300, 0x3000), 10, 32])) for _ in range(80)) for _ in range(200)), "it's we'll THEY'RE 123 4.5\t\n  x  "]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in op2.bpe_round_trip(df, ["doc_id"], with_ids=True).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in op2.bpe_decode(op2.bpe_encode(df)).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert op2.bpe_round_trip(df.limit(0), ["doc_id"]).count() == 0


def test_bpe_tokens_are_their_own_encoding():
    codec = op2.ByteBPE(op2._read(None))
    assert all(codec.as_u32[n] == np.frombuffer(codec.encode_piece(t), "<u4")[0] and len(codec.encode_piece(t)) == 4 for n, t in enumerate(codec.token) if n % 7 == 0)


# --- 3 --------------------------------------------------------------------------------------


def brute_components(rows, size=4, percent=85):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components(spark):
    rng = random.Random(4)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    for n in (1, 2, 3, 4, 5, 7, 9, 12, 16, 24, 40, 70, 150, 400):
        base = said(rng, n, 10**6)
        texts += copies(rng, base, 8, max(1, n // 60))
        texts += [base + " " + said(rng, max(1, n // 12), 10**6), " ".join(base.split()[: max(1, n - n // 10)]), base.upper()]
    line = said(rng, 12, 10**6)
    texts += [f"{line} {said(rng, rng.randrange(1, 20), 10**6)}" for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = docs(spark, texts, order)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.near_components(df).collect()}
    assert got == brute_components(list(zip(order, texts, strict=True)))
    five = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.near_components(df, size=5, percent=80).collect()}
    assert five == brute_components(list(zip(order, texts, strict=True)), 5, 80)  # every link, as the pipeline takes them
    kept = op3.one_of_each(df, size=4, percent=85)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (n, c) in got.items() if i == c}


def test_components_odd_ids(spark):
    df = docs(spark, ["a b c d e", "a b c d e", "q r s t", "q r s t", "u v w x", None], [5, None, 3, 5, None, 9])
    rows = sorted(((r["doc_id"], r["component_id"]) for r in op3.near_components(df).collect()), key=str)
    assert rows == sorted([(5, 3), (None, None), (3, 3), (5, 3), (None, None), (9, 9)], key=str)
    assert op3.near_components(df.limit(0)).count() == 0


def thue_morse(n):
    """Two words whose polynomial hashes modulo 2^64 are equal, whatever the base."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_shingles_are_compared_by_words(spark):
    a, b = thue_morse(1024)
    rng = random.Random(30)
    tail = said(rng, 3, 10**6)
    rows = [(0, f"{a} {tail}"), (1, f"{b} {tail}"), (2, f"{a} {tail}"), (3, a), (4, b), (5, f"{a} {b} {a} {b} {a} {a} {a} {a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.near_components(df).collect()}
    assert got == brute_components(rows)


def test_near_links_are_every_link(spark):
    rng = random.Random(31)
    texts = [t for n in (5, 30, 60) for t in copies(rng, said(rng, n, 10**6), 14, 3)] + ["x y", "x y", None, ""]
    pairs, classes = op3.near_links(docs(spark, texts))
    rep = {r["doc_id"]: r["rep"] for r in classes.collect()}
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) for w in ((t or "").split() for t in texts)]
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    reps = sorted(set(rep.values()))
    assert set(rep) == {i for i, t in enumerate(texts) if t} and all(texts[i] == texts[r] for i, r in rep.items())
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(a, b) for a in reps for b in reps if a < b and alike(sets[a], sets[b])]


def test_large_buckets_are_compared_in_rounds(spark, monkeypatch):
    """Leaders, salts and shuffle joins, as large tables need them."""
    for name in ("BROADCAST_IDS", "BROADCAST_PAIRS", "SALT_ROWS"):
        monkeypatch.setattr(op3, name, 3)
    rng = random.Random(32)
    texts = []
    for n in (2, 4, 6, 9, 14):
        base = said(rng, n, 10**6)
        texts += [t for part in range(4) for t in copies(rng, f"{base} {said(rng, n, 10**6)}", 12, 2 + n // 8)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op3.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("percent", "rare"), [(85, op3.RARE), (80, op3.RARE), (85, 0.99), (80, 0.99)])
def test_pigeonhole_plan_is_sound(monkeypatch, percent, rare):
    """Also with plans whose segments often don't suffice, which match by their empty segments."""
    monkeypatch.setattr(op3, "RARE", rare)
    rng, share = np.random.default_rng(5), percent / 100
    plan = op3.Plan(percent)
    for n in [*range(1, 40), 60, 100, 180, 300, 700]:
        for _ in range(40):
            a = np.unique(op3.mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
            cut = rng.integers(0, int((1 - share) * n) + 1)
            b = a[rng.permutation(len(a))[: len(a) - cut]]
            extra = max(0, int((len(a) - cut) / share) - len(a))
            b = np.unique(np.concatenate((b, op3.mix(rng.integers(0, 1 << 60, rng.integers(0, extra + 1)).astype(np.uint64)))))
            both = len(np.intersect1d(a, b))
            if op3.enough(both, len(a), len(b), percent):
                (x, ex, nx), (y, ey, ny) = plan.signatures(a), plan.signatures(b)
                assert np.intersect1d(x, y).size or np.intersect1d(nx, ey).size or np.intersect1d(ex, ny).size


# --- 4 --------------------------------------------------------------------------------------


def test_media(spark):
    rng = random.Random(6)
    texts = [*ODD, *("".join(chr(rng.randrange(1, 0x2FF)) for _ in range(rng.randrange(4000))) for _ in range(20)), "a" * 9000 + "Z" * 9000]
    df = docs(spark, texts)
    media = op4.to_media(df, ["doc_id"])
    got = {r["doc_id"]: r for r in op4.read_media(media, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
    stored = {r["doc_id"]: r["media"] for r in media.collect()}
    assert hashlib.sha256(stored[3]).hexdigest() == got[3]["media_sha256"] and stored[3] == stored[8] and stored[3][:4] == b"RIFF"
    clips = op4.clips(media).where(F.col("doc_id") == len(texts) - 1).orderBy("clip").collect()
    assert len(clips) == 2 and clips[0]["end_s"] == clips[1]["start_s"] and sum(c["frames"] for c in clips) == 6
    assert op4.read_media(op4.to_media(df.limit(0), ["doc_id"]), ["doc_id"]).count() == 0


def lossless_frame(x, predictor, lengths, symbols):
    """A lossless JPEG frame with the given table (codes of each length) and predictor."""
    code, codes, at = 0, {}, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            codes[symbols[at]] = format(code, f"0{n}b")
            code, at = code + 1, at + 1
        code <<= 1
    bits, h, w = "", *x.shape
    for r in range(h):
        for c in range(w):
            a, b, e = (int(x[r, c - 1]) if c else 0), (int(x[r - 1, c]) if r else 0), (int(x[r - 1, c - 1]) if r and c else 0)
            guess = (b if r else 128) if not c else a if not r else [0, a, b, e, a + b - e, a + ((b - e) >> 1), b + ((a - e) >> 1), (a + b) >> 1][predictor]
            d = int(x[r, c]) - guess
            s = abs(d).bit_length()
            bits += codes[s] + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
    bits += "1" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = b"\x01" + bytes(lengths) + bytes(symbols)
    two = lambda n: n.to_bytes(2, "big")
    return b"\xff\xd8\xff\xc4" + two(2 + len(table)) + table + b"\xff\xc3" + two(11) + b"\x08" + two(h) + two(w) + b"\x01\x01\x11\x00\xff\xda" + two(8) + b"\x01\x01\x10" + bytes([predictor]) + b"\0\0" + raw + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_other_lossless_frames(predictor):
    rng = np.random.default_rng(predictor)
    x = np.cumsum(rng.integers(-20, 21, (5, 23)), axis=1).clip(0, 255).astype(np.uint8)
    frame = lossless_frame(x, predictor, [0, 1, 5, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    rows, width, p, tables, coded = op4._scan(frame)
    assert (rows, width, p) == (5, 23, predictor) and (op4._plain(rows, width, p, tables[0][1], coded) == x).all()
    own = op4.avi(op4.pad(bytes(rng.integers(0, 256, 5000).astype(np.uint8))))
    samples, starts, _ = op4.read_avi(own)
    at = own.index(b"00dc") + 8
    rows, width, p, tables, coded = op4._scan(own[at : at + int.from_bytes(own[at - 4 : at], "little")])
    assert (op4._plain(rows, width, p, tables[0][1], coded) == samples[: starts[1]]).all()


# --- 5 --------------------------------------------------------------------------------------


def test_blocks():
    found = op5.blocks("<body><!-- x<p> --><p>A&amp;B <b>c</b>\n d<br>e<p>f<script>var a='<p>no</p>';</script><ul><li>g<li><a href='x>y'>h</a></ul><style>z")
    assert [t for _, t, _ in found] == ["A&B c d e", "f", "g", "h"] and found[3][2] == 1
    assert op5.blocks("") == [] and op5.blocks("<<<>>>") is not None and op5.blocks("<p") == [] and op5.blocks("plain text")[0][1] == "plain text"


def test_labeller(spark):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages, want = [], []
    for k in range(60):
        own = [text(5), text(40), text(25), text(3)]
        pages.append(f"<html><head><title>t</title></head><body><nav><ul><li><a href='#'>{text(1)}</a></li></ul></nav><div class='cookie-notice'><p>{text(12)}</p></div><article><h1>{own[0]}</h1><p>{own[1]}</p><p><b>{own[2]}</b><br><p>{own[3]}</article><aside class=sidebar><p>{text(9)}</p></aside><section id='comments'><div class='comment'><p>{text(20)}</p></div></section><footer>&copy; {text(3)}</footer></body></html>")
        want.append("\n\n".join(own))
    df = spark.createDataFrame([*enumerate(pages), (100, None), (101, ""), (102, "<nav>x</nav>")], "page_id long, html string")
    model = op5.fit_labeller(df)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op5.extract_text(df, model, ["page_id"]).collect()}
    assert sum(got[k][0] == want[k] for k in range(60)) >= 57
    assert got[100] == ("", 0) and got[101] == ("", 0) and got[0][1] == len(got[0][0])
    fresh = op5.Grammar(np.random.default_rng(99), dict.fromkeys(words[:200], 1), dict.fromkeys(words[200:], 1))
    made = [x for x in (fresh.example() for _ in range(100)) if len(x[1])]
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(model.predict([v for v, _ in made]), made, strict=True)])
    assert right.mean() > 0.98


def article_text(html):
    """Brute force for pages whose only article element is well formed and holds nothing else."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag not in op5.INLINE:
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag not in op5.INLINE:
                self.blocks.append("")
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    r = Reader()
    r.feed(html)
    r.close()
    return "\n\n".join(" ".join(b.split()) for b in r.blocks if b.split())


def test_article_against_a_plain_parse(spark):
    rng = random.Random(38)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    pages = []
    for k in range(50):
        body = "".join(rng.choice((f"<p>{text(rng.randrange(3, 60))} &amp; <em>x</em></p>", f"<h2>{text(4)}</h2>", f"<ul><li>{text(5)}</li><li>{text(7)}</li></ul>", f"<blockquote>{text(20)}</blockquote>")) for _ in range(rng.randrange(2, 40)))
        pages.append(f"<!doctype html><html><body><header><h1>{text(2)}</h1></header><nav><ul><li><a href=/>{text(1)}</a></li></ul></nav><article><h1>{text(6)}</h1>{body}</article><aside class='sidebar'><p>{text(12)}</p></aside><footer><p>&copy; {text(4)}</p></footer></body></html>")
    rows = [(k, h, "u", "x", 1) for k, h in enumerate(pages)] + [(7, pages[7], "u", "x", 1), (90, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars int")  # extra columns, a repeated row
    model = op5.fit_labeller(df)
    got = op5.extract_text(df, model, ["page_id", "url"]).collect()
    assert len(got) == 52 and [r["text"] for r in got if r["page_id"] == 7] == [article_text(pages[7])] * 2
    assert sum(r["text"] == article_text(pages[r["page_id"]]) for r in got if r["page_id"] < 50) >= 49
    assert op5.extract_text(df.limit(0), model, ["page_id"]).count() == 0
    assert op5.page_words(df.limit(0), "html", 10) == [{}, {}]


def test_labeller_is_stored(spark, tmp_path):
    model = op5.BiLSTM.fresh(np.random.default_rng(1))
    op5.save_labeller(spark, model, f"{tmp_path}/model")
    again = op5.load_labeller(spark, f"{tmp_path}/model")
    assert again.w.keys() == model.w.keys() and all((again.w[k] == v).all() for k, v in model.w.items())


def test_long_and_deep_pages(monkeypatch):
    import time

    began = time.time()
    deep = "<div class=a>x <b>" * 50_000 + "</b>" * 50_000 + "<p>y" * 1000 + "</div></span>" * 50_000
    found = op5.blocks(deep)
    assert len(found) == 51_000 and found[-1][0].depth == 50_001 and len(op5.vectors(found)) == 51_000
    assert time.time() - began < 20
    rng = np.random.default_rng(2)
    model, some = op5.BiLSTM.fresh(rng), op5.blocks("".join(f"<p>{'w ' * (k % 9 + 1)}" for k in range(700)))
    whole = model.predict([op5.vectors(some)])[0]
    monkeypatch.setattr(op5, "LONG", 64)
    assert np.allclose(model.streamed(some), whole, atol=1e-5)


# --- 6 --------------------------------------------------------------------------------------


def test_token_shards(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op6.default_vocabulary())
    rng = random.Random(8)
    texts = [*ODD, *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x300, 0x3000), 10, 32])) for _ in range(120)) for _ in range(60))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[0] = None
    shards = op6.write_shards(docs(spark, texts, ids), shard_tokens=500)
    assert shards.count() > 3
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6.read_shards(shards).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: -1 if x[0] is None else x[0]):
        code = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(code), zlib.crc32(np.array(code, "<u4").tobytes()))
        start += len(code)
    assert op6.read_shards(op6.write_shards(docs(spark, texts).limit(0))).count() == 0


def test_token_chunks_are_known_by_their_bytes(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(op6.default_vocabulary())
    texts = [*thue_morse(1024), "plain words"]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in op6.read_shards(op6.write_shards(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        code = [*lib.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == (len(code), zlib.crc32(np.array(code, "<u4").tobytes()))


def test_token_files_do_not_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(34)
    texts = [said(rng, rng.randrange(1, 9)) for _ in range(120)] + [None, ""]
    ids = [7] * 100 + list(range(22))
    df, seen, before = docs(spark, texts, ids), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            shards = op6.write_shards(df.repartition(int(n)), shard_tokens=60)
            seen.append(sorted(tuple(r) for r in op6.read_shards(shards).collect()))
            counts = {r["id"]: r["n"] for r in op6.occurrences(shards, [1, 60_000]).collect()}
            assert counts == {1: 122, 60_000: 0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 122
    monkeypatch.setattr(op6, "CACHE_CHUNKS", 5)  # a full table starts anew
    assert sorted(tuple(r) for r in op6.read_shards(op6.write_shards(df)).collect()) == seen[0]


def test_wavelet_matrix():
    rng = np.random.default_rng(9)
    for n in (1, 7, 8, 9, 40_000):
        ids = rng.zipf(1.3, n).clip(0, 49_000).astype(np.uint32)
        m = op6.WaveletMatrix(op6.shard([3, None], [n - 1, 1], ids))
        assert (m.ids() == ids).all() and m.doc_ids == [3, None] and m.lengths.tolist() == [n - 1, 1]
        for i in rng.integers(0, n, 12):
            c, k = int(ids[i]), int((ids[:i] == ids[i]).sum())
            assert m.access(int(i)) == c and m.rank(c, int(i)) == k and m.select(c, k) == i and m.total(c) == (ids == c).sum()
        assert m.select(int(ids[0]), n) == -1


# --- 7 --------------------------------------------------------------------------------------


def test_chunks_cover_and_shift():
    rng = random.Random(10)
    for t in ["a", "é" * 2000, "x" * 5000, said(rng, 900, 10**6)]:
        value, place = op7.chunks(t)
        start, size = place >> 22, place >> 11 & 2047
        assert start[0] == 0 and (start[1:] == (start + size)[:-1]).all() and (start + size)[-1] == len(t.encode())
        assert (place & 2047).sum() == len(t.split())
    base = said(rng, 600, 10**6)
    one, two = (set(op7.chunks(t)[0].tolist()) for t in (base, "inserted words " + base))
    assert len(one - two) <= 3


def test_repeated_passages(spark):
    rng = random.Random(11)
    own = lambda n: said(rng, n, 10**7)
    passages = [own(60) for _ in range(12)]
    texts, ids = [], []
    for k, p in enumerate(passages):
        for j in range(2 + k % 3):
            texts.append(f"{own(40 + 7 * j)} {p} {own(30)}")
            ids.append(100 * k + j)
    clean = [5000 + k for k in range(40)]
    texts += [f"A common first line here. {own(120)}" for _ in clean] + [None, ""]
    ids += [*clean, 9000, 9001]
    df = docs(spark, texts, ids)
    rows = op7.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == set(ids) - {*clean, 9000, 9001}
    by_id = dict(zip(ids, texts, strict=True))
    for r in rows:
        assert r["n_words"] >= op7.RUN_WORDS and by_id[r["doc_id"]].encode()[r["start"] : r["end"]].decode("utf-8", "ignore").strip()[3:-3] in passages[r["doc_id"] // 100] and r["first_doc_id"] == r["doc_id"] // 100 * 100
    rest = op7.drop_repeats(df)
    assert rest.columns == df.columns and all(tuple(r)[5:] == EXTRA for r in rest.collect())
    left = {r["doc_id"]: r["text"] for r in rest.collect()}
    assert left[0] == by_id[0] and len(left[1]) < len(by_id[1]) and left[9000] is None and left[clean[0]] == by_id[clean[0]]
    same = docs(spark, [texts[0], texts[0], texts[0]], [1, 1, None])
    assert op7.repeated_passages(same).count() == 0 and op7.repeated_passages(df.limit(0)).count() == 0


def test_windows_cover():
    rng = random.Random(12)
    for t in ["a", "é" * 2000, "x" * 5000, said(rng, 14, 10**6), *(said(rng, n, 10**6) for n in (15, 40, 900))]:
        digest, _, place, _ = op7.windows(t)
        edges = [0, *op7.cuts(op7.as_bytes(t)).tolist()]
        raw = t.encode()
        words_before = {x: len(raw[:x].split()) for x in edges}
        count = {(a, b): words_before[b] - words_before[a] for a in edges for b in edges if a < b} if len(edges) < 60 else {}
        spans = set(zip((place >> 32).tolist(), (place & 0xFFFFFFFF).tolist(), strict=True))
        assert len(spans) == len(digest) and (bool(spans) == (len(t.split()) >= 15))
        for (a, b), n in count.items():
            inside = [s for s in spans if a <= s[0] and s[1] <= b]
            assert (n >= 15) == bool(inside) and (not inside or (min(inside)[0] == a and max(s[1] for s in inside) == b))


def test_passages_against_brute_force(spark):
    """Every byte of a reported passage, and no other stretch of RUN_WORDS words, stands in another document."""
    rng = random.Random(33)
    a, b = thue_morse(2048)
    bank = [said(rng, n, 10**7) for n in (10, 14, 20, 35, 60, 80)]
    texts = [" ".join(rng.choice([said(rng, rng.randrange(5, 60), 10**7), rng.choice(bank)]) for _ in range(4)) for _ in range(60)]
    texts += [f"{a} {said(rng, 14, 10**7)}", f"{b} {said(rng, 14, 10**7)}", *texts[:3], " ".join([texts[0], texts[0]])]
    rows = op7.repeated_passages(docs(spark, texts)).collect()
    raw = [t.encode() for t in texts]
    found = [set() for _ in texts]
    for r in rows:
        found[r["doc_id"]] |= set(range(r["start"], r["end"]))
    want = [set() for _ in texts]
    for i, t in enumerate(texts):
        _, _, place, _ = op7.windows(t)
        for s, e in zip((place >> 32).tolist(), (place & 0xFFFFFFFF).tolist(), strict=True):
            stretch = raw[i][s:e]
            for j in range(len(texts)):
                if j != i and stretch in raw[j]:
                    spans = op7.windows(texts[j])[2]
                    if any(raw[j][x >> 32 : x & 0xFFFFFFFF] == stretch for x in spans.tolist()):
                        want[i] |= set(range(s, e))
                        break
    assert found == want and sum(map(bool, found)) > 30


def test_quote_inside_copies_stays(spark):
    rng = random.Random(14)
    own = lambda n: said(rng, n, 10**7)
    quote, before, after = own(40), own(80), own(80)
    texts = {1: f"{own(30)} {quote} {own(30)}", 5: f"{before} {quote} {after}", 9: f"{before} {quote} {after}", 12: quote}
    df = docs(spark, list(texts.values()), list(texts))
    rows = op7.repeated_passages(df).collect()
    for r in rows:
        passage = texts[r["doc_id"]].encode()[r["start"] : r["end"]]
        assert passage in texts[r["first_doc_id"]].encode() and r["n_words"] >= op7.RUN_WORDS
    assert {(r["doc_id"], r["first_doc_id"]) for r in rows} == {(1, 1), (5, 1), (5, 5), (9, 1), (9, 5), (12, 1)}
    left = {r["doc_id"]: r["text"] for r in op7.drop_repeats(df).collect()}
    assert left[1] == texts[1] and not left[9].strip()
    assert quote in left[1] and len(left[5]) < len(texts[5]) and all(w in left[5].split() for w in [*before.split()[:-1], *after.split()[1:]])
    # rows of one id are cut by their own places
    twin = docs(spark, [texts[1], texts[5], own(200)], [1, 5, 5])
    assert twin.collect()[2]["text"] in {r["text"] for r in op7.drop_repeats(twin).collect()}


def test_common_phrases_are_no_repeat(spark):
    rng = random.Random(13)
    line = next(x for x in iter(lambda: said(rng, 4, 10**7), "") if 20 < op7.cuts(op7.as_bytes(x))[0] < len(x))  # cut alike everywhere
    phrases = [said(rng, 4, 10**7) for _ in range(8)]
    texts = [f"{said(rng, 30, 10**7)} {line} {p} {line} {said(rng, 30, 10**7)}" for p in phrases]  # 12 words at a stretch
    texts.append(" ".join(f"{line} {p}" for p in [*phrases, ""]))
    df = docs(spark, texts)
    assert op7.repeated_passages(df).count() == 0
    assert {r["text"] for r in op7.drop_repeats(df).collect()} == set(texts)


# --- 8, 9 -----------------------------------------------------------------------------------


def labelled_corpus(spark, n=1200):
    rng = random.Random(12)
    bad = ["vile", "nasty", "rotten"]
    texts, rows = [], []
    for i in range(n):
        w = said(rng, rng.randrange(20, 120), 600).split()
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.8)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w) if good else " ".join(x + "$$$" for x in w))
        rows.append((i, good, toxic))
    rows += [(None, 1, 1), (5, None, None), (10**9, 1, 1)]
    return docs(spark, [*texts, None, "", "x" * 50_000], [*range(n), 10**6, 10**6 + 1, 10**6 + 2]), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), rows[:n]


def test_toxicity_and_quality(spark):
    df, labels, rows = labelled_corpus(spark)
    for model, scored, label, limit in (
        (op8.fit_toxicity(df, labels), op8.score_toxicity, 2, 0.5),
        (op9.fit_quality(df, labels), op9.score_quality, 1, 0.3),
    ):
        got = {r["doc_id"]: (r["score"], r["h"]) for r in scored(df, model, ["doc_id"]).withColumn("h", held_out()).collect()}
        test = [r for r in rows if got[r[0]][1]]
        assert 100 < len(test) < 400 and all(got[r[0]][1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
        assert np.mean([(got[r[0]][0] >= limit) == r[label] for r in test]) > 0.97
        assert all(0 <= s <= 1 for s, _ in got.values()) and got[10**6][0] == got[10**6 + 1][0]
    empty = df.limit(0)
    assert op9.score_quality(empty, op9.fit_quality(empty, labels), ["doc_id"]).count() == 0 and op8.score_toxicity(empty, op8.fit_toxicity(empty, labels), ["doc_id"]).count() == 0
    kept = op9.keep_quality(df, op9.fit_quality(df, labels))
    assert kept.columns == df.columns and 0.7 < kept.count() / df.count() < 0.9


def test_models_without_labels(spark):
    df, labels, _ = labelled_corpus(spark, 30)
    assert {r["score"] for r in op9.score_quality(df, op9.fit_quality(df, labels.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert max(r["score"] for r in op8.score_toxicity(df, op8.fit_toxicity(df, labels.limit(0)), ["doc_id"]).collect()) < 1e-5
    assert op8.score_toxicity(df.limit(0), op8.fit_toxicity(df, labels), ["doc_id"]).count() == 0


# --- 10 -------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_personal_data(spark):
    rng = random.Random(13)
    parts = ["a", "b.", "@", "c.d", "1", "23", "4111111111111111", "4111 1111-1111 1111", ".", "-", " ", "+1 ", "(", "555", "é", "_", "%", "255.", "0", "\n", "😀", "10.0.0.1"]
    texts = [*ODD, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "0" * 20_000, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(600))]
    df = docs(spark, texts)
    model = op10.fit_pii(df)
    got = {r["doc_id"]: r for r in op10.with_spans(df, model).select("doc_id", op10.listed(F.col("base")).alias("base"), op10.listed(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base"] == brute_pii(t or "")
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["spans"].split(","))


def test_weak_supervision_adds_secrets_and_redacts(spark):
    rng = random.Random(14)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'x token = "{key()}" y' for _ in range(30)] + [f"mail me: p{k}@mail.example.com now" for k in range(40)] + [f"number {rng.randrange(10**15, 10**16)}7 there" for _ in range(30)] + [None, "plain"]
    df = docs(spark, texts)
    model = op10.fit_pii(df)
    clean = op10.redact(df, model)
    assert clean.columns == df.columns
    assert all(tuple(r)[5:] == EXTRA for r in clean.collect())
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(rows[k] == 'x token = "<SECRET>" y' for k in range(30)) and rows[30] == "mail me: <EMAIL> now" and rows[100] is None and rows[101] == "plain"
    assert (model.reliability.sum(axis=2) - 1 < 1e-9).all()
    assert op10.with_spans(df.limit(0), op10.fit_pii(df.limit(0))).count() == 0


def test_personal_data_overlaps(spark):
    """Added spans keep clear of base ones, and redaction takes the first of spans that overlap."""
    rng = random.Random(35)
    parts = ["4111 1111-1111 1111", "+1 (555) 123-4567", "a.b@c.example.com", "10.0.0.1", " ", " x ", "(0201) 1234-5678", "123-45-6789", "DE89 3704 0044 0532 0130 00", "tok3n_abcdef0123456789", "é😀", "1234567890123456", "-", "+"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + [None, ""]
    df = docs(spark, texts)
    model = op10.fit_pii(df)
    got = {r["doc_id"]: r for r in op10.with_spans(df, model).select("doc_id", "base", "spans").collect()}
    clean = {r["doc_id"]: r["text"] for r in op10.redact(df, model).collect()}
    for i, t in enumerate(texts):
        base = [(x["s"], x["e"]) for x in got[i]["base"]]
        added = [x for x in got[i]["spans"] if x["kind"] in op10.EXTRA]
        assert all(not (b < x["e"] and x["s"] < e) for x in added for b, e in base)
        want, at = "", 0
        for x in got[i]["spans"]:
            if x["s"] >= at:
                want, at = want + t[at : x["s"]] + f"<{x['kind'].upper()}>", x["e"]
        assert clean[i] == (None if t is None else want + t[at:])


def test_many_matches_in_one_text(spark):
    """100,000 matches in one text, with added candidates between them."""
    import time

    one = "é 10.0.0.1 (0201) 1234-5678; "
    texts = [one * 50_000, one * 10]
    df = docs(spark, texts)
    began = time.time()
    model = op10.fit_pii(df)
    got = {r["doc_id"]: r for r in op10.with_spans(df, model).select("doc_id", F.size("base").alias("n"), op10.listed(F.col("base")).alias("base")).collect()}
    clean = {r["doc_id"]: r["text"] for r in op10.redact(df, model).collect()}
    assert time.time() - began < 120
    assert got[0]["n"] == 50_000 and got[0]["base"].endswith(f"ip:{len(one) * 49_999 + 2}:{len(one) * 49_999 + 10}")
    assert clean[0] == clean[1] * 5000 and "10.0.0.1" not in clean[0]


def test_added_candidates_against_brute_force(spark):
    """Every match of an added kind that overlaps no base span, and nothing else."""
    import regex

    rng = random.Random(40)
    parts = ["(0201) 1234-5678", "123-45-6789", "DE89 3704 0044 0532 0130 00", "tok3n_abcdef0123456789", "12345678901234", "4111111111111111", "10.0.0.1", "+1 555 123 4567", "a.b@c.example.com", " ", "x", "-", "é", ": "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    rows = op10.with_candidates(docs(spark, texts), "text").select("doc_id", F.transform("_extra", lambda x: F.struct(x["kind"], x["s"], x["e"])).alias("x")).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_pii(t).split(",") if x]
        want = set()
        for kind, pattern in op10.EXTRA.items():
            for m in regex.finditer(pattern, t):
                luhn = kind == "number" and any(int(a) == m.start() and int(b) == m.end() for k, a, b in (x.split(":") for x in brute_pii(t).split(",") if x) if k == "card")
                if not luhn and all(e <= m.start() or m.end() <= s for s, e in base):
                    want.add((kind, m.start(), m.end()))
        assert {tuple(x) for x in r["x"]} - {x for x in {tuple(y) for y in r["x"]} if x[0] == "number"} == {x for x in want if x[0] != "number"}
        assert {tuple(x) for x in r["x"]} <= want
