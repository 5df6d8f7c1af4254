"""The operators on documents, against brute force on small fixtures."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsift.llm import decontamination, language, mixing, near_dedup, parsing, quality_rules, secret_scan, substrings, toxicity, windows

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, extra=True):
    """doc_id, text and columns whose names the operators use themselves."""
    full = [(i, t, 7, "x") for i, t in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, score int, _spans string")
    return df.repartition(3) if extra else df.select("doc_id", "text")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5):
    """Copies, near copies, shared passages, repetition, very short, very long, null and empty texts."""
    rng = random.Random(seed)
    base, passage = prose(rng, 300), prose(rng, 70)
    rows = [(0, None), (1, ""), (2, "one"), (3, "   \n\t "), (4, base), (5, base), (6, base.replace("w1 ", "v1 ", 1))]
    for i in range(7, 15):
        a = prose(rng, rng.randrange(20, 200)).split()
        a[len(a) // 2 : len(a) // 2] = passage.split()[: rng.choice([50, 55, 70, 49])]
        rows.append((i, " ".join(a)))
    rows += [(15, "aaaa" * 200), (16, "abc " * 300), (17, prose(rng, 20000, 50)), (18, "é" * 90 + " ü" * 120), (19, "é" * 90 + " ü" * 120 + "!"), (20, base[:700]), (21, base[300:1200])]
    rows += [(22, prose(rng, 60)), (22, prose(rng, 60)), (23, passage + " " + passage), (24, "one"), (25, "one")]
    return rows


PIECES = pytest.mark.parametrize("piece", [windows.PIECE_BYTES, 4000])  # the small one cuts through groups


@PIECES
def test_suffixes_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(windows, "PIECE_BYTES", piece)
    rows = corpus() + [(4, corpus()[4][1]), (None, corpus()[9][1]), (None, corpus()[10][1] + " x"), *edges()]
    counts = Counter(t[p : p + 200] for _, x in rows for t in [(x or "").encode()] for p in range(len(t) - 199))

    def want(x):
        t = (x or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if counts[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        return len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(c for c, g in zip(t, gone) if not g)

    got = substrings.by_suffixes(table(spark, rows)).select("doc_id", "text", "_spans", "cut.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want(r.text), r.doc_id


def edges():
    """One passage between words of its own in each text: all contexts of its ends are distinct."""
    rng = random.Random(8)
    passage = prose(rng, 90, 5000)
    return [(300 + k, f"{prose(rng, 30, 10**6)} {passage} {prose(rng, 30, 10**6)}") for k in range(60)]


def brute_words(rows):
    first, out = {}, {}
    split = {k: SPACED.findall(x or "") for k, (_, x) in enumerate(rows)}
    for k, (i, _) in enumerate(rows):
        for p in range(len(split[k]) - 49):
            key = tuple(split[k][p : p + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for k, (i, x) in enumerate(rows):
        gone = set()
        for p in range(len(split[k]) - 49):
            if i is not None and first[tuple(split[k][p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out[i, x] = (len(split[k]), len(gone), " ".join(w for j, w in enumerate(split[k]) if j not in gone))
    return out


@pytest.mark.parametrize(("piece", "kind"), [(windows.PIECE_BYTES, "string"), (4000, "long")])
def test_parsing_against_brute_force(spark, monkeypatch, piece, kind):
    monkeypatch.setattr(windows, "PIECE_BYTES", piece)
    base = [*corpus(), *edges()]
    rows = [(i if kind == "long" else str(i), x) for i, x in base]
    # repeated rows, and rows without an id that begin like others and end differently
    rows += [rows[4], rows[4], rows[9], (None, base[4][1]), (None, base[4][1][:900] + " other"), (None, base[9][1])]
    want = brute_words(rows)
    df = table(spark, rows) if kind == "long" else table(spark, [(k, x) for k, (_, x) in enumerate(rows)]).join(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], "doc_id long, name string"), "doc_id").drop("doc_id").withColumnRenamed("name", "doc_id")
    got = substrings.by_parsing(df).select("doc_id", "text", "score", "cut.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text], r.doc_id


WORDS_OF_FEW = st.lists(st.integers(0, 2), max_size=40)


@settings(deadline=None, max_examples=300)
@given(st.lists(WORDS_OF_FEW, min_size=1, max_size=5), WORDS_OF_FEW, st.integers(1, 6))
def test_factors_are_greedy_and_boundaries_are_checked(known, words, window):
    reference = parsing.Reference()
    for x in known:
        reference.add(x)
    strings = {tuple(x[a:b]) for x in known for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    factors, hits = reference.parse(words, window)
    at = 0
    for start, length in factors:
        assert start == at and (not length or tuple(words[at : at + length]) in strings)
        assert at + length == len(words) or tuple(words[at : at + length + 1]) not in strings
        at += max(1, length)
    assert at == len(words)
    assert set(hits) == {q for q in range(len(words) - window + 1) if tuple(words[q : q + window]) in strings}


@pytest.mark.parametrize("unit", [windows.BYTES, windows.WORDS])
def test_blocks_do_not_depend_on_pieces(monkeypatch, unit):
    rng = np.random.default_rng(1)
    kind = np.uint64 if unit.words else np.uint8
    codes, offsets = rng.integers(0, 4, 9000).astype(kind), np.array([0, 150, 150, 5150, 5399, 9000])

    def of_windows():
        """(row, window) -> place of its minimiser and k-gram, from all blocks."""
        out = {}
        for row, first, n, mini, gram, _ in zip(*(x.tolist() for x in windows.blocks_of(codes, offsets, unit)), strict=True):
            for p in range(first, first + n):
                assert (row, p) not in out
                out[row, p] = (mini, gram)
        return out

    whole = of_windows()
    assert len(whole) == sum(max(0, n - unit.window + 1) for n in np.diff(offsets))
    for piece in (700, 1024, 5000):
        monkeypatch.setattr(windows, "PIECE", piece)
        assert of_windows() == whole


def shingle_bag(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in SPACED.findall(text or "")]
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    bags = [shingle_bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bags[a] and bags[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = (bags[a] & bags[b]).total()
                if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                    parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least[root(k)], i)
    return Counter((i, least[root(k)] if i is not None else None) for k, (i, _) in enumerate(rows))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    base = prose(rng, 200, 5000).split()
    rows = [*corpus(), (None, "one two three four five six")]
    for i in range(100, 180):  # near copies of all degrees: many are near each other, but not to the leader
        a = list(base)
        for _ in range(rng.randrange(0, 9)):
            a[rng.randrange(len(a))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(a).upper() if i % 2 else " ".join(a)))
    got = near_dedup.near_duplicates(table(spark, rows))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute_classes(rows)
    kept = near_dedup.deduplicated(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter(dict.fromkeys({c for i, c in brute_classes(rows) if i is not None} | {22}, 1)) + Counter([22])
    assert "score" in kept[0].asDict()


def test_repeated_rows_and_equal_words(spark):
    rows = [*corpus(), *[corpus()[4]] * 40, (400, corpus()[4][1].upper().replace(" ", " \n ")), (None, None), (None, corpus()[4][1])]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(rows)
    kept = Counter(r.doc_id for r in near_dedup.deduplicated(table(spark, rows)).collect())
    assert kept[4] == 1 and kept[5] == kept[400] == 0 and kept[None] == 2


def test_digests_tell_words_apart():
    import pyarrow as pa

    # Thue and Morse's sequence and its complement have equal sums of any code modulo 2**64
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    texts = [" ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits), " A  b\n", "a b", "ab", "a", "b", None, "", " ", "a b c", "\ta\r\n b"]
    d = near_dedup.digests(pa.array(texts))
    assert d[0] != d[1] and d[2] == d[3] == d[11] and len(set(d[3:7] + d[10:11])) == 5 and d[7] == d[8] == d[9]


def test_registers_are_unbiased():
    import pyarrow as pa

    a, b = "a b c d e f g h i j k l " * 3 + "x y z", "a b c d e f g h i j k l " * 2 + "q r s t"
    x, y = shingle_bag(a), shingle_bag(b)
    want = (x & y).total() / (x | y).total()
    row, h, c, _ = near_dedup.shingles(pa.array([a, b]))
    reg = near_dedup.signatures(row, h, c, 2, 4000)
    assert abs((reg[0] == reg[1]).mean() - want) < 0.04
    assert abs(near_dedup.overlap(tuple(z[row == 0] for z in (row, h, c)), tuple(z[row == 1] - (k == 0) for k, z in enumerate((row, h, c))), 1)[0] - want) < 1e-9


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substrings.by_suffixes(none).count() == substrings.by_parsing(none).count() == near_dedup.near_duplicates(none).count() == 0
    assert secret_scan.secrets(none).count() == decontamination.flagged(none, bench).count() == mixing.mixed(none.withColumn("source", F.lit("s"))).count() == 0
    some = table(spark, [(1, "x"), (2, None)])
    assert [r.predicted for r in toxicity.toxic(some, toxicity.learned(some, labels)).collect()] == [0, 0]
    assert [r.lang_pred for r in language.identified(some, language.fit(some.withColumn("lang", F.lit(None).cast("string")))).collect()] == ["und", "und"]
    assert {r.doc_id: r.kept for r in quality_rules.judged(some, quality_rules.fit(some, labels)).collect()} == {1: False, 2: False}
    assert [r["hits"].n_hit for r in decontamination.flagged(some, bench).collect()] == [0, 0]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("most", [decontamination.MOST_TEST_WORDS, 20])
def test_decontamination_against_brute_force(spark, most):
    rng = random.Random(2)
    items = [(k, prose(rng, n, 30)) for k, n in enumerate([12, 10, 3, 1, 0, 40, 9, 2])] + [(50, None), (51, "Only-Once, here!"), (52, prose(rng, 15, 2)), (None, "no id here " + prose(rng, 12, 9)), (5, "another text of item 5")]
    docs = [(0, None), (1, ""), (2, items[0][1].upper() + " tail"), (3, "w1 w2 " + items[2][1] + " z"), (4, prose(rng, 3000, 30)), (5, "see only once here ok"), (6, items[5][1][5:]), (7, prose(rng, 5000, 2)), (7, "x")]
    docs += [(8, "a " + items[5][1] + " b"), (8, "a " + items[5][1] + " b"), (None, items[-2][1] + " ?")]
    df = table(spark, docs).withColumn("hits", F.lit(1)).withColumn("n_words", F.lit("kept"))
    rows = decontamination.flagged(df, spark.createDataFrame(items, "item_id long, text string").withColumn("b", F.lit(0)), most_test_words=most).collect()
    assert len(rows) == len(docs) and all(r.n_words == "kept" for r in rows)
    got = {(r.doc_id, r.text): r["hits"] for r in rows}
    tests = [(None if k is None else str(k), benchmark_words(x)) for k, x in items]
    for i, t in docs:
        w, hit, found, starts = benchmark_words(t), set(), set(), set()
        for k, b in tests:
            n = min(10, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    starts.add(j)
                    found.add(k)
        own = got[i, t]
        assert (own.n_words, own.n_hit, list(own["items"])) == (len(w), len(hit), sorted(found - {None})), i
        texts = defaultdict(list)
        for k, b in tests:
            texts[k].append(b)
        for m in own.matches:
            assert any(w[m.start : m.start + m.length] == b[m.item_start : m.item_start + m.length] for b in texts[m["item"]])
        if most > 20 and len(w) < 4000:  # matches in blocks are those of each block

            def length(j):
                return max((n for _, b in tests for s in range(len(b)) for n in [next((d for d in range(len(b) - s) if j + d >= len(w) or w[j + d] != b[s + d]), len(b) - s)] if n >= min(10, len(b))), default=0)

            longest = {j: length(j) for j in starts}
            assert {(m.start, m.length) for m in own.matches} == {(j, n) for j, n in longest.items() if longest.get(j - 1, 0) != n + 1}, i


def brute_secrets(text):
    text = text or ""
    a = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), "assign", m.end()) for m in a.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted((s, ("assign", "access", "hex").index(k), e) for s, k, e in found)


def test_secrets_base(spark):
    rng = random.Random(4)
    parts = ["token", "TOKEN", "api_key", "apikey", "=", ":", ' "', "'", " ", "AKIA", "ABCDEFGHIJKLMNOP01", "0123456789abcdef", "deadbeefdeadbeef", "ſecret=abcdefgh", "abc", "secret:abcdefg", "é", "\n", "%41", "\\u0041"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(300)] + [(900, None), (901, "")]
    for r in secret_scan.secrets(table(spark, rows)).join(table(spark, rows, extra=False), "doc_id").collect():
        want = brute_secrets(r.text)
        assert [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in r.base_spans] == want, r.text
        assert {(s["start"], s["kind"], s["end"]) for s in r.base_spans} <= {(s["start"], s["kind"], s["end"]) for s in r.spans}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))


def test_secrets_in_layers():
    inner = "password = hunter2hunter2"
    url = "".join(f"%{b:02X}" for b in inner.encode())
    b64 = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    twice = base64.b64encode(url.encode()).decode()
    escapes = "".join(f"\\u{ord(c):04x}" for c in inner)
    for held in (url, b64, packed, twice, escapes, base64.b64encode(packed.encode()).decode(), base64.urlsafe_b64encode(gzip.compress(b64.encode())).decode()):
        text = f"before {held} after"
        base, every, layers = secret_scan.scan(text)
        assert layers > 1 and not base
        assert [(s, text[s:e].strip("=")) for s, e, k in every if k == 0] == [(7, held.strip("="))] or (7, 7 + len(held), 0) in every, held
    partly = "token = abc%64efgh end"
    assert (0, 19, 0) in secret_scan.scan(partly)[1] or any(s == 0 and e >= 17 for s, e, _ in secret_scan.scan(partly)[1])
    assert secret_scan.scan("%25%32%35" * 50)[2] >= 2  # ends


def test_secrets_in_glued_and_broken_base64():
    hidden = lambda text, start, end: any(k == 0 and start <= s < e <= end for s, e, k in secret_scan.scan(text)[1])
    safe = "eyJub3RlIjoiaXMgaXQgb2s_PyIsInBhc3N3b3JkIjoiaHVudGVyMmh1bnRlcjIifQ=="
    assert (5, 5 + len(safe), 0) in secret_scan.scan(f"see  {safe} .")[1]
    inner = b"some notes first, then password = hunter2hunter2 and more notes after it, longer than a line"
    plain, packed = base64.b64encode(inner).decode(), base64.b64encode(gzip.compress(inner)).decode()
    for held in (plain, packed):
        for glue in ("y/p/", "abc/", "x", "xy", "xyz", "word-", "a_b_", "q/w-e_r/"):
            text = f"https://x.{glue}{held} end"
            assert hidden(text, 10, len(text) - 4), text
            assert hidden(f"{held.rstrip('=')}-tail end", 0, len(held) + 5), held
        for eol in ("\n", "\r\n", "\n    "):
            lines = eol.join(re.findall(".{1,76}", held))
            assert hidden(f"before: {lines} after", 8, 8 + len(lines)) and hidden(f"word{eol}{lines}{eol}word", 4, 8 + len(lines) + 2 * len(eol)), lines
            short = eol.join(re.findall(".{1,12}", held))
            assert hidden(f"before: {short}", 8, 8 + len(short)), short
    two = "\n".join(base64.b64encode(x + b" password = hunter2hunter2").decode().rstrip("=") for x in (b"ab", b"abc"))
    assert {k == 0 and s > two.index("\n") for s, e, k in secret_scan.scan(two)[1]} == {True, False}
    lone = "\n".join("word" * (k % 7 + 1) for k in range(3000))
    assert secret_scan.scan(lone)[:2] == ([], [])


def test_secrets_in_layers_that_are_not_all_text():
    inner = "password = hunter2hunter2"
    for mixed in ("\ufeff" + inner, "a\0" + inner, inner + "\u00a0x", "\u200b" + inner + "\f", "note: " + "\0" * 90 + inner):
        for data in (mixed.encode(), gzip.compress(mixed.encode())):
            held = base64.b64encode(data).decode()
            assert any(k == 0 and 7 <= s < e <= 7 + len(held) for s, e, k in secret_scan.scan(f"before {held} after")[1]), mixed
    latin = f"caf\u00e9 {inner} \u00e9t\u00e9".encode("latin-1")
    for held in map(base64.b64encode, (latin, gzip.compress(latin), gzip.compress(gzip.compress(bytes(range(256)) + latin)))):
        assert any(k == 0 and 7 <= s < e <= 7 + len(held) for s, e, k in secret_scan.scan(f"before {held.decode()} after")[1])
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress):  # streams one after another, each with a secret
        lines = [base64.b64encode(pack(f"{inner} {'x' * k}".encode())).decode().rstrip("=") for k in range(6)]
        found, at = secret_scan.scan("\n".join(lines))[1], 0
        for x in lines:
            assert any(k == 0 and s <= at + 4 and at < e <= at + len(x) + 4 for s, e, k in found), (pack, lines, found)
            at += len(x) + 1
    url = "%E9" + "".join(f"%{b:02X}" for b in inner.encode()) + "%C3"
    assert (3, len(url) - 3, 0) in secret_scan.scan(url)[1]
    accent = "".join(f"%{b:02X}" for b in "é".encode())
    assert (len(accent) + 3, len(accent) + 3 + 3 * len(inner), 0) in secret_scan.scan(accent + url)[1]


def test_secrets_in_raw_cut_joined_and_huge_data():
    inner = b"some notes, then password = hunter2hunter2 and more"
    found = lambda text, most=16 << 20: [x for x in secret_scan.scan(text, most)[1] if x[2] == 0]
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = deflate.compress(inner * 3) + deflate.flush()
    cut = gzip.compress(bytes(range(97, 123)) * 9 + inner + random.Random(1).randbytes(400))[:-200]
    packs = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress]
    for data in (raw, cut, *(pack(b"nothing here") + pack(inner) for pack in packs)):
        held = base64.b64encode(data).decode()
        assert found(f"before {held} after") and all(6 <= s and e <= 8 + len(held) for s, e, _ in found(f"before {held} after")), data[:4]
    again = inner
    for k in range(90):  # packed more often than anybody would
        again = (packs[k % 2])(again)
    assert found("x " + base64.b64encode(again).decode())
    huge = b"0 " * 40000 + inner + b"1 " * 300000
    for pack in packs:
        for data in (pack(huge), pack(pack(huge)), pack(b"2 " * 9000) + pack(huge)):
            for most in (70000, 1 << 21):
                held = base64.b64encode(data).decode()
                assert found(f"before {held} after", most), (pack, len(data), most)
    loop = base64.b64encode(zlib.compress(b"")).decode()
    assert secret_scan.scan(loop * 3)[1] == []


def test_secrets_of_planted_layers_are_found():
    """Recall on secrets below one to three random layers, glued to words and broken into lines or not."""
    rng = random.Random(12)
    url = lambda b: "".join(f"%{c:02X}" for c in b)
    escapes = lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode("latin-1"))
    plain = lambda b: base64.b64encode(b).decode()
    safe = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    packed = lambda b: base64.b64encode(rng.choice([gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])(b)).decode()
    wrapped = lambda b: "\n".join(re.findall(".{1,76}", packed(b)))
    got = 0
    for _ in range(400):
        text = f"note {rng.randrange(10**6)}: api_key = {rng.getrandbits(80):x} " + prose(rng, rng.randrange(30))
        for k in range(rng.randrange(1, 4)):
            text = rng.choice([url, escapes, plain, safe, packed, wrapped])(text.encode())
        before = prose(rng, 3) + rng.choice([" ", ": ", "/", '="'])
        full = before + text + rng.choice([" ", '"', "\n", "."]) + prose(rng, 3)
        got += any(k == 0 and len(before) - 8 <= s < e <= len(before) + len(text) + 8 for s, e, k in secret_scan.scan(full)[1])
    assert got >= 396, got


def test_secrets_repeated_rows_and_long_texts(spark):
    long = "word " * 400000 + "token = abcdefgh " + "x" * 100000
    rows = [(1, long), (1, long), (None, "secret: abcdefgh"), (2, "é" * 50 + " password=hunter2x")]
    got = secret_scan.secrets(table(spark, rows)).collect()
    assert Counter((r.doc_id, tuple((s["start"], s["end"]) for s in r.spans)) for r in got) == Counter({(1, ((2000000, 2000016),)): 2, (None, ((0, 16),)): 1, (2, ((51, 68),)): 1})


def test_redaction(spark):
    rows = [(1, "a token = abcdefgh b " + "0" * 30 + " c"), (2, None), (3, "clean")]
    assert {r.doc_id: r.text for r in secret_scan.redacted(table(spark, rows)).collect()} == {1: "a [SECRET] b [SECRET] c", 2: None, 3: "clean"}


def brute_quality(text):
    """The counts and features of one text."""
    t = text or ""
    w = SPACED.findall(t)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    r = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}
    chars, words = r["word_chars"] or 1, len(w) or 1
    upper = sum(unicodedata.category(x) == "Lu" for x in t)
    r |= {"symbol_ratio": r["n_symbols"] / chars, "upper_ratio": upper / chars, "exclaim_ratio": t.count("!") / chars, "digit_ratio": len(re.findall("[0-9]", t)) / chars, "pipe_ratio": t.count("|") / words}
    return r | {"dup_line_ratio": r["n_dup_lines"] / (t.count("\n") + 1), "repeat_ratio": len(again) / words, "mean_word": r["word_chars"] / words, "unique_ratio": len(set(w)) / words, "stop_ratio": sum(len(x) <= 3 for x in w) / words}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_statistics(spark):
    rng = random.Random(9)
    rows = corpus() + [(200 + k, "\n".join(prose(rng, rng.randrange(0, 12), 4) + rng.choice(["", " ###", "|", " !É1"]) for _ in range(rng.randrange(1, 8)))) for k in range(40)]
    rows += [(4, corpus()[4][1]), (None, "a b " * 30)]
    want = Counter()
    for i, t in rows:
        r = brute_quality(t)
        want[i, *(r[c] for c in COUNTS), r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]] += 1
    got = quality_rules.judged(table(spark, rows).withColumn("_w", F.lit(1)).withColumn("rule", F.lit(2)), []).collect()
    assert Counter((r.doc_id, *(r[c] for c in COUNTS), r.base_failed) for r in got) == want and all(r.kept != r.base_failed for r in got)


def test_quality_verdicts_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs.where("doc_id % 2 = 0"), labels)
    assert rules
    label = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    dropped = []
    for r in quality_rules.judged(docs, rules).collect():
        f = brute_quality(texts[r.doc_id])
        near = any(abs(f[t.feature] - t.cut) < 1e-9 for rule in rules for t in rule.tests)
        rule = next((k for k, x in enumerate(rules) if all((f[t.feature] > t.cut) == t.above for t in x.tests)), None)
        failed = f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]
        assert near or (r.rule, r.kept) == (rule, not failed and rule is None), r.doc_id
        if r.doc_id % 2 and not failed and rule is not None and label.get(r.doc_id) is not None:
            dropped.append(label[r.doc_id])
    assert dropped.count(0) >= 0.8 * len(dropped)  # on rows that were not learned from


def test_decision_list_finds_a_conjunction():
    rng = random.Random(1)
    rows = []
    for _ in range(900):
        r = {f: rng.random() for f in quality_rules.FEATURES}
        rows.append(r | {"bad": int(r["symbol_ratio"] > 0.7 and r["mean_word"] <= 0.5)})
    rules = quality_rules.cover(rows)
    assert {t.feature for t in rules[0].tests} == {"symbol_ratio", "mean_word"} and rules[0].precision >= 0.97


def test_mixture_follows_rates(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4000)] + [(9001, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, {"big": 1.0, "small": 1.0, None: 0.0}, size=4000).collect()
    n = Counter(r.source for r in got)
    assert abs(n["big"] - 2000) < 180 and abs(n["small"] - 2000) < 180 and None not in n
    by = Counter(r.doc_id for r in got)
    for i, _, s in rows[:200]:
        u = (int(hashlib.md5(f"17:0:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert by[i] == mixing.poisson(u, {"big": 2000 / 3600, "small": 5.0}[s])
    big = mixing.mixed(docs.where("source = 'small'").limit(3), size=6000.0).collect()
    assert abs(len(big) - 6000) < 400


def test_mixing_keeps_clashing_columns(spark):
    rows = [(k, f"t{k}", "s", "mine", 1.5, "key", "u") for k in range(50)] + [(None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no string, Shuffle_Key double, key string, `of.x` string")
    got = mixing.mixed(docs, size=200.0)
    assert got.columns == [*docs.columns, "copy_no_", "n_copies", "shuffle_key_"]
    out = got.collect()
    assert all(r["copy_no"] == "mine" and r["Shuffle_Key"] == 1.5 and r["of.x"] == "u" for r in out if r.doc_id is not None)
    n = Counter(r.doc_id for r in out)
    assert all(n[r.doc_id] == r.n_copies * (2 if r.doc_id is None else 1) for r in out) and mixing.mixed(docs.limit(0)).count() == 0


def test_languages_and_toxicity_learn(spark):
    rng = random.Random(6)
    en, de = ["the", "and", "thing", "other", "with", "house"], ["der", "und", "ung", "schön", "nicht", "haus"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(40)) + (" vilegunk words" if i % 5 == 0 else ""), "en" if i % 2 else "de") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "THE v1legunk", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identified(docs, language.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred) == ("und", "und", "en")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    tox = {r.doc_id: r for r in toxicity.toxic(docs, toxicity.learned(docs, labels)).collect()}
    assert all(tox[i].predicted == int(i % 5 == 0) for i, _, _ in rows)
    assert tox[902].predicted == 1 and tox[900].predicted == 0  # a digit in place of a letter


def brute_score(text, model):
    """Every word held against every term, without an automaton."""
    w = [x for x in re.split(r"[^\w]|[\d_]", toxicity.folded(text or "")) if x]
    total, hits = 0.0, 0
    for i, x in enumerate(w):
        stem = next((s for s in sorted(model.stems, key=len) if x.startswith(s)), None)
        weight = model.stems[stem] if stem else model.words.get(x)
        around = {(x,), (w[i - 1] if i else "", x), (x, w[i + 1] if i + 1 < len(w) else "")}
        if weight is not None and not around & model.exceptions:
            total, hits = total + weight, hits + 1
    a, b, c = model.factors
    z = a + b * np.log1p(max(0.0, total)) + c * np.log1p(max(0.0, 100 * total / len(w) if w else 0.0))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), hits


def test_toxicity_learns_terms_stems_and_exceptions(spark):
    rng = random.Random(3)
    letters = lambda n: prose(rng, n).translate(str.maketrans("0123456789", "abcdefghij"))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = letters(30).split()
        at = rng.randrange(len(words))
        if toxic:
            words[at:at] = [rng.choice(["vile", "smargle", "smargly", "smarglish", "shoot"])]
        elif i % 6 == 1:
            words[at:at] = rng.choice([["photo", "shoot"], ["smarglefield"], []])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    copied = "this very text has oddword and is copied again and again " + letters(20)
    rows += [(1000 + i, copied + f" number{'abcdefghij'[i % 10]}") for i in range(30)]
    labels += [(1000 + i, 1) for i in range(30)]
    docs = table(spark, rows)
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "vile" in model.words and "shoot" in model.words and any("smarglish".startswith(x) for x in model.stems)
    assert ("photo", "shoot") in model.exceptions and ("smarglefield",) in model.exceptions
    assert "oddword" not in model.words  # one text, however often
    more = [(5000, "V1LE"), (5001, "a photo shoot here"), (5002, "we sh00t"), (5003, "smarglefield smargling"), (5004, None), (5005, ""), (5006, "?! 12"), (5007, "vile " * 30000), (5007, "vile " * 30000)]
    got = toxicity.toxic(table(spark, rows[:200] + more), model).collect()
    texts = {i: t for i, t in rows + more}
    assert len(got) == 209
    for r in got:
        score, hits = brute_score(texts[r.doc_id], model)
        assert abs(r.score - score) < 1e-9 and r.n_hits == hits and r.predicted == int(score >= 0.7), (r.doc_id, texts[r.doc_id][:80])
    by = {r.doc_id: r.n_hits for r in got}
    assert [by[k] for k in range(5000, 5008)] == [1, 0, 1, 1, 0, 0, 0, 30000]


def test_toxicity_and_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    from kinsift.llm import queries

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.85 and sum(n >= 0.7 for n in neg) <= 0.02 * len(neg) and sum(p >= 0.7 for p in pos) >= 0.7 * len(pos)  # 30 toxic texts to learn from
    langs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang", "text")
    rows = queries.op6_language(spark, sf).where("held_out AND lang_pred <> 'und'").join(langs, "doc_id").where("length(text) > 100").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def brute_mixture(likelihoods, rounds=12):
    """The same inference for one text, word by word."""
    k = len(likelihoods[0])
    like = [[2.0 ** max(-40.0, x - max(ws)) + 1e-9 for x in ws] for ws in likelihoods]
    n = len(like)

    def step(pi):
        out = [0.0] * k
        for ws in like:
            z = [p * x for p, x in zip(pi, ws)]
            out = [o + x / sum(z) / n for o, x in zip(out, z)]
        return out

    value = lambda pi: sum(np.log(sum(p * x for p, x in zip(pi, ws)) + 1e-300) for ws in like) - 0.5 * np.log(n + 1) * (sum(p > 0 for p in pi) - 1)
    pi = [1 / k] * k
    for _ in range(rounds):
        pi = step(pi)
    best = value(pi)
    for _ in range(k - 1):
        if sum(p > 0 for p in pi) < 2:
            break
        least = min((p, j) for j, p in enumerate(pi) if p > 0)[1]
        trial = [0.0 if j == least else p for j, p in enumerate(pi)]
        trial = [p / sum(trial) for p in trial]
        for _ in range(2):
            trial = [t if p > 0 else 0.0 for p, t in zip(trial, step(trial))]
            trial = [p / sum(trial) for p in trial]
        if value(trial) < best:
            break
        pi, best = trial, value(trial)
    return pi


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(4)
    logl = rng.normal(0, 3, (40, 3))
    rows = [list(rng.integers(0, 40, n)) for n in (1, 7, 30, 200)]
    pairs = [(r, w, c) for r, ws in enumerate(rows) for w, c in Counter(ws).items()]
    row, of, times = (np.array(x) for x in zip(*pairs))
    pi, _ = language.mixtures(logl[of], row, times, len(rows))
    for r, ws in enumerate(rows):
        assert np.allclose(pi[r], brute_mixture([logl[w].tolist() for w in ws]), atol=1e-9)


def test_languages_of_mixed_repeated_and_long_texts(spark):
    rng = random.Random(6)
    own = {"en": ["the", "and", "thing", "other", "with", "house"], "de": ["der", "und", "ung", "schön", "nicht", "haus"], "fr": ["les", "été", "avec", "maison", "nous"]}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(x, 30), x) for i in range(60) for x in own], "doc_id long, text string, lang string")
    model = language.fit(docs, fit_rows=40)
    both = say("en", 60) + " " + say("de", 40)
    rows = [(1, both), (1, both), (2, say("fr", 60000)), (3, say("de", 1).upper()), (None, say("en", 20)), (4, None), (5, "123")]
    got = language.identified(table(spark, rows), model).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and {x["lang"] for x in by[1][0].langs} == {"en", "de"} and abs(by[1][0].score - 0.6) < 0.05
    assert [by[k][0].lang_pred for k in (2, 3, 4, 5, None)] == ["fr", "de", "und", "und", "en"] and by[None][0].held_out
