"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwork.llm import ann_blocks, hd_language, html_cut, jaccard_join, merkle, pfair_mix, pii, piece_codec, queries, token_binary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a null id, one long text, clashing extra columns."""
    texts = [None, "", " \t\n", "one two", "one two", "a b c d e f g", "A b c D e f g", "word " * 30000, "é ü 漢字 😀 x", "x" * 5000]
    rows = [(i, t, "en", None if i == 3 else "s", 7, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one two", None, "s", 0, 1, 2)]
    return spark.createDataFrame(rows, DOCS + ", doc long, n long")


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_brute_force(spark, sf):
    docs = documents(spark, sf)
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == want


@pytest.mark.parametrize("crowd, light", [(2, 1), (48, 1)])
def test_jaccard_crowded_places(spark, monkeypatch, crowd, light):
    """One passage in all texts, chains and groups of near copies: every place is crowded, heavy or both."""
    r = __import__("random").Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, shared = [], r.choices(words, k=40)
    for g in range(12):
        base = r.choices(words, k=60)
        for v in range(9):
            text = list(base)
            for _ in range(v % 4):
                text[r.randrange(60)] = r.choice(words)
            rows.append((len(rows), " ".join(shared + text)))
    chain = r.choices(words, k=100)
    for _ in range(25):
        chain = chain[3:] + r.choices(words, k=3)
        rows.append((len(rows), " ".join(chain)))
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) < len(rows)


def test_jaccard_odd(spark):
    rows = jaccard_join.jaccard_classes(odd(spark)).collect()
    assert len(rows) == 12
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[4] == (1, 3) and got[6] == (3, 5) and got[7] == (1, 7)
    assert jaccard_join.jaccard_classes(odd(spark).filter("false")).collect() == []


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m[0])]
    return out


PRIVATE = ["mail a.b@c.de, x@y@z.org and 10.0.0.300 or 10.1.2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +49 (30) 123-4567 or +1", "😀 me@x-y.co.uk", None, "",
           "a@b c@d.e.f@g.h 1.2.3.4.5.6.7.8", "00000000000000000000000000", "+123 456 7890+44 20 7946 0000"]


def test_pii_brute_force(spark, sf):
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    docs = documents(spark, sf).select("doc_id", "text").union(extra)
    texts = dict(docs.collect())
    for r in pii.pii_report(docs).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r.doc_id, want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in pii.KINDS)
        assert set(want) <= set(r.spans.split(",")) | {""}


def planted_texts(n=1500, seed=77):
    """Texts with spans that the base patterns miss, and look-alikes; words, surroundings and numbers are not the training set's."""
    r = __import__("random").Random(seed)
    fill = "Yesterday our small team walked along a quiet canal while two friends discussed plans about music gardens and old trains".split()
    some = lambda k: " ".join(r.choices(fill, k=k))
    n4 = lambda: f"{r.randrange(10**4):04}"
    three = lambda: str(r.randrange(200, 999))
    name, host = lambda: r.choice(["maria.lopez", "j.smith", "peter_k", "anna88", "t.o.brien", "k-lee", "sam.w21"]), lambda: r.choice(["acme", "bigbank", "mail-hub", "uni-ulm", "shop24"])

    def card():
        body = r.choice("345") + "".join(r.choices("0123456789", k=14))
        return body + next(c for c in "0123456789" if luhn(body + c))

    def good():
        a, b, c, d = three(), three(), n4(), card()
        hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
        return r.choice([
            ("email", lambda: f"{name()} [at] {host()} [dot] {r.choice(['com', 'org', 'de'])}", ""), ("email", lambda: f"{name()}(at){host()}(dot)net", ""),
            ("email", lambda: f"{name()} at {host()} dot com", "please write to "), ("email", lambda: f"{name()} @ {host()}.org", ""), ("email", lambda: f"{name()} (at) {host()}.de", "my mail is "),
            ("phone", lambda: f"({a}) {b}-{c}", ""), ("phone", lambda: f"{a}-{b}-{c}", ""), ("phone", lambda: f"{a}.{b}.{c}", "please call "), ("phone", lambda: f"{a} {b} {c}", "phone "),
            ("phone", lambda: f"{a}-{b}-{c}", "tel: "), ("phone", lambda: f"0{three()[:2]} {n4()} {n4()}", "dial "), ("phone", lambda: f"{a}{b}{c}", "my mobile "),
            ("card", lambda: ".".join(d[i : i + 4] for i in (0, 4, 8, 12)), ""), ("card", lambda: "_".join(d[i : i + 4] for i in (0, 4, 8, 12)), "visa card "), ("card", lambda: "/".join(d[i : i + 4] for i in (0, 4, 8, 12)), ""),
            ("ip", lambda: ":".join(hexes(4) for _ in range(8)), ""), ("ip", lambda: f"2001:db8::{hexes(3)}:{hexes(2)}", "our server "), ("ip", lambda: f"{r.randrange(1, 255)}[.]{r.randrange(255)}[.]{r.randrange(255)}[.]{r.randrange(255)}", ""),
            ("secret", lambda: hexes(40), 'token = "'), ("secret", lambda: hexes(32), "api_key: "), ("secret", lambda: "ghp_" + "".join(r.choices("abcdEFGH0123456789", k=36)), ""), ("secret", lambda: "AKIA" + "".join(r.choices("ABCDEFGH234567", k=16)), "secret "),
        ])

    def bad():
        a, b, c = three(), three(), n4()
        wrong = next(x for x in iter(lambda: "5" + "".join(r.choices("0123456789", k=15)), None) if not luhn(x))
        hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
        return r.choice([
            lambda: f"order no. {a}-{b}-{c}", lambda: f"invoice {a}.{b}.{c}", lambda: f"serial no. {a} {b} {c}", lambda: f"on {r.randrange(1950, 2030)}-0{r.randrange(1, 9)}-{r.randrange(10, 28)}", lambda: f"from {r.randrange(1, 28)}.{r.randrange(1, 12)}.{r.randrange(1950, 2020)}",
            lambda: f"in {r.randrange(1950, 2000)}-{r.randrange(2000, 2020)}", lambda: f"part no. {a}{b}{c}", lambda: f"about {a} {b} people", lambda: ".".join(wrong[i : i + 4] for i in (0, 4, 8, 12)), lambda: "/".join(wrong[i : i + 4] for i in (0, 4, 8, 12)),
            lambda: f"at {r.randrange(10, 24)}:{r.randrange(10, 60)}:{r.randrange(10, 60)}", lambda: "mac " + ":".join(hexes(2) for _ in range(6)), lambda: f"version {r.randrange(9)}[.]{r.randrange(9)}[.]{r.randrange(9)}[.]{r.randrange(9)}", lambda: f"commit {hexes(40)}", lambda: f"md5 {hexes(32)}",
            lambda: "they looked at canal.old trains", lambda: "meet (at) garden (dot) later", lambda: f"page-about-old-trains-{r.randrange(1950, 2020)}", lambda: f"paid 5 @ {r.randrange(10, 90)} each", lambda: f"score {r.randrange(10, 99)}-{r.randrange(10, 99)}",
        ])

    out = []
    for i in range(n):
        text, spans = some(4), []
        for _ in range(2):
            if r.random() < 0.5:
                kind, make, before = good()
                text += " " + before
                item = make()
                spans.append(f"{kind}:{len(text)}:{len(text) + len(item)}")
                text += item + ('"' if before.endswith('"') else "")
            else:
                text += " " + bad()()
            text += r.choice([" ", ". ", ", "]) + some(4)
        out.append((i, text, spans))
    return out


def test_pii_added_spans(spark):
    """Exact added spans on texts that the trees have not seen: precision and recall of at least 0.9 each."""
    texts = planted_texts()
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.pii_report(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    found, want, right = {}, {}, {}
    for i, text, spans in texts:
        added = got[i] - set(base_spans(text))
        for kind in pii.ALL_KINDS:
            own = {s for s in spans if s.startswith(kind)}
            mine = {s for s in added if s.startswith(kind)}
            found[kind] = found.get(kind, 0) + len(mine)
            want[kind] = want.get(kind, 0) + len(own)
            right[kind] = right.get(kind, 0) + len(own & mine)
    print({k: (round(right[k] / max(1, found[k]), 3), round(right[k] / want[k], 3)) for k in pii.ALL_KINDS})
    assert sum(right.values()) >= 0.9 * sum(found.values()) and sum(right.values()) >= 0.9 * sum(want.values())
    assert all(right[k] >= 0.8 * found[k] and right[k] >= 0.8 * want[k] for k in pii.ALL_KINDS)


def test_tokens_brute_force(spark, sf):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tok, start = Tokenizer.from_file(path), 0
    docs = documents(spark, sf)
    got = {r.doc_id: r for r in token_binary.token_report(docs, path, 2).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_token_shards_random_access(spark, sf, tmp_path):
    """Single documents, in any order, without decompressing others; damage is noticed in the damaged frame only."""
    docs = documents(spark, sf).select("doc_id", "text")
    manifest = token_binary.write_token_shards(docs, queries.vocabulary("word_bpe_49k.json"), 2, f"{tmp_path}/shards").orderBy("part").collect()
    whole = {r.doc_id: r.ids for r in token_binary.read_token_shards(spark.createDataFrame(manifest)).collect()}
    assert len(whole) == docs.count() and sum(m.n_docs for m in manifest) == len(whole)
    path = manifest[0].path
    shard = token_binary.ShardReader(path)
    for k in (len(shard) - 1, 0, len(shard) // 2):
        assert shard.ids(k) == bytes(whole[shard.doc_ids[k]])
    raw = bytearray(open(path, "rb").read())
    raw[shard.begins[1] + int(shard.table[1, 0]) // 2] ^= 255
    open(f"{tmp_path}/bad", "wb").write(raw)
    bad = token_binary.ShardReader(f"{tmp_path}/bad")
    assert bad.ids(0) == shard.ids(0) and bad.ids(2) == shard.ids(2)
    with pytest.raises(Exception):
        bad.ids(1)
    open(f"{tmp_path}/short", "wb").write(raw[:-3])
    with pytest.raises(ValueError):
        token_binary.ShardReader(f"{tmp_path}/short")
    assert token_binary.write_token_shards(docs.filter("false"), queries.vocabulary("word_bpe_49k.json")).collect() == []


def message(*fields):
    """A protobuf message of (number, value): bytes, text, float or int."""
    import struct

    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("kind, own", [(1, False), (1, True), (2, True), (2, False)])
def test_pieces_of_a_small_model(spark, tmp_path, kind, own):
    """A unigram and a BPE model written by hand, with byte fallback and pieces of the user's own, against the sentencepiece library."""
    import sentencepiece

    words = ["\u2581", "a", "b", "c", "d", "ab", "abc", "\u2581a", "\u2581ab", "bc", "cd", "\u2581d", "dd", "\u2581b"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)] + ([("XY", 0.0, 4)] if own else [])
    pieces += [(w, -1.0 - i / 7 if kind == 1 else -float(i), 1) for i, w in enumerate(words)]
    model = message(*((1, message((1, p), (2, s), (3, k))) for p, s, k in pieces), (2, message((3, kind), (35, 1))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    path = f"{tmp_path}/small.model"
    open(path, "wb").write(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = __import__("random").Random(2)
    texts = ["", None, "abc d", "aXYb", "é", "  two  spaces ", "ab cd XY XYX"] + ["".join(r.choice("abcd  XYé") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    rows = piece_codec.decode(piece_codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path), path).collect()
    for row in rows:
        if row.text is None:
            assert row.ids is None and row.decoded is None
        else:
            assert list(row.ids) == sp.encode(row.text) and row.decoded == sp.decode(list(row.ids)), row.text
    report = piece_codec.codec_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert own or sum(x.n_fallen or 0 for x in report) <= 3  # equal sums of scores, rounded another way


def test_pieces_decode(spark, sf):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark, sf).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "\u2581x  y \n😀")], "doc_id long, text string"))
    rows = piece_codec.decode(piece_codec.encode(docs, path), path).collect()
    assert all(r.decoded == (None if r.text is None else r.text.replace("\u2581", " ")) == (None if r.text is None else sp.decode(list(r.ids))) for r in rows)
    bad = piece_codec.decode(spark.createDataFrame([([3 + 0xC3],)], "ids array<int>"), path).collect()
    assert bad[0].decoded == "\ufffd"


def test_pieces_parity(spark, sf):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = piece_codec.encode(documents(spark, sf).select("doc_id", "text"), path).collect()
    assert rows and all(list(r.ids) == sp.encode(r.text or "") for r in rows)


def test_nearest_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all() and np.any(r.embedding)]
    got = {}
    for r in ann_blocks.search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, v in rows:
        if q % 20 == 0:
            want = sorted((-float(v @ w), i) for i, w in rows if i != q)[:20]
            found = sorted(got[q])
            assert [x[0] for x in found] == list(range(1, len(want) + 1))
            assert np.allclose([x[2] for x in found], [-s for s, _ in want], rtol=0, atol=1e-12)
            assert [x[1] for x in found] == [i for _, i in want]


def brute_nearest(rows, k=20):
    """query (id, vector) -> ids and scores; sums in component order, as exact fractions where they overflow."""
    from fractions import Fraction

    def score(v, w):
        total = 0.0
        for x, y in zip(v, w):
            total += x * y
        if not np.isfinite(total):
            exact = sum(Fraction(x) * Fraction(y) for x, y in zip(v, w))
            try:
                total = float(exact)
            except OverflowError:
                total = float("inf") if exact > 0 else float("-inf")
        return total

    out = {}
    for q, v in rows:
        if q % 20 == 0:
            out[q, tuple(v)] = sorted((-score(v, w), i) for i, w in rows if i != q and len(w) == len(v))[:k]
    return out


@pytest.mark.parametrize("case", ["plain", "huge", "tiny", "both", "ties", "repeats", "lengths"])
def test_nearest_odd(spark, case):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6))
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)]
    if case == "huge":
        rows = [(i, [c * 1e160 for c in x]) for i, x in rows]
    if case == "tiny":
        rows = [(i, [c * 1e-322 for c in x]) for i, x in rows]
    if case == "both":
        rows = [(i, [c * 10.0 ** (300 - 37 * (i % 17)) for c in x]) for i, x in rows]
    if case == "ties":
        rows = [(i, [float(round(c)) or 1.0 for c in x]) for i, x in rows] + [(100 + i, [1.0] * 6) for i in range(70)]
    if case == "repeats":
        rows += rows[:5] * 9 + [(20, [0.5] * 6), (40, rows[3][1]), (40, rows[3][1])]
    if case == "lengths":
        rows = [(i, x[: 3 + i % 3]) for i, x in rows]
    bad = [(200, None), (220, [0.0] * 6), (None, [1.0] * 6), (240, [float("nan")] + [1.0] * 5), (260, [float("inf")] * 6), (280, []), (300, [None] + [1.0] * 5)]
    table = spark.createDataFrame([(i, x, "z") for i, x in rows + bad], "vec_id long, embedding array<double>, h string")
    sound = [(i, x) for i, x in rows if any(x)]
    for block in (8192, 16):
        usable = ann_blocks.usable(table)
        got = {}
        for r in ann_blocks.nearest(usable.filter("id % 20 = 0"), usable, 20, block, 2).collect():
            got.setdefault((r.query_id, r.query_hash), []).append((r.rank, -r.score, r.vec_id))
        found = sorted((q, [(s, i) for _, s, i in sorted(x)]) for (q, _), x in got.items())
        assert found == sorted((q, w) for (q, _), w in brute_nearest(sound).items())
    assert ann_blocks.search(table.filter("false")).collect() == []


def test_language_held_out(spark, sf):
    rows = hd_language.language_report(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tried = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in tried) >= 0.9 * len(tried)
    assert all(0 <= r.score <= 1 for r in rows)


def brute_likeness(a, b, sections_of):
    """Likeness of two texts from plain Python sets, given each text's sections as lists of paragraph texts."""
    if a == b:
        return 1.0
    mine, theirs = sections_of[a], sections_of[b]
    n, k = [0, 0], [set(), set()]
    for i, (own, other) in enumerate(((mine, theirs), (theirs, mine))):
        for s in own:
            cut = [y for p in s for y in pieces_of(p)]
            if s in other:
                n[i] += len(cut)
            else:
                k[i] |= set(cut)
    total = sum(n) + len(k[0]) + len(k[1])
    return min((sum(n) + 2 * len(k[0] & k[1])) / total, 1 - 1 / (1 + total)) if total else 0.0


def pieces_of(paragraph):
    """Sentences, cut after 32 code points since the last cut."""
    out, at = [], 0
    for i in range(1, len(paragraph) + 1):
        ends = i == len(paragraph) or paragraph[i - 1] in ".!?\n。" and paragraph[i] not in ".!?\n。" or i - at == merkle.LONGEST
        if ends:
            out.append(paragraph[at:i])
            at = i
    return out


def sections_in(fingerprint, text):
    """The text's sections by a fingerprint's lengths; checks every digest on the way."""
    root, *sections = fingerprint.split(";")
    out, at, digests = [], 0, []
    for s in sections:
        h, *paragraphs = s.split(",")
        texts, below = [], []
        for p in paragraphs:
            digest, n, k = p.split(".")
            part = text[at : at + int(n, 16)]
            at += len(part)
            below.append(hashlib.sha256(part.encode()).hexdigest())
            assert below[-1].startswith(digest) and len(k) == 8 * len(pieces_of(part)), part
            texts.append(part)
        digests.append(hashlib.sha256("".join(below).encode()).hexdigest())
        assert digests[-1].startswith(h)
        out.append(texts)
    assert at == len(text) and hashlib.sha256("".join(digests).encode()).hexdigest() == root
    assert [p for s in out for p in s] == re.findall(r"[^\n]*\n+|[^\n]+", text)
    return out


def test_merkle(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text").filter("doc_id % 3 = 0")
    more = [None, "", "one\n\ntwo\n" * 40, "same\n" * 100 + "end", "no line end. but two sentences", "\n\n\n", "x" * 400]
    docs = docs.union(spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in merkle.fingerprint_report(docs).collect()}
    assert len(got) == len(rows)
    sections = {r.text or "": sections_in(got[r.doc_id].fingerprint, r.text or "") for r in rows}
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        text, cut = r.text or "", len(r.text or "") // 4
        edited = text[: len(text) - cut] + (after.text or "")[:cut]
        out = got[r.doc_id]
        assert out.n_chars == len(text) and out.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        mine = sections | {edited: sections_in(out.edited_fingerprint, edited)}
        assert out.near_edited == pytest.approx(brute_likeness(text, edited, mine)), text
        assert out.near_next == pytest.approx(brute_likeness(text, after.text or "", mine)), text
        if text == edited:
            assert out.edit_begin is None
        else:
            a, b = out.edit_begin, out.edit_end
            tail = len(text) - b
            assert text[:a] == edited[:a] and text[b:] == edited[len(edited) - tail :] and a <= len(text) - cut


def test_merkle_locates_edits(spark):
    base = [f"paragraph {i} says {i * i}." for i in range(300)]
    cases = {"insert": base[:100] + ["new one"] + base[100:], "delete": base[:50] + base[53:], "reorder": base[:20] + base[40:60] + base[20:40] + base[60:], "change": base[:299] + ["last"], "none": base, "all": []}
    join = lambda x: "".join(f"{p}\n" for p in x)
    df = spark.createDataFrame([(n, join(base), join(x)) for n, x in cases.items()], "name string, a string, b string")
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    kept = df.select("*", a.alias("ta"), b.alias("tb"), merkle.fingerprint(a).alias("fa"), merkle.fingerprint(b).alias("fb"))
    stored = kept.select("*", merkle.parsed(F.col("fa")).alias("pa"), merkle.parsed(F.col("fb")).alias("pb"))
    for r in stored.select("name", "a", "b", merkle.differing(F.col("ta"), F.col("tb")).alias("d"), merkle.differing(F.col("pa"), F.col("pb")).alias("e"), merkle.likeness(F.col("ta"), F.col("tb")).alias("l"), merkle.likeness(F.col("pa"), F.col("pb")).alias("m"), (F.col("ta") == F.col("pa")).alias("same")).collect():
        assert r.d == r.e and r.l == r.m and r.same
        if r.name == "none":
            assert r.d is None and r.l == 1
            continue
        lines = lambda x: "".join(join(base[:x]))
        want = {"insert": (len(lines(100)), len(lines(100))), "delete": (len(lines(50)), len(lines(53))), "reorder": (len(lines(20)), len(lines(60))), "change": (len(lines(299)), len(r.a)), "all": (0, len(r.a))}[r.name]
        assert (r.d.begin, r.d.end) == want and (r.l > 0.8 or r.name == "all")


def test_merkle_hot_id(spark):
    """An id that fills many ranges is cut by hash; the order stays that of id, hash and text."""
    rows = [(7, f"text {i % 5000}") for i in range(9000)] + [(None, "x")] * 4000 + [(i, f"t{i}") for i in range(100)]
    got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text", "next_text").collect()
    order = sorted(got, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h, r.text))
    assert len(got) == len(rows) and all(a.next_text == b.text for a, b in zip(order, [*order[1:], order[0]]))


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head</h1><p>First &amp; <b>second</b>\n words that make a sentence of some length.</p><p>More words, which follow the first ones here.</p></article><div class='comments'><p>a reader's note</p></div><footer>Imprint</footer></body></html>"
    rows = html_cut.page_report(spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert rows[0].text == "Head First & second words that make a sentence of some length. More words, which follow the first ones here."
    assert [(r.text, r.n_chars) for r in rows[1:]] == [("", 0), ("", 0)] and rows[0].n_chars == len(rows[0].text)


ARTICLE = "<article><p>First words that make a sentence of some length.</p><p>More words, which follow the first ones here.</p></article>"
WORDS_OF_ARTICLE = "First words that make a sentence of some length. More words, which follow the first ones here."


@pytest.mark.parametrize("page", [
    f"<body class='overflow-hidden'>{ARTICLE}</body>", f"<main style='overflow:hidden'>{ARTICLE}</main>", f"<div class='hidden-xs'>{ARTICLE}</div>",
    f"<div aria-hidden='false'>{ARTICLE}</div>", f"<div data-hidden='1' title='display: none'>{ARTICLE}</div>",
    *(f"<body><div><{x}></div>{ARTICLE}</body>" for x in "noscript object template canvas svg math option iframe select datalist".split()),
    *(f"<body><{x}>{ARTICLE}</body>" for x in "noscript object template canvas svg option".split()),
    f"<body><select><option>One<option>Two</select><noscript><a href=/>no <h2>no</noscript>{ARTICLE}</body>", f"<head><noscript>no</noscript><body>{ARTICLE}</body>",
    f"<body class='has-sidebar'><main>{ARTICLE}</main></body>", f"<html class='no-cookie-banner'><body class='menu'>{ARTICLE}</body></html>",
    f"<svg><svg></svg>no</svg>{ARTICLE}", f"<div hidden><p>A sentence that nobody sees, of some length.</p></div>{ARTICLE}",
    f"<div style='color:red; Display : none'><p>A sentence that nobody sees, of some length.</p></div>{ARTICLE}", f"{ARTICLE}<section aria-hidden=true><p>A sentence that nobody sees.</p></section>",
    f"<div>{ARTICLE}<script>var a = '<p>no</p>'"])
def test_html_whole_article(page):
    assert html_cut.extract(page) == WORDS_OF_ARTICLE


@pytest.mark.parametrize("page", [
    f"<p class='advert'>Buy one of these today, they are cheap.</p>{ARTICLE}", f"<title>Never closed<body>{ARTICLE}</body>", f"<style>p {{}}<body>{ARTICLE}</body>", f"<table><tr><td class='sidebar'>Some words at the side.<td class=ad>more</table>{ARTICLE}",
    f"{ARTICLE}<ul class='comments'><li>I liked it.<li>So did I.</ul>"])
def test_html_broken_or_named_elements(page):
    assert html_cut.extract(page) == WORDS_OF_ARTICLE


def test_min_cut_exhaustive():
    """Every labelling of small graphs: none is cheaper, and the cut has the fewest nodes of content among the cheapest."""
    from itertools import product

    r = __import__("random").Random(4)
    for _ in range(300):
        n = r.randrange(1, 8)
        odds = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(n)]
        edges = [(a, b, r.choice([0.25, 0.5, 1.0, 2.0])) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda side: sum(o for s, o in zip(side, odds) if o > 0 and not s) - sum(o for s, o in zip(side, odds) if o < 0 and s) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(product([False, True], repeat=n), key=lambda s: (round(cost(s), 9), sum(s)))
        assert tuple(html_cut.min_cut(odds, edges)) == best


def test_cut_changes_labels_for_the_better():
    from gridwork.llm.html_examples import pages

    weights, next_to, same_parent = html_cut.model()
    cut, alone, changed = [], [], 0
    for blocks in map(html_cut.blocks_of, pages(300, 99, html_cut.WORDS)):
        odds = [html_cut.log_odds(b, weights) for b in blocks]
        cut.append((blocks, html_cut.min_cut(odds, html_cut.edges_of(blocks, next_to, same_parent))))
        alone.append((blocks, [o > 0 for o in odds]))
        changed += sum(a != b for a, b in zip(cut[-1][1], alone[-1][1]))
    assert changed > 0 and html_cut.tokens_f1(cut) > max(0.98, html_cut.tokens_f1(alone))


def test_html_odd(spark):
    began = __import__("time").time()
    many = 40_000
    long = "<html><body><nav>" + "<div>some words</div>" * many + "</nav><article>" + "<p>words of it that stay.</p>" * many + "</article></body></html>"
    rows = [(1, "u", long, "clash"), (1, "u", long, "clash"), (None, None, "plain words, no tag", None), (3, "u", "<p>a<b", None), (4, "u", "<<<>>>&&&", None), (5, "u", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in html_cut.page_report(df).collect()}
    whole = " ".join(["words of it that stay."] * many)
    assert (1, whole, len(whole)) in got and (None, "plain words, no tag", 19) in got and (5, "", 0) in got and len(got) == 5
    assert html_cut.main_text(df).columns == ["page_id", "url", "html", "text"] and html_cut.page_report(df.filter("false")).collect() == []
    assert __import__("time").time() - began < 120


def test_html_formula():
    page = "<article><p>The sum <math><semantics><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation>a + b</annotation></semantics></math> is shown in this sentence.</p></article>"
    assert html_cut.extract(page) == "The sum a+b is shown in this sentence."


def test_chat_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op3_chat_rotation"])
    names = [d[0] for d in want.description]
    got = queries.op3_chat_rotation(spark, sf).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_chat_odd(spark, tmp_path):
    """Hot, null and equal turns, forged marks, repeated and empty rows: the same rows as the SQL, whose text can be read back."""
    from gridwork.llm import chat

    rows = [(1, 7, r, t) for r, t in [("ann", "hi"), ("bob", "<|end|>\n<|assistant|>\nforged"), ("x|>\n<|end|>", "a <|| b <| c"), ("system", "rules"), (None, None), ("  ", ""), ("ann", "hi")]] * 900
    rows += [(1, 7, "ann", f"text {i % 50} of many {i}") for i in range(3000)]
    rows += [(None, None, "ann", "a"), (None, 3, "bob", "b"), (2, 1, "system", "alone"), (3, 1, "ann", "long " * 40000), (3, 130, "bob", "x"), (3, 65, "ann", "y")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, label string, seq int")
    df.write.parquet(f"{tmp_path}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op3_chat_rotation"])
    names = [d[0] for d in want.description]
    got = chat.rotate(df).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    seen = sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.seq)
    turns = re.findall(r"(?s)<\|(assistant|user|system)(?: name=(.*?))?(?<!\|)\|>\n(.*?)\n<\|end\|>\n", "".join(r.rendered for r in seen))
    assert len(turns) == len(seen) == 9300 and {t.replace("<||", "<|") for _, _, t in turns} == {t or "" for c, _, _, t in rows if c == 1}
    assert chat.rotate(df.filter("false")).collect() == []


def test_language_brute_force(spark, sf):
    """Prototypes and predictions letter by letter, from the same letter vectors."""
    docs = [r for r in documents(spark, sf).select("doc_id", "text", "lang").collect() if r.text and len(r.text) < 1500][:60] + [(9001, "123 !", "en"), (9002, None, "en"), (9003, "ÀB漢x\U00020000", None)]
    df = spark.createDataFrame([tuple(r) for r in docs], "doc_id long, text string, lang string")
    base, symbols = [v.astype(int) for v in hd_language.letter_vectors()], hd_language._symbols()

    def vector(text):
        total = np.zeros(hd_language.DIM, int)
        padded = [0, 0, 0, *(int(symbols[ord(c)]) for c in text), 0, 0, 0]
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            if (a, b, c) != (0, 0, 0):
                total += base[0][a] * base[1][b] * base[2][c]
        return total

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    whole = {}
    for i, text, lang in map(tuple, docs):
        if text and lang and not held(i):
            whole[lang] = whole.get(lang, 0) + vector(text)
    rows = {r.doc_id: r for r in hd_language.language_report(df).collect()}
    names = sorted(whole)
    sure = 0
    for i, text, _ in map(tuple, docs):
        v = vector(text or "")
        if not any(ch.isalpha() for ch in text or ""):
            assert rows[i].lang_pred == "und" and rows[i].score == 0
            continue
        cosine = [float(v @ whole[n] / np.linalg.norm(v) / np.linalg.norm(whole[n])) for n in names]
        best = max(cosine)
        assert rows[i].score == pytest.approx(max(0.0, best), abs=2e-3)
        if best - sorted(cosine)[-2] > 5e-3:
            assert rows[i].lang_pred == names[cosine.index(best)]
            sure += 1
    assert sure > 50


def fluid_amounts(sizes, weights, slot):
    """Blocks of each source that the fluid mix has given before a slot, exactly."""
    from fractions import Fraction

    given, left, t = {s: Fraction(0) for s in sizes}, dict(sizes), Fraction(0)
    while t < slot:
        active = [s for s in sizes if given[s] < sizes[s]]
        total = sum(Fraction(weights[s]) for s in active)
        step = min([slot - t, *((sizes[s] - given[s]) * total / Fraction(weights[s]) for s in active)])
        for s in active:
            given[s] += step * Fraction(weights[s]) / total
        t += step
    return given


@pytest.mark.parametrize("sizes", [{"a": 400, "b": 133, "c": 61, "d": 7, "e": 300}, {"a": 1}, {"a": 600, "b": 600}, {"a": 513, **{f"s{i}": 3 for i in range(60)}}])
def test_pfair_lag(spark, sizes):
    """Over several frames: no block early or late, and at every slot less than one block from the fluid mix."""
    weights = {"a": 4.0, "b": 2.0, "c": 0.75}
    of = {s: weights.get(s, 1.0) for s in sizes}
    rows = sorted(pfair_mix.schedule(spark.createDataFrame(list(sizes.items()), "_source string, blocks long"), weights, 1.0).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(sum(sizes.values())))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    placed = {s: 0 for s in sizes}
    for r in rows:
        placed[r.name] += 1
        assert r.block == placed[r.name]
        if r.slot % 7 == 0 or r.slot < 300:
            ideal = fluid_amounts(sizes, of, r.slot + 1)
            assert all(abs(placed[s] - ideal[s]) < 1 for s in sizes)


def test_pfair_bundles(spark, monkeypatch):
    """More sources than a plan holds: every block once, and less than two blocks from the fluid mix of equal sources."""
    monkeypatch.setattr(pfair_mix, "MOST_SOURCES", 12)
    sizes = {f"s{i}": 10 for i in range(90)}
    rows = sorted(pfair_mix.schedule(spark.createDataFrame(list(sizes.items()), "_source string, blocks long"), {"s0": 1.0}, 1.0).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(900)) and len({(r.name, r.block) for r in rows}) == 900
    placed = {s: 0 for s in sizes}
    for r in rows:
        placed[r.name] += 1
        assert r.block == placed[r.name] and all(abs(n - (r.slot + 1) / 90) < 2 for n in placed.values())


def test_pfair(spark, sf):
    docs = documents(spark, sf)
    rows = pfair_mix.mix_report(docs, queries.MIX_WEIGHTS).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len({r.position for r in rows}) == len(rows)
    clash = odd(spark).withColumn("slot", F.lit("x")).withColumn("position", F.lit("y"))
    assert pfair_mix.mix(clash).select("position").distinct().count() == 12


@pytest.mark.parametrize("f", [hd_language.language_report, merkle.fingerprint_report, pii.pii_report, pfair_mix.mix_report, lambda d: token_binary.token_report(d, queries.vocabulary("word_bpe_49k.json")), lambda d: piece_codec.codec_report(d, queries.vocabulary("piece_bpe_32k.model"))])
def test_odd_rows(spark, f):
    assert f(odd(spark)).count() == 12
    assert f(odd(spark).filter("false")).count() == 0


def test_keep_first_odd(spark):
    rows = jaccard_join.keep_first(odd(spark)).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 5, 7, 8, 9]
    # Ids say nothing of the texts: three texts stay, a copy of each goes.
    texts = [(None, "here is a text of its own"), (None, "here is a text of its own"), (5, "some other text that has no id like it"), (5, "yet another one under the same number"), (5, "yet another one under the same number"), (9, "some other text that has no id like it")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = jaccard_join.keep_first(docs).collect()
    assert sorted(map(tuple, rows), key=repr) == [(5, texts[2][1]), (5, texts[3][1]), (None, texts[0][1])]
    assert jaccard_join.keep_first(odd(spark).filter("false")).collect() == []


def test_mix_reaches_the_end(spark, sf, tmp_path):
    """Every prefix of the encoded documents has each source's share, less than a block off."""
    import corpus_pipeline

    blocks = {"src0": 40, "src1": 20, "src2": 15, "other": 10}  # all end together under MIX_WEIGHTS
    docs = spark.createDataFrame([(i * 1000 + k, f"text {k} of {s}", "en", s, 9) for i, (s, n) in enumerate(blocks.items()) for k in range(n * pfair_mix.BLOCK)], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    stages["mix"](spark, docs.repartition(7), sf).write.parquet(f"{tmp_path}/mix")
    rows = stages["encode"](spark, spark.read.parquet(f"{tmp_path}/mix"), sf).select("source", "position").collect()
    order = [r.source for r in sorted(rows, key=lambda r: r.position)]
    assert len(order) == docs.count() == len({r.position for r in rows})
    for end in range(pfair_mix.BLOCK, len(order) + 1, pfair_mix.BLOCK):
        for s, n in blocks.items():
            assert abs(order[:end].count(s) - end * n / sum(blocks.values())) < pfair_mix.BLOCK


def test_pipeline_stages(spark, sf, tmp_path):
    """Each stage on what its predecessor kept, against a plain version."""
    import corpus_pipeline
    import sentencepiece

    before, rows = documents(spark, sf), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = {r.doc_id: r for r in before.collect()}
    docs = {r.doc_id: r for r in documents(spark, sf).collect()}
    said = {r.doc_id: r for r in hd_language.language_report(documents(spark, sf)).collect()}
    assert set(rows["language"]) == {i for i, r in said.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_COSINE}
    assert all(rows["language"][i].text == docs[i].text for i in rows["language"])
    assert set(rows["near_dups"]) == {c for _, c in brute_components([(i, r.text) for i, r in rows["language"].items()]).values()}
    assert set(rows["pii"]) == set(rows["near_dups"])
    for i, r in rows["pii"].items():
        assert base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not base_spans(docs[i].text) and not re.search("[0-9]", docs[i].text):
            assert r.text == docs[i].text
    assert {(i, r.text) for i, r in rows["mix"].items()} == {(i, r.text) for i, r in rows["pii"].items()} and len({r.position for r in rows["mix"].values()}) == len(rows["mix"])
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    assert all(list(r.ids) == sp.encode(rows["mix"][i].text) and r.n_tokens == len(r.ids) and r.position == rows["mix"][i].position for i, r in rows["encode"].items()) and set(rows["encode"]) == set(rows["mix"])


def test_pipeline_odd(spark, sf):
    """Nulls, copies, clashing columns and an empty table through all stages."""
    import corpus_pipeline

    docs = odd(spark).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1)).withColumn("position", F.lit("p")).withColumn("ids", F.lit("i"))
    for source, want in ((docs, True), (docs.filter("false"), False)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, source, sf)
            if name in ("language", "near_dups", "pii"):
                assert after.columns == source.columns
            source = after
        rows = source.collect()
        assert len(rows) == len({r.position for r in rows}) and source.columns == ["doc_id", "source", "lang", "position", "n_tokens", "ids"]
        if want:
            # Not kept: no text, no letters, and what is a copy of another text.
            assert {5, 8, 9} <= {r.doc_id for r in rows} <= {3, 5, 7, 8, 9}
        else:
            assert rows == []


def test_pipeline(spark, sf):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf).collect()
    docs = documents(spark, sf)
    first = {c for _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]).values()}
    assert len(got) == len({r.doc_id for r in got}) and {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}
    assert len({r.doc_id for r in got}) >= 0.9 * len(first)


def test_words_by_their_ends():
    """Words of letters go through the tokenizer together, without marks; odd ones by themselves, with the same ids."""
    from tokenizers import Tokenizer

    from gridwork.llm import _chunks

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    asked = []
    alone = lambda chunks: asked.extend(chunks) or [np.array(tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]
    words = [f"{a}{b}" for a in ("house", "Été", "straße", "ﬁ", "日本", "Ω", "x") for b in ("", "ly", "ñ", "zzqx")]
    odd = ["it's", "a.b", "2024", "<|endoftext|>", "—", "don't!", "x1"]
    many = _chunks.by_word_end(tokenizer, alone, joined=5)
    got = many(words + odd)
    assert sorted(asked) == sorted(odd)
    assert got == alone(words + odd)
    assert many(["one", "İstanbul", "two"]) == alone(["one", "İstanbul", "two"])  # a letter that becomes two, one of them no letter
    # The memory keeps what is in use, within its bytes, and gives the same ids whatever it forgets.
    memory = _chunks.LastingMemory(lambda chunks: many([c.decode() for c in chunks]), 20_000)
    for k in range(40):
        text = [b"house", *(f"w{chr(97 + k % 26)}{chr(97 + i)}{'q' * (k // 26)}".encode() for i in range(20)), b"y" * 70]
        assert list(memory.encode([text, text[::-1]])) == [b"".join(alone([c.decode() for c in t])) for t in (text, text[::-1])]
        assert b"house" in memory.known and sum(_chunks.ENTRY + len(c) + len(x) for d in (memory.known, memory.old) for c, x in d.items()) <= 21_000
    assert memory.old


def test_pfair_without_a_switch(spark, monkeypatch):
    """The slots are those of the exact mix, whatever the number of sources."""
    sizes = {f"s{i}": 1 + i % 3 for i in range(40)}
    df = spark.createDataFrame(list(sizes.items()), "_source string, blocks long")
    of = {s: {"s0": 4.0}.get(s, 1.0) for s in sizes}
    few = sorted(map(tuple, pfair_mix.schedule(df, {"s0": 4.0}, 1.0, frame=16).collect()))
    monkeypatch.setattr(pfair_mix, "MOST_SOURCES", 5)
    assert sorted(map(tuple, pfair_mix.schedule(df, {"s0": 4.0}, 1.0, frame=16).collect())) == few
    placed = {s: 0 for s in sizes}
    for name, _, slot, release, deadline in sorted(few, key=lambda r: r[2]):
        placed[name] += 1
        ideal = fluid_amounts(sizes, of, slot + 1)
        assert release <= slot < deadline and all(abs(placed[s] - ideal[s]) < 1 for s in sizes)


def test_word_columns():
    """Capitals and marks make no new piece; odd texts have the tokenizer's own ids, also with a small memory and another normaliser."""
    import json
    import struct

    import pyarrow as pa
    from tokenizers import Tokenizer

    from gridwork.llm import _chunks

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    own = lambda t, x: struct.pack(f"<{len(i := t.encode(x or '', add_special_tokens=False).ids)}I", *i)
    texts = [None, "", " \x0b\x0c\r\n\t ", "Word, WORD! (word) word's WE'LL i'd 'S 't' !'s a1b22", "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 256))), "ÀÉÎ,Õü ÿß!? µ ª º ² × ÷ \x7f\x80\x85\xa0x \x1c y\x1fz",
             "İ, I\u0307, e\u0301,e =\u0338 >\u0338. ΟΔΟΣ, ΣΑΣ 日本語 ١٢ ½ 😀! \u2028q", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|> <|x </w> a</w>b", "no<b>de</b>", "x" * 300 + "." + "é" * 90 + " end"]
    asked = []
    for limit, made in ((4_000_000, tokenizer), (2_000, tokenizer)):
        column = _chunks.WordColumn(made, lambda chunks: [own(made, c) for c in chunks], limit)
        many = column.pieces.encode_many
        column.pieces.encode_many = lambda pieces, many=many: asked.extend(pieces) or many(pieces)
        for _ in range(3):
            assert list(column(pa.array(texts, pa.string()))) == [own(made, t) for t in texts]
        assert list(column(pa.array([None, ""], pa.string()))) == [b"", b""] and list(column(pa.array([], pa.string()))) == []
        assert list(column(pa.array(["日本 語"]))) == [own(made, "日本 語")]
    column.pieces.clear()
    asked.clear()
    assert list(column(pa.array(texts[3:4]))) == [own(tokenizer, texts[3])] and asked.count("word") == 1 and "Word" not in asked and "word," not in asked
    upper = json.loads(tokenizer.to_str())
    upper["normalizer"] = None
    upper = Tokenizer.from_str(json.dumps(upper))
    column = _chunks.WordColumn(upper, lambda chunks: [own(upper, c) for c in chunks], 4_000_000)
    assert column.pieces is None and list(column(pa.array(texts[3:4]))) == [b"".join(own(upper, c) for c in texts[3].split())]
    rows = pa.record_batch({"text": pa.array(["a" * 10, None, "b " * 2_000_000, "c"])})
    assert [b.num_rows for b in _chunks.gathered([rows, rows], "text", 100)] == [2, 1, 3, 1, 1]
    assert [b.num_rows for b in _chunks.gathered([rows.slice(0, 2)] * 3, "text", 100)] == [6]
    assert list(token_binary.encoded(token_binary._memory(queries.vocabulary("word_bpe_49k.json")), rows.column(0)[2:3])) == [own(tokenizer, "b " * 2_000_000)]
