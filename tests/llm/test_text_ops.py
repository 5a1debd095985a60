"""The text operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from viatica.llm import base, language, lines, lm, media, mixing, packing, queries, simhash, tokencount, tokens, toxicity

SPACE = "[^\x20\x09-\x0d]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


# -- SimHash


def brute_fingerprint(text):
    words = re.findall(SPACE, lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    got = Counter((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((r.doc_id, brute_fingerprint(r.text)) for r in docs.collect())


def test_every_close_pair_shares_an_anchor_with_a_home():
    random = np.random.default_rng(0)
    for _ in range(300):
        a = int(random.integers(0, 2**63)) * 2 + int(random.integers(0, 2))
        b = a
        for bit in random.choice(64, int(random.integers(1, 4)), replace=False):
            b ^= 1 << int(bit)
        met = False
        for half in (0, 1):
            halves = np.array([a >> 32 * half & 0xFFFFFFFF, b >> 32 * half & 0xFFFFFFFF], np.uint64)
            which, found, home = simhash.anchors(halves)
            mine = [{(int(f), bool(h)) for w, f, h in zip(which, found, home, strict=True) if w == i} for i in (0, 1)]
            assert all(sum(h for _, h in m) == 1 and len(m) <= 17 for m in mine)
            met |= any(f in {g for g, _ in mine[1]} for f, h in mine[0] if h) or any(f in {g for g, _ in mine[0]} for f, h in mine[1] if h)
        assert met


def test_components_by_brute_force(spark):
    random = np.random.default_rng(1)
    base_ = random.integers(-(2**62), 2**62, 40)
    fps = [int(x) for x in base_]
    for x in base_[:20]:  # chains: each differs from the one before by two bits
        y = int(x)
        for _ in range(6):
            y ^= (1 << int(random.integers(0, 62))) ^ (1 << int(random.integers(0, 62)))
            fps.append(y)
    fps += fps[:10] + [0, 0, 1, 7, 15]
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    links = simhash.linked(df).collect()
    f = np.array(fps, np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 3)
    root = simhash._roots(len(f), i, j)
    place = {v: n for n, v in enumerate(fps)}
    a, b = np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links])
    k, m = np.nonzero(f[:, None] == f)
    mine = simhash._roots(len(f), np.r_[a, k], np.r_[b, m])
    assert (root == mine).all()
    assert all((int(r.a) ^ int(r.b)) & (2**64 - 1) for r in links)


def test_crowded_anchor_splits_exactly():
    random = np.random.default_rng(2)
    fps = (np.uint64(12345) << np.uint64(32)) | random.integers(0, 1 << 16, 5000).astype(np.uint64)
    fps = np.unique(fps)
    fps = np.r_[fps, random.integers(0, 2**62, 4500).astype(np.uint64)]
    home = np.ones(len(fps), bool)
    pairs = set()
    for i, j in simhash._close(fps, home, 3):
        pairs |= set(zip(i.tolist(), j.tolist(), strict=True))
    i, j = np.nonzero(np.bitwise_count(fps[:1500, None] ^ fps) <= 3)
    assert all(p in pairs or p[0] == p[1] for p in zip(i.tolist(), j.tolist(), strict=True))


def test_near_duplicates_edges(docs, empty):
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got[(2, 1)] == 1 and got[(4, 3)] == 1 and got[(5, 3)] == 1 and got[(7, 7)] == 2 and got[(None, None)] == 1
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]


def test_one_of_each_keeps_every_text(spark):
    """Rows without an id, and different texts of one id, are documents of their own; of rows alike in both one stays."""
    other = [" ".join(f"{w}{i}" for i in range(40)) for w in ("some", "quite", "wholly", "entirely")]
    rows = [(None, other[0]), (None, other[1]), (None, other[0]), (7, other[2]), (7, other[3]), (7, other[3]), (9, other[2]), (None, other[2]), (None, None), (None, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("None", other[0]), ("None", other[1]), ("7", other[2]), ("7", other[3]), ("None", "")])
    assert simhash.one_of_each(kept.limit(0)).count() == 0


# -- lines


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("parts", ["2", "8"])
def test_line_dedup_by_brute_force(spark, first, parts):
    random = np.random.default_rng(3)
    texts = ["\n".join(random.choice(["A b ", "a b", "x", "", " ", "rare" + str(i), "y y", "hot"], int(random.integers(1, 9)))) for i in range(60)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(3, texts[3], "n"), (None, "hot\nonly", "n"), (99, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(df, min_docs=4, first_stays=first).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = lambda x: lowered(x.strip(" \t\n\r\x0b\x0c"))
    where: dict = {}
    for doc, t, _ in rows:
        for n, x in enumerate((t or "").split("\n")):
            if key(x):
                where.setdefault(key(x), set()).add((-(2**63) if doc is None else doc, n))
    common = {k: min(v) for k, v in where.items() if len({d for d, _ in v}) >= 4}
    want = Counter()
    for doc, t, _ in rows:
        all_ = (t or "").split("\n")
        stay = [x for n, x in enumerate(all_) if key(x) not in common or first and common[key(x)] == (-(2**63) if doc is None else doc, n)]
        want[(doc, "\n".join(stay), len(all_), len(all_) - len(stay))] += 1
    assert got == want


def test_one_line_in_every_range(spark):
    """A line that fills several ranges, with few documents in the last of them."""
    rows = [(i, "same\nown " + str(i)) for i in range(400)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10)
    assert {(r.n_lines, r.n_dropped) for r in got.collect()} == {(2, 1)}


def test_line_dedup_edges(docs, empty):
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and got.count() == docs.count()
    assert lines.dedup_lines(empty).count() == 0


# -- packing and tokens


def test_pieces_cover_documents(docs, empty):
    rows = packing.pack(docs, tokens.vocabulary(), capacity=64, window=500).collect()
    library = tokens.encoder(tokens.vocabulary()).tokenizer
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    by_sequence: dict = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.start + r.length <= r.doc_tokens
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0 and at < 64
    long = {d: b"".join(r.ids for r in sorted(rows, key=lambda r: r.start) if r.doc_id == d) for d in (1, 3, 4, 5, 6, 8, None)}
    for d, ids in long.items():
        assert (d, tuple(np.frombuffer(ids, "<u4").tolist())) in want
    assert packing.pack(empty, tokens.vocabulary()).count() == 0


def test_costs_are_balanced():
    lengths = np.array([30] * 40 + [10] * 120)
    pieces = packing.assign(lengths, 64, 1.0, 0.1)
    cost: Counter = Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n + 0.1 * n * n
    full = sorted(cost.values())
    assert full[-2] <= 2 * full[len(full) // 2]
    assert sum(n for _, _, n, _, _ in pieces) == lengths.sum()


def test_encoder_equals_library():
    import random

    random.seed(4)
    letters = "abcdefghijklmnopqrstuvwxyzAEÉéñß'''.,;:!?0123456789#@İıſ中文 \n\t\x00́ \x85Σς<|endoftext|>"
    own = tokens.PieceEncoder(tokens.vocabulary(), limit=50)
    for _ in range(40):
        texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(20)]
        ids, first = own.encode([t.encode() for t in texts])
        for n, t in enumerate(texts):
            assert ids[first[n] : first[n + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_by_bytes_and_refuses_others(tmp_path):
    own = tokens.PieceEncoder(tokens.vocabulary(), limit=10_000, most=5_000)
    for n in range(6):
        texts = ["x" * 3000 + str(n), "short words " * 5, "\u4e2d\u6587" * 400]
        ids, first = own.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert own.numbers.size <= 5_000 + sum(len(t.encode()) for t in texts)
    own._forget()
    assert own.numbers.size <= 64 * len(own.numbers)
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"Ab,": 0, " ": 1, "[UNK]": 2}, unk_token="[UNK]")).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="white space"):
        tokens.PieceEncoder(str(tmp_path / "t.json"))


def test_token_counts(spark, docs, empty):
    library = tokens.encoder(tokens.vocabulary()).tokenizer
    for block in (1, 7, 1000):
        folder = base.fresh_dir(spark, "t")
        files, order = tokencount.write_token_files(docs, tokens.vocabulary(), folder)
        small = tokencount.document_lengths(files, folder, block=block) if block > 1 else tokencount.document_lengths(files, folder, block=300)
        got = Counter((r.doc_id, r.n_tokens, r.complete) for r in small.join(order, ["file", "nth"]).collect())
        assert got == Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), True) for r in docs.collect())
    folder = base.fresh_dir(spark, "t")
    files, _ = tokencount.write_token_files(empty, tokens.vocabulary(), folder)
    assert tokencount.document_lengths(files, folder).count() == 0


def test_separators_across_blocks_and_an_open_end(spark, tmp_path):
    ids = np.array([5, 9, 9, 1, 2, 3, 4, 9, 7, 7], "<u2")
    (tmp_path / "a.ids").write_bytes(ids.tobytes())
    files = spark.createDataFrame([("a.ids", 10)], "file string, n_ids long")
    for block in (1, 2, 3, 10):
        got = [(r.nth, r.start, r.n_tokens, r.complete) for r in tokencount.document_lengths(files, f"file://{tmp_path}", end=9, block=block).orderBy("nth").collect()]
        assert got == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 4, True), (3, 8, 2, False)]


# -- media


def test_media_round_trip(spark, docs):
    for data in (b"\0" * 64, bytes(range(256)), b"abc".ljust(64, b"\0")):
        assert media.from_png(media.to_png(data)) == data


def brute_feature(payload):
    n, c = len(payload), Counter(payload)
    entropy = max(0.0, -sum(x / n * math.log2(x / n) for x in c.values()))
    return f"{n // 64}x64 mean={sum(payload) / n:.4f} entropy={entropy:.4f}"


def brute_png(payload):
    import struct

    out = b"\x89PNG\r\n\x1a\n"
    lines = b"".join(b"\0" + payload[i : i + 64] for i in range(0, len(payload), 64))
    for name, data in ((b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return out


def test_media_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.position, r.caption) for r in media.op3_media(spark, str(tmp_path)).collect())
    want: Counter = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * (64 if not data else -len(data) % 64)
        png = brute_png(payload)
        want[(r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), brute_feature(payload), 2, f"all {len(data)} bytes")] += 1
    assert got == want


def test_a_page_keeps_its_order(spark):
    """The query's page, item by item, with both its references resolved."""
    html = spark.range(1).select("id", media.page_of(F.lit("ab"), F.lit(5)).alias("html"))
    rows = media.resolve(media.parse(html), spark.createDataFrame([("ab", 9)], "digest string, size long")).orderBy("position").collect()
    assert [(r.kind, r.text or r.digest, r.caption, r.size) for r in rows] == [
        ("text", "Document", None, None), ("text", "Before", None, None), ("media", "ab", "all 5 bytes", 9), ("text", "Between", None, None), ("media", "none", "none", None), ("text", "After", None, None), ("media", "ab", "ab", 9)]


def test_pages_of_the_web(spark):
    """Every page of the table is parsed: its media references are those a search for tags finds, in order, and all come back together."""
    pages = base.table(spark, "/root/testdata/sf0.001", "pages")
    parsed = media.parse(pages)
    for r, p in zip(parsed.orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        want = [m[1].lower() for m in re.finditer(r"<(img|video|audio|source|embed)\b[^>]*>", re.sub(r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "", p.html or ""), re.I)]
        assert len([i for i in r["items"] if i.kind == "media"]) == len(want)
        assert all(i.text and i.text == " ".join(i.text.split()) for i in r["items"] if i.kind == "text")
    store = spark.createDataFrame([("x", 1)], "digest string, size long")
    again = {r.page_id: [(i["item"].kind, i["item"].text) for i in r["items"]] for r in media.assemble(media.resolve(parsed, store), "page_id").collect()}
    assert again == {r.page_id: [(i.kind, i.text) for i in r["items"]] for r in parsed.collect() if r["items"]}


def test_clashing_names_of_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<img src='sha256:x'>", "t", "k", "d", "c", 7, "s", "i")], "page_id long, html string, text string, kind string, digest string, caption string, position long, size string, items string")
    rows = media.resolve(media.parse(pages), spark.createDataFrame([("x", 3)], "digest string, size long")).orderBy("position").collect()
    assert [(r.kind, r.digest, r.size, r.page_text, r.page_kind, r.page_digest, r.page_caption, r.page_position, r.page_size) for r in rows] == [("text", None, None, "t", "k", "d", "c", 7, "s"), ("media", "x", 3, "t", "k", "d", "c", 7, "s")]


def test_any_name_may_be_there(spark):
    """Every name that the modules give their own columns, and those of the struct that carries the others."""
    import ast
    import pathlib
    import re

    found = {"_", "__"}
    for path in pathlib.Path(media.__file__).parent.glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]{0,15}", node.value):
                found.add(node.value)
    names = sorted({x.lower(): x for x in found}.values())
    names = [x for x in names if x.lower() not in ("page_id", "html", "items", "doc_id", "text", "lang", "source", "n_chars")]
    assert len(names) > 100
    own = {x: F.lit(x) for x in names}
    pages = spark.createDataFrame([(1, "<p>a<img src='sha256:x'>")], "page_id long, html string").withColumns(own)
    shown = media.resolve(media.parse(pages), spark.createDataFrame([("x", 3)], "digest string, size long"))
    rows = shown.filter("kind = 'media' and size = 3").collect()
    assert len(rows) == 1 and all(rows[0][x if x in rows[0] and rows[0][x] == x else f"page_{x}"] == x for x in ("_", "__", "digest", "position"))
    docs_ = spark.createDataFrame([(1, "one two\nthree", "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(own)
    for stage in (lambda d: language.with_language(d, {"en": "one two three", "de": "eins zwei drei"}), lambda d: lines.dedup_lines(d, counted=False), simhash.one_of_each, mixing.mix):
        out = stage(docs_)
        assert out.columns == docs_.columns and out.filter("_ <> '_' or __ <> '__' or digest <> 'digest'").isEmpty()


def test_interleaved_order_and_captions(spark):
    html = "<p>one<figure><img src='sha256:aa' alt='x'><figcaption>cap <b>tion</b></figcaption></figure>two<script>no</script><img src='sha256:bb' alt='alt'><img src='u'>three"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size long")
    rows = media.resolve(media.parse(pages), store)
    got = [(r.position, r.kind, r.text, r.digest, r.caption, r.size) for r in rows.orderBy("position").collect()]
    assert got == [(0, "text", "one", None, None, None), (1, "media", None, "aa", "cap tion", 7), (2, "text", "two", None, None, None), (3, "media", None, "bb", "alt", None), (4, "media", None, None, None, None), (5, "text", "three", None, None, None)]
    assert [i.position for i in media.assemble(rows, "page_id").first()["items"]] == [0, 1, 2, 3, 4, 5]


# -- language


def brute_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_parse_table_counts_phrases():
    import random

    random.seed(5)
    sample = [random.randint(0, 3) for _ in range(200)]
    automaton = language.automaton(sample)
    as_text = "".join(map(str, sample))
    for _ in range(50):
        text = [random.randint(0, 4) for _ in range(60)]
        for table in (language.Table(automaton, 5), language.Hashed(automaton, 5)):
            count, _ = table.run(table.column[np.array(text)[:, None]], np.zeros(1, np.int32))
            assert count[0] == brute_phrases(as_text, "".join(map(str, text)))


def test_phrases_of_whole_texts():
    """Blocks make no difference: texts of 1 to 100,000 letters, pieces of the sample over many blocks, and both in turn."""
    import random

    random.seed(6)
    draw = lambda n, letters="abcd": "".join(random.choices(letters, k=n))
    samples = {"aa": draw(20_000), "bb": draw(3_000, "abce")}
    model = language.Model(samples)
    texts = [draw(n, "abcdef") for n in (1, 2, 511, 512, 513, 1024, 5000, 100_000)] + [samples["aa"], samples["aa"][77:15_000], "f" * 3000, ""]
    texts += [samples["aa"][i : i + n] + draw(m, "abcdef") + samples["bb"][:2000] for i, n, m in ((5, 9000, 3), (0, 600, 700), (300, 5000, 1))]
    got, letters = model.phrases(texts)
    assert letters.tolist() == [len(x) for x in texts]
    for n, lang in enumerate(model.languages):
        assert got[:, n].tolist() == [brute_phrases(samples[lang], x) for x in texts]
    assert got[8, 0] == 1 and got[9, 0] == 1
    cost = got * np.log2([20_000, 3_000])
    lang, score = model.predict(texts)
    assert lang == [model.languages[c.argmin()] if x else "und" for c, x in zip(cost, texts, strict=True)]
    assert np.allclose(score, [1 - c.min() / c.max() if x else 0 for c, x in zip(cost, texts, strict=True)])


def scripts(n=8, size=400):
    """(language, letters) of eight languages: six scripts, three of them of some hundred letters, and two languages of one script."""
    starts = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 24), "hebrew": (0x5D0, 27), "thai": (0xE01, 46), "large1": (0x4E00, size), "large2": (0x4F00, size), "large3": (0xAC00, size)}
    return {k: [chr(a + i) for i in range(m) if chr(a + i).isalpha()] for k, (a, m) in list(starts.items())[:n]}


def test_languages_of_many_scripts():
    """Each language has its own letters, however many there are in all."""
    import random

    random.seed(8)
    letters = scripts()
    draw = lambda own, n: "".join(random.choice(own) if random.random() < 0.8 else " " for _ in range(n))
    words = {k: [draw(v, random.randint(2, 6)) for _ in range(300)] for k, v in letters.items()}
    text = lambda k, n: " ".join(random.choice(words[k]) for _ in range(n))
    samples = {k: text(k, 1500) for k in letters}
    model = language.Model(samples)
    assert sum(isinstance(t, language.Hashed) for t in model.tables) == 3 and len({c for x in letters.values() for c in x}) > 1000
    asked = [(k, text(k, 30)) for k in letters for _ in range(40)]
    found, _ = model.predict([x for _, x in asked])
    assert all(sum(f == k for f, (k, _) in zip(found, asked, strict=True) if k == want) >= 39 for want in letters)
    counts, _ = model.phrases([x for _, x in asked[::40]])  # spaces are one symbol, as in the sample
    for n, k in enumerate(model.languages):
        assert counts[:, n].tolist() == [brute_phrases(samples[k], x) for _, x in asked[::40]]


def test_letters_that_no_sample_has_are_a_phrase_each():
    model = language.Model({"aa": "abc" * 100, "kk": "".join(chr(0x4E00 + i) for i in range(300)) * 3})
    counts, letters = model.phrases(["\u03b1\u03b2\u0430\u05d0", "a\u03b1bc", "\u4e00\u4e01\u03b1"])
    assert counts.tolist() == [[4, 4], [3, 4], [3, 2]] and letters.tolist() == [4, 4, 3]


def test_language_sample_is_of_whole_texts(spark):
    rows = [(i, "en", f"short text {i} " * 5) for i in range(200)] + [(300, "xx", "only long " * 1000), (301, "xx", "longer " * 3000), (302, None, "none"), (303, "en", None), (304, "en", "".join(f"long{i} " for i in range(2000)))]
    docs_ = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.training_sample(docs_, rows=50, chars=500)
    assert set(got) == {"en", "xx"} and 400 < len(got["en"]) <= 500 and all(any(x in r[2] for r in rows if r[1] == "en" and r[2]) for x in got["en"].split("\n"))
    assert len(got["xx"]) == 500 and (got["xx"] in rows[200][2] or got["xx"] in rows[201][2])
    assert set(language.training_sample(docs_, languages=1)) == {"en"}
    assert sum(map(len, language.training_sample(docs_, chars=500, total=600).values())) <= 600
    long = language.training_sample(docs_.filter("doc_id = 304"), stretch=700)["en"]  # within a long text, not its beginning alone
    assert len(long) == 700 and long in rows[-1][2] and not rows[-1][2].startswith(long)


def test_long_labelled_documents_are_learned_from(spark):
    """A corpus of articles of which none is short."""
    letters = scripts(5)
    docs_ = spark.createDataFrame([(i, k, "".join(own[(i * n * n + n) % len(own)] + " " * (n % 5 == 0) for n in range(9000))) for i in range(6) for k, own in letters.items()], "doc_id long, lang string, text string")
    samples = language.training_sample(docs_)
    assert set(samples) == set(letters) and all(len(x) > 20_000 for x in samples.values())
    found = language.identify(docs_, samples)
    assert found.filter("lang = lang_pred").count() == 30


def test_language_edges(docs, empty):
    samples = {"en": "the quick brown fox jumps over the lazy dog " * 20, "fr": "portez ce vieux whisky au juge blond qui fume " * 20}
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(docs, samples).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert {x for x, _ in language.identify(docs, {}).select("lang_pred", "lang_score").collect()} == {"und"}
    assert language.identify(docs, {"en": "abc"}).filter("doc_id = 7").first().lang_score == 1.0
    assert language.identify(empty, samples).count() == 0 and language.learn(empty) == {}


def test_language_accuracy(spark):
    docs_ = base.table(spark, "/root/testdata/sf0.01", "documents")
    found = language.op4_language(spark, "/root/testdata/sf0.01").join(docs_.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


# -- toxicity


def test_toxicity_learns_pairs():
    """Toxic only if both terms are there: no linear model can tell."""
    random = np.random.default_rng(6)
    rows = random.integers(0, 2, (400, 4))
    labels = (rows[:, 0] & rows[:, 1]).astype(float)
    place, feature = np.nonzero(rows)
    machine = toxicity.Machine(4)
    machine.fit(feature, place, labels)
    assert (((machine.score(feature, place, 400) >= 0.5) == (labels == 1)).mean()) > 0.98


def test_toxicity_fit_learns_what_counts_beside(spark):
    """zap is toxic with folk only, and folk is as common in clean rows; pow is toxic without jest only."""
    kinds = [("zap folk", 1)] * 3 + [("zap", 0)] * 3 + [("pow", 1)] * 3 + [("pow jest", 0)] * 3 + [("folk", 0)] * 16 + [("jest", 0)] * 3 + [("", 0)] * 5
    rows = [(i, f"{kinds[i % len(kinds)][0]} w{i % 17} x{i % 23}", kinds[i % len(kinds)][1]) for i in range(2880)]
    all_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame(list(enumerate(("zap folk w1", "pow w1", "zap w1", "pow jest w1", "folk w1", "jest w1"))), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, *toxicity.fit(all_.select("doc_id", "text"), all_.select("doc_id", "toxic"))).collect()}
    assert [got[k] >= toxicity.THRESHOLD for k in range(6)] == [True, True, False, False, False, False]


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 9)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        got = toxicity.score(docs, *toxicity.fit(docs, own))
        assert got.count() == docs.count() and got.filter("score < 0 or score > 1 or score is null").isEmpty()
    assert toxicity.score(empty, *toxicity.fit(empty, labels)).count() == 0


def test_toxicity_held_out(spark):
    found = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").join(base.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").toPandas()
    assert found.toxic[found.predicted == 1].mean() > 0.95 and found.predicted[found.toxic == 1].mean() > 0.75


# -- language model


def test_base_score_and_normalisation(spark, docs, empty):
    rows = docs.collect()
    got = lm.score(docs.select("doc_id", "text"), docs.filter("doc_id is null or doc_id <> 6").select("doc_id", "text"), classes=16, width=4).collect()
    tok = lambda t: [*re.findall(SPACE, lowered(t)), "\n"]
    c: Counter = Counter(x for r in rows if r.doc_id != 6 for x in tok(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, len(tok(r.text)), sum(c[x] > 0 for x in tok(r.text)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(r.text)), 6)) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert lm.score(empty, empty, classes=16, width=4).count() == 0
    model = lm.LogBilinear(np.full(12, 1 / 12), 5)
    a1, a2, z = model.tables()
    p = np.exp(a1[:, None, :] + a2[None, :, :] - z[:, :, None]).sum(2)
    assert np.allclose(p, 1, atol=1e-4)


def test_rare_tokens_have_their_own_probability(spark):
    """With no classes but the end and the groups: a and b, c and d are as frequent, and only their contexts tell c from d, which share a group."""
    groups = {}
    for w in (f"w{i}" for i in range(2000)):
        groups.setdefault(int(lm.groups_of(lm.hashes_of([w.encode()], 1))[0]), []).append(w)
    (a, *_), (b, *_), (c, d, *_) = sorted(groups.values())[:3]
    learned = spark.range(40_000).coalesce(2).selectExpr("id as doc_id", f"if(id % 2 = 1, '{a} {c}', '{b} {d}') as text")
    asked = spark.createDataFrame([(0, f"{a} {c}"), (1, f"{a} {d}"), (2, f"{b} {c}"), (3, f"{b} {d}")], "doc_id long, text string")
    for near in (0, 100):
        got = {r.doc_id: r for r in lm.score(asked, learned, classes=2, near=near, width=8).collect()}
        assert len({round(r.base_score, 9) for r in got.values()}) == 1
        assert got[0].score > got[1].score + 0.1 and got[3].score > got[2].score + 0.1


def test_most_frequent_words(spark):
    random = np.random.default_rng(3)
    rows = [(int(h), int(c)) for h, c in zip(random.integers(-(2**63), 2**63 - 1, 5000), np.r_[random.integers(1, 4, 4900), random.integers(4, 900_000, 100)], strict=True)]
    words = spark.createDataFrame(rows, "h long, c long")
    for most in (0, 1, 40, 100, 130, 2000, 4999, 5000, 9000):
        hashes, counted = lm.most_frequent(words, most)
        want = sorted((-c, h) for h, c in rows)[:most]
        assert hashes.tolist() == [h for _, h in want] and counted.tolist() == [-c for c, _ in want]
    assert len(lm.most_frequent(words.limit(0), 5)[0]) == 0


def test_leaves_are_normalised():
    random = np.random.default_rng(1)
    context = random.normal(size=(40, 5)).astype(np.float32)
    hashes, counted = random.integers(-(2**63), 2**63 - 1, 300), random.integers(1, 9, 300).astype(float)
    leaf, before = random.integers(0, 300, 5000), random.integers(0, 40, 5000)
    whole = lm.Leaves(hashes, counted, context)
    assert list(whole.find(np.r_[whole.hashes[7], 12345])) == [7, 300]
    group = lm.Group.of(context, np.bincount(before, minlength=40), float((counted + 1).sum() + 1))
    for taught in (False, True):
        if taught:
            whole.add(leaf, before)
        q, b, total = whole.learn(group)
        z = np.log(total + math.exp(group.unseen()))
        p = np.exp(lm.leaf_scores(context @ q.astype(np.float32).T, b) - z[:, None])
        assert np.allclose(p.sum(1) + np.exp(group.unseen() - z), 1, atol=1e-4)
    assert q.any()
    parts = [lm.Leaves(whole.hashes[s], whole.counted[s], context) for s in (slice(0, 100), slice(100, 300))]  # as in parts
    parts[0].add(leaf[leaf < 100], before[leaf < 100])
    parts[1].add(leaf[leaf >= 100] - 100, before[leaf >= 100])
    learned = [x.learn(group) for x in parts]
    assert np.allclose(np.concatenate([x[1] for x in learned]), b, atol=1e-5) and np.allclose(sum(x[2] for x in learned), total)


def test_score_is_the_sum_of_its_tokens(spark, docs):
    """Every token's probability once more, one by one, from the parameters learned."""
    learned = docs.filter("doc_id is null or doc_id <> 6").select("doc_id", "text").union(spark.createDataFrame([(50 + i, f"lorem{i % 7} ipsum{i % 3} dolor elit{i}") for i in range(300)], "doc_id long, text string"))
    lm_tokens, lm.TASK_TOKENS = lm.TASK_TOKENS, 3  # groups in parts
    try:
        own = lm.learn(learned, classes=9, near=12, width=4)
    finally:
        lm.TASK_TOKENS = lm_tokens
    assert own.more > 0 and own.tasks > 8
    asked = learned.union(spark.createDataFrame([(900, "never seen lorem1 ipsum2"), (901, "elit5 elit6 elit7")], "doc_id long, text string"))
    a1, a2, z = own.model.tables()
    leaf = {}
    for h, q, b in zip(own.near.tolist(), own.near_q, own.near_b, strict=True):
        leaf[h] = (q, b)
    for r in own.leaves.collect():
        hs = np.frombuffer(r.a, np.int64)
        leaf.update((h, (q, b)) for h, q, b in zip(hs.tolist(), *lm._leaf_arrays(r.c, len(hs)), strict=True))
    top = {h: n + 2 for n, h in enumerate(own.top.tolist())}
    assert len(own.near) == 12 and len(top) == 7 and len(leaf) == own.v - 8

    def brute(text):
        i = j = lm.CLOSE
        total = 0.0
        for t in [*re.findall(SPACE, lowered(text)), None]:
            h = None if t is None else int(lm.hashes_of([t.encode()], 1)[0])
            g = 0 if t is None else int(lm.groups_of(np.array([h]))[0])
            w = lm.CLOSE if t is None else top.get(h, 0 if g == 0 else len(top) + 1 + g)
            total += a1[i, w] + a2[j, w] - z[i, j]
            if t is not None and h not in top:
                q, b = leaf.get(h, (np.zeros(4), own.unseen_b[g]))
                total += min(float(own.model.context()[i] @ q.astype(np.float32) + b), lm.HIGHEST) - own.z[g, i]
            i, j = w, i
        return total / math.log(10)

    want = Counter((r.doc_id, round(brute(r.text), 2)) for r in asked.collect())
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm.apply(asked, own).collect())
    off = {k: (x, y) for (k, x), (_, y) in zip(sorted(want, key=str), sorted(got, key=str), strict=True) if abs(x - y) > 0.02}
    assert not off and sum(got.values()) == sum(want.values())


def test_model_beats_counts_on_held_out_text(spark):
    docs_ = base.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    held = base.fold("doc_id", 7) == 2
    own = lm.learn(docs_.filter(~held))
    sums = lm.apply(docs_.filter(held), own).selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert sums.s - sums.b > 0.1 * sums.n


# -- mixing


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {(r.d, r.s): int(r.quota) for r in mixing.leaf_quotas(leaves, ["d", "s"], {}, (1000, 2010), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 490, ("b", "z"): 500}
    got = {(r.d, r.s): int(r.quota) for r in mixing.leaf_quotas(leaves.filter("s <> 'y'"), ["d", "s"], {}, (500, 1010), 1).collect()}
    assert got == {("a", "x"): 10, ("b", "z"): 490}


def test_mixing_edges(docs, empty):
    got = mixing.mix(docs, share=(1, 1))
    assert got.columns == docs.columns and got.count() == docs.count()
    twice = mixing.mix(docs, share=(2, 1), max_epochs=2)
    assert twice.filter("n_chars = 1 and doc_id = 6").count() == 2
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    assert mixing.mix(docs, share=(0, 1)).filter("text like '%lorem%'").count() == 0
