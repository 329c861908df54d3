"""Each operator against a plain version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import avi_media, chat_format, decontaminate, html_text, language_id, line_dedup, near_dedup, packing, quality, substring_dedup

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 50)) for _ in range(n))


LONG = prose(1, 400)
ROWS = [
    (1, LONG, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "one two", "de", None, 7), (5, LONG, "en", "a", 1), (5, LONG, "en", "a", 1),
    (6, LONG.replace("alpha", "ALPHA", 2), "en", "b", 1), (7, "x" * 50_000, "en", "b", 50_000), (8, "\n\n \t", "fr", "b", 4), (9, prose(2, 60) + " " + " ".join(LONG.split()[10:60]) + " " + prose(3, 60), "es", "c", 3),
    (10, "ünï 日本 \U0001f600 end", "xx", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ("tid", "rid", "row", "key", "lines", "score", "kept", "batch", "n")
    df = spark.createDataFrame(ROWS, DOC)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


# ---- substring dedup


def plain_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_substring_small(docs, nothing):
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == sorted(plain_repeats([r[1] for r in ROWS]))
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_substring_random(spark, seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(list("abc"), 300)) for _ in range(3)]
    texts = []
    for _ in range(12):
        parts = [base[rng.integers(3)].split()[(a := rng.integers(0, 250)) : a + rng.integers(20, 120)] for _ in range(3)]
        texts.append(" ".join(itertools.chain(*parts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df, batches=3, fan_in=2).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts)


def test_index_tells_batches_what_history_has(spark):
    texts = spark.createDataFrame([(b"a", LONG), (b"b", LONG)], "rid binary, text string")
    index = substring_dedup.FingerprintIndex(spark)
    assert index.ingest(texts.where("rid = X'61'"), 35).count() == 0
    seen = index.ingest(texts.where("rid = X'62'"), 35)
    assert seen.count() == index.anchors().where("rid = X'62'").count() > 10
    index.compact()
    assert len(index.runs) == 1 and index.runs[0].agg(F.min("n")).first()[0] == 2


def test_index_is_opened_again(spark):
    """Batches from several sessions, compaction among them, give the result of one batch; runs are joined without a shuffle of them."""
    parts = [LONG.split()[a : a + 80] for a in (0, 60, 100, 150, 155, 300)]
    rows = [(i, " ".join([*prose(700 + i, 30).split(), *p, *prose(800 + i, 30).split()])) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = substring_dedup.FingerprintIndex(spark).path
    for i in range(len(rows)):
        session = spark.newSession()
        for table in [t.name for t in session.catalog.listTables() if t.name.startswith("barloom_run_")]:
            session.sql(f"DROP TABLE {table}")  # as in another application
        own = session.createDataFrame(rows[i : i + 1], "doc_id long, text string")
        substring_dedup.FingerprintIndex(session, path, fan_in=2).ingest(substring_dedup.identified(own), 35)
    index = substring_dedup.FingerprintIndex(spark, path)
    assert len(index.state["runs"]) <= 3 and len(index.state["anchors"]) == len(rows)
    got = [tuple(r)[1:] for r in substring_dedup.kept_words(index, df).orderBy("doc_id").collect()]
    assert got == plain_repeats([t for _, t in rows]) == [tuple(r)[1:] for r in substring_dedup.remove_repeats(df, batches=1).orderBy("doc_id").collect()]
    a, b = index.runs[0].select("fp"), index.runs[-1].select("fp")
    plan = a.join(b.hint("merge"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.delete()


def test_op2_sql(spark):
    got = sorted(tuple(r) for r in substring_dedup.op2_substring_dedup(spark, D).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    assert got == sorted(con.execute(substring_dedup.OP2_SQL).fetchall())


# ---- media


def test_media_round_trip(docs, nothing):
    got = avi_media.read_back(avi_media.to_media(docs)).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for _, text, *_ in ROWS:
        raw = avi_media.padded((text or "").encode())
        assert len(raw) % 64 == 0 and raw
        want[(len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))] += 1
    assert Counter((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert avi_media.media_clips(avi_media.to_media(nothing)).count() == 0


def test_every_byte_and_damage():
    rng = np.random.default_rng(0)
    payloads = [bytes(range(256)) * 5, rng.integers(0, 256, 64 * 37).astype(np.uint8).tobytes(), b"\xff\x00" * 320]
    for p, (grey, rate, n) in zip(payloads, avi_media.read_files(avi_media.write_avis(payloads))):
        assert grey.ravel().tobytes()[:n] == p and rate == avi_media.RATE
    with pytest.raises(ValueError):
        avi_media.parse_avi(b"RIFF")


def test_bad_media_give_error_rows(spark):
    good = avi_media.write_avis([bytes(range(64)) * 40])[0]
    files = [good, None, b"", b"RIFF", good[: len(good) // 2], good[:200] + b"\x00" * 60 + good[260:], b"RIFF\x04\x00\x00\x00AVI ", good.replace(b"\xff\xc0", b"\xff\xc2"), good, b"\x00" * 500]
    df = spark.createDataFrame([(i, 2560, m) for i, m in enumerate(files)], "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: r for r in avi_media.read_back(df).collect()}
    assert len(got) == len(files) and [i for i, r in got.items() if r["error"] is None] == [0, 8]
    assert got[0]["payload_sha256"] == got[8]["payload_sha256"] == hashlib.sha256(bytes(range(64)) * 40).hexdigest()
    assert all(got[i]["payload_bytes"] is None and got[i]["feature"] is None for i in got if got[i]["error"]) and got[1]["media_bytes"] is None and got[4]["media_bytes"] == len(files[4])
    clips = avi_media.media_clips(df).collect()
    assert sorted(r["doc_id"] for r in clips if r["error"]) == [1, 2, 3, 4, 5, 6, 7, 9] and {r["doc_id"] for r in clips if r["clip"] is not None} == {0, 8}


def encoded(planes, quantizer, sampling):
    """A baseline JPEG by the book, one block at a time: planes of whole blocks, flat Huffman tables of 8 bits, a restart after every unit row."""
    import struct as st

    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    basis = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    dc_codes, ac_codes = {k: (k, 8) for k in range(12)}, {s: (i, 8) for i, s in enumerate(sorted(r << 4 | k for r in range(16) for k in range(11) if k or r in (0, 15)))}
    bits_of = lambda v: format(v if v >= 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    seg = lambda m, body: st.pack(">BBH", 255, m, len(body) + 2) + body
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    high, wide = planes[0].shape[0] * vmax // sampling[0][1], planes[0].shape[1] * hmax // sampling[0][0]
    table = lambda codes: bytes([0] * 7 + [len(codes)] + [0] * 8) + bytes(codes)
    across, down = wide // (8 * hmax), high // (8 * vmax)
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(list(quantizer))) + seg(0xC0, st.pack(">BHHB", 8, high, wide, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += seg(0xC4, b"\0" + table(dc_codes)) + seg(0xC4, b"\x10" + table(ac_codes)) + seg(0xDD, st.pack(">H", across)) + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    pixels = []
    for row in range(down):
        text, last = "", [0] * len(planes)
        for col in range(across):
            for c, (h, v) in enumerate(sampling):
                for y, x in itertools.product(range(v), range(h)):
                    block = planes[c][(row * v + y) * 8 : (row * v + y) * 8 + 8, (col * h + x) * 8 : (col * h + x) * 8 + 8].astype(float) - 128
                    z = np.rint((basis @ block @ basis.T).ravel()[zigzag] / quantizer).astype(int)
                    if c == 0:
                        back = np.zeros(64)
                        back[zigzag] = z * quantizer
                        pixels.append(np.clip(np.rint(basis.T @ back.reshape(8, 8) @ basis) + 128, 0, 255))
                    d, last[c] = z[0] - last[c], z[0]
                    text += format(dc_codes[abs(int(d)).bit_length()][0], "08b") + bits_of(int(d))
                    run = 0
                    for k in range(1, 64):
                        if z[k] == 0:
                            run += 1
                            continue
                        while run > 15:
                            text, run = text + format(ac_codes[0xF0][0], "08b"), run - 16
                        text, run = text + format(ac_codes[run << 4 | abs(int(z[k])).bit_length()][0], "08b") + bits_of(int(z[k])), 0
                    if run:
                        text += format(ac_codes[0][0], "08b")
        text += "1" * (-len(text) % 8)
        out += bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0") + bytes([255, 0xD9 if row == down - 1 else 0xD0 + row % 8])
    return out, np.array(pixels).ravel()


def test_foreign_frames_by_a_plain_encoder():
    rng = np.random.default_rng(5)
    quantizer = np.arange(3, 67)
    smooth = lambda h, w: np.clip(128 + 60 * np.sin(np.arange(h)[:, None] / 5) + 40 * np.cos(np.arange(w) / 3) + rng.normal(0, 20, (h, w)), 0, 255)
    grey = [encoded([smooth(16, 40)], quantizer, [(1, 1)]) for _ in range(2)]
    colour = [encoded([smooth(32, 48), smooth(16, 24), smooth(16, 24)], quantizer, [(2, 2), (1, 1), (1, 1)]), encoded([smooth(16, 16)] * 3, quantizer, [(1, 1)] * 3)]
    for got, (_, want) in zip(avi_media.decode_frames([x for x, _ in [*grey, *colour]]), [*grey, *colour]):
        assert len(got) == len(want) and np.abs(got.astype(float) - want).max() <= 1 and (got != want).mean() < 0.01


def test_standard_tables_are_the_library_of_java(spark):
    """Java's image library has the standard's tables as constants."""
    known = spark._jvm.javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for at, name in ((0, "StdDCLuminance"), (1, "StdDCChrominance"), (16, "StdACLuminance"), (17, "StdACChrominance")):
        table = getattr(known, name)
        lengths, values = list(table.getLengths()), list(table.getValues())
        assert list(avi_media.standard_tables()[at]) == lengths + [0] * (16 - len(lengths)) + values


def test_frames_without_tables():
    """A camera's frames leave the standard tables out."""
    tables = avi_media.standard_tables()
    payload = np.random.default_rng(7).integers(0, 256, 64).astype(np.uint8)
    # flat blocks: a difference's size and bits, then the end of the block
    dc, ac = (avi_media._codes(list(t[:16]), list(t[16:])) for t in (tables[0], tables[16]))
    text, last = "", 0
    for v in payload.tolist():
        d, last = v - 128 - last, v - 128
        size = abs(d).bit_length()
        code, bits = dc[size]
        text += format(code, f"0{bits}b") + (format(d if d >= 0 else d + (1 << size) - 1, f"0{size}b") if size else "") + format(ac[0][0], f"0{ac[0][1]}b")
    text += "1" * (-len(text) % 8)
    scan = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")
    frame = b"\xff\xd8\xff\xdb\0\x43\0" + bytes([8] * 64) + b"\xff\xc0\0\x0b\x08\0\x40\0\x40\x01\x01\x11\0" + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + scan + b"\xff\xd9"
    assert avi_media.decode_frames([frame])[0].tolist() == payload.tolist()


def test_indexes_of_other_writers():
    """Offsets from the file's start, and OpenDML's indexes of a stream in place of idx1."""
    import struct

    payload = np.random.default_rng(8).integers(0, 256, 64 * 900).astype(np.uint8).tobytes()
    (own,) = avi_media.write_avis([payload])
    spans, rate, length = avi_media.parse_avi(own)
    at = own.index(b"idx1")
    entries = np.frombuffer(own[at + 8 :], "<u4").reshape(-1, 4).copy()
    entries[:, 2] += own.index(b"movi")
    assert avi_media.parse_avi(own[: at + 8] + entries.tobytes()) == (spans, rate, length)
    # a super index in the stream's list names one standard index behind the frames
    base = 12
    ix = struct.pack("<HBBI4sQI", 2, 0, 1, len(spans), b"00dc", base, 0) + b"".join(struct.pack("<II", a + 40 + 8 - base, b - a) for a, b in spans)
    where = at + 40 + 8
    indx = b"indx" + struct.pack("<I", 40) + struct.pack("<HBBI4s12s", 4, 0, 0, 1, b"00dc", bytes(12)) + struct.pack("<QII", where, len(ix) + 8, len(spans))
    strl = own.index(b"strl")
    grown = bytearray(own[: strl + 4] + indx + own[strl + 4 : at] + b"ix00" + struct.pack("<I", len(ix)) + ix)
    for name, more in ((b"strl", len(indx)), (b"hdrl", len(indx))):
        size = grown.index(name) - 4
        struct.pack_into("<I", grown, size, struct.unpack_from("<I", grown, size)[0] + more)
    struct.pack_into("<I", grown, 4, len(grown) - 8)
    again = avi_media.parse_avi(bytes(grown))
    assert again == ([(a + len(indx), b + len(indx)) for a, b in spans], rate, length) and len(spans) > 0
    assert [bytes(grown[a:b]) for a, b in again[0]] == [own[a:b] for a, b in spans]


def test_a_long_file_goes_in_parts(monkeypatch):
    monkeypatch.setattr(avi_media, "AT_ONCE", 3)
    payload = np.random.default_rng(4).integers(0, 256, 64 * 100).astype(np.uint8).tobytes()
    files = avi_media.write_avis([payload, payload[:64]])
    monkeypatch.undo()
    assert files == avi_media.write_avis([payload, payload[:64]]) and avi_media.read_files(files)[0][0].ravel().tobytes()[:6400] == payload


def test_shots_find_a_change_of_scene():
    rng = np.random.default_rng(1)
    calm, other = rng.integers(0, 32, (20, 512)).astype(np.uint8), rng.integers(180, 250, (15, 512)).astype(np.uint8)
    assert avi_media.shots(np.concatenate([calm, other])) == [(0, 20), (20, 35)]


# ---- decontamination


def test_ids_of_one_name(spark):
    text = "the committee reviewed the quarterly figures and found them in order"
    docs, items = (spark.createDataFrame([(i, t)], "id long, text string") for i, t in ((1, f"well, {text} today"), (7, text)))
    assert [(r["id"], r["item_id"]) for r in decontaminate.contamination(docs, items, id_col="id", item_col="id").collect()] == [(1, 7)]


def plain_distance(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        now = [i + 1]
        for j, b in enumerate(t):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_myers():
    rng = np.random.default_rng(3)
    for _ in range(150):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, 90))) for _ in range(2))
        assert decontaminate.myers(p, t, 999)[0] == plain_distance(p, t)


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, prose(7, 40)), (2, prose(8, 30)), (3, None), (4, "short one"), (5, prose(7, 40))], "item_id long, text string")
    a, b = prose(7, 40), prose(8, 30)
    edited = b[:60] + "#" + b[61:120] + b[122:]
    texts = [prose(9, 50) + "\n" + a.upper() + " " + prose(10, 20), prose(11, 30) + " " + edited + " x", b[: len(b) // 2], "short one", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contamination(df, items, block_chars=300).collect()}
    want = {}
    for (i, t), (n, x) in itertools.product(enumerate(texts), [(r["item_id"], r["text"]) for r in items.collect()]):
        x, t = decontaminate.normalized(x or ""), decontaminate.normalized(t or "")
        if len(x) >= 24 and (e := plain_distance(x, t)) <= decontaminate.budget(len(x), 0.06):
            want[(i, n)] = e
    # short items unchanged and between word ends
    short = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.contamination(df, items).where("short").collect()}
    assert short == {(3, 4): 0}
    assert got == want | short and set(want) == {(0, 1), (0, 5), (1, 2)}
    near = spark.createDataFrame([(0, "a cat, sat"), (1, "concat"), (2, "cats"), (3, "CAT"), (4, "x (cat)")], "doc_id long, text string")
    one = spark.createDataFrame([(1, " Cat "), (2, ""), (3, " ")], "item_id long, text string")
    assert sorted((r["doc_id"], r["match_end"]) for r in decontaminate.contamination(near, one).collect()) == [(0, 5), (3, 3), (4, 6)]
    assert decontaminate.drop_contaminated(near, one).count() == 5 and decontaminate.drop_contaminated(near, one, short_too=True).count() == 2
    assert sorted(r[0] for r in decontaminate.drop_contaminated(df, items).select("doc_id").collect()) == [2, 3, 4, 5]
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(df, items.where("false")).count() == 0


# ---- pages


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two.<p>x</article><footer>&copy; c</footer>", "A & B\nOne two.\nx"),
        ('<body><div class="menu"><a href=x>Home</a></div><div id=c><h2>T</h2><p>Some longer text here.</p></div><div class="reader-comments"><p>I like this page very much.</p></div>', "T\nSome longer text here."),
        ("<article><p>a<br>b</p><script>var x='<p>no</p>';</script><!-- <p>no</p> --><p>c</article>", "a b\nc"),
        ("<article><p>cut off", "cut off"),
        ("<article><aside>no</aside><form><p>no</p></form><p>kept</p></article>", "kept"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


BODY = "<h1>Title</h1><p>First paragraph of the page.</p><p>Second paragraph, a little longer than the first.</p>"
SAID = "Title\nFirst paragraph of the page.\nSecond paragraph, a little longer than the first."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="layout has-sidebar"><nav>Home</nav><article>{BODY}</article></div>', SAID),
        (f'<div class="no-sidebar"><article>{BODY}</article></div>', SAID),
        (f'<div class="sidebar"><article>{BODY}</article></div>', SAID),
        (f'<form><div class="main-menu">{BODY}</div></form>', SAID),
        (f'<article>{BODY}</article><aside><article><p>Teaser of another page.</p></article></aside>', SAID),
        (f'<article>{BODY}</article><div id="comments"><p>{"I like this page very much. " * 9}</p></div>', SAID),
        (f'<article>{BODY}<div class="cookie-banner ad-300x250">no</div></article>', SAID),
        ('<article><section id="discussion"><h2 id="search">Search</h2><p>We found much.</p></section><div class="form-factor">Small.</div></article>', "Search\nWe found much.\nSmall."),
        ("<article><p>x</p><figure><table><tr><td>cell</td></tr></table><pre>code</pre><figcaption>Caption</figcaption></figure><p>where <math><mi>a</mi></math> is</p></article>", "x\ncell\ncode\nCaption\nwhere a is"),
    ],
)
def test_furniture_that_holds_the_text_stays(page, text):
    assert html_text.main_text(page) == text


ADVERT, LONGER = '<div class="ad"><p>Buy this now.</p></div>', "<p>" + "This is the body of the text. " * 20 + "</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div><h1>Title</h1>{ADVERT}{LONGER}{ADVERT}<p>The end of it.</p></div></body>", "Title\n" + ("This is the body of the text. " * 20).strip() + "\nThe end of it."),
        (f"<body><div>{LONGER}{ADVERT}<p><a href=x>More on this</a></p>{ADVERT}<p>The end of it.</p></div></body>", ("This is the body of the text. " * 20).strip() + "\nMore on this\nThe end of it."),
        (f"<body><div>{LONGER}</div>{ADVERT}<div><p>Another box.</p></div></body>", ("This is the body of the text. " * 20).strip()),
        (f"<body><div>{LONGER}{ADVERT}<p>The end of it.</p></div><nav>x</nav><div><article><p>Teaser.</p></article></div></body>", ("This is the body of the text. " * 20).strip() + "\nThe end of it."),
        (f"<body><article>{LONGER}{ADVERT}<p>The end of it.</p></article><div><p>A line outside.</p></div></body>", ("This is the body of the text. " * 20).strip() + "\nThe end of it."),
    ],
)
def test_what_was_taken_out_does_not_part_a_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_against_their_article(spark):
    from html import unescape

    for r, p in zip(html_text.op5_html_text(spark, D).orderBy("page_id").collect(), spark.read.parquet(f"{D}/pages.parquet").orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


MORE = "<p>" + "Another part that goes on for a while. " * 12 + "</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<article><header><h1>Title</h1></header>{MORE}</article><article class="comment"><p>{"I like it. " * 30}</p></article>', "Title\n" + ("Another part that goes on for a while. " * 12).strip()),
        (f"<main><article><h1>Title</h1>{MORE}</article><article><h2>Next</h2><p>Teaser of it.</p></article></main>", "Title\n" + ("Another part that goes on for a while. " * 12).strip()),
        *((f'<div class="{c}">{MORE}</div>', ("Another part that goes on for a while. " * 12).strip()) for c in ("page-with-sidebar", "market-share", "long-form", "side-by-side")),
        (f'<div id="page-with-sidebar"><h1>Title</h1>{MORE}</div>', "Title\n" + ("Another part that goes on for a while. " * 12).strip()),
        (f"<div><div><h1>Title</h1></div><div>{MORE}</div></div><div>Short words here.</div>", "Title\n" + ("Another part that goes on for a while. " * 12).strip()),
        (f"<div><div>{MORE}</div><div>{MORE}</div><div><p>End of it.</p></div></div><div>Short words here.</div>", "\n".join([("Another part that goes on for a while. " * 12).strip()] * 2 + ["End of it."])),
        (f"<div><ul><li><a href=x>Some link of the page</a><li><a href=y>Another link</a><li><a href=z>A third</a></ul></div><div>{MORE}<ul><li><a href=x>Source</a></ul></div>", ("Another part that goes on for a while. " * 12).strip() + "\nSource"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<body><section><p>The first part.</p></section><section><p>The second part.</p></section><div>x</div></body>", "The first part.\nThe second part."),
        ("<body><p>One of two lines here.</p><div class=ad>Buy</div><p>Two of two lines here.</p></body>", "One of two lines here.\nTwo of two lines here."),
    ],
)
def test_the_distribution_decides(page, text):
    assert html_text.main_text(page) == text


def article_of(page):
    from html import unescape

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)) if b)


def test_pages_with_neutral_names():
    pages = [x for (x,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    plain = [re.sub(r'<div class="\w+">', "<div>", re.sub(r"<(/?)(?:nav|footer|article)>", r"<\1div>", x)) for x in pages]
    right = sum(html_text.main_text(x) == article_of(y) for x, y in zip(plain, pages))
    assert right >= 0.95 * len(pages)


def test_pages_operator(spark):
    rows = [(1, "a", BODY), (1, "a", BODY), (2, None, None), (None, "b", ""), (3, "c", "<p>" + "long text " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(-1), "k0": F.lit(1)})
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter([(1, "a", SAID, len(SAID))] * 2 + [(2, None, "", 0), (None, "b", "", 0), (3, "c", ("long text " * 30_000).strip(), 299_999)])
    assert html_text.extract_text(df.where("false")).count() == 0


# ---- packing


def test_packing(spark, docs, nothing):
    got = packing.pack(docs, packing.word_vocabulary(), capacity=64).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_vocabulary())
    want = Counter()
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[s : s + 64], "<u4")
            want[(i, k, s, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert packing.pack(nothing, packing.word_vocabulary()).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_best_fit_is_close_to_the_least(spark, partitions):
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1.2, 6_000).astype(int), 1, 4096)
    lengths[::3] = 500  # a size that a third has
    rows = spark.createDataFrame([(i, 0, 0, int(n), 0, i) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long, tie long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = packing.best_fit(rows, 4096, packing.Workspace(spark, "test")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["length"] for r in got) == Counter(lengths.tolist()) and len({r["id"] for r in got}) == len(lengths)
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096
    assert len(by) <= 1.005 * -(-int(lengths.sum()) // 4096) + 1


@pytest.mark.parametrize("method", ["by_lengths", "in_rounds"])
def test_both_ways_of_packing_fill_sequences(spark, method):
    rng = np.random.default_rng(4)
    lengths = [*rng.integers(1, 97, 300).tolist(), *[31] * 200, *[96] * 5]
    rows = spark.createDataFrame([(i % 7, 0, 0, n, 0, i) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long, tie long")
    got = getattr(packing, method)(rows, 96, packing.Workspace(spark, "test")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter((r["id"], r["length"]) for r in got) == Counter((i % 7, n) for i, n in enumerate(lengths))
    for own in map(sorted, by.values()):
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 96


@pytest.mark.parametrize("seed", range(20))
def test_length_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 41, rng.integers(0, 400)).tolist(), reverse=True)
    left, sequences = [], 0
    for n in lengths:
        fits = [g for g in left if g >= n]
        if fits:
            left.remove(min(fits))
        else:
            sequences += 1
        left.append((min(fits) if fits else 40) - n)
    plan, counts = packing.length_plan(dict(Counter(lengths)), 40), Counter(lengths)
    used = defaultdict(list)
    for k, (length, since, first, each, offset) in enumerate(plan.tolist()):
        until = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        for nth in range(int(until) - since):
            used[first + nth // each].append((offset + nth % each * length, length))
    assert Counter(n for own in used.values() for _, n in own) == counts and sorted(used) == list(range(sequences))
    for own in map(sorted, used.values()):
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 40
    assert sorted(40 - sum(sorted(own)[-1]) for own in used.values()) == sorted(left)


def test_packing_takes_as_many_jobs_whatever_the_partitions(spark):
    """A plan over lengths, no rounds of exchanges: on many small partitions each round had cost a pass over all of them."""
    rows = spark.range(3000).selectExpr("id", "0 piece", "0L start", "1 + pmod(xxhash64(id), 4096) length", "0L ids_crc32", "id tie")
    tables = []
    for partitions in (3, 60):
        work = packing.Workspace(spark, "test")
        packing.best_fit(rows.repartition(partitions), 4096, work)
        tables.append(work._n)
    assert tables == [1, 1]


@pytest.mark.parametrize("seed", range(20))
def test_successors_by_a_plain_sweep(seed):
    rng = np.random.default_rng(seed)
    pieces, gaps = rng.integers(1, 12, rng.integers(0, 30)), rng.integers(1, 14, rng.integers(0, 30))
    left, want = Counter(gaps.tolist()), Counter()
    for size in sorted(pieces.tolist(), reverse=True):
        fits = [g for g in left if left[g] and g >= size]
        if fits:
            left[min(fits)] -= 1
            want[size, min(fits)] += 1
    p, g = packing.successors(pieces, gaps)
    assert Counter(zip(pieces[p].tolist(), gaps[g].tolist())) == want and len(set(p.tolist())) == len(p) and len(set(g.tolist())) == len(g)


def test_plan_gives_each_gap_once():
    parts = [{"part": 3, "pieces": 2, "largest": 90, "gaps": 5, "least": 80}, {"part": 2, "pieces": 7, "largest": 30, "gaps": 1, "least": 40}, {"part": 0, "pieces": 9, "largest": 10, "gaps": 0, "least": None}]
    assert packing.plan_between(parts) == [(2, 0, 6, 3, 4, 2), (2, 6, 7, 3, 1, 1), (0, 0, 4, 2, 0, 4), (0, 4, 9, 3, 0, 5)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.word_vocabulary()), packing.Encoder(packing.word_vocabulary())
    texts = ["a\x1cb", "x\x85y z\xa0w", "it's don't 's", "<|endoftext|> hi<|endoftext|>", "ÀÉ ΣΑΣ ς", "１２３ 12ab!!", "é ́x", "", "  ", "a᠎b​c", "日本語", "\U0001f600ok", "İI", "", None]
    for end in (None, 1):
        ids, cuts = e.encode(pa.array(texts), end)
        got = [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
        assert got == [t.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end]) for text in texts]


# ---- line dedup


def test_lines(spark, docs, nothing):
    rows = [(i, f"menu\nown {i}\n\nfoot", "s" if i < 8 else None) for i in range(12)] + [(20, None, "s"), (21, "menu", "s"), (22, "menu\nmenu", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"row": F.lit(1), "kept": F.lit(2), "host": F.lit(3)})
    for most in (16 << 20, -1):  # broadcast, and merged by host
        got = {r["doc_id"]: r["text"] for r in line_dedup.drop_site_boilerplate(df, ratio=0.5, broadcast_bytes=most).collect()}
        assert got == {**{i: f"own {i}\n" for i in range(12)}, 20: None, 21: "", 22: "menu\nmenu"}
    copied = df.where("doc_id < 8").union(df.where("doc_id = 0").crossJoin(spark.range(50)).drop("id"))
    assert line_dedup.drop_site_boilerplate(copied, ratio=0.5).where("text = 'own 0\\n'").count() == 51
    assert line_dedup.drop_site_boilerplate(docs).columns == docs.columns and line_dedup.drop_site_boilerplate(docs).count() == len(ROWS)
    assert line_dedup.drop_site_boilerplate(nothing).count() == 0


def test_op7_sql(spark):
    got = sorted(tuple(r) for r in line_dedup.op7_line_dedup(spark, D).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    assert got == sorted(con.execute(line_dedup.OP7_SQL).fetchall())


def test_op7_sql_where_lines_go(spark, tmp_path):
    rows = [(i, f"menu\nown {i}\n\nfoot {i % 3}", "s" if i % 2 else None) for i in range(60)] + [(100 + i, "a copied\ntext", "s") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in line_dedup.op7_line_dedup(spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(line_dedup.OP7_SQL).fetchall())
    kept = {r[0]: r[2] for r in got}
    assert all(kept[100 + i] == len("a copied\ntext") for i in range(50)) and all(kept[i] == len(f"own {i}\n") for i in range(60))


# ---- quality


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    m = quality.LineModel(np.zeros(1), np.ones(1), np.ones(1), rng.normal(size=(2, 2)))
    row, e = np.array([0] * 3 + [1] + [2] * 5), rng.normal(size=9)
    p, moves = quality.marginals(m, e, row)
    want = np.zeros((2, 2))
    for k in range(3):
        own, whole, good = e[row == k], 0.0, 0.0
        part = np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=len(own)):
            w = np.exp(sum(v for v, b in zip(own, y) if b) + sum(m.moves[a, b] for a, b in zip(y, y[1:])))
            whole, good = whole + w, good + w * np.array(y)
            for a, b in zip(y, y[1:]):
                part[a, b] += w
        assert np.allclose(good / whole, p[row == k])
        want += part / whole
    assert np.allclose(want, moves)


def test_pieces_do_not_change_marginals():
    rng = np.random.default_rng(3)
    m = quality.LineModel(np.zeros(1), np.ones(1), np.ones(1), rng.normal(size=(2, 2)))
    row = np.repeat(np.arange(7), [1, 2, 3, 7, 50, 64, 301])
    e = rng.normal(size=len(row)) * 2
    whole = quality.marginals(m, e, row, 1000)
    for piece in (1, 2, 7, 50):
        p, expected = quality.marginals(m, e, row, piece)
        assert np.allclose(p, whole[0], atol=1e-10) and np.allclose(expected, whole[1], atol=1e-8)


def test_a_text_of_very_many_lines():
    import time

    m = quality.LineModel(np.zeros(39), np.ones(39), np.ones(39) / 10, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    began = time.process_time()
    score, lines, good = quality.text_scores(m, pa.array(["word\n" * 400_000, "a", None]))
    assert lines.tolist() == [400_001, 1, 1] and (0 <= score).all() and (score <= 1).all() and time.process_time() - began < 60


def test_quality(spark, docs, nothing):
    got = quality.op8_quality(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.8
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    model = quality.fit_on_labels(spark, D)
    assert quality.score(docs, model).count() == len(ROWS)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(nothing, model).count() == 0
    assert quality.fit(nothing.withColumn("quality", F.lit(1))) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


# ---- languages


def test_languages(spark, docs, nothing):
    truth = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang")
    got = language_id.op9_language_id(spark, D).join(truth, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    model = language_id.fit(spark.read.parquet(f"{D}/documents.parquet"))
    small = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the and of"), (5, "日本")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(small, model).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and found[4][0] == "en" and found[5][0] in model.languages
    assert language_id.predict(docs, model).count() == len(ROWS)
    assert language_id.predict(docs, language_id.fit(nothing)).select("lang_pred").distinct().collect()[0][0] == "und"


def plain_languages(train, texts, longest=5):
    """(language, score) by dictionaries alone."""
    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    langs = sorted({x for _, x in train})
    counts = {x: Counter(w for t, lang in set(train) if lang == x for w in words(t)) for x in langs}
    vocabulary = set().union(*counts.values())
    grams = {n: {x: Counter() for x in langs} for n in range(1, longest + 1)}
    for x in langs:
        for w, c in counts[x].items():
            for n in grams:
                for i in range(len(w) + 3 - n):
                    grams[n][x][f"_{w}_"[i : i + n]] += c
    log = lambda c, whole, size: np.log(c + 0.5) - np.log(whole + 0.5 * size)
    of = lambda table, key: np.array([log(table[x][key], sum(table[x].values()), len(set().union(*table.values()))) for x in langs])
    out = []
    for t in texts:
        total, own = np.zeros(len(langs)), words(t)
        for w in own:
            if w in vocabulary:
                total += of(counts, w)
                continue
            for n in range(longest, 0, -1):
                known = [g for i in range(len(w) + 3 - n) if any((g := f"_{w}_"[i : i + n]) in grams[n][x] for x in langs)]
                if known:
                    total += np.mean([of(grams[n], g) for g in known], axis=0)
                    break
        best = int(total.argmax())
        out.append((langs[best], float(1 / np.exp(total - total.max()).sum())) if own else ("und", 0.0))
    return out


def test_whole_predictions_by_a_plain_version(spark, nothing):
    train = [("der hund und die katze", "de"), ("das haus und der garten", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("the dog and the cat", "en"), ("un chat, deux chats; der", "fr"), ("ναι", "el")]
    texts = ["der dog", "hunde katzen", "thee cats", "und", "chatte", "", None, "12 !", "zzz q", "the the der", "Ναι ναι ο"]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    got = [(r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    want = plain_languages(train, texts)
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert language_id.predict(nothing, model).count() == 0


def test_unseen_words_back_off():
    one = lambda *rows: language_id.Scores(np.zeros(2), np.arange(0, 2 * len(rows) + 1, 2), np.tile([0, 1], len(rows)).astype(np.int32), np.array(rows, float).ravel())
    grams = {"abc": (3, 0), "_a": (2, 0), "z": (1, 0)}
    m = language_id.LanguageModel(["x", "y"], np.zeros(1, np.uint64), one([0, 0]), grams, {3: one([-1, -5]), 2: one([-2, -1]), 1: one([-3, -4])}, 3)
    assert m.unseen("abc").tolist() == [-1.0, -5.0] and m.unseen("ax").tolist() == [-2.0, -1.0] and m.unseen("zz").tolist() == [-3.0, -4.0] and m.unseen("q") is None


# ---- near duplicates


def plain_classes(rows, threshold=0.8):
    bags = []
    for _, t in rows:
        w = (t or "").encode().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] is None or rows[j][1] is None:
            continue
        both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
        if rows[i][1] == rows[j][1] or (either and both / either >= threshold):
            group[root(i)] = root(j)
    return Counter(frozenset(k for k in range(len(rows)) if root(k) == g) for g in {root(k) for k in range(len(rows))})


def edited(text, k, seed):
    w, rng = text.split(), np.random.default_rng(seed)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"edit{seed}_{i}"
    return " ".join(w)


def test_batches_to_python_are_small(spark):
    """Long texts go to Python in batches of a few MB, not of 64 MB or 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, "64m")
    near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")).collect()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    found = spark.range(24).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1).mapInArrow(sizes, "bytes long").collect()
    assert max(r["bytes"] for r in found) <= 6 << 20
    spark.conf.set(name, "1m")
    near_dedup.near_duplicates(spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string"))
    assert spark.conf.get(name) == "1m"  # a lower limit stays
    spark.conf.unset(name)


def test_near_duplicates(spark, nothing):
    base = [prose(100 + i, 250) for i in range(4)]
    texts = base + [edited(base[0], k, k) for k in (1, 2, 3, 4, 8, 20)] + [edited(base[1], 2, 50 + k) for k in range(12)] + [base[2], base[2], None, None, "", "", "few words", "few  words", LONG + " end"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tid": F.lit(1), "row": F.lit(2), "class_id": F.lit(3)})
    got = defaultdict(set)
    for r in near_dedup.near_duplicates(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert all(min(v) == k for k, v in got.items())
    assert Counter(map(frozenset, got.values())) == plain_classes(rows)
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(got)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_repeated_rows_leave_one(spark, docs):
    left = near_dedup.drop_near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([1, 2, 3, None, 7, 8, 9, 10])


def test_signatures_estimate_similarity():
    a, k = prose(5, 600), 1024
    b = edited(a, 15, 1)
    cells, of = near_dedup.unit_cells(*near_dedup.utf8(pa.array([a, b, "one"])), 5)
    s = near_dedup.dart_signatures(cells, of, 3, k)
    x, y = set(cells[of == 0].tolist()), set(cells[of == 1].tolist())
    true = len(x & y) / len(x | y)
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)
    assert (s[2] != 0).all() and (s[0] != s[2]).all()


@pytest.mark.parametrize("least_block", [512, 8])
def test_groups_about_the_threshold(spark, monkeypatch, least_block):
    """Documents alike by about 0.7 to 0.85: classes equal brute force, also with many blocks, and links left open are fewer than members."""
    monkeypatch.setattr(near_dedup, "BLOCK", least_block)
    if least_block == 8:  # as if tables were too large to be broadcast
        monkeypatch.setattr(near_dedup.Workspace, "joinable", lambda self, table, limit=0: table.hint("merge"))
    base = prose(900, 300)
    rows = list(enumerate(edited(base, 4 + i % 6, 1000 + i) for i in range(60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in near_dedup.near_duplicates(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert Counter(map(frozenset, got.values())) == plain_classes(rows)


def test_forest_has_fewer_links_than_members(spark):
    texts = [edited(prose(901, 200), 1, 2000 + i) for i in range(40)] + [prose(902 + i, 200) for i in range(5)]
    df = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "tid binary, text string")
    sketches = near_dedup._sketches(df, 36, 7, 5)
    for home, most in ((b"", 39), (bytes([0]), 2 * 39)):
        members = df.select(F.lit(b"p").alias("pivot"), "tid", F.col("tid").alias("label"), F.lit(home).alias("home"))
        found = near_dedup._left_open(members, sketches, df, 0.8, 252, 5).collect()
        assert 39 <= len(found) <= most and len({x for r in found for x in (bytes(r["a"]), bytes(r["b"]))}) == 40


# ---- chats


def test_markers():
    seen = [chat_format.read_marker(x)[0] for x in ["User: hi", "### Response: ok", "<|assistant|> yes", "[INST] do", "Note: x", ">> hello", "**Human:** q", "a", "system: s"]]
    assert seen == [3, 4, 4, 3, 0, 1, 3, 0, 2]


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(6)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = chat_format.ChatModel(log(3), log(3, 3), log(3, 5), log(3, len(chat_format._LENGTHS) + 1), log(3, 5)).fixed()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 7))
        seen = np.stack([rng.integers(0, 5, n), rng.integers(0, 5, n), rng.integers(0, 5, n), rng.integers(0, 5, n), np.arange(n) == 0, (np.arange(n) == 0) | (rng.random(n) < 0.5), rng.integers(0, 1 << 40, n)], axis=1).astype(np.int64)
        emission = model.emission(seen)
        score = lambda path: sum(emission[t, path[t]] + (model.start[path[0]] if t == 0 else model.step(seen[t])[path[t - 1], path[t]]) for t in range(n))
        best = max(itertools.product(range(3), repeat=n), key=score)
        last, back = chat_format._best(model, seen, np.zeros(3, np.int64))
        roles, _ = chat_format._path(back, int(last.argmax()))
        assert last.max() == score(best) and tuple(roles) == best
        if n > 2:  # cut in two, joined by the matrices of the parts
            a, b = chat_format._matrix(model, seen[:2]), chat_format._matrix(model, seen[2:])
            assert (a[:, :, None] + b[None]).max() == score(best)


def test_markers_are_learned(spark):
    """Where labelled turns use a name against its sense, it means what they say."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{('Bot', 'User')[t % 2]}: " + "word " * 20) for c in range(100) for t in range(4)]
    model = chat_format.fit(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert model.marker[1, 4] > model.marker[2, 4] and model.marker[2, 3] > model.marker[1, 3] and (model.marker[:, :2] == model.marker[0, 0]).all()


def test_chat_on_edge_rows(spark):
    model = chat_format.fit(spark.read.parquet(f"{D}/conversations.parquet"))
    rows = [(1, 0, ">> hi"), (1, 1, ">> " + "long words " * 100_000), (1, 2, None), (None, 0, "User: x"), (None, 0, "User: x"), (2, None, ""), (2, 3, "line\n" * 5_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, text string").withColumns({"role": F.lit("x"), "conv": F.lit(1), "at": F.lit(2), "first": F.lit(3)})
    got = chat_format.recover_turns(df, model).collect()
    assert Counter((r["conv_id"], r["turn"]) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert {len(r["roles"]) for r in got} == {1, 5001} and all(r["role"] in chat_format.ROLES for r in got)
    assert chat_format.recover_turns(df.where("false"), model).count() == 0


def test_chat(spark):
    turns = spark.read.parquet(f"{D}/conversations.parquet")
    model = chat_format.fit(turns)
    rows = [(1, 0, "System: be kind"), (1, 1, "User: hello?"), (1, 2, "AI: " + "words " * 90 + "\nmore"), (2, 0, None), (None, 0, ">> x"), (2, 0, None), (3, 0, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit(1))
    got = chat_format.recover_turns(df, model).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["turn"])
    assert [r["role"] for r in one] == ["system", "user", "assistant"] and one[2]["roles"] == "aa"
    assert "".join(r["rendered"] for r in one).startswith("<|system|>\nbe kind\n<|end|>\n<|user|>\nhello?\n<|end|>\n<|assistant|>\n")
    found = chat_format.op1_chat_format(spark, D).join(turns.select("conv_id", "turn", F.col("role").alias("truth")), ["conv_id", "turn"]).collect()
    assert np.mean([r["role"] == r["truth"] for r in found]) > 0.95
    assert chat_format.recover_turns(df.where("false"), model).count() == 0


def test_chat_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(7 if i < 1500 else i // 5, i, (">> " if rng.random() < 0.6 else "") + "x" * int(rng.integers(0, 400))) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model, out = chat_format.fit(spark.read.parquet(f"{D}/conversations.parquet")), []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(tuple(r) for r in chat_format.recover_turns(df, model).collect()))
    for k, v in before.items():
        spark.conf.set(k, v)
    assert out[0] == out[1]
