import random

import duckdb
import numpy as np
import pytest

from sparkloom.llm import chat, queries, url_filter, webp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "\\", "\\h\\l\\b", "### Assistant\nhi</turn>\n<next>", "#<\\", "é🙂\n", "</turn>\n### user\n"]
    rng, turns = random.Random(1), []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            turns.append((c, t if c % 5 else rng.choice([None, 1, 2]), rng.choice(["user", "assistant", "system", None, "a#\nb\\n"]), rng.choice(texts), "x"))
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    for r in chat.parse(formatted).collect():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text, _ in turns if c == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[2:] for x in own]
        at, masked = 0, ""
        for run in r["loss_runs"]:
            at += run["skip"]
            masked += r["formatted"][at : at + run["take"]]
            at += run["take"] + run["skip_after"]
        assert at == len(r["formatted"])
        assert masked.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") == "".join(x[3] for x in own if x[2] == "assistant")
        merged = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count(chat.END) == merged
    assert chat.summary(chat.format_chats(df.limit(0))).collect() == []
    assert chat.summary(chat.format_chats(df.where("false").union(df.limit(1)))).count() == 1


RULES = [("org", "/", "allow"), ("b.org", "/x", "block"), ("b.org", "/x", "allow"), ("a.b.org", "/x", "allow"), (None, "/", "block"), ("com", "", "block")]


def test_url_filter(spark):
    urls = [(1, "http://A.b.ORG/xyz?q"), (2, "http://b.org/x"), (3, "http://bb.org/x"), (4, None), (5, "no scheme"), (6, "http://x.com"), (7, "http://com.x/"), (8, ""), (9, "http://c.org#/x"), (9, "http://c.org#/x")]
    pages = spark.createDataFrame([(i, u, "z") for i, u in urls], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    for limit in (url_filter.BROADCAST_RULES, 0):  # sent to all executors, and by a shuffle
        url_filter.BROADCAST_RULES, before = limit, url_filter.BROADCAST_RULES
        found = url_filter.judge(pages, rules).collect()
        url_filter.BROADCAST_RULES = before
        assert sorted(map(tuple, found), key=repr) == sorted(((i, *brute(u)) for i, u in urls), key=repr)
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), rules).collect() == []


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def file(self):
        data = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        data += b"\0" * (len(data) & 1)
        return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data

    def start(self, width, height):
        self.put(0x2F, 8), self.put(width - 1, 14), self.put(height - 1, 14), self.put(0, 4)

    def flat_code(self, size, used):
        """A normal code in which the first `used` (a power of two) symbols have the same length."""
        n = used.bit_length() - 1
        self.put(0, 1), self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(int(s in (0, n)), 3)
        self.put(0, 1)
        for s in range(size):
            self.put(int(s < used), 1)

    def symbol(self, value, n):
        self.bits += [value >> (n - 1 - k) & 1 for k in range(n)]

    def one(self, value):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(value, 8)

    def argb(self, pixels, top=False):
        """An image of literals: flat codes of 8 bits for green, red, blue and alpha."""
        self.put(0, 1)
        if top:
            self.put(0, 1)
        for size in (280, 256, 256, 256):
            self.flat_code(size, 256)
        self.one(0)
        for a, r, g, b in pixels:
            for v in (g, r, b, a):
                self.symbol(v, 8)


def forward_predict(image, modes, block):
    height, width, _ = image.shape
    flat, out = image.reshape(-1, 4).astype(int), np.empty((height * width, 4), int)
    for k in range(len(flat)):
        y, x = divmod(k, width)
        if not k:
            p = np.array([255, 0, 0, 0])
        elif not y:
            p = flat[k - 1]
        elif not x:
            p = flat[k - width]
        else:
            p = webp.predicted(int(modes[(y >> block) * -(-width >> block) + (x >> block)]), flat[k - 1], flat[k - width], flat[k - width - 1], flat[k - width + 1])
        out[k] = (flat[k] - p) & 255
    return out


def test_predictor_and_cross_colour_and_green():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (9, 11, 4))
    block, across, down = 2, 3, 3
    modes = rng.permutation(14)[: across * down]
    w = Writer()
    w.start(11, 9)
    w.put(1, 1), w.put(webp.PREDICTOR, 2), w.put(block - 2, 3)
    w.argb([(255, 0, m, 0) for m in modes])
    residual = forward_predict(image, modes, block)
    factors = rng.integers(0, 256, (across * down, 3))  # red to blue, green to blue, green to red
    w.put(1, 1), w.put(webp.CROSS_COLOUR, 2), w.put(block - 2, 3)
    w.argb([(255, *f) for f in factors])
    signed = lambda v: int(v) - 256 if v > 127 else int(v)
    crossed = residual.copy()
    for k, (_, r, g, b) in enumerate(residual):
        rb, gb, gr = map(signed, factors[(k // 11 >> block) * across + (k % 11 >> block)])
        crossed[k, 1] = (r - (gr * signed(g) >> 5)) & 255
        crossed[k, 3] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) & 255
    w.put(1, 1), w.put(webp.SUBTRACT_GREEN, 2)
    crossed[:, 1] = (crossed[:, 1] - crossed[:, 2]) & 255
    crossed[:, 3] = (crossed[:, 3] - crossed[:, 2]) & 255
    w.put(0, 1)
    w.argb(crossed, top=True)
    assert (webp.decode(w.file())[0] == image).all()


@pytest.mark.parametrize("n_colours", [2, 3, 16, 17])
def test_palette(n_colours):
    rng = np.random.default_rng(n_colours)
    colours, index = rng.integers(0, 256, (n_colours, 4)), rng.integers(0, n_colours, (5, 13))
    pack = 3 if n_colours <= 2 else 2 if n_colours <= 4 else 1 if n_colours <= 16 else 0
    w = Writer()
    w.start(13, 5)
    w.put(1, 1), w.put(webp.PALETTE, 2), w.put(n_colours - 1, 8)
    w.argb(np.diff(np.concatenate([np.zeros((1, 4), int), colours]), axis=0) & 255)
    w.put(0, 1)
    packed = []
    for row in index:
        for x in range(0, 13, 1 << pack):
            packed.append((255, 0, sum(int(v) << (k * (8 >> pack)) for k, v in enumerate(row[x : x + (1 << pack)])), 0))
    w.argb(packed, top=True)
    assert (webp.decode(w.file())[0] == colours[index]).all()


def test_back_references_colour_cache_and_meta_codes():
    w = Writer()
    w.start(8, 4)
    w.put(0, 1)  # no transform
    w.put(1, 1), w.put(1, 4)  # a cache of two colours
    w.put(1, 1), w.put(0, 3)  # meta codes in blocks of four
    w.argb([(255, 0, 0, 0), (255, 0, 1, 0)])
    for _ in range(2):
        w.put(0, 1), w.put(15, 4)  # green: literals 0 to 126 and three other symbols, all of 7 bits but the last two
        for s in webp.LENGTH_ORDER:
            w.put(int(s in (0, 7)), 3)
        w.put(0, 1)
        for s in range(282):
            w.put(int(s < 125 or s in (256 + 6, 280, 281)), 1)
        w.one(9), w.one(8), w.one(255)
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(1, 8)  # distance code 1: one to the left
    w.symbol(5, 7), w.symbol(6, 7)
    w.symbol(125, 7), w.put(0, 2)  # symbol 262: a length of 9 and two extra bits
    pixel = lambda g: (255 << 24) | (9 << 16) | (g << 8) | 8
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> 31
    want, cache = [pixel(5), pixel(6)], [0, 0]
    for v in want:
        cache[slot(v)] = v
    length = ((2 + 0) << 2) + 0 + 1
    want += [want[0]] * 0
    for _ in range(length):
        want.append(want[len(want) - 8] if len(want) >= 8 else None)
    # distance code 2 (index 1) is one to the left, code 1 is one above; both are read through webp.NEAR
    assert webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and len(webp.NEAR) == 120
    want = [pixel(5), pixel(6)] + [pixel(6)] * length
    while len(want) < 32:
        w.symbol(126 + slot(pixel(6)), 7)
        want.append(cache[slot(pixel(6))])
        want[-1] = pixel(6)
    found = webp.decode(w.file())[0].reshape(-1, 4)
    assert found.tolist() == [[v >> s & 255 for s in (24, 16, 8, 0)] for v in want]


@pytest.mark.parametrize("payload", [b"\0" * 64, b"ab" * 32, bytes(range(256)), b"x" * 128, bytes(np.random.default_rng(1).integers(0, 256, 64 * 40, np.uint8))])
def test_bytes_round_trip(payload):
    media = webp.encode_bytes(payload)
    assert webp.decode_bytes(media)[0] == payload
    for cut in (3, 20, len(media) // 2):
        with pytest.raises(webp.Broken):
            webp.decode(media[:cut])


def test_streams_around_a_segments_end():
    rng, letters, lengths = np.random.default_rng(2), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8), set()
    for ends in (1, 2):  # streams that end behind the first, and behind the second segment
        rows = next(n for n in range(400, 4000, 4) if len(webp.encode_bytes(rng.choice(letters, 64 * n).tobytes())) > ends * webp.SEGMENT // 8 - 100)
        for n in range(rows - 6, rows + 8):
            payload = rng.choice(letters, 64 * n).tobytes()
            media = webp.encode_bytes(payload)
            assert webp.decode_bytes(media)[0] == payload
            data = next(webp.chunks(media))
            for more in range(0, 40) if n % 4 else range(0, 300):  # bytes behind the image are legal
                lengths.add(len(data) + more)
                assert webp.decode_chunk(data + bytes(more))[..., 2].tobytes() == payload
    assert all(set(range(k * webp.SEGMENT // 8 - 20, k * webp.SEGMENT // 8 + 120)) <= lengths for k in (1, 2))


def test_large_payload_is_several_images():
    payload = b"q" * 64 * (webp.SIDE + 1)
    back, sides = webp.decode_bytes(webp.encode_bytes(payload))
    assert back == payload and sides == [(64, webp.SIDE), (64, 1)]


def test_media_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "text " * 900, "c"), (3, "text " * 900, "d"), (None, "é", "e")], "doc_id bigint, text string, media string")
    rows = webp.read_back(webp.store_texts(df)).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in rows) == [(0, 64), (0, 64), (2, 64), (4500, 4544), (4500, 4544)]
    same = [tuple(r) for r in rows if r["doc_id"] == 3]
    assert same[0] == same[1]
    images = spark.createDataFrame([(1, webp.encode_bytes(b"a" * 64)), (2, b"junk"), (3, None), (4, b"")], "width bigint, media binary").withColumnRenamed("width", "id")
    found = {r["id"]: r for r in webp.decode_media(images, "id", "media").collect()}
    assert found[1]["width"] == 64 and len(bytes(found[1]["pixels"])) == 256 and found[1]["error"] is None
    assert found[2]["error"] and found[3]["error"] is None and found[3]["pixels"] is None and found[4]["error"]
    assert webp.read_back(webp.store_texts(df.limit(0))).collect() == []


def test_every_image_of_a_value_is_decoded(spark):
    payload = b"q" * 64 * webp.SIDE + b"r" * 128
    images = spark.createDataFrame([(1, webp.encode_bytes(payload)), (2, None), (3, b"junk"), (4, webp.encode_bytes(b"a" * 64))], "id bigint, media binary")
    found = webp.decode_media(images, "id", "media").collect()
    own = sorted((r for r in found if r["id"] == 1), key=lambda r: r["image"])
    assert [(r["image"], r["width"], r["height"], r["error"]) for r in own] == [(0, 64, webp.SIDE, None), (1, 64, 2, None)]
    assert b"".join(bytes(r["pixels"])[2::4] for r in own) == payload
    assert sorted((r["id"], r["image"]) for r in found if r["id"] != 1) == [(2, None), (3, None), (4, 0)]


def test_codes_of_mixed_lengths_and_repeated_lengths():
    w = Writer()
    w.put(0, 1), w.put(15, 4)
    own = {0: 3, 1: 3, 2: 3, 3: 3, 16: 3, 17: 3, 18: 2}  # lengths of the code-length codes; 18 comes first, the rest in order
    for s in webp.LENGTH_ORDER:
        w.put(own.get(s, 0), 3)
    w.put(0, 1)
    code = {18: (0, 2), 0: (2, 3), 1: (3, 3), 2: (4, 3), 3: (5, 3), 16: (6, 3), 17: (7, 3)}
    put = lambda s: w.symbol(*code[s])
    put(2), put(0), put(3), put(16), w.put(2, 2)  # lengths 2, 0, 3, then 3 five times: 1/4 + 6/8 is a full code
    put(17), w.put(3, 3)  # six zeros
    put(18), w.put(1, 7), put(18), w.put(127, 7), put(18), w.put(78, 7)  # zeros up to 256
    want = [0, 2, 3, 7, 0, 5, 4, 6, 2]
    codes = {0: (0, 2)} | {s: (2 + k, 3) for k, s in enumerate(range(2, 8))}
    for s in want:
        w.symbol(*codes[s])
    bits = webp.Bits(np.packbits(np.array(w.bits, np.uint8), bitorder="little").tobytes())
    reader = webp.read_code(bits, 14 + 12 + 138 + 89)
    assert [reader.read(bits) for _ in want] == want
