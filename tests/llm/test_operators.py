"""Each operator against brute force, a round trip or held-out accuracy."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerwatch.llm import bpe, chat, common, language, licences, lines, media, mixing, ngrams, pii, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 20, 300)] + rng.normal(size=(300, 16)) * 0.04
    every = np.concatenate([base, near, base[:30]]).astype(np.float32)
    labels = np.concatenate([np.arange(600) % 2, np.arange(30) % 2])
    labels[300:600] = 0
    table = spark.createDataFrame([(k, every[k].tolist(), int(labels[k])) for k in range(len(every))], "vec_id long, embedding array<float>, label int")
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    roots = common.local_roots(len(every), *np.nonzero(linked))
    found = vectors.near_duplicates(table)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == {k: (int(linked[k].sum()), int(roots[k])) for k in range(len(every))}
    assert vectors.audit(table, found, 7) == 1.0


def tight_groups(rng, sizes, dim=16, noise=0.02):
    return np.concatenate([rng.normal(size=dim) + rng.normal(size=(n, dim)) * noise for n in sizes]).astype(np.float32)


def brute_links(every, labels):
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    roots = common.local_roots(len(every), *np.nonzero(linked))
    return {k: (int(linked[k].sum()), int(roots[k])) for k in range(len(every))}


@pytest.mark.parametrize("sizes", [[65, 65, 65], [50, 120, 500, 80, 3, 1, 1], [900, 700]])
def test_vectors_in_tight_groups(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "SHARD", 400)  # the blocks of a cell too
    every = tight_groups(np.random.default_rng(len(sizes)), sizes)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(every)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table).collect()}
    assert got == brute_links(every, np.ones(len(every)))


def test_near_copies_share_one_cell(spark):
    rows = []
    for n in (1000, 4000):
        every = tight_groups(np.random.default_rng(n), [n])
        member = spark.createDataFrame([(k, 1, v.tolist(), 1) for k, v in enumerate(every)], "node long, label long, v array<float>, copies long")
        rows.append(vectors.celled(member).select(F.sum(F.size("cells"))).first()[0] / n)
    assert rows == [1, 1]


def test_every_close_pair_meets_in_a_cell():
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.normal(size=(3000, 24)))
    x = np.concatenate([x, vectors.unit(x + rng.normal(size=x.shape) * 0.03)])
    part = pd.DataFrame({"node": range(len(x)), "label": 1, "copies": 1, "v": list(x), "is_centre": False})
    centres = part.sample(40, random_state=1).assign(is_centre=True)
    out = vectors._celled("<f8")(pd.concat([part, centres])).set_index("node")
    cells = [set(c.tolist()) for c in out["cells"].loc[range(len(x))]]
    homes = out["home"].loc[range(len(x))].tolist()
    close = [k for k in range(3000) if x[k] @ x[k + 3000] >= vectors.COSINE]
    assert len(close) > 500 and all(homes[k] in cells[k + 3000] or homes[k + 3000] in cells[k] for k in close)


def test_repeated_vec_ids_and_ties(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 3.0], 1), (3, [0.0, 3.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 1, 1)]


def test_mix_comes_near_its_targets(documents):
    rows = mixing.mix(documents, block=64).toPandas()
    rows["taken"] = rows["copies"] * rows["size"]
    per = rows.fillna({"source": ""}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), source=("source_size", "first"), longest=("size", "max"))
    assert (abs(per["taken"] - per["target"]) <= np.maximum(per["longest"], 0.02 * per["target"])).all()
    assert rows["copies"].between(0, 3).all() and abs(per["target"].sum() - rows["size"].sum()) < 1e-3
    assert sorted(map(tuple, mixing.mix(documents, block=64).select("doc_id", "copies").collect())) == sorted(map(tuple, rows[["doc_id", "copies"]].itertuples(index=False)))


def test_targets_stop_at_three_times_the_source(docs):
    rows = docs((1, "a " * 10, "en", "a"), (2, "a " * 100, "en", "b"), (3, "a " * 100, "en", None))
    goal = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(rows)).collect()}
    assert goal["a"] == pytest.approx(30) and goal["b"] == pytest.approx(180 * 2 / 3) and goal[None] == pytest.approx(180 / 3)


def brute_targets(sizes):
    """Shares by weight with the excess over three times a source reshared, by bisection of the level."""
    order = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    low, high = 0.0, 3.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[k], level * weight[k]) for k in order) < sum(sizes.values()) else (low, level)
    return {k: min(3 * sizes[k], high * weight[k]) for k in order}


def test_targets_and_sizes_against_brute_force(documents):
    rows = documents.select("doc_id", "source", "text").collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    total = {s: sum(size[k] for k in size if source[k] == s) for s in set(source.values())}
    goal = brute_targets(total)
    found = mixing.mix(documents).collect()
    assert {r["doc_id"]: r["size"] for r in found} == size and all(r["source_size"] == total[r["source"]] for r in found)
    assert all(r["target"] == pytest.approx(goal[r["source"]], rel=1e-9) for r in found)


def test_targets_of_many_sources(docs):
    rng = random.Random(5)
    sizes = {f"s{k:03d}": rng.choice([1, 5, 40, 300, 2000]) for k in range(60)} | {None: 77}
    rows = docs(*[(k, "a " * n, "en", s) for k, (s, n) in enumerate(sizes.items())])
    goal, want = {r["source"]: r["target"] for r in mixing.targets(mixing.sizes(rows)).collect()}, brute_targets(sizes)
    assert goal == {k: pytest.approx(want[k], rel=1e-9) for k in want}


def test_rows_alike_share_their_copies(docs):
    rows = docs(*[(1, "a b c", "en", "a")] * 3000, *[(k, "x y z w", "en", "b") for k in range(500)])
    found = mixing.mix(rows, block=64).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r["source"]: r["n"] for r in found} == {"a": 3000, "b": 500} and all(abs(r["taken"] - r["target"]) <= 8 and r["most"] <= 3 for r in found)


def test_flight_is_fair():
    rng = np.random.default_rng(3)
    p, size = rng.random(40), rng.integers(1, 60, 40).astype(float)
    mean = np.mean([mixing.flight(p, size, seed) for seed in range(4000)], axis=0)
    assert abs(mean - p).max() < 0.05


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 3000, 500).astype(float)
    after = mixing.flight(p, size, 0)
    assert after.sum() == pytest.approx(p.sum(), abs=1e-5) and (after * size).sum() == pytest.approx((p * size).sum(), abs=1e-2)
    assert ((after > 0) & (after < 1)).sum() <= 2


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            ok = {"ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda n=number: 12 <= len(n) <= 19 and luhn(n), "phone": lambda n=number: 9 <= len(n) <= 15}.get(kind, lambda: True)()
            out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}")] if ok else []
    return [x[2] for x in sorted(out)]


def test_pii_base_against_brute_force(docs, documents):
    odd = docs((-1, "a@b@c.d x_y@z.co.uk._q@r.s 300.1.1.1 1.2.3.4.5.6.7.8 001.002.3.255 +1 (234) 567-8901 x 4111 1111 1111 1111"), (-2, "1" * 4000 + " " + "7 " * 2000), (-3, "a.b" * 2000 + "@x" + ".y" * 2000), (-4, "éü😀 a@b.cd 😀 1.2.3.4"))
    rows = documents.select(odd.columns).union(odd)
    found = {r["doc_id"]: r for r in pii.find(rows).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()}
    for r in rows.collect():
        want = base_spans(r["text"] or "")
        assert found[r["doc_id"]]["base"] == ",".join(want)
        assert set(want) <= set(found[r["doc_id"]]["spans"].split(","))


def test_trees_separate_checked_from_failed():
    good, bad = (4, 3, 0, 1, 0, 0, 0), (4, 3, 0, 0, 0, 0, 0)
    model = pii.train([(bad, 50.0, 1.0), (good, 0.0, 60.0)])
    assert model.trees and 0.5 <= model.threshold < 1
    assert pii.train([]).threshold > 1


def test_added_spans_come_from_format_and_context(docs, documents):
    said = ["write to john.doe [at] mail [dot] com today", "jane(AT)corp.org", "token=abcdefghijklmnopqrstuvwx ok", "secret: 'qwertyuiopasdfghjklz'", "password=" + "aZ" * 400, "ssn 123-45-6789", "call 555-123-4567 now"]
    want = ["spelt_email:9:37", "spelt_email:0:16", "secret:0:30", "secret:0:30", "secret:0:809", "digits:4:15", "local_phone:5:17"]
    alike = ["token=short", "we meet [at] noon", "4111-1111-1111-1112", "300.400.500.600", "12-34-5678", "2024-01-15 10:00"]
    rows = documents.select("doc_id", "text").union(docs(*[(-1 - k, x) for k, x in enumerate(said + alike)]).select("doc_id", "text"))
    found = {r["doc_id"]: r["spans"] for r in pii.find(rows).where("doc_id < 0").select("doc_id", pii.written(F.col("spans")).alias("spans")).collect()}
    assert [found[-1 - k] for k in range(len(found))] == want + [""] * len(alike)
    assert "checked" not in pii.FEATURES


def test_trees_decide_by_context(docs, documents, monkeypatch):
    said = ["please call 646-555-7788 today", "order no. 646-555-7788 today", "ssn 321-45-6789", "part no. 321-45-6789", "call 555-7788 now", "from 1950-1975 on", "password=1q2w3e4r5t6y7u8i9o", "password=zzzzzzzzzzzzzzzzzzzz"]
    rows = documents.select("doc_id", "text").union(docs(*[(-1 - k, x) for k, x in enumerate(said)]).select("doc_id", "text"))

    def spans():
        found = {r["doc_id"]: r["spans"] for r in pii.find(rows).where("doc_id < 0").select("doc_id", pii.written(F.col("spans")).alias("spans")).collect()}
        return [found[-1 - k] for k in range(len(said))]

    assert spans() == ["local_phone:12:24", "", "digits:4:15", "", "local_phone:5:13", "", "secret:0:27", ""]
    # every candidate with its score worked out tree by tree
    found = common.checkpoint(pii.described(rows))
    model = pii.fitted(found)
    assert {name for a, _, b, _, _ in model.trees for name in (a, b)} >= {"cue", "other"}
    want = {}
    for r in found.collect():
        base = [c for c in r["candidates"] if c["kind"] in pii.PATTERNS and c["label"] == 1]
        want[r["doc_id"]] = {(c["kind"], c["start"], c["end"]) for c in base}
        for c in r["candidates"]:
            total = model.start + sum(leaves[2 * (c["f"][a] >= x) + (c["f"][b] >= y)] for a, x, b, y, leaves in model.trees)
            score = 1 / (1 + math.exp(-(total * model.slope + model.offset)))
            if c["kind"] in pii.ADDED and score >= model.threshold and not any(b["start"] < c["end"] and c["start"] < b["end"] for b in base):
                want[r["doc_id"]].add((c["kind"], c["start"], c["end"]))
    assert {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in pii.find(rows).collect()} == want
    # without trees nothing is added
    monkeypatch.setattr(pii, "train", lambda table: pii.Trees(0.0, [], 1.0, 0.0, 2.0))
    assert spans() == [""] * len(said)


def test_pii_without_a_corpus(docs):
    rows = docs((1, "call 646-555-7788 today"), (2, "order no. 646-555-7788 today"), (3, "john [at] mail [dot] com"), (4, None))
    found = {r["doc_id"]: r["spans"] for r in pii.find(rows).select("doc_id", pii.written(F.col("spans")).alias("spans")).collect()}
    assert found == {1: "local_phone:5:17", 2: "", 3: "spelt_email:0:24", 4: ""}


def test_redaction(docs):
    row = pii.redact(docs((1, "mail a@b.cd or 1.2.3.4"), (2, "clean words"))).orderBy("doc_id").collect()
    assert [r["text"] for r in row] == ["mail [email] or [ip]", "clean words"]


def decoded_jpeg(jpeg):
    """A slow reader of the baseline JPEGs: one grey level for each block."""
    scan = jpeg[jpeg.index(b"\xff\xda") + 10 : -2].replace(b"\xff\x00", b"\xff")
    bits, at, level, out = "".join(f"{b:08b}" for b in scan), 0, 128, []
    codes = {f"{c:0{n}b}": k for k, (c, n) in enumerate(zip(media.CODES, media.CODE_LENGTHS, strict=True))}
    while len(out) < 64:
        n = next(n for n in range(2, 7) if bits[at : at + n] in codes)
        size = codes[bits[at : at + n]]
        extra = int(bits[at + n : at + n + size] or "0", 2)
        level += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
        assert bits[at + n + size] == "0"
        at += n + size + 1
        out.append(level)
    return bytes(out)


def test_media_keep_every_byte(texts):
    rng = random.Random(2)
    payloads = [media.padded(x) for x in list(texts.values())[:40] + [None, "", "x" * 63, "é" * 3000]] + [bytes(rng.randrange(256) for _ in range(6400)), bytes([255, 0] * 3200)]
    stored = media.store(payloads)
    assert [x.tobytes() for x in media.load(stored)] == payloads
    starts, sizes, _ = media.frames_of(stored[-1])
    frames = [decoded_jpeg(stored[-1][a : a + n]) for a, n in zip(starts[:3], sizes[:3], strict=True)]
    assert b"".join(frames) == payloads[-1][:192]
    assert stored[0][:4] == b"RIFF" and stored[0][8:12] == b"AVI "


def plain_jpeg(pixels, step=2, interval=0, colour=False):
    """A slow writer of baseline JPEGs with codes of 4 and 8 bits, AC coefficients and restarts; with `colour`, two flat components at half sampling."""
    part = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
    acs = [0, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
    bits, out, unit, before = [], [], 0, {}
    h, w = pixels.shape
    side = 16 if colour else 8
    padded = np.pad(pixels, ((0, -h % side), (0, -w % side)), mode="edge").astype(float) - 128

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n - 1, -1, -1))

    def number(d, code, n):
        size = abs(d).bit_length()
        put(code(size), n)
        put(d if d > 0 else d + (1 << size) - 1, size) if size else None

    def block(cells, part):
        c = np.rint(media.COSINES @ cells @ media.COSINES.T / step).astype(int).ravel()[media.ZIGZAG].tolist()
        number(c[0] - before.get(part, 0), lambda size: size, 4)
        before[part], run = c[0], 0
        for d in c[1:]:
            if d == 0:
                run += 1
                continue
            while run > 15:
                put(1, 8)
                run -= 16
            number(d, lambda size, run=run: acs.index(run << 4 | size), 8)
            run = 0
        put(0, 8) if run else None

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        raw = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))
        bits.clear()
        before.clear()
        return raw.replace(b"\xff", b"\xff\x00")

    for y in range(0, padded.shape[0], side):
        for x in range(0, padded.shape[1], side):
            if interval and unit and unit % interval == 0:
                out.append(flush() + b"\xff" + bytes([0xD0 + (unit // interval - 1) % 8]))
            for dy in range(0, side, 8):
                for dx in range(0, side, 8):
                    block(padded[y + dy : y + dy + 8, x + dx : x + dx + 8], 1)
            for other in (2, 3) if colour else ():
                block(np.full((8, 8), 30.0 * other), other)
            unit += 1
    out.append(flush())
    parts = [(1, 0x22), (2, 0x11), (3, 0x11)] if colour else [(1, 0x11)]
    frame = b"".join(bytes([c, s, 0]) for c, s in parts)
    return b"".join([
        b"\xff\xd8", part(0xFE, b"made for a test"), part(0xDB, bytes([0] + [step] * 64)), part(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(parts)]) + frame),
        part(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12) + bytes(range(12))), part(0xC4, bytes([0x10] + [0] * 7 + [162] + [0] * 8) + bytes(acs)),
        part(0xDD, interval.to_bytes(2, "big")) if interval else b"", part(0xDA, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c, _ in parts) + b"\0\x3f\0"), *out, b"\xff\xd9",
    ])


@pytest.mark.parametrize(("shape", "interval", "colour"), [((24, 40), 0, False), ((19, 33), 3, False), ((32, 48), 0, True), ((21, 35), 2, True)])
def test_any_baseline_jpeg_is_decoded_by_its_own_tables(shape, interval, colour):
    rng = np.random.default_rng(sum(shape))
    pixels = np.clip(rng.normal(128, 40, shape) + np.linspace(-60, 60, shape[1]), 0, 255).astype(np.uint8)
    found = media.decode_jpeg(plain_jpeg(pixels, interval=interval, colour=colour))
    assert found.shape == shape and abs(found.astype(int) - pixels).max() <= 4


def test_frames_written_here_are_plain_jpegs():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 640).astype(np.uint8).tobytes()
    stored = media.store([payload])[0]
    starts, sizes, _ = media.frames_of(stored)
    frames = [media.decode_jpeg(stored[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
    assert b"".join(f[::8, ::8].tobytes() for f in frames) == payload and all((f == np.kron(f[::8, ::8], np.ones((8, 8), int))).all() for f in frames)


def test_what_is_no_baseline_jpeg_is_an_error():
    good = plain_jpeg(np.full((16, 16), 90, np.uint8))
    cut = good.index(b"\xff\xc4")
    for bad in (b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2"), good[:cut] + good[cut + 2 + int.from_bytes(good[cut + 2 : cut + 4], "big") :], good[:-6] + b"\xff\xd9", good[: good.index(b"\xff\xda")]):
        with pytest.raises(ValueError):
            media.decode_jpeg(bad)
    stored = bytearray(media.store([b"abc" * 64])[0])
    start = int(media.frames_of(bytes(stored))[0][0])
    stored[start + len(media.HEAD) : start + len(media.HEAD) + 12] = b"\xfe" * 12
    with pytest.raises(ValueError):
        media.load([bytes(stored)])
    with pytest.raises(ValueError):
        media.load([b"RIFF\0\0\0\0WAVE"])


@pytest.mark.parametrize("index", ["relative", "absolute", "none"])
def test_foreign_files_are_cut_into_clips(spark, index):
    rng = np.random.default_rng(4)
    frames = [plain_jpeg(np.clip(rng.normal(level, 3, (16, 24)), 0, 255).astype(np.uint8)) for level in [40] * 8 + [200] * 7]
    chunks, entries = b"", []
    for f in frames:
        entries.append((b"00db", 0x10, 4 + len(chunks), len(f)))
        chunks += b"00db" + len(f).to_bytes(4, "little") + f + b"\0" * (len(f) & 1)
    body = b"AVI " + media._list(b"hdrl", media._chunk(b"avih", (50_000).to_bytes(4, "little") + b"\0" * 52))
    base = 8 + len(body) + 8 if index == "absolute" else 0
    rows = np.array([(a, b, c + base, d) for a, b, c, d in entries], [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    body += media._list(b"movi", chunks) + (media._chunk(b"idx1", rows.tobytes()) if index != "none" else b"")
    table = spark.createDataFrame([(1, bytearray(b"RIFF" + len(body).to_bytes(4, "little") + body)), (2, None)], "doc_id long, media binary")
    found = [(r["doc_id"], r["start_ms"], r["end_ms"], round(r["mean_level"])) for r in media.clip_rows(table).orderBy("clip").collect()]
    assert [x[:3] for x in found] == [(1, 0.0, 400.0), (1, 400.0, 750.0)] and abs(found[0][3] - 40) <= 1 and abs(found[1][3] - 200) <= 1


def test_media_of_long_texts(docs):
    text = "".join(chr(97 + k % 26) for k in range(media.FRAMES * media.UNIT + 1000))
    row = media.digests(docs((1, text))).first()
    want = media.padded(text)
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(text), len(want), hashlib.sha256(want).hexdigest())


def test_shots_are_cut_where_the_picture_changes():
    levels = np.concatenate([np.full((20, 64), 10), np.full((20, 64), 200), np.full((5, 64), 90)]).astype(np.uint8)
    assert media.clips(levels) == [(0, 20), (20, 40), (40, 45)]


def test_clips_are_timed(docs):
    rows = media.clip_rows(media.media_column(docs((1, "a" * 640 + "ÿ" * 640)))).orderBy("clip").collect()
    assert rows[0]["start_ms"] == 0 and rows[-1]["end_ms"] == 30 * 40 and all(a["end_ms"] == b["start_ms"] for a, b in zip(rows, rows[1:]))


def test_chat_conflicts_come_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", "a & b < c [x]"), (3, 0, "assistant", "&lt;<s>")], "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.format_conversations(rows).withColumn("again", chat.parse(F.col("formatted"))).collect()}
    assert all(r["again"] == r["turns"] for r in found.values())
    assert [found[k]["level"] for k in (1, 2, 3)] == [1, 0, 1]
    span = found[2]["loss_spans"][0]
    assert found[2]["formatted"][span["start"] : span["end"]] == "a & b < c [x]"


def test_rows_without_a_conversation_stand_alone(spark):
    rows = spark.createDataFrame([(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    assert sorted(len(r["turns"]) for r in chat.format_conversations(rows).collect()) == [1, 1, 1, 1]


def test_licences_near_the_threshold(docs):
    rows = licences.scan(docs((1, "x\nReleased  under the MIT license!"), (2, "mit der license"), (3, "\n".join(licences.TEMPLATES[3][1].split(", "))), (4, "Licensed under CC BY-NC 4.0."))).collect()
    assert {(r["doc_id"], r["unit"], r["licence"]) for r in rows} == {(1, "line", "MIT"), (1, "paragraph", "MIT"), (3, "paragraph", "MIT"), (4, "line", "CC-BY-NC-4.0")}


def test_licences_whole_and_within_prose(docs):
    mit = "MIT License\nCopyright (c) 2020 Some One\n" + licences.MIT_GRANT + "\n" + licences.MIT_REST
    rows = [
        (1, mit), (2, mit.replace("\n", "\n\n")), (3, "We made this. Licensed under the Apache License, Version 2.0. Have fun with it!"), (4, "Read on.\n" + licences.BSD_SOURCE + "\nMore follows here"),
        (5, "\n".join(["Redistribution"] + licences.BSD_GRANT.split()[1:]) + "\n\n1. " + licences.BSD_SOURCE + "\n\n2. " + licences.BSD_BINARY + "\n\n3. " + licences.BSD_NAMES + "\n\n" + licences.BSD_REST),
        (6, "Copyright 2001 X\n" + licences.ISC[0] + "\n" + licences.ISC[1]), (7, "We permit redistribution of nothing. The license is somewhere else, under the stairs."), (8, licences.UNLICENSE_REST),
        (9, "A tool. " + dict(licences.NOTICES)["AGPL-3.0-or-later"] + " " + licences.GNU_REST.format("Affero General") + " Call us."),
    ]
    found = {}
    for r in licences.scan(docs(*rows)).collect():
        found.setdefault(r["doc_id"], set()).add((r["unit"], r["licence"]))
    assert ("paragraph", "MIT") in found[1] and ("text", "MIT") in found[2] and found[3] == {("sentence", "Apache-2.0")} and ("line", "BSD") in found[4]
    assert ("text", "BSD-3-Clause") in found[5] and ("paragraph", "ISC") in found[6] and 7 not in found and ("line", "Unlicense") in found[8] and ("line", "AGPL-3.0-or-later") in found[9]


def test_telling_words_leave_no_licence_out():
    rng, pattern = random.Random(2), re.compile(licences.telling(licences.TEMPLATES, 0.8))
    for _, text in licences.TEMPLATES:
        grams, every = set(licences.template_bigrams(text)), text.split()
        for _ in range(200):
            cut = list(every)
            for _ in range(rng.randrange(1 + len(every) // 3)):
                del cut[rng.randrange(len(cut))]
            own = set(licences.template_bigrams(" ".join(cut)))
            assert 2 * len(own & grams) < 0.8 * (len(own) + len(grams)) or pattern.search(" ".join(cut).lower())


def test_bpe_as_tiktoken(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, made = random.Random(4), bpe.codec()
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700), 32, 10]))
    for text in [*texts.values(), "", "a" * 500, "a" * 9001, "=-" * 300, "anotherwise" * 3000, *("".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(500))]:
        ids = made.encode(text)
        assert ids == known.encode_ordinary(text) and "".join(made.decode(ids)) == text


def test_utf8_stream_holds_back_unfinished_characters():
    stream, raw = bpe.Utf8Stream(), "aé😀z".encode()
    assert "".join(stream.feed(raw[k : k + 1]) for k in range(len(raw))) + stream.close() == "aé😀z"


def test_bpe_digests(docs):
    row = bpe.digests(docs((1, None))).first()
    assert (row["n_tokens"], row["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


def test_repeated_runs_go_and_single_lines_stay(docs):
    rows = docs((1, "a\nb\nc\nd"), (2, "x\nb\nc\ny"), (3, "q\nb\nz"), (4, "r\n\nr\n\nr"))
    assert [r["text"] for r in lines.without_repeats(rows).orderBy("doc_id").collect()] == ["a\nb\nc\nd", "x\ny", "q\nb\nz", "r\n\n"]


def test_repeats_are_extended_both_ways(docs):
    rows = docs((1, "a\nb\nc\nd\ne"), (2, "x\nb\n\nc\nd\ny\na\nb"), (3, "c\nd\ne\nx\nb\nc"), (None, "q\nx\nb"))
    found = [(r["doc_id"], r["first_doc_id"], r["start"], r["first_start"], r["places"]) for r in lines.repeats(rows).collect()]
    want = [(2, 1, 1, 1, [1, 3, 4]), (2, 1, 5, 0, [6, 7]), (3, 1, 0, 2, [0, 1, 2]), (3, 2, 3, 0, [3, 4]), (3, 1, 4, 1, [4, 5]), (None, 2, 1, 0, [1, 2])]
    assert sorted(found, key=str) == sorted(want, key=str)


def brute_repeats(texts, run):
    """Every line of a run that stands at an earlier place."""
    held, out = {}, {}
    for doc_id in sorted(texts):
        every = texts[doc_id].split("\n")
        filled = [k for k, x in enumerate(every) if x.strip(" ")]
        gone = set()
        for at in range(len(filled) - run + 1):
            window = tuple(every[k] for k in filled[at : at + run])
            if held.setdefault(window, (doc_id, at)) != (doc_id, at):
                gone.update(filled[at : at + run])
        out[doc_id] = "\n".join(x for k, x in enumerate(every) if k not in gone)
    return out


@pytest.mark.parametrize("run", [2, 3])
def test_repeats_against_brute_force(docs, run):
    rng = random.Random(run)
    texts = {k: "\n".join(rng.choice(["a", "b", "c", "d", "", "long line"]) for _ in range(rng.randrange(12))) for k in range(60)}
    found = lines.without_repeats(docs(*texts.items()), run)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_repeats(texts, run)


def test_running_sums(spark):
    values = list(range(1, 1000))
    row = spark.createDataFrame([(values,), ([],)], "v array<int>").select(common.running_sums(F.col("v")).alias("s")).collect()
    assert row[0]["s"] == [0, *np.cumsum(values).tolist()] and row[1]["s"] == [0]


def test_ngrams_of_long_texts_do_not_depend_on_the_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdé 1.") for _ in range(3 * language.PIECE // 2))
    whole = np.zeros(language.BUCKETS, int)
    for rows in language.ngram_rows(text):
        whole += np.bincount(rows, minlength=language.BUCKETS)
    for piece in (1000, 10**7):
        monkeypatch.setattr(language, "PIECE", piece)
        again = np.zeros(language.BUCKETS, int)
        for rows in language.ngram_rows(text):
            again += np.bincount(rows, minlength=language.BUCKETS)
        assert (again == whole).all()


def test_bpe_ids_beside_the_digests(docs):
    row = bpe.digests(docs((1, "hello there, hello")), with_ids=True).first()
    assert len(row["ids"]) == row["n_tokens"] and hashlib.sha256(",".join(map(str, row["ids"])).encode()).hexdigest() == row["ids_sha256"]


def test_language_held_out_accuracy(documents):
    model = language.train(language.sample(documents.where(~language.held_out())))
    rows = language.predict(documents.where(language.held_out() & F.col("lang").isNotNull()), model).select("lang", "lang_pred", "rejected").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_similar_documents_against_brute_force(docs, documents, texts):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    copies = [(10_000 + k, " ".join(words * 4 + [f"tail{k % 5}"])) for k in range(40)] + [(20_000, "one two"), (20_001, "one  two"), (20_002, "")]
    rows = documents.select("doc_id", "text").union(docs(*copies).select("doc_id", "text"))
    every = texts | dict(copies)
    sets = {}
    for k, text in every.items():
        w = WORD.findall(text)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    degree, place = dict.fromkeys(ids, 0), {k: n for n, k in enumerate(ids)}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    roots = common.local_roots(len(ids), np.array([place[a] for a, _ in links], int), np.array([place[b] for _, b in links], int))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngrams.similar_documents(rows).collect()}
    assert got == {k: (degree[k], ids[roots[place[k]]]) for k in ids}


def test_chains_are_compared_pair_by_pair(docs, monkeypatch):
    monkeypatch.setattr(ngrams, "GROUP_BLOCK", 4)
    words = [f"w{k}" for k in range(2000)]
    every = {k: words[12 * k : 12 * k + 160] for k in range(100)} | {200 + k: [f"x{j}" for j in range(60)] + [f"own{k}"] for k in range(10)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in every.items()}
    links = {k: sum(1 for j in sets if j != k and 5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j])) for k in sets}
    rows, compared = docs(*[(k, " ".join(w)) for k, w in every.items()]), []
    plain = type(rows).mapInPandas
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, f, *a, **b: (compared.append(f is ngrams._compared), plain(self, f, *a, **b))[1])
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngrams.similar_documents(rows).collect()}
    assert any(compared) and max(links.values()) == 9 and 0 < links[1] < 9
    assert got == {k: (links[k], 0 if k < 200 else 200) for k in every}


def test_blocks_give_the_same_links(spark, docs, monkeypatch):
    monkeypatch.setattr(ngrams, "BAND_BLOCK", 8)
    monkeypatch.setattr(ngrams, "GROUP_BLOCK", 8)
    words = [f"w{k}" for k in range(60)]
    rows = docs(*[(k, " ".join([*words, f"own{k}"])) for k in range(50)])
    assert {(r["n_links"], r["class_id"]) for r in ngrams.similar_documents(rows).collect()} == {(49, 0)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    assert {(r["id"], r["component"]) for r in common.components(edges).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}


def test_components_take_no_step_without_need(spark, monkeypatch):
    """Every step costs the driver threads and plans: stars take none, and a step that leaves stars is the last."""
    from ledgerwatch.functions import components as module

    steps, step = [], module._with_least
    monkeypatch.setattr(module, "_with_least", lambda edges: steps.append(1) or step(edges))
    found = lambda rows: {(r["id"], r["component"]) for r in module.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found([(k, k % 3) for k in range(3, 30)] + [(1, 1), (0, 3), (4, 1)]) == {(k, k % 3) for k in range(30)}
    assert not steps
    assert found([(1, 2), (2, 3), (3, 1)]) == {(1, 1), (2, 1), (3, 1)}
    assert len(steps) == 2  # a large and a small star


def test_bpe_lets_go_of_a_batch_before_the_next(docs):
    """Texts stay in Arrow's bytes but for those at work, and nobody holds a batch while the next one is read."""
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k, k + 1, k + 2], "text": ["aé 漢", None, "b" * k]}) for k in range(3)]
    for batch in batches:
        for chars in (1, 2, 5, 100):
            parts = list(bpe.arrow_slices(batch, chars))
            assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
            assert all(len(part) for part in parts)
    assert list(bpe.arrow_slices(batches[0].slice(0, 0))) == []
    assert bpe.digests(docs((1, "a b"), (2, None))).select("doc_id").count() == 2
    assert "MapInArrow" in bpe.digests(docs((1, "a")))._jdf.queryExecution().executedPlan().toString()
