"""Packing, archives, token files, vectors, mixing, pictures and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import io
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidebook.llm import embeddings, media, mixing, packing, tokenfile, warc
from tidebook.llm.common import components
from tidebook.llm.tokens import LETTERS, NUMBERS, SPACES, Encoder, default_vocabulary, portions, pre_tokens

TEXTS = [None, "", " ", "a  b", "don't  stop\n\nnow ", "<|endoftext|> x", "a　b ﷽", "½ ²³¹ ª\x85 \xa0c", "x" * 500, "\x1c\x1d a", "word " * 4000]


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sÉ.1\x00\x85\xa0"), st.characters(codec="utf-8")), max_size=40), max_size=4))
@settings(max_examples=150, deadline=None)
def test_cached_ids_are_the_tokenizers(texts):
    own = test_cached_ids_are_the_tokenizers.__dict__.setdefault("own", Encoder(capacity=50))
    assert own.encode(texts) == [own.direct(t) + b"\0\0\0\0" for t in texts]


def test_edge_texts_encode(encoder):
    assert encoder.encode(TEXTS) == [encoder.direct(t or "") + b"\0\0\0\0" for t in TEXTS]


PRE_TOKEN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@given(st.lists(st.text(alphabet=" \n\t'strevlmdaÉ1½.\xa0", max_size=12), min_size=1, max_size=4))
@settings(max_examples=500, deadline=None)
def test_pre_tokens_are_the_patterns(texts):
    whole = "".join(texts)
    starts = pre_tokens(np.frombuffer(whole.encode("utf-16-le"), "<u2"), np.cumsum([len(t) for t in texts])).tolist()
    assert [whole[a:b] for a, b in zip(starts, starts[1:])] == [w for t in texts for w in PRE_TOKEN.findall(t)]


def test_a_call_asks_its_cache_once_a_word():
    """However often a word stands in the texts, one search of the great cache serves them all."""
    asked = []

    class Asked(dict):
        def get(self, word, default=None):
            asked.append(word)
            return super().get(word, default)

        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    own = Encoder()
    texts = ["one two one three " * 300, None, "two one" * 100, "", " three"]
    own.kept = Asked()
    assert own.encode(texts) == [own.direct(t or "") + b"\0\0\0\0" for t in texts]
    assert len(asked) <= len({w for t in texts for w in PRE_TOKEN.findall(t or "")})


def test_a_cache_too_small_changes_no_ids(encoder):
    texts = [" ".join(f"w{i * k}" for i in range(50)) for k in range(9)]
    own = Encoder(capacity=7)
    for _ in range(2):
        assert own.encode(texts) == encoder.encode(texts)
        assert [own.encode([t])[0] for t in texts] == encoder.encode(texts)


def test_portions_have_all_rows():
    texts = [None, "", "ab", "é" * 3, "x" * 50, None, "y", "z" * 9, "z" * 8, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(10), "text": pa.array(texts)}).slice(1)
    for most in (1, 8, 9, 1000):
        parts = list(portions(batch, most))
        assert [t for part in parts for t in part["text"].to_pylist()] == texts[1:]
        assert all(part.num_rows == 1 or sum(len((t or "").encode()) for t in part["text"].to_pylist()) <= most for part in parts)
    assert len(parts) == 1 and not list(portions(batch.slice(9)))


@given(st.lists(st.integers(0, (1 << 32) - 1), min_size=1, max_size=400))
@settings(max_examples=80, deadline=None)
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (tokenfile.unpack_block(tokenfile.pack_block(ids)) == ids).all()


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_shard_round_trip(block):
    rng = np.random.default_rng(1)
    docs = [(None, 3), (5, 1), (5, 10000), (-9, 2)]
    docs = [(d, rng.integers(0, 60000, n).astype("<u4").tobytes()) for d, n in docs]
    out = io.BytesIO()
    writer = tokenfile.ShardWriter(out, block)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = tokenfile.ShardReader(pa.BufferReader(out.getvalue()))
    assert [(d, ids) for d, _, ids in reader.documents()] == docs
    assert [at for _, at, _ in reader.documents()] == [0, 3, 4, 10004]
    broken = bytearray(out.getvalue())
    broken[-60] ^= 1
    with pytest.raises(ValueError):
        tokenfile.ShardReader(pa.BufferReader(bytes(broken)))


def test_token_files(spark, scratch, docs_of, encoder):
    ids = [9, 4, 4, None, 2, 11, 12, 13, 14, 15, 16]
    got = tokenfile.read_shards(tokenfile.write_shards(docs_of(TEXTS, ids), scratch), with_ids=True).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert order[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:]))
    wanted = collections.Counter((i, zlib.crc32(b), len(b) // 4) for i, b in zip(ids, encoder.encode(TEXTS)))
    assert collections.Counter((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == wanted
    assert all(np.array(r["ids"], "<u4").tobytes()[-4:] == b"\0\0\0\0" for r in got)
    assert tokenfile.read_shards(tokenfile.write_shards(docs_of([]), scratch, "none")).count() == 0


@given(st.lists(st.integers(1, 30), max_size=200), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_open_sequences(lengths, most):
    bins, used = packing.OpenSequences(30, most), collections.defaultdict(int)
    free: dict[int, int] = {}
    for n in lengths:
        fits = [f for f in free.values() if f >= n]
        s, offset = bins.place(n)
        assert offset == used[s]
        if fits:
            assert free[s] == min(fits)
        else:
            assert s not in free
            if len(free) == most and n < 30:
                free.pop(min(free, key=free.get))  # the fullest; equal ones are alike
                free = {k: v for k, v in free.items()}
        used[s] += n
        assert used[s] <= 30
        free = {k: 30 - used[k] for k in [x for v in bins.by_free.values() for x in v]}
        assert len(free) <= most


def test_packing(spark, scratch, docs_of, encoder):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    rows = packing.pack_documents(docs_of(texts), scratch).collect()
    ids = encoder.encode(texts)
    for i, data in enumerate(ids):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(data) // 4
        assert all(r["length"] == 2048 for r in own[1:])
        assert all(zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in own)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 2
    assert packing.pack_documents(docs_of([]), scratch).count() == 0


def test_archives(spark, scratch):
    long, short = "<p>é</p>" * 30, "<p>"
    pages = [(5, "u5", long), (3, "http://x y", long), (9, None, long), (1, "a", short), (2, "b", short), (7, "n", None), (8, "e", ""), (None, "q", long), (10, "z", "w" * 3_000_000), (11, "z", "\r\n\r\nWARC/1.1\r\n" * 20)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    index = warc.write_archives(frame, scratch)
    rows = warc.read_archives(index, with_payload=True).collect()
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows}
    for i, _, html in pages:
        body = (html or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert bytes(by[i]["payload"]) == (body if by[i]["record_type"] == "response" else b"")
    assert {i: r["refers_to"] for i, r in by.items() if r["record_type"] == "revisit"} == {5: 3, 9: 3}
    path = index.first()["path"].removeprefix("file://")
    with open(path, "rb") as f:  # any Zstandard reader takes the file whole
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(warc.write_archives(frame.limit(0), scratch, "none")).count() == 0


def test_vectors_are_brute_force(spark, scratch):
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2, None):
        for c in rng.normal(size=(20, 16)):
            rows += [(len(rows) + k, (c + rng.normal(size=16) * s).astype("f4").tolist(), label) for k, s in enumerate((0, 0, 0.03, 0.1, 0.2, 1))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [2.0, 4.0], 1), (n + 6, [], 1), (n + 7, [float("inf")] * 16, 1), (n + 8, [3e38] * 16, 2), (n + 9, [1e-38] * 16, 2)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, first int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, scratch, block=7).collect()}

    def usable(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    links = collections.defaultdict(set)
    for a in filter(usable, rows):
        for b in filter(usable, rows):
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], "f4").astype(float), np.array(b[1], "f4").astype(float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].add(b[0])
    assert {i: r["n_links"] for i, r in got.items()} == {r[0]: len(links[r[0]]) for r in rows}
    for i, r in got.items():
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        assert r["component_id"] == min(seen) and r["kept"] == (i == min(seen))
    assert embeddings.near_duplicates(frame.limit(0), scratch).count() == 0


def test_vectors_of_doubles_keep_them(spark, scratch):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.20305866063400], 1), (3, [1.0, 0.20305866063401], 1)]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()}
    close = [1 / np.hypot(1, r[1][1]) >= 0.98 for r in rows[1:]]
    assert got == {1: sum(close), 2: 1 + close[0], 3: 1 + close[1]}


def test_packing_does_not_depend_on_partitions(spark, scratch, docs_of):
    found = packing.pieces(docs_of(["a b c " * (7 * k % 300) for k in range(400)]), 256)
    found = scratch.write(found, "pieces")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(packing.pack(found.repartition(3), 2, 256)) == key(packing.pack(found.repartition(7), 2, 256))


def test_components(spark, scratch):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)] + [(7777, 7777)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != 7777}
    assert components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


def slow_targets(sizes, weights, share, most):
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, heavy = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest / heavy > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * rest / heavy for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(spark, scratch):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60) if i % 40 else None, rng.choice(["é", "a", "z", None, "B"] + ["hot"] * 4)) for i in range(900)]
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, "en", 3) for r in rows], "doc_id long, text string, source string, lang string, size int")
    got = mixing.mix(frame, scratch).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    own = collections.Counter()
    for _, t, s in rows:
        own[s] += size(t)
    wanted = slow_targets(own, (3, 1, 2), 1.5, 2.0)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == own[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in own)
    again = mixing.mix(frame.repartition(3), scratch).collect()
    key = lambda rs: sorted((r["doc_id"], r["size"], r["copies"]) for r in rs)
    assert key(got) == key(again)
    mixed = mixing.apply_mix(frame, scratch)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(frame.limit(0), scratch).count() == 0
    assert mixing.mix(frame.withColumn("text", F.lit(None).cast("string")), scratch).agg(F.sum("copies")).first()[0] == 0


def test_mixing_keeps_large_ids_beside_null(spark, scratch):
    big = (1 << 53) + 1
    rows = [(big + 2 * i, "a b c " * (i % 5 + 1), "s" if i % 3 else None) for i in range(40)] + [(None, "a b", "s"), (None, "a b", "s"), (None, None, None), (0, "zero", "s")]
    frame = spark.createDataFrame([(*r, 1, "h", 2, 3) for r in rows], "doc_id long, text string, source string, text_hash int, hash string, total int, number int")
    got = mixing.mix(frame, scratch).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    taken = collections.Counter()
    for r in got:
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mixing.apply_mix(frame, scratch)
    assert mixed.columns == frame.columns
    out = mixed.collect()
    assert collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out) == +taken
    assert {(r["text_hash"], r["hash"], r["total"], r["number"]) for r in out} == {(1, "h", 2, 3)}


def test_rounding_keeps_sums_and_expectations():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(0, 50, 300), np.full(300, 0.37)
    total = np.zeros(300)
    for k in range(300):
        out, left = mixing.round_pivotally(sizes, p, np.random.default_rng(k))
        fixed = np.delete(out, left) if left >= 0 else out
        assert set(fixed) <= {0.0, 1.0}
        assert abs((sizes * out).sum() - (sizes * p)[sizes > 0].sum()) < 1e-6
        total += out
    assert abs(total[sizes > 0].mean() / 300 - 0.37) < 0.01 and np.abs(total[sizes > 0] / 300 - 0.37).max() < 0.15


def slow_image_components(rows):
    """All pairs of pictures compared by their whole corners."""
    found = [None if c is None or (p := media.decode(c)) is None else media.corners(p[None])[0] for _, c in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if same or (found[i] is not None and found[j] is not None and media.agree(found[i], found[j]) >= media.INLIERS):
                up[root(j)] = root(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: least[root(k)] for k, (i, _) in enumerate(rows)}


BROKEN = [None, None, b"", b"no picture", b"P5", b"P5 12", b"P5 3 3 255", b"P5 3 3 255\n" + b"a" * 9, b"P5 9 9 255\nshort", b"P5 2 2 65535\n" + b"a" * 8, b"P5 99999 99999 255\n", b"\x89PNG\r\n\x1a\n", b"P6 #"]


@pytest.mark.parametrize("crowd", [64, 3])
def test_image_copies_are_brute_force(spark, scratch, monkeypatch, crowd):
    monkeypatch.setattr(media, "CROWD", crowd)
    rng = np.random.default_rng(2)
    base = [media.picture(rng.normal(size=8).astype("f4")) for _ in range(18)]
    rows = [(10 * i, media.encode_pgm(p)) for i, p in enumerate(base)]
    rows += [(10 * i + 1, media.encode_pgm(media.edited(p, i))) for i, p in enumerate(base)]
    rows += [(300 + i, media.encode_pgm(base[0] * 0.6 + 2 * i)) for i in range(8)]
    wanted = slow_image_components(rows)
    extra = [(500 + k, x) for k, x in enumerate(BROKEN)] + [(600, rows[0][1]), (0, rows[0][1]), (None, rows[10][1])]
    frame = spark.createDataFrame([(*r, 1, "r") for r in rows + extra], "image_id long, content binary, corners int, root string")
    got = media.copies(frame, scratch).collect()
    assert len(got) == len(rows) + len(extra)
    component = {r["image_id"]: r["component_id"] for r in got if r["image_id"] is not None}
    assert len({wanted[10 * i] for i in range(18)}) == 18 and sum(wanted[10 * i + 1] == 10 * i for i in range(18)) >= 17
    assert all(component[i] in (w, i) for i, w in wanted.items())  # nothing joined that brute force keeps apart
    assert sum(component[i] == w for i, w in wanted.items()) >= len(wanted) - 1
    assert component[600] == 0 and all(component[500 + k] == 500 + k for k in range(len(BROKEN)))
    assert [(r["n_equal"], r["component_id"], r["kept"]) for r in got if r["image_id"] is None] == [(1, 100, False)]
    assert {r["n_equal"] for r in got if r["image_id"] == 0} == {2}
    assert media.copies(spark.createDataFrame([], "image_id long, content binary"), scratch).count() == 0


def test_copies_do_not_depend_on_other_files(spark, scratch):
    """Pairs that barely meet, alone and among files that are no pictures."""
    rows = []
    for seed, scale in ((7069, 0.6), (7110, 0.6), (7117, 0.65)):
        p = media.picture(np.random.default_rng(seed).normal(size=8).astype("f4"))
        rows += [(len(rows), media.encode_pgm(p)), (len(rows) + 1, media.encode_pgm(media.resize(p[None], scale)[0]))]
    others = [(100 + i, b"no picture %d" % i) for i in range(2000)]
    for more in ([], others):
        got = media.copies(spark.createDataFrame(rows + more, "image_id long, content binary"), scratch).where("image_id < 100").collect()
        assert {r["image_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


@pytest.mark.parametrize("far", [0, 1])
def test_crowded_entries_link_what_others_link(spark, scratch, monkeypatch, far):
    """One entry of two copies whose shapes there agree or not, crowded or not."""
    p = media.picture(np.arange(8, dtype="f4"))
    frame = spark.createDataFrame([(1, media.encode_pgm(p)), (2, media.encode_pgm(p * 0.7 + 40))], "image_id long, content binary")
    assert media.agree(*[media.corners(x[None])[0] for x in (p, np.floor(p * 0.7 + 40))]) >= media.INLIERS

    def entries(found, tests):
        low = found.agg(F.min("cid").alias("low"))
        length = F.when(F.col("cid") == F.col("low"), 0).otherwise(far * 5000)  # the third of the shape's parts
        return found.crossJoin(low).select(F.lit(7).cast("long").alias("key"), "cid", F.shiftleft(length.cast("long"), 32).alias("shape"))

    monkeypatch.setattr(media, "entries", entries)
    for crowd in (64, 1):
        monkeypatch.setattr(media, "CROWD", crowd)
        got = {r["image_id"]: r["component_id"] for r in media.copies(frame, scratch).collect()}
        assert got == {1: 1, 2: 2 if far else 1}, crowd


def test_copies_of_every_kind_are_found(spark, scratch):
    """Meeting in tables and agreeing, for each edit and sizes between the levels of the pyramid."""
    rng = np.random.default_rng(6)
    base = [media.picture(rng.normal(size=8).astype("f4")) for _ in range(30)]
    tests = media.chosen_tests(*media.tables_for(50_000))

    def entries(p):
        c = media.corners(media.decode(media.encode_pgm(p))[None])[0]
        pairs = media.partners(c)
        shape = np.zeros((len(pairs), 4), np.int16)
        shape[:, :3] = media.invariants(c, pairs)
        return c, media.keys(c, pairs, tests), shape.view(np.int64)[:, 0]

    def found(x, y):
        i, j, _ = np.nonzero(x[1][:, None, :] == y[1][None, :, :])
        return bool(len(i)) and media.same_shape(x[2][i], y[2][j]).any() and media.agree(x[0], y[0]) >= media.INLIERS

    own = [entries(p) for p in base]
    edits = {k: lambda p, k=k: media.edited(p, k) for k in range(media.KINDS)}
    edits |= {s: lambda p, s=s: media.resize(p[None], s)[0] for s in (0.95, 0.75, 0.67)}
    for kind, edit in edits.items():
        assert np.mean([found(x, entries(edit(p))) for x, p in zip(own, base)]) >= 0.9, kind
    assert not any(found(x, y) for x, y in zip(own, own[1:]))


def test_corners_grow_with_the_picture():
    p = media.picture(np.arange(8, dtype="f4"), 256)
    many, few = [len(media.corners(x[None])[0]) for x in (p, p[64:192, 64:192])]
    assert many > 3 * few > 60


def png(pixels, kind):
    import struct

    h, w, c = pixels.shape
    lines, before = b"", np.zeros(w * c, int)
    for row in pixels.reshape(h, -1).astype(int):
        left = np.concatenate([np.zeros(c, int), row[:-c]])
        corner = np.concatenate([np.zeros(c, int), before[:-c]])
        if kind == 4:
            p = left + before - corner
            d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
            guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], before, corner))
        else:
            guess = (0, left, before, (left + before) // 2)[kind]
        lines += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("c", [1, 3])
def test_decode_png(kind, c):
    pixels = np.random.default_rng(kind).integers(0, 256, (11, 7, c))
    assert np.allclose(media.decode(png(pixels, kind)), pixels.mean(axis=2), atol=1e-3)


def test_pipeline_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near-duplicates", "source mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        counts.append((docs.count(), out.count()))
        docs = out
    assert all(0 < after <= before for before, after in counts[:3])
    assert set(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns) >= {"doc_id", "sequence_id", "offset"}


def test_stages_keep_batches_small(spark):
    """A stage lowers the session's limit on Arrow batches, and leaves one that the session set."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    corpus_pipeline.stage_scratch(session, "test")
    assert session.conf.get(limit) == str(corpus_pipeline.BATCH_BYTES)
    session.conf.set(limit, "1234567")
    corpus_pipeline.stage_scratch(session, "test")
    assert session.conf.get(limit) == "1234567"


def test_packing_leaves_no_cache(spark, docs_of, tmp_path):
    """A worker that has cut documents holds no pre-tokens of them when it runs other tasks."""
    own = str(shutil.copy(default_vocabulary(), tmp_path / "own.json"))  # no other test's encoder
    assert packing.pieces(docs_of(["one two three"] * 50).repartition(4), vocabulary=own).count() == 50

    def held(batches):
        from tidebook.llm.tokens import _encoders

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(_encoders[own].kept) if own in _encoders else 0] * batch.num_rows})

    assert spark.range(0, 8, 1, 8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0
