"""Line dedup, fingerprints, similarity, personal data and toxicity against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tidebook.llm import linededup, pii, similar, simhash, toxicity
from tidebook.llm.queries import QUERIES

EDGES = [None, "", " \t\n", "a", "A b", "a B c", "x " * 30000, "a b c", "a b c", "ß É", "\n\n\n"]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("crowded", [32, 0])
def test_simhash_is_brute_force(spark, scratch, docs_of, crowded, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (crowded,))
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(80)) for _ in range(6)]
    texts = EDGES + [re.sub("aa", rng.choice(["aa", "zz"]), b, count=1) + rng.choice(["", " q", "!"]) for b in base for _ in range(8)]
    prints = [slow_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == prints
    linked = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 2]
    got = {r["doc_id"]: (r["fingerprint"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs_of(texts), scratch).collect()}
    wanted = slow_components(range(len(texts)), linked)
    assert got == {i: (p, wanted[i]) for i, p in enumerate(prints)}


@pytest.mark.parametrize("crowded", [32, 0])
def test_simhash_broadcasts_nothing(spark, scratch, docs_of, crowded, monkeypatch):
    """Every table grows with the documents, so none may go to the driver, however small Spark takes it for."""
    monkeypatch.setattr(simhash.links, "__defaults__", (crowded,))
    write, plans = scratch.write, {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(scratch, "write", noted)
    texts = [" ".join(random.Random(i // 3).choices("abcdefgh", k=60)) + " q" * (i % 3) for i in range(30)]
    out = simhash.near_duplicates(docs_of(texts), scratch)
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plans["out"] and out.count() == 30
    assert {n for n, p in plans.items() if "Broadcast" in p} == set()


def test_close_fingerprints_all_meet(spark, scratch):
    """Random fingerprints with 0 to 3 bits turned, by tables and by balls."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    prints = {int(b) for b in base}
    for b in base:
        for n in (1, 2, 3):
            x = int(b) & (1 << 64) - 1
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            prints.add(x - (1 << 64) if x >> 63 else x)
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    wanted = {frozenset((a, b)) for a in prints for b in prints if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowded in (32, 0):
        pairs = {frozenset((r["a"], r["b"])) for r in simhash.links(frame, scratch, crowded).collect()}
        if crowded:
            assert pairs == wanted
        assert slow_components(prints, map(sorted, pairs)) == slow_components(prints, map(sorted, wanted))


def test_simhash_edges(spark, scratch, docs_of):
    got = simhash.near_duplicates(docs_of(["a b c d", "a b c d", None], [None, None, 3]), scratch).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got if r["doc_id"] is None) == [(-1, None), (-1, None)]
    assert simhash.near_duplicates(docs_of([]), scratch).count() == 0


def slow_similar(texts, size=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    return [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


@pytest.mark.parametrize("crowd", [16, 2])
def test_similar_documents(spark, scratch, docs_of, crowd, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", crowd)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(5))
    texts = list(EDGES)
    for _ in range(12):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 5, 9, 30):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    linked = slow_similar(texts)
    got = {r["doc_id"]: r["root"] for r in similar.groups(docs_of(texts), scratch).collect()}
    wanted = slow_components(range(len(texts)), linked)
    found = sum(got[a] == got[b] for a, b in linked) / len(linked)
    assert found >= 0.95
    assert all(wanted[a] == wanted[b] for a in got for b in got if got[a] == got[b])
    kept = similar.keep_one(docs_of(texts), scratch)
    assert kept.columns == docs_of([]).columns and kept.count() == len(set(got.values()))
    assert {r["doc_id"] for r in kept.collect()} == {min(i for i in got if got[i] == g) for g in set(got.values())}


def test_pairs_at_the_threshold_are_all_found(scratch, docs_of):
    rng, texts = random.Random(4), []
    for k in range(300):  # 400 words, and a copy with nine words replaced, two of them close: Jaccard 0.80 to 0.81
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(400)]
        texts.append(" ".join(words))
        for at in rng.sample(range(0, 40), 8):
            words[10 * at] = f"new{k}x{rng.randrange(10**6)}"
        words[10 * at + 4] = f"new{k}x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    pairs = [(2 * k, 2 * k + 1) for k in range(300)]
    sets = [similar.shingles(t, 5) for t in texts]
    close = [(a, b) for a, b in pairs if 0.8 <= len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) < 0.85]
    got = {r["doc_id"]: r["root"] for r in similar.groups(docs_of(texts), scratch).collect()}
    found = sum(got[a] == got[b] for a, b in close)
    assert len(close) >= 250 and found == len(close), (found, len(close))


def test_similar_edges(spark, scratch, docs_of):
    assert similar.keep_one(docs_of([]), scratch).count() == 0
    twice = docs_of(["p q r s t u"] * 3, [1, 1, None])
    assert [r["doc_id"] for r in similar.keep_one(twice, scratch).collect()] == [1]


def slow_lines(docs, least):
    """Later copies by comparing every line's runs with all runs before it."""
    seq = [(d, line) for d, t in docs if t is not None for line in t.split("\n")]
    segments, now = [], None
    for j, (d, _) in enumerate(seq):
        best = 0
        for q in range(j):
            n = 0
            while j + n < len(seq) and seq[j + n][0] == d and seq[q + n][0] == seq[q][0] and seq[j + n][1] == seq[q + n][1]:
                n += 1
            best = max(best, n)
        if best and now and seq[now[0]][0] == d and j < now[1]:
            now[1] = max(now[1], j + best)
        elif best:
            segments.append(now := [j, j + best])
    gone = {k for a, b in segments for k in range(a, b) if sum(len(seq[x][1].split()) for x in range(a, b)) >= least}
    out = {d: None if t is None else [] for d, t in docs}
    for j, (d, line) in enumerate(seq):
        if j not in gone:
            out[d].append(line)
    return {d: None if x is None else "\n".join(x) for d, x in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_is_brute_force(spark, scratch, docs_of, seed):
    rng = random.Random(seed)
    lines = ["a b", "c", "d e f", "g h i j", "k", "", "l m"]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.8 else f"u{rng.random()}" for _ in range(rng.randint(1, 12))) for _ in range(25)]
    texts[3], texts[4], texts[7], texts[9], texts[11] = None, "", texts[2], "\n".join(["c"] * 40), "\n".join(["c"] * 40)
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(docs_of(texts), scratch, 8).collect()}
    assert got == slow_lines(list(enumerate(texts)), 8)


def test_line_dedup_edges(spark, scratch, docs_of):
    passage = "\n".join(" ".join(f"w{k}{i}" for i in range(20)) for k in range(3))
    out = linededup.deduplicate(docs_of([passage, f"own\n{passage}\nend", passage, passage, "short", "short"], [None, 5, 6, 6, 7, 8]), scratch)
    assert out.columns == [*docs_of([]).columns, "removed"]
    rows = sorted(((r["doc_id"] or -1), r["text"]) for r in out.collect())
    assert rows == [(-1, passage), (5, "own\nend"), (6, ""), (6, ""), (7, "short"), (8, "short")]
    assert linededup.deduplicate(docs_of([]), scratch).count() == 0


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_pii(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k] if k != 1 else all(int(x) <= 255 for x in m.group().split("."))
            if fine:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_spans_are_brute_force(spark, docs_of, model):
    rng = random.Random(3)
    parts = ["a.b@c.d", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (2) 345-678 90", "+12", ".", "-", " ", "x", "é", "\U0001f600", "5", "\n", "001.2.3.255", "_d@e.f"]
    texts = EDGES + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["9" * 5000, "1." * 4000, "a@" + "b." * 20000 + "c", " a." * 3000 + "@x.y"]
    found = pii.find(docs_of(texts), *model).select("doc_id", pii.written(pii.F.col("base")).alias("b"), "base", "found").collect()
    for r in found:
        assert r["b"] == slow_pii(texts[r["doc_id"]])
        assert set(r["base"]) <= set(r["found"])
        ends = sorted((x["s"], x["e"]) for x in r["found"] if x not in r["base"])
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_added_spans(spark, docs_of, model):
    texts = ["mail me: joe.x [at] foo [dot] com now", "host 10[.]0[.]0[.]7 or call (212) 555-1234 ok", "look at this. Then 2021-10-12 date", "a@b.co and 10.0.0.1"]
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs_of([*texts, None]), *model).collect()}
    assert rows == {0: "mail me: [email] now", 1: "host [ip] or call [phone] ok", 2: texts[2], 3: "[email] and [ip]", 4: None}


@pytest.mark.parametrize("form", ["jane(@)example.com", "jane[@]example.com", "jane@example [dot] com", "jane@example(dot)com", "jane@example dot com", "jane [ at ] example.com"])
def test_every_form_of_address_is_found_alone(spark, docs_of, model, form):
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs_of([f"contact {form}", f"Kontakt: {form}", f"contact {form} at noon"]), *model).collect()}
    assert rows == {0: "contact [email]", 1: "Kontakt: [email]", 2: "contact [email] at noon"}


def candidates_of(spark, made):
    text = pii.F.explode(pii.F.split(pii.F.lit("\n".join(f"{y}{t}" for t, y in made)), "\n"))
    rows = spark.range(1).select(text.alias("t")).select(pii.F.left("t", pii.F.lit(1)).cast("int").alias("y"), pii.F.explode(pii.candidates(pii.F.expr("substring(t, 2)"))).alias("c")).select("y", "c.f.*").collect()
    return np.array([[r[n] for n in pii.FEATURES] for r in rows], float), np.array([r["y"] for r in rows])


def test_trees_separate_unseen_examples(spark, model):
    x, y = candidates_of(spark, pii.examples(600, seed=99))
    chosen = pii.apply_trees(x, model[0]) >= np.array(model[1])[x[:, 0].astype(int)]
    assert y[chosen].mean() >= 0.95


def with_check_digit(body):
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def test_spans_of_every_kind_are_added(spark, docs_of, model):
    """Texts by other rules than the trees' own: what is hidden in them is found, numbers that are no personal data are not."""
    rng = random.Random(17)
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(6))
    texts, kinds = [], []
    for _ in range(60):
        card, octet = with_check_digit("4" + num(14)), [str(rng.randint(2, 254)) for _ in range(4)]
        for kind, span in (("email", rng.choice(["anna.lee (at) firm (dot) com", "bob_7 [at] site.org", "carl @ web.de", "dora at mail dot net"])), ("ip", rng.choice(["[.]", "(.)", " dot "]).join(octet)),
                           ("card", rng.choice([f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}", f"{with_check_digit('4' + num(14))} {card}", f"{card[:4]}/{card[4:8]}/{card[8:12]}/{card[12:]}"])),
                           ("phone", rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0049 {num(3)} {num(3)} {num(3)}"]))):
            lead = {"email": "write to", "ip": "the host", "card": "her credit card", "phone": "call"}[kind]
            texts.append(f"{filler()} {lead} {span} {filler()}")
            kinds.append(kind)
    none = [f"{filler()} {x} {filler()}" for x in ("on 2021-10-12", "chapter 3.14.15.92653", "isbn 9781234567897123", "room 12 34 56", "see you @ noon. Then we go", "version 10. 300. 5. 2", "order 12345 67890 12345", "look at this. Now", "invoice 90210 90210")]
    rows = {r["doc_id"]: (r["base"], r["found"]) for r in pii.find(docs_of(texts + none), *model).select("doc_id", "base", "found").collect()}
    for k, kind in enumerate(pii.KINDS):
        own = [i for i, x in enumerate(kinds) if x == kind]
        assert kind == "phone" or not any(rows[i][0] for i in own)  # one in ten of the longer phone numbers has a check digit
        assert np.mean([any(x["k"] == k for x in rows[i][1]) for i in own]) >= 0.9, kind
    assert [len(rows[len(texts) + i][1]) for i in range(len(none))] == [0] * len(none)


def test_personal_data_keeps_other_columns(spark, model):
    frame = spark.createDataFrame([(1, "mail a@b.co", 5, "f", 2), (1, "mail a@b.co", 5, "f", 2), (None, None, 6, None, 3)], "doc_id long, text string, base int, found string, wide int")
    out = pii.redact(frame, *model)
    assert out.columns == frame.columns
    assert sorted((r["text"] or "", r["base"], r["found"] or "", r["wide"]) for r in out.collect()) == [("", 6, "", 3), ("mail [email]", 5, "f", 2), ("mail [email]", 5, "f", 2)]
    assert pii.redact(frame.limit(0), *model).count() == 0


def test_personal_data_query_runs_no_python(spark, sf_dir):
    out = QUERIES["op7_personal_data"](spark, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    r = out.first()
    base = [s for s in r["spans"].split(",") if s] if r["spans"] else []
    assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] <= len(base)
    assert len(r["base_sha256"]) == len(hashlib.sha256(b"").hexdigest())


def test_toxicity_on_held_out_rows(spark, scratch, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7)))
    texts, marks = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = "glumph" + word()
        texts.append(" ".join(words))
        marks.append((i, int(toxic)))
    texts += EDGES
    docs = docs_of(texts)
    labels = spark.createDataFrame([m for m in marks if m[0] % 3] + [(9999, None)], "doc_id long, toxic int")
    model = toxicity.train(labels, docs, scratch)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [m for m in marks if m[0] % 3 == 0]
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(y) for i, y in held]) >= 0.98
    assert all(0 <= s <= 1 for s in got.values()) and all(got[600 + i] < toxicity.THRESHOLD for i in range(len(EDGES)))


def test_toxicity_without_a_class(spark, scratch, docs_of):
    docs = docs_of(["a b", None])
    for labels, wanted in (([], 0), ([(0, 0)], 0), ([(0, 1)], 1)):
        model = toxicity.train(spark.createDataFrame(labels, "doc_id long, toxic int"), docs, scratch)
        assert [round(r["score"]) for r in toxicity.score(docs, model).collect()] == [wanted, wanted]


def test_repeated_ids_train_once(spark, scratch, docs_of):
    docs = docs_of(["bad glumph"] * 40 + ["fine"] * 40 + [None], [1] * 40 + [2] * 40 + [None])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    toxicity.train(labels, docs, scratch, most=1)
    assert spark.read.parquet(scratch.path("sample")).count() == 2
    scored = toxicity.score(docs.withColumn("score", docs["doc_id"]), toxicity.train(labels, docs, scratch))
    assert scored.columns.count("score") == 1 and scored.schema["score"].dataType.simpleString() == "double"
    assert toxicity.score(docs.limit(0), toxicity.train(labels, docs.limit(0), scratch)).count() == 0


def test_long_texts_give_the_same_ngrams():
    text = "".join(random.Random(1).choice("abc d") for _ in range(toxicity.PIECE * 2 + 77))
    cut = collections.Counter(int(x) for h in toxicity.ngrams(text) for x in h)
    whole = toxicity.PIECE
    toxicity.PIECE = 1 << 30
    try:
        assert cut == collections.Counter(int(x) for h in toxicity.ngrams(text) for x in h)
    finally:
        toxicity.PIECE = whole
