"""Every operator against brute force or exact round trips, and on nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sardabir.llm import bpe, chat, decontaminate, html_text, neardup, oracles, pii, quality, queries, sharding, shingles, toxicity, winnowing

SMALL = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, kept boolean, component_id long, words string"


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "one two three four five six"), (2, None), (3, ""), (4, "one two three four five six"), (4, "one two three four five six"), (5, "ü " * 40_000), (6, "\n\t "), (None, "no id here"), (7, "x" * 100_000), (8, "a b")]
    return spark.createDataFrame([(k, t, None, "s", None, 9, 0.5, True, 0, "w") for k, t in rows], WIDE)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], oracles.ORACLE_SQL[name])


# ---- 2: shards


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark):
    keys = np.array([0, 1, 2, 10**18, 2**64 - 1, *range(100, 1100)], dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sharding.assign_shards(docs, 8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == jump(r["doc_id"], 8) and r["grown_shard"] in (r["shard"], 8) and r["grown_shard"] == jump(r["doc_id"], 9)
    for s in range(8):
        mine = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [y for _, y in mine] == sorted(y for _, y in mine)


def test_shards_of_odd_rows(spark):
    got = sharding.assign_shards(odd(spark), 3).collect()
    assert len(got) == 10 and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign_shards(odd(spark).limit(0), 3).count() == 0


# ---- 3: chat


def test_chat_round_trip(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", r"<\s>", r"[\\INST]", "\\", "a", "\n", " ", "[", "]", "é"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "[INST]", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 7))]
    turns += [(90, 0, None, None), (90, None, "user", "late"), (90, 1, "assistant", "x"), (90, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    told = chat.format_conversations(df).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("parts")).alias("loss"))
    for r in told.collect():
        want = sorted(((t is None, t or 0, role or "", text or "") for c, t, role, text in turns if c == r["conv_id"]))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(role, text) for _, _, role, text in want]
        assert r["loss"] == "".join(text for _, _, role, text in want if role == "assistant")
        runs = sum(k == 0 or want[k][2] != want[k - 1][2] for k in range(len(want)))
        assert len(re.findall(r"<s>", r["formatted"])) == runs
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 4: decontamination


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "Three four  five six seven eight nine ten"), (2, "a b"), (3, ""), (4, None), (None, "x y"), (5, "TWO three four FIVE six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", 0), (2, None, 0), (3, "b a b", 0), (4, "three four five six zzz", 0), (None, "a b", 0), (1, "a b", 0)], "doc_id long, text string, words int")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (3, 2), (1, 5)}
    assert sorted(r["text"] or "" for r in decontaminate.clean(docs, items).collect()) == ["", "a b", "three four five six zzz"]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), items).count() == 0


# ---- 5: main text


def test_main_text_of_unseen_pages():
    rng, trees, right = random.Random(99), html_text.trained(300), 0
    for _ in range(150):
        source, good = html_text.made_up_page(rng)
        got = {w.strip(",.;") for w in html_text.extract([source], trees)[0].split()}
        want = {w for w in good if w in source}
        right += len(got & want) >= 0.95 * max(len(got), len(want))
    assert right >= 125


def test_main_text_of_the_pages(spark):
    import html

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    told, wrong = {r["page_id"]: r for r in html_text.main_text(rows).collect()}, 0
    for r in rows.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article|$)", r["html"])
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"<[^<>]*$|</?b>", "", body[1] if body else ""))).split())
        wrong += told[r["page_id"]]["text"] != want
        assert told[r["page_id"]]["n_chars"] == len(told[r["page_id"]]["text"])
    assert wrong <= 0.01 * len(told) + 1
    edge = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p", "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html_text.main_text(edge).collect()] == ["", "", ""]


def test_decoding_never_contradicts():
    rng = np.random.default_rng(4)
    for seed in range(40):
        page = html_text.Page(html_text.made_up_page(random.Random(seed))[0])
        kept = html_text.decode(page, rng.normal(0, 3, len(page.parent)))
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


# ---- 6: near-duplicates


def test_shingle_sets():
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "b", " ", "  ", "\n", "ü", ".", "\x0b", "\xa0"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    got = shingles.shingle_sets(texts)
    assert [len(s) for s in got] == [len(s) for s in sets]
    for i in range(0, 300, 3):
        for j in range(300):
            assert (len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j]))


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 1.0):
        errors = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
            n = int(round(2 * 400 * share / (1 + share)))
            b = np.unique(np.concatenate((a[:n], rng.integers(0, 2**63, 400 - n, dtype=np.uint64))))
            m = neardup.pack(shingles.minima([a, b], neardup.FACTORS, neardup.SHIFTS))
            both = len(np.intersect1d(a, b))
            errors.append(neardup.estimate(m[0], m[1]) - both / (len(a) + len(b) - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# ---- 7: BPE

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_pieces_change_nothing():
    enc, rng = bpe.encoding(PATH, public_tokenizers.PATTERN), random.Random(3)
    parts = ["word", " word", "  ", "\n", "\n\n ", "'s", " 12", "ü", "漢字", "!!", " \t", "\xa0", "a" * 40, "😀"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        ids = bpe.encode(text, enc, size=7)
        assert ids.tolist() == enc.encode_ordinary(text) and "".join(bpe.pieces(text, 7)) == text
        assert bpe.decode(ids, enc) == text.encode()


def test_bpe_digests(spark):
    enc = bpe.encoding(PATH, public_tokenizers.PATTERN)
    for r, s in zip(odd(spark).collect(), bpe.token_digests(odd(spark), PATH, public_tokenizers.PATTERN).collect()):
        ids = enc.encode_ordinary(r["text"] or "")
        assert (s["doc_id"], s["n_tokens"]) == (r["doc_id"], len(ids))
        assert s["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert s["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert all(r["whole"] for r in bpe.tokenize(odd(spark), PATH, public_tokenizers.PATTERN).collect())


# ---- 8: surrogates

KEY = b"k" * 16


def test_surrogates_keep_type_form_and_identity():
    text = 'a.B.7@mail3.example.com A.b.7@MAIL3.EXAMPLE.COM +1 (136) 555-7479 1-136-555-7479 97.51.17.173 4736962573099581 4111 1111 1111 1111 token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" Mr. John Smith Mrs Jane Doe 123-45-6789 DE89370400440532013000 version 3. 2024-01-02 ۰۹۱۲-1'
    new, found = pii.pseudonymize(text, KEY)
    assert sorted({k for _, _, k in found}) == sorted(pii.KINDS) and len(new) > 0
    assert pii.pseudonymize(text, KEY)[0] == new and pii.pseudonymize(text, b"other")[0] != new
    for s, e, kind in found:
        assert kind == "name" or text[s:e] not in new
    emails = re.findall(r"\S+@\S+", new)
    assert emails[0].lower() == emails[1].lower()
    phones = re.findall(r"(?:\+1 |1-)\(?\d{3}\)?[ -]\d{3}-\d{4}", new)
    assert len(phones) == 2
    card = [int(d) for d in re.findall(r"(?<!\d)\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")]
    assert pii._luhn(card) == 0
    for clean in ("nothing to see. Version 4.0.", "CC BY-NC 4.0.", "", "10:30 = 5"):
        assert pii.pseudonymize(clean, KEY) == (clean, [])


def test_surrogates_are_distinct():
    for make, kind in ((lambda i: f"10.{i // 250}.{i % 250}.7", "ip"), (lambda i: f"{i:013d}", "card"), (lambda i: f"u{i:05d}@mail1.example.com", "email"), (lambda i: f"+1 (555) {i % 1000:03d}-{i // 1000:04d}", "phone")):
        values = [make(i) for i in range(3000)]
        assert len({pii.surrogate(v, kind, KEY) for v in values}) == len(set(values))
    text = " ".join(f"Mr {a}{b} ," for a, b in zip(["Tom", "Jim", "Bob", "Sam", "Max", "Ted"] * 2, ["", "", "", "", "", "", "my", "my", "by", "my", "el", "dy"]))
    new, found = pii.pseudonymize(text, KEY)
    assert len({text[s:e] for s, e, _ in found}) == len(set(re.findall(r"Mr (\w+)", new)))


def test_surrogates_of_odd_rows(spark):
    new = pii.replace_pii(odd(spark).withColumn("text", F.concat("text", F.lit(" x.1@mail1.example.com"))), KEY)
    assert new.columns == odd(spark).columns
    for a, b in zip(odd(spark).collect(), new.collect()):
        assert (b["text"] is None) == (a["text"] is None) and (b["text"] is None or "example.com" not in b["text"])
    assert pii.describe_pii(odd(spark), KEY).count() == 10 and pii.replace_pii(odd(spark).limit(0), KEY).count() == 0


# ---- 9: winnowing


def brute_prints(text, gram, window):
    if not text:
        return set()
    gram = min(gram, len(text))
    hashes = winnowing.gram_hashes(np.array([ord(c) for c in text], dtype=np.uint32), gram).tolist()
    window = min(window, len(hashes))
    return {(max(k for k in range(i, i + window) if hashes[k] == min(hashes[i:i + window])), min(hashes[i:i + window])) for i in range(len(hashes) - window + 1)}


def test_winnowing_equals_brute_force(monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK", 90)
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("abü 😀") for _ in range(rng.randint(0, 400)))
        hashes, at = winnowing.winnow(text)
        assert set(zip(at.tolist(), hashes.tolist())) == brute_prints(text, winnowing.GRAM, winnowing.WINDOW)
    shared = "".join(rng.choice("abcdefgh") for _ in range(39))
    a, b = (set(winnowing.winnow(x + shared + x)[0].tolist()) for x in ("q" * 50, "z" * 60))
    assert a & b


def test_neighbours(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in odd(spark).collect()]
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0, zlib.crc32(d[1].encode()), d[1]))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r) for r in winnowing.compare_neighbours(odd(spark)).collect())
    want = [(key, len(text), hashlib.sha256(winnowing.edited(text, docs[(k + 1) % len(docs)][1]).encode()).hexdigest()) for k, (key, text) in enumerate(docs)]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"])) for _, r in got)
    hexed = lambda text: "".join(f"{h:08x}" for h in sorted({h for _, h in brute_prints(text, winnowing.GRAM, winnowing.WINDOW)}))
    cut = lambda x: {x[k:k + 8] for k in range(0, len(x), 8)}
    alike = lambda a, b: len(cut(a) & cut(b)) / len(cut(a) | cut(b)) if a or b else 1.0
    told = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for _, r in got}
    for (key, text), row, following in zip(docs, want, [*docs[1:], docs[0]]):
        if len(text) < 1000:
            own, others, r = hexed(text), hexed(winnowing.edited(text, following[1])), told[row]
            assert (r["fingerprint"], r["edited_fingerprint"], r["near_edited"]) == (own, others, alike(own, others))
            assert r["near_next"] == alike(own, hexed(following[1])) if len(following[1]) < 1000 else r["near_next"] < 1
    same = [r["fingerprint"] for _, r in got if r["doc_id"] in (1, 4)]
    assert len(set(same)) == 1
    assert winnowing.compare_neighbours(odd(spark).limit(0)).count() == 0
    alone = winnowing.compare_neighbours(spark.createDataFrame([(5, "abcdefgh" * 9)], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_of_odd_rows(spark):
    for r, s in zip(odd(spark).collect(), winnowing.fingerprints(odd(spark)).collect()):
        assert r["doc_id"] == s["doc_id"] and len(s["hashes"]) == len(s["positions"])
        if len(r["text"] or "") < 1000:
            assert sorted(zip(s["positions"], s["hashes"])) == sorted(brute_prints(r["text"], winnowing.GRAM, winnowing.WINDOW))
    assert winnowing.fingerprints(odd(spark).limit(0)).count() == 0


def test_neighbours_and_shards_of_a_hot_id(spark, monkeypatch):
    from sardabir.llm import common

    rng = random.Random(5)
    rows = [(k if k % 3 else None if k % 2 else 77, " ".join(rng.choice("abcdefg") * 3 for _ in range(12))) for k in range(300)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = common.range_splits
    for module in (winnowing, sharding):
        monkeypatch.setattr(module, "range_splits", lambda df, col, n=20: real(df, col, 20))
    splits, hot = real(df.withColumnRenamed("doc_id", "id"), "id", 20)
    assert hot.tolist() == [77]
    docs = sorted(rows, key=lambda d: (d[0] is None, d[0] or 0, zlib.crc32(d[1].encode()), d[1]))
    want = [(key, len(text), hashlib.sha256(winnowing.edited(text, docs[(k + 1) % len(docs)][1]).encode()).hexdigest()) for k, (key, text) in enumerate(docs)]
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in winnowing.compare_neighbours(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    told = sharding.assign_shards(df, 3).collect()
    order = lambda k, crc: (k is not None, k or 0, crc)
    for s in range(3):
        mine = sorted((r["slot"], order(r["doc_id"], r["text_crc32"])) for r in told if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and [y for _, y in mine] == sorted(y for _, y in mine)


# ---- 1 and 10: classifiers


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32), None)
    f, x = np.arange(9, dtype=np.int32) * 5, rng.normal(size=9).astype(np.float32)
    want = 0.3 + float(model.linear[f] @ x) + sum(float(model.factors[f[i]] @ model.factors[f[j]]) * x[i] * x[j] for i in range(9) for j in range(i))
    assert abs(model.logits(np.array([9]), f, x)[0] - want) < 1e-3


def test_scores_are_those_of_all_pairs():
    texts = ["the quick fox. It ran and slept well", "x | y | z | w | v!!", "", "one two two three!"]
    model = quality.train(texts[:2] * 30, [None, 5] * 30, np.array([1, 0] * 30))
    for text, length in zip(texts, [None, 5, 0, 18]):
        _, f, x = model.inputs(*quality.describe([text], [length]))
        want = model.bias + sum(float(model.linear[i]) * v for i, v in zip(f, x)) + sum(float(model.factors[f[i]] @ model.factors[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(model.scores([text], [length])[0] - 1 / (1 + np.exp(-want))) < 1e-4


def test_gru_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    vectors = rng.normal(size=(9, 2 * toxicity.WIDTH))
    vectors[-1] = 0
    places = rng.integers(0, 9, (5, 3))
    places[:2] = rng.integers(0, 8, (2, 3))
    kept = {}
    net.logits(net.project(vectors), places, kept)
    g, _ = net.gradients(np.ones(3), vectors, places, kept)
    for name in ("Wf", "Ub", "cf", "A", "v", "o", "p"):
        at = tuple(rng.integers(0, n) for n in net.weights[name].shape)
        old, values = net.weights[name][at], []
        for step in (1e-4, -1e-4):
            net.weights[name][at] = old + step
            values.append(float(net.logits(net.project(vectors), places).sum()))
        net.weights[name][at] = old
        assert abs((values[0] - values[1]) / 2e-4 - g[name][at]) < 2e-3, name


def test_classifiers_on_odd_rows(spark):
    good, bad = "the quick fox. It ran and slept well", "x | y | z | w | v!!"
    model = quality.train([good, bad] * 30, [None, 5] * 30, np.array([1, 0] * 30))
    got = quality.score(odd(spark), model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(odd(spark), model).columns == odd(spark).columns
    net = toxicity.train(["you scum of mine", "a nice day we had"] * 20, np.array([1, 0] * 20))
    got = toxicity.score(odd(spark), net).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert net.scores(["such scum"])[0] > net.scores(["a nice day"])[0]
    for constant in (quality.train([], [], np.zeros(0)), toxicity.train([], np.zeros(0))):
        texts = (["a"], [1]) if isinstance(constant, quality.Model) else (["a"],)
        assert constant.scores(*texts).tolist() == [0.5]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd(spark), none, F.lit(True)).linear is None and toxicity.fit(odd(spark), none, F.lit(True)).constant == 0.5
