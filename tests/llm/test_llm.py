"""Each operator against brute force, round trips and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from assay.llm import chat, decontaminate, license_scan, near_dedup, token_rollup, toxicity
from assay.llm import sentencepiece_codec as pieces
from assay.llm import url_filter, vector_search, warc
from assay.llm.queries import QUERIES
from assay.scratch import scratch_path
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, node string"


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = {int(h): int(c) for h, c in zip(rng.integers(0, 2**63, 60), rng.integers(1, 9, 60), strict=True)}
    b = {h: max(1, c - int(rng.integers(0, 3))) for h, c in list(a.items())[:50]}
    both = [a, b]
    hashes = np.array([h for x in both for h in x], dtype=np.uint64)
    counts = np.array([c for x in both for c in x.values()])
    doc = np.repeat([0, 1], [len(a), len(b)])
    s = near_dedup.signatures(hashes, counts, doc, 2, m=4000)
    true = sum(min(a[h], b.get(h, 0)) for h in a) / sum(max(a[h], b.get(h, 0)) for h in a)
    assert abs((s[0] == s[1]).mean() - true) < 0.03


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(120)]
    near = base[:60] + ["other"] + base[61:]
    rows = [
        (1, " ".join(base), "x"),
        (2, " ".join(base).upper() + "!", "x"),
        (3, " ".join(near), "x"),
        (4, " ".join(f"z{i}" for i in range(120)), "x"),
        (5, None, "x"),
        (6, "", "x"),
        (7, "", "x"),
        (8, "a b", "x"),
        (9, "a b", "x"),
        (9, "a b", "x"),
        (None, "a b", "x"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, None])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_copies_of_one_character_are_one_class(spark):
    texts = ["A.", "a", "漢", "漢", " ", " ", "!", "! ", "A. b"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    assert near_dedup.deduplicate(df).count() == 6


def test_chat_round_trip(spark):
    hard = "\\l\\\\b<[ </s>[INST] \\"
    rows = [
        (1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (1, 2, None, None),
        (2, 0, "to[ol", ""), (None, None, "assistant", "x"), (3, 2000, "assistant", "b"), (3, 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_chat(df)
    back = sorted(((r.conv_id, r.role, r.text) for r in chat.read_turns(segments).collect()), key=str)
    assert back == sorted(((c, r, t or "") for c, _, r, t in rows), key=str)
    digests = {r.conv_id: r for r in chat.chat_digests(segments).collect()}
    assert digests[1].loss_sha256 == hashlib.sha256((hard * 2).encode()).hexdigest()
    assert digests[3].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    full = {(r.conv_id, r.example): r for r in chat.render(segments).collect()}
    assert len(full) == 4
    example = full[(3, 0)]
    assert example.text == "<s>[INST] a [/INST]<s>[OUT] b</s>"
    assert example.text[example.loss_start : example.loss_start + example.loss_chars] == "b"
    assert chat.chat_digests(chat.format_chat(df.limit(0))).count() == 0


def test_chat_query_makes_examples(spark, tmp_path, monkeypatch):
    turns = [("system", "[s]"), ("user", "a<b"), ("assistant", "\\\\l é😀"), (None, "n"), ("assistant", "</s>[b]"), ("user", "z")]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    segments = chat.format_chat(df)
    parts = [r.segment for r in segments.filter("conv_id = 1").orderBy("seq").collect()]
    made = chat.examples(segments).orderBy("example").collect()
    assert [(r.conv_id, r.example, r.context_segments, r.context_chars) for r in made] == [
        (1, n, at, len("".join(parts[:at]))) for n, at in enumerate((2, 4))
    ]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    replies = [turns[2][1], turns[4][1]]
    got = {r.conv_id: r for r in QUERIES["op2_chat_prefix_targets"](spark, str(tmp_path)).collect()}
    assert (got[1].loss_sha256, got[1].loss_chars) == (digest("".join(replies)), len("".join(replies)))
    assert (got[2].loss_sha256, got[2].loss_chars) == (digest(""), 0)
    # What is trained comes from the examples: without the second one its reply isn't.
    every = chat.examples
    monkeypatch.setattr(chat, "examples", lambda s: every(s).filter("example = 0"))
    got = {r.conv_id: r for r in QUERIES["op2_chat_prefix_targets"](spark, str(tmp_path)).collect()}
    assert (got[1].loss_sha256, got[1].n_turns) == (digest(replies[0]), 6)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (None, [1.0] * 6), (420, [2.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=7, query_block=4, candidate_block=50).collect()
    x = {i: np.floor(np.array(v) * 64) for i, v in rows[:300]}
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:7]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == want
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity(spark):
    docs = [(i, f"word{i % 7} some plain text here" + (" you utter moronix" if i % 3 == 0 else ""), "x") for i in range(400)]
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "text", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, labels).collect()}
    assert len(got) == 403
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(400))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_documents(df, labels.limit(0)).filter("score != 0").count() == 0


def test_toxicity_keeps_the_share_of_all_labels(spark, monkeypatch):
    # Nothing tells the texts apart, so each score is the toxic share of all labels.
    df = spark.createDataFrame([(i, "the same plain words") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 < 7)) for i in range(3000)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 200)
    monkeypatch.setattr(toxicity, "MAX_OTHER", 200)
    model = toxicity.fit_toxicity(df, labels)
    assert model.calibration is not None and abs(model.prior - 0.14) < 0.02
    rows = model.score(df).select("score", "predicted").distinct().collect()
    assert len(rows) == 1 and abs(rows[0].score - 0.14) < 0.05 and rows[0].predicted == 0


def test_toxicity_remembers_only_telling_words():
    features = toxicity.Features({"rotten": 2.5, "slim-": 3.0})
    row = dict(zip(toxicity.FEATURES, features.row("River, you slimy IDIOT r0tten looong river"), strict=True))
    assert features.seen["River,"] is False and features.seen["river"] is False and features.seen["slimy"]
    assert (row["hits"], row["distinct_hits"], row["undone_hits"]) == (3.0, 3.0, 1.0)
    assert row["hits_near_second_person"] == 3.0 and row["weight_density"] == pytest.approx(5.5 / 7)
    assert row["shouted_share"] == row["obfuscated_share"] == row["stretched_share"] == 1 / 7


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    item = [word() for _ in range(40)]
    changed = item[:10] + ["new"] + item[11:25] + item[27:]
    clean = [" ".join(word() for _ in range(200)) for _ in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(clean)]
    rows += [(100, " ".join(clean[0].split()[:70] + item) + " " + clean[1], "x"), (101, clean[2] + " " + " ".join(changed), "x")]
    rows += [(102, None, "x"), (103, "", "x"), (None, " ".join(item), "x"), (100, " ".join(item), "x"), (104, " ".join(item[:12]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == {(100, 7), (101, 7)}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(6)
    zipf = 1 / np.arange(1, 3001)
    draw = lambda n: [f"w{i}" for i in rng.choice(3000, n, p=zipf / zipf.sum())]
    pieces = [draw(n) for n in (5, 8, 15) for _ in range(60)]
    rows = []
    for i, own in enumerate(pieces * 2):
        # Of the longer ones 60 % of the words, the last four among them; the short ones whole.
        kept = own
        if len(own) > 5:
            least = -(-len(own) * 3 // 5)
            at = np.sort(rng.choice(len(own) - 4, least - 4, replace=False))
            kept = [own[k] for k in at] + own[-4:]
        text = draw(96 - len(kept))
        cut = int(rng.integers(0, len(text)))
        rows.append((i, " ".join(text[:cut] + kept + text[cut:])))
    items = decontaminate._numbered(list(range(len(pieces))), pieces)
    want = set()
    for doc, text in rows:
        known = [(items.vocabulary[w], k) for k, w in enumerate(text.split()) if w in items.vocabulary]
        # The passage of the first 96 words, and that of the last 48.
        for part in (known, [x for x in known if x[1] >= decontaminate.STRIDE]):
            words, places = [w for w, _ in part], np.array([k for _, k in part])
            want |= {(doc, i) for i in range(len(pieces)) if decontaminate.judge(items, i, words, places)}
    assert len(want) >= len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(pieces)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want


def test_decontamination_searches_every_passage_in_the_latent_space(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 800, n))
    pieces = [draw(30) for _ in range(40)]
    rows = [(i, draw(200)) for i in range(60)] + [(60, draw(20) + " " + pieces[3] + " " + draw(20)), (61, "nothing of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = decontaminate._numbered(list(range(40)), [p.split() for p in pieces])
    encoded = decontaminate._encode(df, "doc_id", "text", items).cache()
    frequency, passages = decontaminate._frequencies(encoded, len(items.vocabulary))
    items.weight = decontaminate.word_weights(items, frequency, passages)
    assert passages == sum(-(-len(t.split()) // decontaminate.STRIDE) for _, t in rows)
    encoded = encoded.filter("_id IS NOT NULL")
    # No passage is left out for the words it shares, and the cosine alone brings the copy.
    assert {r._id for r in encoded.collect()} == set(range(61))
    basis = decontaminate.latent_basis(encoded, items)
    found = decontaminate._search(encoded.withColumn("able", F.lit(b"")), items, basis).collect()
    assert {(r._id, r.piece) for r in found} == {(60, 3)}
    assert all(r.cosine >= decontaminate.MIN_COSINE and r.lcs == 1.0 for r in found)


def test_latent_basis_spans_the_leading_directions(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{t}w{i}" for i in rng.integers(0, 6, 40)) for t in rng.integers(0, 5, 80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [f"t{t}w{i}" for t in range(5) for i in range(6)]
    items = decontaminate._numbered(list(range(5)), [words[a : a + 6] for a in range(0, 30, 6)])
    items.weight = np.linspace(0.5, 1.5, 30)
    encoded = decontaminate._encode(df, "doc_id", "text", items).filter("_id IS NOT NULL")
    basis = decontaminate.latent_basis(encoded, items, 5)
    rows = np.zeros((80, 30))
    for r, text in zip(rows, texts, strict=True):
        for w in set(text.split()):
            at = items.vocabulary[w]
            r[at] = (1 + np.log(text.split().count(w))) * items.weight[at]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own = np.zeros((5, 30))
    for r, piece in zip(own, items.pieces, strict=True):
        r[piece] = items.weight[piece]
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    gram = rows.T @ rows + own.T @ own * 80 / 5
    best = np.linalg.eigvalsh(gram)[::-1][:5].sum()
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-4)
    assert np.trace(basis.T @ gram @ basis) >= 0.99 * best


def test_lcs_against_table():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        mask = {}
        for i, x in enumerate(a):
            mask[x] = mask.get(x, 0) | 1 << i
        assert decontaminate.lcs(mask, len(a), b) == t[-1][-1]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    rows = [(1, "http://a/ b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df, path, compression=compression)
    got = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == 5 and all(r.kind == "record" for r in got.values())
    assert (got["1"].record_type, got["1"].refers_to, got["1"].payload_bytes) == ("revisit", "2", 1)
    assert got["2"].record_type == "response" and got["4"].payload.decode() == rows[3][2]


def test_warc_salvage():
    def record(n, body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)

    good = [record(i, b"body %d" % i) for i in range(4)]
    data = good[0] + good[1][:-9] + good[2] + b"noise" + good[3]
    rows = list(warc.salvage("f", data))
    assert [r[6] for r in rows if r[3] == "record"] == ["0", "2", "3"]
    assert [(r[1], r[2]) for r in rows if r[3] == "gap"] == [(len(good[0]), len(good[1]) - 9), (len(data) - len(good[3]) - 5, 5)]
    assert sum(r[2] for r in rows) == len(data)


def test_encoding_equals_the_library(spark):
    texts = ["", None, " two  spaces ", "Ünï ▁ 漢字 😀\n\t\0x", "<s>[INST]</s>", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in pieces.encode(df, MODEL).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == sp.encode(text, add_bos=True, add_eos=True)
        assert r.decoded == sp.decode(r.ids)
        data = text.encode()
        inner = list(zip(r.starts, r.ends, strict=True))[1:-1]
        assert b"".join(data[a:b] for a, b in inner) == data


def test_token_rollup(spark):
    rows = spark.createDataFrame([("s", "en", "v1", 3), ("s", None, "v1", 4), ("s", "en", "v1", 5)], "source string, lang string, version string, tokens long")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_rollup.inserts(rows)) and not rollup.commit("a", token_rollup.inserts(rows))
    old = rows.filter("tokens = 3")
    rollup.commit("b", token_rollup.revisions(old, old.withColumn("version", F.lit("v2")).withColumn("tokens", F.lit(9))))
    rollup.commit("c", token_rollup.deletes(rows.filter("lang IS NULL")))
    rollup.commit("d", token_rollup.inserts(rows.limit(0)))
    got = sorted(tuple(r) for r in rollup.totals().collect())
    assert got == [("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 9)]


def test_license_scan_against_brute_force(spark):
    texts = ["Released under the MIT license", "plain\n\nLicensed under the Apache License, Version 2.0!\nx y", None, "", "one",
             "This work is licensed under the GNU General Public License version 3 or later", "under the under the MIT"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    grams = lambda t: Counter(zip(w := re.findall(r"[^\W_]+", t.lower()), w[1:], strict=False))
    got = {(r.doc_id, r.unit, r.at): (r.license, r.dice) for r in license_scan.scan_licenses(df).collect()}
    want = {}
    for i, t in enumerate(texts):
        for at, line in enumerate((t or "").split("\n")):
            a = grams(line)
            scores = [(-2 * (a & grams(x)).total() / max(1, a.total() + grams(x).total()), k) for k, x in license_scan.TEMPLATES]
            if min(scores)[0] <= -0.8:
                want[(i, "line", at)] = (min(scores)[1], -min(scores)[0])
    assert got.keys() >= want.keys()
    assert all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
    assert len([k for k in got if k[1] == "line"]) == len(want)


@pytest.mark.parametrize("limit", [url_filter.MAX_FILTER_BYTES, 0])
def test_url_filter(spark, limit):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "block")]
    urls = [("http://Www.Example.COM/en/1", "allow"), ("x://a.example.com/en/?q", "block"), ("http://example.com/e", "allow"), ("http://net/es/", "block"),
            ("http://a.net/fr", "allow"), (None, "allow"), ("no url", "allow"), ("http://com?x", "allow"), ("http://net/es/", "block"), ("", "allow")]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, "rule string, action string"), max_filter_bytes=limit)
    rows = {r.page_id: r for r in got.collect()}
    assert {i: r.verdict for i, r in rows.items()} == {i: v for i, (_, v) in enumerate(urls)}
    assert rows[0].rule == "www.example.com/en/" and rows[0].host == "www.example.com" and rows[7].rule is None


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.xxhash64(F.lit(1), "id").alias("h1"), F.xxhash64(F.lit(2), "id").alias("h2"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys, "listed")
    rows = keys.toPandas()
    assert (cascade.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["listed"].to_numpy()).all()


@pytest.mark.parametrize("heads", [(), (1,)])
def test_variants_near_the_limit_against_brute_force(spark, monkeypatch, heads):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(60):
        own = list(base)
        for at in rng.choice(300, int(rng.integers(2, 10)), replace=False):
            own[at] = f"x{i}_{at}"
        texts[i] = " ".join(own)
    runs = {i: Counter(tuple(t.split()[a : a + 5]) for a in range(296)) for i, t in texts.items()}
    want = {i: i for i in texts}
    for a in texts:
        for b in range(a):
            if (runs[a] & runs[b]).total() >= 0.8 * (runs[a] | runs[b]).total() and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {i: low if c == high else c for i, c in want.items()}
    assert len(set(want.values())) > 5
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], DOCS)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, heads=heads).collect()}
    assert got == want


def test_toxicity_with_parts_that_hold_no_labelled_text(spark):
    """Parts without rows of the asked kind count nothing; they used to break the worker."""
    rows = [(i, f"you idiot number {i}" if i % 3 == 0 else f"a calm note about item {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(24, "doc_id")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic")
    assert "idiot" in toxicity.learn_lexicon(sample.repartition(97, "_id"))
    assert toxicity.learn_lexicon(sample.filter("label = 1").repartition(7, "_id")) == {}


def test_top_k_with_a_far_vector_and_empty_ones(spark):
    """Bounds hold beside a vector millions of times as long, which is a pivot of every block."""
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(5, 8))
    rows = [(i, [float(v) for v in middle[i % 5] + 0.05 * rng.normal(size=8)]) for i in range(400)]
    rows += [(1000, [4e6 * v for v in rows[3][1]]), (1010, [-8e6 * v for v in rows[7][1]])]
    rows += [(2000 + 10 * i, []) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.top_k(df, F.col("vec_id") % 10 == 0, k=5, candidate_block=100).collect()
    x = {i: [int(np.floor(c * 64)) for c in v] for i, v in rows}
    want = set()
    for q in (i for i in x if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), c) for c in x if c != q and len(x[c]) == len(x[q]))
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_two_drivers_commit_one_batch(spark):
    """Of two attempts that both found the batch missing, the one listed first counts, for good."""
    path = scratch_path(spark, "rollup-race")
    rows = spark.createDataFrame([("s", "en", "v", 5)], token_rollup.DELTAS.replace("docs long, ", ""))
    other = spark.createDataFrame([("s", "en", "v", 9)], rows.schema)
    one, two = token_rollup.Rollup(spark, path), token_rollup.Rollup(spark, path)
    late = two.prepare("load", token_rollup.inserts(other))
    assert one.commit("load", token_rollup.inserts(rows))
    total = lambda: [tuple(r) for r in one.totals().collect()]
    assert total() == [("s", "en", "v", 1, 5)]
    two.publish("load", late)
    assert total() == [("s", "en", "v", 1, 5)]
    one.prepare("lost", token_rollup.inserts(other))
    assert total() == [("s", "en", "v", 1, 5)]
    assert not two.commit("load", token_rollup.inserts(other))


def test_snapshots_change_no_total(spark):
    path = scratch_path(spark, "rollup-snap")
    rollup = token_rollup.Rollup(spark, path)
    rows = [spark.createDataFrame([("s", "en", f"v{i % 2}", i)], "source string, lang string, version string, tokens long") for i in range(4)]
    total = lambda: sorted(tuple(r) for r in rollup.totals().collect())
    rollup.compact()
    assert total() == []
    rollup.commit("a", token_rollup.inserts(rows[0]))
    rollup.commit("b", token_rollup.inserts(rows[1]))
    rollup.compact()
    assert total() == [("s", "en", "v0", 1, 0), ("s", "en", "v1", 1, 1)]
    assert not rollup.commit("a", token_rollup.inserts(rows[0]))
    rollup.commit("c", token_rollup.inserts(rows[3]))
    assert total() == [("s", "en", "v0", 1, 0), ("s", "en", "v1", 2, 4)]
    # A snapshot that was written but never listed isn't seen.
    rows[2].selectExpr("source", "lang", "version", "7L AS docs", "tokens").write.parquet(f"{path}/snapshot/lost/sums")
    rollup.compact()
    rollup.commit("d", token_rollup.deletes(rows[0]))
    assert total() == [("s", "en", "v1", 2, 4)]
