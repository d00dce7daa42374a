import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactra.llm import binary, chat, components, embeddings, licenses, minhash, mixing, packing, quality, rules, token_counts
from redactra.llm.tokenization import UnitEncoder, public_path

DOCS = "doc_id long, text string, source string, n_words string, score string, bands string"
WORDS = " ".join(f"w{k} and" for k in range(60)) + "."


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, None if k % 3 == 0 else "s", "x", "y", "z") for k, t in enumerate(texts)], DOCS)


TEXTS = [None, "", "   \n\n ", WORDS, WORDS, WORDS + " more", "Und " * 400, "é ß 漢字 😀 don't  stop", "long " + "word " * 3000 + "end.", "Licensed under CC BY-NC 4.0."]


@pytest.mark.parametrize("texts", [TEXTS, []])
def test_every_operator_takes_odd_rows(spark, texts):
    docs = docs_of(spark, texts)
    n = len(texts)
    assert token_counts.count_tokens(docs, public_path("piece_bpe_32k.model")).count() == n
    assert rules.apply_rules(docs, keep=["doc_id"]).count() == n
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(n)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels), keep=["doc_id"]).where("score between 0 and 1").count() == n
    assert minhash.near_duplicates(docs).count() == n
    assert minhash.drop_near_duplicates(docs).columns == docs.columns
    assert binary.write_and_read(docs, public_path("byte_bpe_50k.json"), shards=3).count() == n
    assert mixing.mix(docs, keep=["doc_id"]).count() >= 0
    packed = packing.pack(packing.cut_pieces(docs, public_path("word_bpe_49k.json"))).collect()
    assert {r["doc_id"] for r in packed} == set(range(n))
    assert licenses.scan(docs, licenses.train(["plain words here"] * 4)).count() == (1 if n else 0)
    assert licenses.scan(docs, licenses.train([])).count() == (1 if n else 0)


def test_units_equal_whole_texts():
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encode = UnitEncoder(public_path(name), spaced)
        for t in ["", " ", "a  b", "\n\na", "a\n", "x \n y", "it's  x", " lead", "é ́x", "don't <|endoftext|> b", "a\r\nb", "İx ΑΣ Σ", "x² Ⅷa", "a's b'", WORDS]:
            assert encode.encode(t) == encode._raw(t), t


def test_token_counts_against_plain_dynamic_programming():
    scores = token_counts.piece_scores(public_path("piece_bpe_32k.model"))
    trie = token_counts.PrefixTrie(scores)
    words = ["▁" + w for w in ["token", "tokens", "tokenizer", "漢字", "zzzzqqq", "Łódź", "a"]]
    for word, count in trie.counts(words).items():
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[a][0] + scores[word[a:end]], -best[a][1] - 1) for a in range(end) if word[a:end] in scores]
            size = len(word[end - 1].encode())
            if word[end - 1] not in scores:
                options.append((best[end - 1][0] + size * token_counts.BYTE_SCORE, -best[end - 1][1] - size))
            top = max(options)
            best.append((top[0], -top[1]))
        assert count == best[-1][1], word


def test_chat_escapes_and_reads_back():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\</s><|end|>\\\\<\\"), ("odd|>role", ""), ("assistant", "<<SYS>>x<")]
    text, spans = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("</s>") == 1 and "[INST]" not in text


def test_reply_tree_ranks_branches(spark):
    rows = [(1, None, "t", "user", "q", 0.0), (2, 1, "t", "assistant", "bad", 1.0), (3, 1, "t", "assistant", "good", 5.0), (4, 3, "t", "user", None, None), (5, None, "u", None, "alone", None)]
    out = chat.format_trees(spark.createDataFrame(rows, "id long, parent long, tree string, role string, text string, score double"), "id", "parent", "tree", score_col="score", top=2).collect()
    best = {(r["tree"], r["rank"]): chat.read_turns(r["formatted"]) for r in out}
    assert best[("t", 1)] == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert best[("t", 2)] == [("user", "q"), ("assistant", "bad")] and best[("u", 1)] == [("", "alone")]


def test_packing_fills_exactly_and_loses_nothing():
    rng = np.random.default_rng(0)
    for trial in range(20):
        capacity = int(rng.integers(5, 60))
        counts = np.zeros(capacity + 1, np.int64)
        for x in rng.integers(1, capacity + 1, int(rng.integers(0, 300))):
            counts[x] += 1
        used, bins = Counter(), 0
        for runs, times in packing.plan(counts, capacity):
            assert sum(x * k for x, k in runs) <= capacity
            bins += times
            for x, k in runs:
                used[x] += k * times
        assert used == Counter({k: int(n) for k, n in enumerate(counts) if n})
        assert bins <= 1.1 * -(-int((counts * np.arange(capacity + 1)).sum()) // capacity) + 2


def test_packed_sequences_hold_the_ids(spark):
    docs = docs_of(spark, TEXTS)
    path = public_path("word_bpe_49k.json")
    pieces = packing.cut_pieces(docs, path, capacity=64, with_ids=True)
    packed = packing.pack(pieces, 64)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed, pieces).collect()}
    for r in packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"]).collect():
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert max(map(len, got.values())) <= 64


def test_classifier_holds_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(quality.held_out())
    right = out.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.97


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), np.repeat(base[:1] + 0.01, 30, 0), 3 * base[:3]]).astype(np.float32)
    rows = [(k, [float(v) for v in e], k % 2) for k, e in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 16, None), (905, [], 1)]
    got = {r["vec_id"]: r for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])
    assert near.sum() > 100
    for k in range(len(x)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (near[k].sum(), root[k], root[k] == k)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 906))


def test_grid_finds_every_link():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.12 * rng.standard_normal((200, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.93), strict=True) if i < j}
    z, found = u @ embeddings.rotation(16), []
    for b, part in enumerate(embeddings.blocks_of(16)):
        row, cell, home = embeddings.cells(z[:, part], 6, (0.14 / 2) ** 0.5, 16)
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            i, j = embeddings.links_in_cell(x[row[own]], home[own], np.zeros(len(own)), b, 0.93)
            found += [tuple(sorted((int(row[own[p]]), int(row[own[q]])))) for p, q in zip(i, j, strict=True)]
    assert len(found) == len(set(found)) and set(found) == want


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{v}" for v in rng.integers(0, 5000, 80)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(6):
            c = list(b)
            c[int(rng.integers(0, 80))] = "changed"
            texts.append(" ".join(c))
    texts += ["x y", "x  y", "", None]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}

    def bag(t):
        w = (t or "").split()
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(5):
        for i, a in enumerate(bags):
            for j, b in enumerate(bags):
                if a and b and (a & b).total() >= 0.8 * (a | b).total():
                    root[i] = root[j] = min(root[i], root[j])
    assert got == dict(enumerate(root))


def test_signatures_are_unbiased_for_weights():
    rng, errors = np.random.default_rng(4), []
    for _ in range(150):
        keys = rng.integers(0, 2**63, 30).astype(np.uint64)
        a, b = rng.integers(1, 12, 30), rng.integers(1, 12, 30)
        errors.append((minhash.signature(keys, a) == minhash.signature(keys, b)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


def test_rules_against_brute_force():
    hashes = rules.WordHashes()
    for text in [WORDS, "Und " * 50, "a b c d e f g h x a b c d e f g h", "l1 x\nl1 x\n\nl1 x\n # <|", "one\ttwo\x0bthree\x1cfour five", ""]:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        cover = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        got = rules.judge(text, hashes)
        assert got[:5] == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_shards_read_only_what_is_asked(spark, tmp_path):
    path = tmp_path / "x.zst"
    rng = np.random.default_rng(5)
    ids = {k: rng.integers(0, 50_000, int(n)).astype(np.uint32) for k, n in enumerate([5, 0, 300, 40, 7])}
    with path.open("wb") as f:
        writer = binary.ShardWriter(f, frame_ids=64)
        for k, v in ids.items():
            writer.add(k, v)
        writer.close()
    with path.open("rb") as f:
        reader = binary.ShardReader(f)
        assert all((d == ids[k]).all() and len(d) == len(ids[k]) for k, d in reader.of(ids))
        reader = binary.ShardReader(f)
        list(reader.of([4]))
        assert reader.frames_read == 1 < len(reader.frames)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert (np.frombuffer(whole, "<u2") == np.concatenate(list(ids.values()))).all()
    damaged = bytearray(path.read_bytes())
    damaged[20] ^= 255
    path.write_bytes(bytes(damaged))
    with path.open("rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        list(binary.ShardReader(f).of(ids))


def test_mixing_meets_its_budgets(spark):
    rows = [(k, "w " * 10, "big" if k % 10 else "small") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r[0]: (r[1], r[2]) for r in mixing.mix(docs, keep=["doc_id"]).groupBy("mix_source").agg(F.sum("mix_tokens"), F.max("mix_epoch")).collect()}
    assert abs(out["small"][0] - 8000) <= 10 and abs(out["big"][0] - 32_000) <= 10 and out["small"][1] == 1
    x = mixing.find_exponent({"a": 900, "b": 100}, 1000, target_entropy=0.6)
    assert abs(mixing.entropy(mixing.mix_weights({"a": 900, "b": 100}, x)) - 0.6) < 1e-6


#: Notices that share no text with those that the classifier is fitted to, and plain texts with the same words.
HELD_OUT = {
    "GPL-3.0": ["Licensed under GPLv3 or later", "This plugin is under the GNU General Public License version 3.", "GPL v3 applies to all files"],
    "GPL-2.0": ["This driver is under the GNU General Public License version 2.", "GPLv2 applies to all files", "The module is licensed under GPL-2.0-or-later."],
    "LGPL": ["Covered by the GNU LGPL v2.1.", "This module is under the GNU Lesser General Public License, version 3.", "Use of this library is permitted under the LGPL"],
    "MIT": ["This software is MIT-licensed.", "Free to use under the MIT License.", "Code released under MIT license, 2019", "subject to the MIT licence"],
    "BSD": ["This project uses the BSD 3-clause licence.", "Source is available under a BSD licence.", "Redistribution in binary form must reproduce the copyright notice and the disclaimer."],
    "Apache-2.0": ["Made public under the Apache License v2.0", "You may obtain a copy of the Apache License at the address below.", "Apache 2 license"],
    "MPL-2.0": ["This file is subject to the Mozilla Public License version 2.0.", "MPL 2.0 covers this file", "Released under the terms of the MPL, version 2."],
    "CC-BY-NC": ["This photo is shared under Creative Commons Attribution-NonCommercial 2.0.", "Content licensed CC BY-NC 3.0"], "CC-BY-SA": ["This photo is shared under Creative Commons Attribution-ShareAlike 2.0.", "Content licensed CC BY-SA 3.0"],
    "CC-BY": ["This photo is shared under Creative Commons Attribution 2.0.", "Content licensed CC BY 3.0"], "CC0": ["The data are in the public domain (CC0).", "CC0 waiver: no rights reserved"],
    "proprietary": ["All rights reserved.", "(c) 2021 Some Firm, all rights reserved worldwide", "This file is confidential; unauthorized copying is strictly prohibited.", "No part of this book may be reproduced without permission of the publisher."],
    "unknown": [
        "The museum holds a copy of the notice.", "She lost her driving license.", "The general public is welcome at the library.", "Permission was granted by the city.", "Commons debated the bill.",
        "The new version of the software was released in 2015.", "Apache is a tribe.", "He works at MIT.", "The conditions of the contract were met.", "The court reserved all rights of appeal.", "", "in 2020",
    ],
}


def test_licences_kept_out_of_the_fit(spark):
    """Recall and precision of nine in ten at least; the columns say what the model itself says, both ways."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.fit(docs)
    cases = [(f, t) for f, texts in HELD_OUT.items() for t in texts]
    known = [t for texts in licenses.KNOWN.values() for t in texts]
    assert not {t for _, t in cases} & ({*known} - {"All rights reserved."})
    found = [(f, model.family(t)) for f, t in cases]
    right = sum(f == g for f, g in found if f != "unknown")
    assert right >= 0.9 * sum(f != "unknown" for f, _ in found) and right >= 0.9 * sum(g != "unknown" for _, g in found)
    own = [(f, model.family(t)) for f, texts in licenses.KNOWN.items() for t in texts]
    assert sum(f == g for f, g in own) >= 0.95 * len(own)
    texts = [t for _, t in cases] + known + licenses.UNKNOWN
    rows = spark.createDataFrame([(k, t, "x", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, family string, probability double")
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licenses.scan(rows, model).collect()}
    assert {k: f for k, (f, _) in got.items()} == {k: model.family(t) for k, t in enumerate(texts) if model.family(t) != "unknown"}
    assert {k for k, (_, sure) in got.items() if sure} >= {k + len(cases) for k, (f, g) in enumerate(own) if f == g}
    whole = licenses.scan(docs, model).select("doc_id", "paragraph", "family").collect()
    lines = licenses.paragraphs(docs, "doc_id", "text").collect()
    want = Counter((r["doc_id"], r["paragraph"], f) for r in lines if (f := model.family(r["text"])) != "unknown")
    assert Counter(map(tuple, whole)) == want and sum(want.values()) > 30


def test_wrapped_notices_are_one_paragraph(spark):
    rows = [(1, "Licensed under the Apache License,\nVersion 2.0 (the License)\n\nText."), (2, "a\n\nb\n c"), (3, "x" * 101 + "\ny"), (4, None), (5, "One.\nTwo")]
    out = licenses.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert [tuple(r) for r in sorted(out)] == [(1, 0, "Licensed under the Apache License, Version 2.0 (the License)"), (1, 1, ""), (1, 2, "Text."), (2, 0, "a"), (2, 1, ""), (2, 2, "b  c"), (3, 0, "x" * 101), (3, 1, "y"), (4, 0, ""), (5, 0, "One."), (5, 1, "Two")]


def test_planted_notices_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = {
        "All rights reserved.": "proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    planted = {r["text"]: r["count"] for r in docs.select(F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").isin(list(kinds))).groupBy("text").count().collect()}
    kind = F.coalesce(*(F.when(F.col("text").endswith(k), k) for k in kinds))
    lines = licenses.paragraphs(docs, "doc_id", "text").select("doc_id", "paragraph", kind.alias("text")).where("text is not null")
    model = licenses.fit(docs)
    found = licenses.scan(docs, model).where("confirmed").join(lines, ["doc_id", "paragraph"]).groupBy("text", "family").count().collect()
    assert set(planted) == set(kinds)
    assert {(r["text"], r["family"]): r["count"] for r in found} == {(t, kinds[t]): n for t, n in planted.items()}
    short = ["Copyright 2019 Some Firm. All rights reserved.", "Copyright (c) 1998 Jane Doe", "Copyright © 2021 Some Firm", "Copyright 2007 Jane Doe", "© 2020 Some Firm"]
    got = licenses.scan(spark.createDataFrame(list(enumerate([*short, "Copyright law protects authors.", "The town grew until 2011."])), "doc_id long, text string"), model)
    assert {r["doc_id"]: (r["family"], r["confirmed"]) for r in got.collect()} == {k: ("proprietary", True) for k in range(len(short))}


def test_notices_in_the_sample_do_not_count_as_plain(spark):
    plain = [f"the river number {k} flows to the sea" for k in range(200)]
    notices = [t for t in ("Released under the GPL v3.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.") for _ in range(4)]
    model = licenses.train([*notices, *plain])
    known = [(f, t) for f in licenses.TEMPLATES for t in licenses.TEMPLATES[f]]
    assert [model.family(t) for _, t in known] == [f for f, _ in known]
    texts = [t for _, t in known] + licenses.UNKNOWN + ["", "the software", "of the", "Released under the GPL v3. and then", "© 2021", plain[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", licenses.notice(F.col("t"))).collect()
    assert dict(map(tuple, rows)) == {k: licenses.is_notice(t) for k, t in enumerate(texts)}
    assert all(licenses.is_notice(t) for _, t in known) and not any(map(licenses.is_notice, ["the software", "of the", "", *plain]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(notices * 3 + plain)], "doc_id long, text string")
    got = licenses.scan(docs, licenses.fit(docs, sample=100)).where("confirmed").groupBy("family").count().collect()
    assert dict(map(tuple, got)) == {"GPL-3.0": 12, "CC0": 12, "proprietary": 12}


def test_packing_fills_by_sums_of_three_and_open_bins():
    rng = np.random.default_rng(0)
    # four pieces a sequence (best fit alone: 5,527 and 5,559), and six with open bins filled (3,203)
    for low, high, most in ((860, 1181, 5010), (900, 1151, 5095), (550, 701, 3150)):
        counts = np.bincount(rng.integers(low, high, 20_000), minlength=packing.CAPACITY + 1)
        patterns, used = packing.plan(counts), np.zeros(packing.CAPACITY + 1, np.int64)
        for runs, times in patterns:
            assert times > 0 and sum(x * k for x, k in runs) <= packing.CAPACITY
            for x, k in runs:
                used[x] += k * times
        assert (used == counts).all() and sum(times for _, times in patterns) <= most
    assert sum(times for _, times in packing.plan(np.bincount([7, 9, 11, 13, 7, 9, 11, 13], minlength=41), 40)) == 2


def test_pipeline_rules_remove_failed_lines(spark):
    import corpus_pipeline

    texts = [WORDS + "\nAll rights reserved.\nHome | News | About\n" + WORDS.replace("w", "v"), WORDS, "too short", None]
    docs = docs_of(spark, texts)
    out = corpus_pipeline.quality_rules(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: WORDS + "\n" + WORDS.replace("w", "v"), 1: WORDS}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    good = [" ".join(f"w{v}" for v in rng.integers(0, 4000, 60)) + " end." for _ in range(24)]
    texts = good + [g.replace(" end.", " fin.") for g in good[:6]] + [g + "\nAll rights reserved." for g in good[6:9]] + ["BUY!! NOW!! " + " ".join(f"Q{v}!!" for v in rng.integers(0, 4000, 60)) for _ in range(8)] + [None, "short"]
    docs = spark.createDataFrame([(k, t, "a" if k % 4 else "b") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 33)) for k in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_duplicates", "source_mixing", "best_fit_packing"]

    def run(name):
        before = sorted(now.collect())
        after = stages[name](spark, now, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        return before, spark.read.parquet(f"{tmp_path}/{name}")

    before, after = run("quality_rules")
    judged = [(r, rules.judge(r["text"] or "", rules.WordHashes())) for r in before]
    assert sorted(map(tuple, after.collect())) == sorted((r["doc_id"], v[8], r["source"]) for r, v in judged if v[6])
    now = after
    weights = quality.fit(now, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    before, after = run("quality_classifier")
    assert sorted(after.collect()) == [r for r in before if quality.sigmoid(quality.dot(weights, quality.features(r["text"], quality._Streams()))) >= 0.5]
    now = after
    before, after = run("near_duplicates")

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    bags, root = [bag(r["text"]) for r in before], list(range(len(before)))
    for _ in range(3):
        for i, a in enumerate(bags):
            for j, b in enumerate(bags):
                if (a & b).total() >= 0.8 * (a | b).total():
                    root[i] = root[j] = min(root[i], root[j])
    assert sorted(after.collect()) == [before[k] for k in sorted(set(root))] and len(set(root)) < len(before)
    now = after
    before, after = run("source_mixing")
    tokens = {s: sum(len(r["text"].split()) for r in before if r["source"] == s) for s in "ab"}
    shares = mixing.mix_weights(tokens, mixing.find_exponent(tokens, sum(tokens.values())))
    uses, most = Counter(after.collect()), max(len(r["text"].split()) for r in before)
    assert set(uses) <= set(before)
    for s in "ab":
        own = [uses[r] for r in before if r["source"] == s]
        used = sum(len(r["text"].split()) * n for r, n in uses.items() if r["source"] == s)
        assert max(own) - min(own) <= 1 and 0 <= used - round(shares[s] * sum(tokens.values())) < most
    now = after
    before, after = run("best_fit_packing")
    from redactra.llm.tokenization import encoder

    encode = encoder(public_path("word_bpe_49k.json"), False).encode
    data = [(r["doc_id"], encode(r["text"]) + np.array([1], "<u4").tobytes()) for r in before]
    rows = after.collect()
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows) == sorted((k, len(d) // 4, zlib.crc32(d)) for k, d in data)
    held = Counter((r["sequence_id"], r["offset"] + i) for r in rows for i in range(r["length"]))
    assert max(held.values()) == 1 and max(at for _, at in held) < packing.CAPACITY
