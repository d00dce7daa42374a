"""Whole operators against plain Python, over the smallest tables and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactra.llm import binary, chat, embeddings, mixing, packing, quality, queries, token_counts
from redactra.llm.base import words_of
from redactra.llm.tokenization import UnitEncoder, public_path

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def plain_ids(name, texts, special=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    t.encode_special_tokens = not special
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_counts_of_whole_texts(spark):
    docs = documents(spark)[:60]
    scores = token_counts.piece_scores(public_path("piece_bpe_32k.model"))
    longest, known = max(map(len, scores)), {}

    def pieces(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                options = [(best[a][0] + scores[word[a:end]], best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in scores]
                if word[end - 1] not in scores:
                    size = len(word[end - 1].encode())
                    options.append((best[end - 1][0] + size * token_counts.BYTE_SCORE, best[end - 1][1] - size))
                best.append(max(options))
            known[word] = -best[-1][1]
        return known[word]

    want = {k: (len(t.split()) + t.count("\n"), sum(pieces("▁" + w) for w in t.split()) + t.count("\n")) for k, t in docs}
    got = {r[0]: (r[1], r[2]) for r in queries.op1_token_counts(spark, SF).where(F.col("doc_id").isin([k for k, _ in docs])).collect()}
    assert got == want


def test_op3_pieces_against_the_library(spark):
    docs = documents(spark)
    want = {}
    for (k, _), ids in zip(docs, plain_ids("word_bpe_49k.json", [t for _, t in docs]), strict=True):
        ids = [*ids, 1]
        want |= {(k, i): (a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for i, a in enumerate(range(0, len(ids), 4096))}
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= 1.02 * math.ceil(sum(n for _, n, _ in want.values()) / packing.CAPACITY) + 1


def test_op9_files_against_the_library(spark):
    docs = documents(spark)
    want, start = {}, 0
    for (k, _), ids in zip(docs, plain_ids("byte_bpe_50k.json", [t for _, t in docs]), strict=True):
        want[k] = (start, len(ids) + 1, crc([*ids, 0]))
        start += len(ids) + 1
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_token_binary(spark, SF).collect()}
    assert got == want


def test_control_strings_are_text_unless_asked_for():
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "plain words", "<|endoftext", "x\n<|endoftext|>"]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for special in (False, True):
            own = UnitEncoder(public_path(name), spaced, special)
            assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == plain_ids(name, texts, special)
    assert 50256 in plain_ids("byte_bpe_50k.json", texts[:1], True)[0] and 50256 not in plain_ids("byte_bpe_50k.json", texts[:1])[0]


def test_ids_that_do_not_fit_are_refused(tmp_path):
    with (tmp_path / "x").open("wb") as f:
        writer = binary.ShardWriter(f, "<u2")
        writer.add(1, np.array([65_535], np.uint32))
        with pytest.raises(ValueError, match="does not fit"):
            writer.add(2, np.array([65_536], np.uint32))
    with (tmp_path / "y").open("wb") as f:
        writer = binary.ShardWriter(f, "<u4")
        writer.add(None, np.array([65_536, 3], np.uint32))
        writer.close()
    with (tmp_path / "y").open("rb") as f:
        assert [(d, ids.tolist()) for d, ids in binary.ShardReader(f).of([None])] == [(None, [65_536, 3])]


def test_op4_against_a_dictionary(spark):
    """The same updates coordinate by coordinate in plain Python, and the same scores."""
    docs = documents(spark)[:30]
    texts = {k: t[:400] for k, t in docs}
    labels = {k: k % 2 for k in texts}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    weights = quality.fit(frame, marks)
    order = frame.where(~quality.held_out()).orderBy(F.xxhash64("doc_id")).select("doc_id").collect()
    assert {r[0] for r in order} == {k for k in texts if zlib.crc32(str(k).encode()) % 3 != 1}
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def row(text):
        x = defaultdict(float)
        for found in quality.features(text, quality._Streams()):
            for i in found.tolist():
                x[i] += 1 / len(found)
        x[1 << quality.BITS] = 1.0
        return x

    rows = [(row(texts[r[0]]), labels[r[0]]) for r in order]
    for _ in range(quality.PASSES):
        for x, y in rows:
            g = 1 / (1 + math.exp(-min(35, max(-35, sum(weight(i) * v for i, v in x.items()))))) - y
            for i, v in x.items():
                w, d = weight(i), g * v
                z[i] += d - (math.sqrt(n[i] + d * d) - math.sqrt(n[i])) / quality.ALPHA * w
                n[i] += d * d
    for k, t in texts.items():
        want = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in row(t).items())))
        assert abs(quality.sigmoid(quality.dot(weights, quality.features(t, quality._Streams()))) - want) < 1e-4, k
    assert len(words_of(texts[docs[0][0]])) > 0


def test_op10_passes_are_block_permutations(spark):
    rows = [(k, f"w{k} " * (3 + k % 5), "big" if k % 7 else None, "x") for k in range(6000)] + [(7000, None, "big", "x"), (7001, "", "none", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_order string")
    out = mixing.mix(docs).select("doc_id", *mixing.RESULT).collect()
    words = {k: len((t or "").split()) for k, t, _, _ in rows}
    tokens = Counter()
    for k, _, s, _ in rows:
        tokens[s] += words[k]
    shares = mixing.mix_weights(tokens, mixing.find_exponent(tokens, sum(tokens.values())))
    used = Counter()
    for r in out:
        used[r["mix_source"]] += r["mix_tokens"]
    assert all(0 <= used[s] - round(shares[s] * sum(tokens.values())) < 10 for s in tokens)
    assert {r["doc_id"] for r in out if r["mix_source"] == "none"} == {7001}
    for source, size in (("big", 5143), (None, 858)):
        bits = max(1, math.ceil(math.log2(size / mixing.BLOCK)))
        orders = {}
        for epoch in {r["mix_epoch"] for r in out}:
            own = sorted((r["mix_order"], r["doc_id"]) for r in out if r["mix_source"] == source and r["mix_epoch"] == epoch)
            blocks = [o >> (62 - bits) for o, _ in own]
            inside = {d: o & ((1 << (62 - bits)) - 1) for o, d in own}
            assert blocks == sorted(blocks) and max(blocks, default=0) < 1 << bits
            orders[epoch] = ({d: o >> (62 - bits) for o, d in own}, inside)
        if 0 in orders and 1 in orders and orders[1][0]:  # a block's documents stay together, in their order
            pairs = {(orders[0][0][d], orders[1][0][d]) for d in orders[1][0]}
            assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
            assert all(orders[0][1][d] == x for d, x in orders[1][1].items())
    far = mixing.mix(docs, driver_sources=1).select("doc_id", *mixing.RESULT).collect()
    assert sorted(map(tuple, far), key=str) == sorted(map(tuple, out), key=str)


def test_block_permutation_is_a_bijection(spark):
    for bits in (1, 2, 5, 10):
        found = spark.range(1 << bits).select(mixing._permuted(F.col("id"), F.lit(bits), F.lit(3)), mixing._permuted(F.col("id"), F.lit(bits), F.lit(4))).collect()
        assert sorted(r[0] for r in found) == sorted(r[1] for r in found) == list(range(1 << bits))
    assert [r[0] for r in found] != [r[1] for r in found]


def test_exponent_of_a_table_is_that_of_a_dictionary(spark):
    tokens = {"a": 9000, "b": 700, "c": 30, "d": 0}
    totals = spark.createDataFrame(list(tokens.items()), "s string, tokens long")
    for target, repeats in ((None, 2.0), (None, 5.0), (0.9, None), (5.0, None), (0.0, None)):
        x = mixing.find_exponent(tokens, 9730, target, repeats)
        assert abs(mixing.find_exponent_of(totals, 9730, 9730, target, repeats) - x) < 1e-9


CHAT = "id long, parent long, tree string, role string, text string, score double, leaf string, formatted string"


def test_chat_takes_odd_rows_and_leaves_cycles_out(spark):
    rows = [
        (1, None, "t", "user", None, None), (2, 1, "t", None, "", 0.0), (3, 99, None, "user", "lost parent", 1.0), (4, 5, "c", "user", "x", 0.0), (5, 6, "c", "user", "y", 0.0), (6, 4, "c", "user", "z", 0.0),
        (7, 5, "c", "user", "hangs on the cycle", 0.0), (8, 8, "c", "user", "itself", 0.0), *((100 + k, 99 + k if k else None, "long", "assistant", "w " * 50, 0.0) for k in range(70)),
    ]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], CHAT)
    out = {r["tree"]: chat.read_turns(r["formatted"]) for r in chat.format_trees(docs, "id", "parent", "tree", score_col="score").collect()}
    assert out == {"t": [("user", ""), ("", "")], None: [("user", "lost parent")], "long": [("assistant", "w " * 50)] * 70}
    assert chat.format_trees(docs.limit(0), "id", "parent", "tree").count() == 0
    same = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, 1, "assistant", "x" * 100_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_trees(chat.conversation_messages(same), "mid", "parent", "conv_id")).collect()}
    assert got == {1: (3, 100_000), None: (1, 0)}


def test_vectors_take_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string, key string"
    assert embeddings.link_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.0], 2), (None, None, None)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_vectors(spark.createDataFrame([(*r, "x", "y") for r in rows], schema)).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 0, None)])


def test_vectors_cost_no_more_disk_than_their_own_size(spark):
    """Spread evenly over all directions, as cells prune worst: nothing may be sent to many places."""
    n, written = 6_000, lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    x = np.random.default_rng(4).standard_normal((n, 64)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32())), "label": np.zeros(n, np.int32)}))
    before = written()
    assert embeddings.link_vectors(rows).where("n_links > 0").count() == 0
    assert written() - before < 3 * x.nbytes


def test_vectors_of_many_cells_and_pieces_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 60)
    monkeypatch.setattr(embeddings, "PIECE_BYTES", (16 << 10, 16 << 10))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2600, 16))
    x[600:900] = x[:300] + 0.25 * rng.standard_normal((300, 16))  # on both sides of the limit
    x[900:1300] = x[0] + 0.01 * rng.standard_normal((400, 16))  # copies but for a little: many cells of one group
    x[1300:1500] = x[1] + 0.3 * rng.standard_normal((200, 16))  # a group whose vectors are not all linked
    x[1500:1520] = x[:20]
    x = x.astype(np.float32).astype(float)
    label = np.where(np.arange(2600) < 2000, 0, np.where(np.arange(2600) < 2550, 1, 2))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    root = np.arange(2600)
    while (less := np.minimum(root, np.where(near, root, 2600).min(1))).tolist() != root.tolist():
        root = less
    for kind in ("float", "double"):
        got = embeddings.link_vectors(spark.createDataFrame([(k, e.tolist(), int(c)) for k, (e, c) in enumerate(zip(x, label, strict=True))], f"vec_id long, embedding array<{kind}>, label int"))
        assert [tuple(r) for r in got.orderBy("vec_id").select("n_links", "component_id", "kept").collect()] == [(int(n), int(c), bool(c == k)) for k, (n, c) in enumerate(zip(near.sum(1), root, strict=True))]


def test_vectors_without_id_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, [1.0, 0.02], 1)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == Counter([(1, 1, 1), (None, 0, None), (None, 0, None), (2, 1, 1)])
