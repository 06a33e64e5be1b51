"""The operators by themselves: kernels against brute force, odd rows, clashing columns."""

import base64
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelet.llm import chat, decontaminate, exact_dedup, language, pieces, quality, secret_scan, simhash, toxicity, url_filter


# ------------------------------------------------ exact dedup
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.integers(0, 9)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_patricia(rows):
    trie = exact_dedup.Patricia()
    for t, i in rows:
        trie.owner(t.encode()).add(i, i, 1, 1)
    want = {}
    for t, i in rows:
        want.setdefault(t.encode(), []).append(i)
    assert {t: (o.least, o.most, o.ties, o.rows) for t, o in trie.items()} == {t: (min(v), max(v), v.count(max(v)), len(v)) for t, v in want.items()}


@given(st.lists(st.tuples(st.text("ab", max_size=6), st.one_of(st.none(), st.integers(0, 9))), max_size=40), st.integers(0, 12))
@settings(max_examples=80, deadline=None)
def test_spilled_subtrees_lose_nothing(rows, held):
    """However early subtrees are spilled, what they and the rest say adds up; and no more than the bound is held."""
    trie, seen = exact_dedup.Patricia(), []
    for t, i in rows:
        trie.owner(t.encode()).add(i, i, 1, 1)
        if trie.held > held:
            seen += trie.spill(held // 2)
            assert trie.held <= held // 2
    assert trie.held == sum(map(exact_dedup.weight, trie.root.edges.values()))
    got, want = {}, {}
    for t, o in [*seen, *trie.items()]:
        got.setdefault(t, exact_dedup.Terminal()).add(o.least, o.most, o.ties, o.rows)
    for t, i in rows:
        want.setdefault(t.encode(), []).append(i)
    known = {t: [i for i in v if i is not None] for t, v in want.items()}
    assert {t: (o.least, o.most, o.ties, o.rows) for t, o in got.items()} == {t: (min(known[t], default=None), m := max(known[t], default=None), v.count(m), len(v)) for t, v in want.items()}


def test_classes_do_not_depend_on_the_bound(odd):
    every = [sorted(map(str, exact_dedup.owners(odd, held=n).collect())) for n in (0, 60, exact_dedup.HELD)]
    assert every[0] == every[1] == every[2]


def test_merged_owners_tell_texts_of_one_hash_apart():
    key, whole = T.LongType(), T.LongType()
    fields = exact_dedup.owner_fields(key)
    texts = T.StructType([T.StructField("n", whole), T.StructField("h", whole), T.StructField("t", T.BinaryType()), *fields])
    rows = exact_dedup.batch_of([(1, 5, b"a", 1, 1, 1, 1), (1, 5, b"b", 2, 2, 1, 1), (1, 5, b"a", 3, 3, 1, 1)], texts)
    out = [r for b in exact_dedup.merged_owners(T.StructType([T.StructField("sha", T.StringType()), *fields]))(iter([rows])) for r in b.to_pylist()]
    assert {r["sha"]: (r["least"], r["most"], r["rows"]) for r in out} == {hashlib.sha256(b"a").hexdigest(): (1, 3, 2), hashlib.sha256(b"b").hexdigest(): (2, 2, 1)}


def test_string_identifiers(spark, odd):
    """Identifiers keep their type; the largest and the smallest are those of that type's order."""
    docs = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = exact_dedup.exact_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert all({r["keep_id"] for r in rows} == {max([r["doc_id"] for r in rows if r["doc_id"]], default=None)} and sum(r["kept"] for r in rows) == 1 for rows in by.values())
    near = simhash.near_duplicates(docs).collect()
    least = {}
    for r in near:
        least.setdefault(r["root"], []).append(r["doc_id"])
    assert all(r["component_id"] == min([i for i in least[r["root"]] if i], default=None) for r in near)
    assert simhash.representatives(docs).count() == len(least)
    items = spark.createDataFrame([("b", "one two three"), ("a", "ÉCOLE d'été"), ("10", "one two three"), (None, "the mat")], "item_id string, text string")
    found = {(r["doc_id"], r["text"]): r for r in decontaminate.contamination(docs, items).collect()}
    assert found["d8", "one two three"]["hit_items"] == ["10", "b"] and found["d7", "ÉCOLE d'été"]["hit_items"] == ["a"]
    first = found["d1", "The cat sat on the mat and looked at the dog."]
    assert first["hit_items"] == [] and first["hit_words"] == [[4, 6]]


def every_name(df, names):
    """``df`` with a column of every name it does not have yet."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(f"own {n}") for n in names if n.lower() not in have})


HELPERS = "t id th n h k v u at root roots least most rows ties sha fp owner size kept keep_id group_size text_sha256 component_id line p host path rule verdict block_probability n_words hit_words hit_chars hit_items piece_ids decoded n_tokens ids_sha256 decoded_sha256 secrets score predicted lang_pred lettered one cid cth c0 c1 __c0 __o0 __text __k __z __c __p __r __s __h __salt __id __y __sha __n __cid __rid __rth __line".split()


def test_columns_of_any_name_pass_through(spark, odd):
    """Every operator and stage on a table with a column of each helper's and output's name, keeping all columns."""
    wide = every_name(odd, HELPERS)
    grammar, model, labels = toxicity.Grammar(), language.learn(odd, F.lit(True)), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    made = {
        "exact": (lambda d: exact_dedup.exact_duplicates(d), {"keep_id", "group_size", "kept", "text_sha256"}),
        "near": (lambda d: simhash.near_duplicates(d, keep=d.columns), {"fp", "root", "component_id"}),
        "one of each": (simhash.representatives, set()),
        "bench": (lambda d: decontaminate.contamination(d, items), {"n_words", "hit_words", "hit_chars", "hit_items"}),
        "bench in shards": (lambda d: decontaminate.contamination(d, items, max_words=10), {"n_words", "hit_words", "hit_chars", "hit_items"}),
        "language": (lambda d: language.identify(d, model), {"lang_pred", "score"}),
        "pieces": (pieces.encode, {"piece_ids", "decoded"}),
        "secrets": (secret_scan.scan, {"secrets"}),
        "toxic": (lambda d: toxicity.score(d, grammar), {"score", "predicted"}),
        "quality": (lambda d: quality.score(d, quality.learn(odd, labels, F.lit(True))), {"score", "predicted"}),
        "url": (lambda d: url_filter.judge(d, "text"), {"host", "path", "rule", "verdict", "block_probability"}),
    }
    for name, (fn, outputs) in made.items():
        crowded, plain = fn(wide), fn(odd)
        assert {c.lower() for c in crowded.columns} == {c.lower() for c in wide.columns} | outputs, name
        assert len(crowded.columns) == len({c.lower() for c in crowded.columns}), name
        rows = crowded.collect()
        for n in HELPERS:
            if n not in outputs and n not in odd.columns:
                assert {r[n] for r in rows} == {f"own {n}"}, (name, n)
        same = [c for c in plain.columns if c not in wide.columns or c in outputs or c in odd.columns]
        assert sorted(map(str, crowded.select(same).collect())) == sorted(map(str, plain.select(same).collect())), name


def test_maps_have_hashes(spark, odd):
    docs = odd.withColumn("more", F.create_map(F.lit("a"), F.col("n_chars")))
    assert exact_dedup.exact_duplicates(docs).where("kept").count() == exact_dedup.exact_duplicates(odd).where("kept").count()
    assert simhash.representatives(docs).count() == simhash.representatives(odd).count()


def test_exact_duplicates_of_odd_rows(odd, crowded, none):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == 14
    assert sum(r["kept"] for r in got) == len({exact_dedup.normal(None if r["text"] is None else r["text"].encode()) for r in got})
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for rows in by.values():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert {r["keep_id"] for r in rows} == {max(ids, default=None)} and {r["group_size"] for r in rows} == {len(rows)}
        assert sum(r["kept"] for r in rows) == 1
    assert sorted(map(str, exact_dedup.exact_duplicates(crowded, keep=["doc_id"]).collect())) == sorted(map(str, exact_dedup.exact_duplicates(odd, keep=["doc_id"]).collect()))
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_hot_group(spark):
    """A third of the rows are copies; keys over the bound take the broadcast way."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_duplicates(docs).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (2000, 5997, 2000, 1)


def test_repeated_rows_over_many_partitions(spark):
    docs = spark.range(4000, numPartitions=5).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise(F.concat(F.lit("t "), "id")).alias("text"))
    got = exact_dedup.exact_duplicates(docs)
    assert tuple(got.where("doc_id = 1").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("group_size")).first()) == (3000, 1, 3000)
    assert got.where("kept").count() == 1001
    assert simhash.representatives(docs.where("doc_id = 1")).count() == 1


# ------------------------------------------------ decontamination
def hits(text, items, window):
    doc = decontaminate.words(text)
    hit, ids = set(), set()
    for i, t in items:
        for w in decontaminate.windows(decontaminate.words(t), window):
            for s in range(len(doc) - len(w) + 1):
                if tuple(doc[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    ids.add(i)
    return hit, ids


@given(st.lists(st.sampled_from("a b c d".split()), max_size=30), st.lists(st.lists(st.sampled_from("a b c".split()), max_size=7), max_size=4))
@settings(max_examples=150, deadline=None)
def test_scan(doc, items):
    text, items = " ".join(doc).encode(), [(i, " ".join(t).encode()) for i, t in enumerate(items)]
    built, numbers = decontaminate.automaton(items, 3)
    spans, ids = decontaminate.scan(decontaminate.words(text), built, numbers)
    hit, want = hits(text, items, 3)
    assert {i for a, b in spans for i in range(a, b)} == hit and ids == want
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_offsets_point_into_the_original():
    text = "Éa -- Two,  THREE! x".encode()
    built, numbers = decontaminate.automaton([(1, b"two three")], 13)
    spans, _ = decontaminate.scan(decontaminate.words(text), built, numbers)
    (a, b), = decontaminate.offsets(text, spans)
    assert text.decode()[a:b] == "Two,  THREE"


def test_contamination_in_shards(spark, odd, crowded, none):
    items = spark.createDataFrame([(1, "sat on the mat and"), (2, "one two"), (3, None), (None, "école d'été")], "item_id long, text string")
    whole = decontaminate.judged(decontaminate.contamination(odd, items, keep=["doc_id"]))
    parted = decontaminate.judged(decontaminate.contamination(odd, items, keep=["doc_id"], max_words=60))
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_chars").collect()))
    assert key(whole) == key(parted)
    assert len(decontaminate.shards(items, "item_id", "text", 13, 60)) > 1
    by = {(r["doc_id"], r["n_words"]): r for r in whole.collect()}
    assert by[1, 11]["n_hit"] == 5 and by[1, 11]["contaminated"] and by[7, 3]["n_hit"] == 3 and by[7, 3]["n_items"] == 0
    assert by[3, 0]["contaminated"] is False
    assert key(decontaminate.judged(decontaminate.contamination(crowded, items, keep=["doc_id"]))) == key(whole)
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.judged(decontaminate.contamination(odd, items.limit(0))).where("contaminated").count() == 0


# ------------------------------------------------ languages
def test_gradients():
    model = language.ByteTagger(["a", "b", "c"], hidden=4)
    rng = np.random.default_rng(1)
    x, y = rng.integers(65, 90, (9, 3)).astype(np.uint8), np.array([0, 1, 2])
    _, g = model.gradients(x, y)
    for name in ("xzf", "xnb", "uzf", "unb", "of", "bo"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step = 1e-2
        model.w[name][at] += step
        up = model.gradients(x, y)[0]
        model.w[name][at] -= 2 * step
        down = model.gradients(x, y)[0]
        model.w[name][at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4


def test_pooling_reads_every_chunk():
    model = language.ByteTagger(["a", "b"])
    text = b"abc def " * 100
    p = model.pooled([text, b"", text[:130]])
    x = [np.frombuffer(text[i : i + language.LENGTH], np.uint8)[:, None] for i in range(0, len(text), language.LENGTH)]
    each = np.concatenate([model.probabilities(c)[:, 0] for c in x])
    mask = language.LETTER[np.frombuffer(text, np.uint8)]
    assert np.allclose(p[0], each[mask].mean(0), atol=1e-5) and not p[1].any()
    alone = model.pooled([text[:130]])
    assert np.allclose(p[2], alone[0], atol=1e-6)  # whatever a text is read with
    assert len(model.positions(text)) == len(text)
    assert sum(b - a for a, b, _ in language.tagged(model, text.decode())) == len(text)


def test_identify_odd_rows(odd, crowded, none):
    model = language.learn(odd, F.lit(True))
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd, model).collect()}
    for key in ((3, None), (4, ""), (5, " \n\t "), (9, "12 34 -- !!")):
        assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
    assert got[10, "漢字 🙂 ▁ x  y"]["lang_pred"] != "und"
    assert language.has_letter("漢".encode()) and not language.has_letter("🙂 1 ▁".encode())
    assert language.learn(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    same = language.identify(crowded, model)
    assert same.columns.count("lang_pred") == 1 and same.count() == 14 and language.identify(none, model).count() == 0


# ------------------------------------------------ pieces
@pytest.fixture(scope="module")
def table():
    return pieces.tables(pieces.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def same(table, library, text):
    parts = table.encode(text)
    raw = b"".join(parts)
    ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids == want
    assert table.decode(parts).decode() == library.decode(want)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_pieces_of_any_text(table, library, text):
    same(table, library, text)


@given(st.lists(st.sampled_from(["a", "the", "in", " ", "  ", "\n", "▁", "é", "🙂", "漢", "ing", ".", "--", "\t", "0", "<s>", "<0x0A>"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_pieces_of_built_texts(table, library, parts):
    same(table, library, "".join(parts))


@pytest.mark.parametrize("text", [" " * 500 + "a" + " " * 37, "x" * 5000, "ab" * 3000, "\n" * 40, "a \n b"])
def test_pieces_of_runs(table, library, text):
    same(table, library, text)


def test_memory_is_bounded():
    memo = pieces.Remembered(lambda k: k, 3)
    assert [memo[i] for i in range(10)] == list(range(10)) and len(memo) <= 3


def test_encode_odd_rows(odd, crowded, none):
    got = pieces.encode(odd).collect()
    assert len(got) == 14 and all(r["piece_ids"][0] == 1 and r["piece_ids"][-1] == 2 for r in got)
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert pieces.encode(crowded).columns.count("decoded") == 1 and pieces.encode(none).count() == 0


# ------------------------------------------------ simhash
def clustered(rng, n):
    base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.int64).astype(np.uint64)
    flips = lambda: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64))
    return np.unique(np.array([base[rng.integers(len(base))] ^ flips() for _ in range(n)]))


@pytest.mark.parametrize("n", [1, 2, 3, 60, 700])
def test_bk_tree(n):
    points = clustered(np.random.default_rng(n), n)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    tree, found = simhash.BKTree(points), set()
    for q, node in tree.search(points, 4):
        found |= set(zip(q.tolist(), node.tolist(), strict=True))
    assert found == set(zip(*[x.tolist() for x in np.nonzero(near)], strict=True))
    a, b = simhash.forest(points)
    assert np.array_equal(simhash.rooted(len(points), a, b), simhash.rooted(len(points), *np.nonzero(near)))


def test_fingerprints_within_the_radius_agree_in_some_parts():
    """At each depth, whatever four bits differ."""
    rng = random.Random(8)
    fixed = 0
    while 64 - fixed.bit_count() > simhash.BLOCKS:
        found = simhash.masks(fixed, simhash.RADIUS, simhash.BLOCKS)
        assert len(found) == 15 and all(m & fixed == fixed != m for m in found)
        free = [b for b in range(64) if not fixed >> b & 1]
        assert all(any(d & m == 0 for m in found) for d in (sum(1 << b for b in rng.sample(free, 4)) for _ in range(300)))
        fixed = rng.choice(found)


def test_a_shard_that_is_over_full_is_dealt_anew(spark, monkeypatch):
    """All points agree in the first 40 bits, so shards of those bits hold all of them."""
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 2**24, 3000, dtype=np.int64)) | (0x5A5A5A5A5A << 24)
    sizes = []
    solved = simhash.forest
    monkeypatch.setattr(simhash, "forest", lambda p, r: (sizes.append(len(p)), solved(p, r))[1])
    rows = [pa.RecordBatch.from_arrays([pa.array(np.full(len(points), k, np.int64)) for k in (1, 2)] + [pa.array(points)], names=["k", "v", "p"])]
    back = [b for b in simhash.shard_links(4, 6, 500)(iter(rows))]
    assert sum(b.num_rows for b in back) == len(points) and not sizes and all(b.column(2).null_count == 0 for b in back)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in points], "fp long"), most=500)).collect()}
    near = np.bitwise_count((points[:, None] ^ points[None, :]).view(np.uint64)) <= 4
    label = simhash.rooted(len(points), *np.nonzero(near))
    assert [got.get(int(v), int(v)) for v in points] == [int(points[k]) for k in label]


@pytest.mark.parametrize("most", [20_000, 60])
def test_links_and_components(spark, most):
    """Whatever the size of a tree, components are those of all pairs; small trees are cut again and again."""
    points = clustered(np.random.default_rng(9), 400)
    points = np.unique(np.concatenate([points, np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    rows = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, most=most)).collect()}
    values = np.sort(points.view(np.int64))
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 4
    label = simhash.rooted(len(values), *np.nonzero(near))
    assert [got.get(int(v), int(v)) for v in values] == [int(values[k]) for k in label]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    nodes = list(range(0, 300))
    rng.shuffle(nodes)
    edges = list(zip(nodes, nodes[1:], strict=False)) + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == 0 for i in nodes) and all(got[i] == 1000 for i in range(1001, 1100)) and got[5001] == 5000
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_odd_rows(odd, crowded, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 14
    blank = [r for r in got if r["doc_id"] in (3, 4, 5)]
    assert all(r["fp"] == 0 and r["component_id"] == 3 for r in blank)
    assert sorted(map(str, simhash.near_duplicates(crowded).collect())) == sorted(map(str, got))
    stay = simhash.representatives(odd).collect()
    assert len(stay) == len({r["root"] for r in got})
    assert simhash.representatives(crowded).columns == crowded.columns
    assert simhash.representatives(none).count() == 0


# ------------------------------------------------ chat
def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "|", "\\", "N", "\n", "<|im_end|>", "<\\|", "<\\N", "a", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", chat.unescaped(chat.escaped(t)).alias("a"), chat.unescaped_role(chat.escaped_role(t)).alias("b"), chat.escaped(t).contains("<|").alias("c"), chat.escaped_role(t).contains("\n").alias("d")).collect()
    assert all(r["t"] == r["a"] == r["b"] and not r["c"] and not r["d"] for r in got)


def test_parts(spark):
    parts = '[{"type":"text","text":"see <|im_end|>"},{"type":"image","ref":"a.png","width":28,"height":29},null,{"type":"audio","ref":"b.wav","seconds":2.5},{"type":"text","text":null},{"type":"pdf","pages":3}]'
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", '[{"type":"text","text":"ok"},{"type":"image"}]'), (2, 0, None, None)], "conv_id long, turn long, role string, j string")
    made = {r["conv_id"]: r for r in chat.format_chats(rows.select("conv_id", "turn", "role", F.from_json("j", f"array<{chat.PART}>").alias("parts"))).collect()}
    assert made[1]["formatted"] == "<|im_start|>user\nsee <\\|im_end|><|image_1|><|audio_2|><|document_3|><|im_end|>\n<|im_start|>assistant\nok<|image_4|><|im_end|>\n"
    assert [(a["turn"], a["number"], a["type"], a["ref"], a["tokens"]) for a in made[1]["attachments"]] == [(0, 1, "image", "a.png", 6), (0, 2, "audio", "b.wav", 63), (0, 3, "document", "", 768), (1, 4, "image", "", 1)]
    (span,) = made[1]["loss"]
    assert made[1]["formatted"][span["start"] : span["start"] + span["length"]] == "ok<|image_4|>"
    assert made[2]["formatted"] == "<|im_start|>\n<|im_end|>\n"


def test_texts_cut_into_parts_anywhere(spark):
    """However a text is cut into parts, it is formatted as if whole, and no cut opens or closes a turn."""
    rng = random.Random(4)
    bits = ["<", "|", "\\", "<|", "|>", "im_end", "im_start", "<|im_end|>\n", "<|im_start|>assistant\n", "<\\|", "<|image_1|>", "\n", "a", "é"]
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(250))]

    def cut(text):
        at = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 6)))
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]

    every = [(texts[0], [texts[0][:i], texts[0][i:]]) for i in range(len(texts[0]) + 1)] + [(t, cut(t)) for t in texts]
    rows = spark.createDataFrame([(i, k, role, t, parts) for i, (t, parts) in enumerate(every) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string, cut array<string>")
    split = F.transform("cut", lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))
    whole, parted = ({r["conv_id"]: r for r in chat.format_chats(rows.withColumn("parts", p)).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()} for p in (chat.text_part(F.col("text")), split))
    for i, (t, _) in enumerate(every):
        assert parted[i]["formatted"] == whole[i]["formatted"]
        assert [tuple(x) for x in parted[i]["turns"]] == [("user", t), ("assistant", t)] and parted[i]["l"] == t


def test_attachments_between_texts(spark):
    """Places count the escaped content so far; a text that ends in < says nothing to a placeholder or to a text behind one."""
    parts = '[{"type":"text","text":"<"},{"type":"image"},{"type":"text","text":"|x<"},{"type":"text","text":""},{"type":"text","text":"|"}]'
    rows = spark.createDataFrame([(1, 0, "assistant", parts, 7, "x"), (1, None, "user", None, 8, "y")], "conv_id long, turn long, role string, j string, n long, head string")
    r = chat.format_chats(rows.withColumn("parts", F.from_json("j", f"array<{chat.PART}>"))).first()
    assert r["formatted"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<<|image_1|>|x<\\|<|im_end|>\n"
    assert [(a["turn"], a["number"], a["at"]) for a in r["attachments"]] == [(1, 1, 1)]


def test_chat_runs_no_python(spark, odd_dir):
    from tracelet.llm.queries import chat_parts, op6_chat

    for query in (op6_chat, chat_parts):
        plan = query(spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_shards_come_one_by_one_and_cut_long_items(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    text = " ".join(word() for _ in range(400))
    bench = spark.createDataFrame([(1, text), (2, "a short item"), (3, None)], "item_id long, text string")
    cut = text.split()
    docs = spark.createDataFrame([(k, " ".join(["x", *cut[k * 37 : k * 37 + 30], "y"])) for k in range(10)] + [(10, "A short ITEM"), (11, None)], "doc_id long, text string")
    parts = decontaminate.shards(bench, "item_id", "text", 5, 900)
    assert len(parts) > 1 and not isinstance(parts, list)
    parts = list(parts)
    assert all(sum(5 * len(decontaminate.words(t)) for _, t in p) < 400 * 5 for p in parts)
    whole = {(i, w) for i, t in [("1", text.encode()), ("2", b"a short item")] for w in decontaminate.windows(decontaminate.words(t), 5)}
    assert {(i, w) for p in parts for i, t in p for w in decontaminate.windows(decontaminate.words(t), 5)} == whole
    one, some = (sorted(map(str, decontaminate.contamination(docs, bench, window=5, max_words=most).collect())) for most in (10**6, 900))
    assert one == some


# ------------------------------------------------ secrets
def der(tag, *content):
    body = b"".join(content)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


KEY = der(0x30, *[der(0x02, bytes([i + 1]) * 30) for i in range(9)])
PKCS8 = der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48"), der(0x05)), der(0x04, KEY))


def test_confirmed_structures():
    token = b".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=") for x in ({"alg": "HS256"}, {"sub": "é"})) + b".sig"
    ssh = secret_scan.SSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"x" * 30
    for raw in (KEY, PKCS8):
        assert secret_scan.is_key_encoding(raw) and not secret_scan.is_key_encoding(raw + b"x") and not secret_scan.is_key_encoding(raw[:-1])
        assert [k for k, _, _ in secret_scan.spans(b"\xc3\xa9 " + base64.b64encode(raw) + b" .")] == ["der"]
        assert "der" in [k for k, _, _ in secret_scan.spans(b"x " + raw.hex().encode())]
    assert secret_scan.spans("é ".encode() + token) == [("jwt", 2, 2 + len(token))]
    assert [k for k, _, _ in secret_scan.spans(base64.b64encode(ssh))] == ["ssh"]
    assert secret_scan.spans(base64.b64encode(bytes(range(60)))) == [] and not secret_scan.is_signed_token(b"eyJh.eyJh.x")


def test_keys_end_where_their_lengths_say():
    """DER lengths of every remainder by three, with and without padding, in PEM and among other lines."""
    ed25519 = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))
    sized = [der(0x30, der(0x02, b"\0"), der(0x30, der(0x06, b"\x2a\x86\x48"), der(0x05)), der(0x04, bytes([0xFB]) * n)) for n in (60, 61, 62, 200, 201, 202, 900, 901, 902)]
    assert {len(raw) % 3 for raw in sized} == {0, 1, 2} and len(ed25519) == 48
    for raw in (ed25519, *sized):
        for code in (base64.b64encode(raw), base64.b64encode(raw).rstrip(b"="), base64.urlsafe_b64encode(raw).rstrip(b"=")):
            for eol in (b"\n", b"\r\n"):
                body = eol.join(code[i : i + 64] for i in range(0, len(code), 64))
                for left, right in ((b"-----BEGIN PRIVATE KEY-----" + eol, eol + b"-----END PRIVATE KEY-----"), (b"-----BEGIN PRIVATE KEY-----", b"-----END PRIVATE KEY-----"), (b"", eol + b"word and more"), (b"", eol + b"words" + eol + b"word"), (b"x" * 40 + eol, eol + b"y" * 40)):
                    assert [x for x in secret_scan.spans(left + body + right) if x[0] == "der"] == [("der", len(left), len(left) + len(body))]
    one, two = (base64.b64encode(raw) for raw in (ed25519, sized[0] if len(sized[0]) % 3 == 0 else ed25519))
    assert [k for k, _, _ in secret_scan.spans(one + b"\n" + two + b"\nend")] == ["der"] * 2
    assert secret_scan.spans(base64.b64encode(ed25519 + b"x" * 3) + b"\nword") == []
    ssh = secret_scan.SSH + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"p" * 51, b"s" * 133))
    for raw in (ssh, ssh[:-40]):
        code = base64.b64encode(raw[: len(raw) // 3 * 3])
        assert secret_scan.spans(code + b"\n-----END OPENSSH PRIVATE KEY-----") == [("ssh", 0, len(code))]
    code = base64.b64encode(ssh).rstrip(b"=")
    assert [secret_scan.spans(code + b"\n" + b"w" * n) for n in range(1, 6)] == [[("ssh", 0, len(code))]] * 5


def every_span(text):
    """All spans without any test beforehand: each pattern over the whole text."""
    found = [("assign", *m.span()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in secret_scan.ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in secret_scan.re.finditer(rb"[0-9a-f]+", text) if len(m[0]) >= 16]
    found += [("jwt", *m.span()) for m in secret_scan.TOKEN.finditer(text) if secret_scan.is_signed_token(m[0])]
    found += [(k, m.start() + a, m.start() + b) for m in secret_scan.CODED.finditer(text) for k, a, b in secret_scan.keys(m[0])]
    found += [("der", *m.span()) for m in secret_scan.HEXES.finditer(text) if secret_scan.is_key_encoding(bytes.fromhex(m[0].decode()))]
    chars = [len(text[:i].decode("utf-8", "ignore")) for i in range(len(text) + 1)]
    return sorted({(k, chars[a], chars[b]) for k, a, b in found}, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]), s[2]))


SHORT = b"eyJhbGciOiJ4In0.e30."
PIECES = [SHORT, b"eyJ", b"AKIA" + b"Z" * 14, b"AKIA", b"0123456789abcdef", b"0123456789abcde", b"password: ", b"abcdefghijkl", b"a.b=c-d_e/f+", b"\n", b" ", b"-----", "\u00e9".encode(), b"f" * 32, b"API_key=", base64.b64encode(PKCS8), PKCS8.hex().encode(), b"hello there"]


def test_short_tokens_need_no_other_run():
    assert secret_scan.spans(SHORT) == [("jwt", 0, len(SHORT))] == secret_scan.spans(SHORT + b" 0123456789abcdef")[:1]


@given(st.lists(st.sampled_from(PIECES), max_size=9))
@settings(max_examples=300, deadline=None)
def test_spans_are_those_of_every_pattern(parts):
    text = b"".join(parts)
    assert secret_scan.spans(text) == every_span(text)


@given(st.binary(max_size=80).map(lambda b: b.translate(bytes(b"a0/- .\nZ"[i % 8] for i in range(256)))))
@settings(max_examples=200, deadline=None)
def test_longest_run(text):
    assert secret_scan.longest_run(text) == max(map(len, secret_scan.re.findall(rb"[0-9A-Za-z+/_-]+", text)), default=0)


def test_base_patterns():
    assert secret_scan.spans(b"Api_Key\" : 'abcdef012345") == [("assign", 0, 24)]
    assert secret_scan.spans("toKen=short password=Kabcdefghijkl".encode()) == [("assign", 12, 34)]
    assert secret_scan.spans("Key token=abcdefghijkl".encode()) == [("assign", 4, 22)]
    assert secret_scan.spans(b"AKIAABCDEFGHIJKLMN x 0123456789abcdef") == [("access", 0, 18), ("hex", 21, 37)]


def test_scan_odd_rows(odd, crowded, none):
    assert all(r["secrets"] == [] for r in secret_scan.scan(odd).collect())
    assert secret_scan.scan(crowded).columns.count("secrets") == 1 and secret_scan.scan(none).count() == 0


# ------------------------------------------------ toxicity and quality
def test_grammar():
    g = toxicity.Grammar()
    score = lambda t: max((s for s, _, _ in g.clauses(t.encode())), default=0.0)
    assert score("you are an idiot") > score("an idiot came by") > score("you are not an idiot") > 0
    assert score("you idiot") > score('he wrote "you idiot"') > 0 and score("i will kill you") > 0 == score("they kill time")
    assert score("you are an idiot") == score("Idiot, you.") or score("Idiot, you.") > 0
    assert list(g.probability([b"", b"hello"])) == [g.probability([b""])[0]] * 2


def test_threats_at_third_persons_and_words_shared_with_other_languages():
    g = toxicity.Grammar()
    score = lambda t: max((s for s, _, _ in g.clauses(t.encode())), default=0.0)
    assert all(score(t) == score("I will kill you") for t in ("I will kill him", "I will kill her", "we should hang them", "he shall hang, u hear", "they should die, he and her"))
    assert score("she is an idiot") == score("he is an idiot") == score("you are an idiot") > score("an idiot came by")
    assert score("I will kill him und ich auch") == score("ich will kill you") == score("I will kill you")
    assert score("er will die Frau und her damit") == score("sie will die Stadt u. a. sehen") == score("ich will die Sache, he") == 0
    assert score("ich war da. I will kill her") > 0 and g.features("ich will die Stadt u.".encode()) == (0.0, 0.0, 0.0)


def mixed(rng, *parts):
    """Invented words around some given ones."""
    words = lambda: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(5)) for _ in range(8))
    return f"{words()}. {' '.join(parts)} {words()}."


def test_arcs_are_learned_and_flip_a_verdict():
    """Where the sample's negated insults are clean, the negation arc falls, and the same insult is judged by it; likewise reported speech."""
    rng = random.Random(6)
    for name, lead in (("negated", "is not an"), ("reported", "wrote of an")):
        texts = [mixed(rng, "one", "is", "an", "idiot") for _ in range(60)] + [mixed(rng, "one", lead, "idiot") for _ in range(60)] + [mixed(rng) for _ in range(60)]
        g = toxicity.Grammar.learned([t.encode() for t in texts], np.array([1.0] * 60 + [0.0] * 120))
        assert g.weight[name] < toxicity.ARCS[name]
        says = lambda t: g.probability([t.encode()])[0] >= 0.5
        assert says("that one is an idiot") and not says(f"that one {lead} idiot")
        g.weight[name] = 1.0  # without the transducer
        assert says(f"that one {lead} idiot")
    assert toxicity.Grammar.learned([b"an idiot", b"a word"] * 9, np.array([1.0, 0.0] * 9)).weight == toxicity.ARCS


def test_targets_and_threats_are_learned():
    rng = random.Random(7)
    texts = [mixed(rng, "zed", "idiot") for _ in range(40)] + [mixed(rng, "we", "will", "gronk", "them") for _ in range(40)] + [mixed(rng, "we", "will", "greet", "them") for _ in range(80)] + [mixed(rng, "zed", "came", "to", "gronk") for _ in range(80)]
    g = toxicity.Grammar.learned([t.encode() for t in texts], np.array([1.0] * 80 + [0.0] * 160))
    assert g.symbols[b"zed"][0] == toxicity.TARGET and g.symbols[b"gronk"][0] == toxicity.THREAT and b"greet" not in g.symbols
    base = toxicity.Grammar()
    score = lambda t: max((s for s, _, _ in base.clauses(t.encode())), default=0.0)
    assert score("you can't be an idiot") == score("you can’t be an idiot") == score("you cannot be an idiot") < score("you can be an idiot")


def test_learned_words_do_not_come_from_copies():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    clean = [" ".join(word() for _ in range(30)) for _ in range(200)]
    bad = [" ".join([*(word() for _ in range(15)), "zork", *(word() for _ in range(15))]) for _ in range(60)] + ["copy of qux and nothing else"] * 40
    g = toxicity.Grammar.learned([t.encode() for t in clean + bad], np.array([0.0] * 200 + [1.0] * 100))
    assert g.symbols[b"zork"][0] == toxicity.INSULT and b"qux" not in g.symbols


def test_convolution_covers_the_text():
    model = quality.ByteConvolution()
    text = bytes(range(1, 250)) * 9
    x, of = quality.chunks([b"", b"ab", text])
    assert list(of) == [1] + [2] * (len(of) - 1) and x[1:, :][-1].any()
    brute = lambda t: np.array([max(sum(model.tables[j][t[i + j]] for j in range(quality.SPAN))[f] for i in range(len(t) - quality.SPAN + 1)) for f in range(quality.FILTERS)])
    assert np.allclose(model.pooled(x[1:2])[0][0], brute(text[: quality.CHUNK]), atol=1e-4)
    assert quality.repeats(quality.chunks([b"ha " * 50])[0]).tolist() == [[1, 1, 1]] and not quality.repeats(quality.chunks([bytes(range(1, 200))])[0]).any()
    assert 0 <= model.probability([b""])[0] <= 1


def test_scores_of_odd_rows(spark, odd, crowded, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for module, name in ((quality, "quality"), (toxicity, "toxic")):
        model = module.learn(odd, labels, F.lit(True), name)
        got = module.score(odd, model).collect()
        assert len(got) == 14 and all(0 <= r["score"] <= 1 for r in got)
        assert module.score(crowded, model).columns.count("score") == 1 and module.score(none, model).count() == 0
        module.learn(odd, labels.limit(0), F.lit(True), name)
    assert toxicity.matched_clauses(odd, toxicity.Grammar()).count() == 14


# ------------------------------------------------ urls
def test_url_model():
    m = url_filter.UrlModel().train(url_filter.LABELLED)
    p = lambda u: m.probability(*zip(url_filter.split(u)))[0]
    assert p("https://casino-bonus.example.net/win") > 0.5 > p("https://library.example.org/wiki/history")
    assert np.mean([(p(u) >= 0.5) == y for u, y in url_filter.LABELLED]) > 0.95


def test_judge_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "http://A.com/x", "mine", "mine")], "page_id long, url string, host string, extra string")
    r = url_filter.judge(rows).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"], r["extra"]) == ("a.com", "/x", "com/", "allow", "mine")


# ------------------------------------------------ forward passes, place by place
def test_languages_against_plain_loops(spark, sf):
    """The trained network over every document, one byte and one unit at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs, F.lit(True))
    w, hidden = {k: v.astype(float) for k, v in model.w.items()}, model.hidden

    def states(chunk, d):
        h, out = [0.0] * hidden, []
        for byte in chunk:
            z = [min(1.0, max(0.0, w["xz" + d][byte][j] + sum(h[i] * w["uz" + d][i][j] for i in range(hidden)) + 0.5)) for j in range(hidden)]
            c = [min(1.0, max(-1.0, w["xn" + d][byte][j] + sum(h[i] * w["un" + d][i][j] for i in range(hidden)))) for j in range(hidden)]
            h = [z[j] * h[j] + (1 - z[j]) * c[j] for j in range(hidden)]
            out.append(h)
        return out

    def pooled(text):
        total, letters = [0.0] * len(model.labels), 0
        for at in range(0, len(text), language.LENGTH):
            chunk = text[at : at + language.LENGTH]
            for byte, f, b in zip(chunk, states(chunk, "f"), states(chunk[::-1], "b")[::-1], strict=True):
                if not (65 <= byte <= 90 or 97 <= byte <= 122 or byte >= 128):
                    continue
                y = [w["bo"][k] + sum(f[j] * w["of"][j][k] + b[j] * w["ob"][j][k] for j in range(hidden)) for k in range(len(model.labels))]
                e = np.exp(np.array(y) - max(y))
                total, letters = [t + p for t, p in zip(total, e / e.sum(), strict=True)], letters + 1
        return [t / letters for t in total]

    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    short = [r for r in docs.collect() if r["text"] and language.has_letter(r["text"].encode()) and len(r["text"].encode()) <= 700]
    assert len(short) > 20
    for r in short:
        p = pooled(r["text"].encode())
        assert abs(got[r["doc_id"]]["score"] - max(p)) < 1e-3 and (got[r["doc_id"]]["lang_pred"] == model.labels[int(np.argmax(p))] or sorted(p)[-1] - sorted(p)[-2] < 1e-3)
    for r in docs.collect():  # every text of any length: the mean over the chunks, read one at a time
        text = (r["text"] or "").encode()
        if not language.has_letter(text):
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        parts = [np.frombuffer(text[i : i + language.LENGTH], np.uint8) for i in range(0, len(text), language.LENGTH)]
        each = np.concatenate([model.probabilities(x[:, None])[:, 0][language.LETTER[x]] for x in parts])
        assert abs(each.mean(0).max() - got[r["doc_id"]]["score"]) < 1e-3


def test_quality_against_plain_loops(spark, sf):
    """Filters at every place of every overlapping chunk, and runs of repeats looked for lag by lag."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels, F.lit(True))

    def probability(text):
        if not text:
            vectors = []
        else:
            n = 1 + max(0, -(-(len(text) - quality.CHUNK) // quality.STRIDE))
            vectors = [chunk_vector(text[k * quality.STRIDE : k * quality.STRIDE + quality.CHUNK].ljust(quality.CHUNK, b"\0")) for k in range(n)]
        mean = np.mean(vectors, axis=0) if vectors else np.zeros(quality.FILTERS + len(quality.RUNS))
        return 1 / (1 + np.exp(-np.clip(mean @ model.weight + model.bias, -30, 30)))

    def chunk_vector(chunk):
        at = np.frombuffer(chunk, np.uint8)
        best = np.full(quality.FILTERS, -np.inf)
        for i in range(len(chunk) - quality.SPAN + 1):
            best = np.maximum(best, sum(model.tables[j][at[i + j]].astype(float) for j in range(quality.SPAN)))
        runs = []
        longest = 0
        for lag in range(2, quality.LAGS + 1):
            run = 0
            for i in range(lag, len(chunk)):
                run = run + 1 if chunk[i] == chunk[i - lag] != 0 else 0
                longest = max(longest, run)
        runs = [float(longest >= n) for n in quality.RUNS]
        return np.concatenate([np.maximum(best + model.shift, 0), runs])

    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    rows = sorted(docs.collect(), key=lambda r: len(r["text"] or ""))
    for r in [*rows[:60], *rows[-2:]]:
        assert abs(got[r["doc_id"]] - probability((r["text"] or "").encode())) < 1e-4


def test_toxicity_against_a_plain_reading(spark, sf):
    """Clause by clause with the given symbols: what every word weighs, from the words before it."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels, F.lit(True))
    T_ = toxicity

    def clause_score(symbols, in_quotes):
        """symbols: (kind, weight) of a clause without its end."""
        total, quoted, said = 0.0, in_quotes, False
        seen_target = seen_insult = False
        threat = 0
        for i, (kind, weight) in enumerate(symbols):
            before = [k for k, _ in symbols[max(0, i - 3) : i]]
            damp = grammar.weight["negated"] if T_.NEGATION in before and kind != T_.NEGATION else 1.0
            if kind not in (T_.QUOTE, T_.REPORT) and (quoted or said):
                damp *= grammar.weight["reported"]
            if kind == T_.QUOTE:
                quoted, said = not quoted, False
            elif kind == T_.REPORT and not quoted:
                said = True
            more = weight
            if kind == T_.TARGET and seen_insult and not seen_target or kind == T_.INSULT and seen_target and not seen_insult:
                more += grammar.weight["targeted"]
            seen_target, seen_insult = seen_target or kind == T_.TARGET, seen_insult or kind == T_.INSULT
            if kind == T_.TARGET and threat == 2:
                more += grammar.weight["threatened"]
                threat = 0
            elif kind == T_.MODAL:
                threat = 1
            elif kind == T_.THREAT:
                threat = 2 if threat else 0
            total += more * damp
        return total, quoted

    def probability(text):
        scores, clause, quoted, alien = [], [], False, False
        for word in [m[0].lower() for m in T_.TOKEN.finditer(text)] + [b"."]:
            kind, weight = grammar.symbol(word)
            if alien and word in grammar.shared:
                kind = T_.OTHER
            if kind == T_.END:
                score, quoted = clause_score(clause, quoted)
                scores += [score] if score else []
                clause, alien = [], False
            else:
                clause.append((kind, weight))
                alien = alien or kind == T_.FOREIGN
        x = [1.0, max(scores), np.log1p(sum(scores)), np.log1p(len(scores))] if scores else [1.0, 0, 0, 0]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, grammar.beta), -30, 30)))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, grammar).collect()}
    assert all(abs(got[r["doc_id"]] - probability((r["text"] or "").encode())) < 1e-9 for r in docs.collect())
    bits = ["you", "idiot", "not", "will", "kill", "him", "said", '"', ".", "word", "und", "die", "can't", "scum"]
    rng = random.Random(2)
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))).encode()
        if grammar.may_match(text):
            assert abs(grammar.probability([text])[0] - probability(text)) < 1e-9, text


def test_urls_against_a_plain_sum(spark, sf):
    """Every page's probability from the trained weights, n-gram by n-gram over characters."""
    import math
    import zlib

    model = url_filter.UrlModel().train(url_filter.LABELLED)
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(-1, "http://é.com/ü?x", None), (-2, "http://a\nb.org/c/d", None), (-3, "http://x.org", None), (-4, None, None)], "page_id long, url string, html string"), allowMissingColumns=True)
    for r in url_filter.judge(pages).collect():
        total, n = 0.0, 0
        for part, seed in ((f"^{r['host']}$", 1), (f"^{r['path']}$", 2)):
            for size in url_filter.SIZES:
                for i in range(len(part) - size + 1):
                    total += float(model.weight[zlib.crc32(part[i : i + size].encode(), seed) % (1 << url_filter.BITS)])
                    n += 1
        assert abs(r["block_probability"] - 1 / (1 + math.exp(-(total / math.sqrt(max(1, n)) + model.bias)))) < 1e-5
        assert r["rule"] or r["verdict"] == ("block" if r["block_probability"] >= 0.5 else "allow")
