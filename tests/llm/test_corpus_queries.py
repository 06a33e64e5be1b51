"""Every query against SQL or brute force on whole small tables; odd and empty tables."""

import hashlib
import re
import struct
import zlib

import pytest
import xxhash


from tracelet.llm import queries

SF = "/root/testdata/sf0.001"

ROWS = {"op1_url_filter": "pages", "url_rules": "pages"}


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(agrees, name):
    agrees(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd_dir, empty_dir, name):
    made = queries.QUERIES[name](spark, odd_dir).collect()
    if name == "op6_chat":
        assert {r["conv_id"] for r in made} == {1, 2, None, -1}
    elif name == "secret_base":
        assert made == []
    elif name == "chat_parts":
        assert {r["conv_id"] for r in made} == {1, 2, None}
    else:
        assert len(made) == len(table(spark, odd_dir, ROWS.get(name, "documents")))
    nothing = queries.QUERIES[name](spark, empty_dir).collect()
    assert len(nothing) == (1 if name == "op6_chat" else 0)


def test_pieces_are_the_library_s(spark):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in queries.op4_pieces(spark, SF).collect()}
    docs = table(spark, SF, "documents")
    assert len(docs) == len(got)
    for d in docs:
        ids = lib.encode(d["text"] or "", add_bos=True, add_eos=True)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest id reachable, by brute force over all pairs."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_components(spark):
    prints = {d["doc_id"]: fingerprint(d["text"]) for d in table(spark, SF, "documents")}
    want = linked(prints)
    got = queries.op5_simhash(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in prints.items()}


ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def test_secrets(spark):
    for d in (SF,):
        got = {r["doc_id"]: r for r in queries.op7_secrets(spark, d).collect()}
        for row in table(spark, d, "documents"):
            t = row["text"] or ""
            spans = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
            spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
            spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
            spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            r = got[row["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
            assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def test_url_rules(spark, odd_dir):
    for d in (SF, odd_dir):
        got = queries.op1_url_filter(spark, d).collect()
        pages = table(spark, d, "pages")
        assert len(got) == len(pages)
        want = {}
        for p in pages:
            head, mark, rest = (p["url"] or "").partition("://")
            host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0]) if mark else ""
            path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0] if mark else ""
            fits = [r for r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
            want[p["page_id"]] = (host, path, max(fits, key=len, default=None))
        for r in got:
            assert (r["host"], r["path"], r["rule"]) == want[r["page_id"]]
            assert r["verdict"] == (RULES[r["rule"]] if r["rule"] else "block" if r["block_probability"] >= 0.5 else "allow")


def crc(i):
    return zlib.crc32(str(i).encode())


def test_languages_on_held_out_rows(spark):
    truth = {d["doc_id"]: d["lang"] for d in table(spark, SF, "documents")}
    got = queries.op3_language(spark, SF).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "threshold", "least"), [("op8_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op10_quality", "quality", 4, 2, 0.7, 0.85)])
def test_labels_on_held_out_rows(spark, name, label, modulus, rest, threshold, least):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in table(spark, sf, "labels")}
    got = queries.QUERIES[name](spark, sf).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % modulus == rest) and r["predicted"] == int(r["score"] >= threshold) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= least * len(held)
