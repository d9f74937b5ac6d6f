"""Limits of pieces, blocks and shards: many of them on small data, in this process, where they can be set."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, line_dedup, lm, minhash, mixing, quality_rules, repeats, sharding, subwords, textkernel, token_files, wordstore
from tessel.llm.textkernel import raw

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- repeats: blocks, ranges and hot triggers ------------------------------------


def _exchange(make, blocks, told, ranges):
    sent = [row for no, p in enumerate(blocks) for row in make(no, p, told[no], ranges)]
    names, out = ("kind", "range", "block", "items", "extra", "flags"), [dict(t) for t in told]
    for group in {r[:2] for r in sent}:
        rows = [r for r in sent if r[:2] == group]
        back = repeats._settle(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}))
        for block, kind, items in zip(*(back.column(c).to_pylist() for c in ("block", "kind", "items")), strict=True):
            mine = np.frombuffer(items, np.uint64)
            out[block][kind] = np.unique(np.concatenate([out[block].get(kind, mine[:0]), mine]))
    return out


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_repeats_in_many_blocks(monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SORTED", 700)
    monkeypatch.setattr(repeats, "PIECE", 500)
    rng = random.Random(7)
    line = "the very common line that stands in every document of this corpus, "
    common = "".join(rng.choice("abc ") for _ in range(260))
    texts = []
    for i in range(60):
        own = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300)))
        texts.append((own + line + own[::-1] + (common[rng.randint(0, 150) :] if i % 3 else "") + line * (i % 4)).encode())
    texts += [b"", b"z" * 700, texts[4], texts[4]]
    parsed, at = [], 0
    while at < len(texts):
        n = rng.randint(1, 9)
        part = texts[at : at + n]
        parsed.append(repeats.Parse(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])])))
        at += n
    told = [{} for _ in parsed]
    for make in (repeats._keys, repeats._phrases, repeats._strings):
        told = _exchange(make, parsed, told, 8)
    got = b"".join(repeats._removed(p, t).tobytes() for p, t in zip(parsed, told, strict=True))
    want, seen = b"", set()
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(t[i : i + 100])
        want += bytes(gone)
    assert got == want
    if hot == 1:
        assert any(repeats._SPREAD in t for t in told)


def test_suffixes_sorted_by_their_prefix():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(0, 3900)
    rank = repeats.sort_prefixes(data, at)
    held = [data[i : i + 100].tobytes() for i in at]
    order = sorted(set(held))
    assert rank.tolist() == [order.index(h) for h in held]


# --- pieces of long texts ---------------------------------------------------------


def test_long_texts_over_every_piece(monkeypatch):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "Beta", "ñu", "x" * 300]) for _ in range(3000))
    column = pa.array([long, None, "", "one", "y" * 5000, long])
    want = textkernel.shingle_hashes(column)
    low = minhash.min_max(*minhash.distinct(*textkernel.shingle_hashes(pa.array([long, "a b c d e f"]))))
    monkeypatch.setattr(textkernel, "PIECE", 777)
    monkeypatch.setattr(minhash, "BLOCK", 50)
    for a, b in zip(textkernel.shingle_hashes(column), want, strict=True):
        assert (a == b).all()
    again = minhash.min_max(*minhash.distinct(*textkernel.shingle_hashes(pa.array([long, "a b c d e f"]))))
    assert (low[0] == again[0]).all() and (low[1] == again[1]).all()


def test_word_store_is_bounded_by_bytes():
    made = []
    store = wordstore.WordStore(lambda ps: made.append(len(ps)) or [[len(p)] for p in ps], limit=1000, limit_bytes=75)
    for k in range(5):
        ids, at = store.ids([["a" * 60, f"w{k}"], ["a" * 60]])
        assert ids.tolist() == [60, 2, 60] and at.tolist() == [0, 2, 3]
        assert len(store.index) <= 4
    assert len(made) == 5 and made.count(2) >= 2  # emptied in between


def test_pieces_of_texts_with_runs_of_blanks():
    tok = token_files.tokens(token_files.default_tokenizer())
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "word", " ", "  ", "\n", "\t", " \n", "é", "9", ".", "'s", "\x1c", "\x00", " ", "　"]) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    ids, at = tok.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids, t
    double = "two  blanks " + "and many words " * 300
    assert len(tok.pieces(double)) > 800


def test_distinct_pieces_reach_the_library_once_and_together():
    tok = token_files.Tokens(token_files.default_tokenizer())
    library, calls = tok.tokenizer, []

    class Counted:
        def __getattr__(self, name):
            return lambda texts, **more: calls.extend(texts) or getattr(library, name)(texts, **more)

    tok.tokenizer = Counted()
    rng = random.Random(6)
    some = ["".join(rng.choices("aehinorst", k=rng.randint(2, 12))) for _ in range(5000)]
    texts = [" ".join(w + rng.choice(["", ".", ",", "\n", ".\nThen", "'s", " \u3000x", "\u2014\u00a0y", "é", "<|endoftext|>", "?!"]) for w in rng.choices(some, k=300)) for _ in range(60)] + ["", " ", "\n", "ends \n"]
    ids, at = tok.encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert sum(map(len, calls)) < sum(map(len, texts)) and len(calls) < 3000  # over 10 000 distinct pieces between spaces
    calls.clear()
    tok.encode(texts)
    assert not calls


def test_lm_words_reach_the_tokenizer_once_and_together():
    sub = lm.Subwords(lm.default_tokenizer())
    plain, calls = sub.ordinary, []
    sub.ordinary = lambda text: calls.append(text) or plain(text)
    rng = random.Random(8)
    some = ["".join(rng.choices("aehinorst'.9é\u3042\u043f", k=rng.randint(1, 9))) + rng.choice(["", "", "", "'s", "\u00a0", "\x1c", "\u2014"]) for _ in range(6000)]
    texts = [" ".join(rng.choices(some, k=300)) for _ in range(60)] + ["", " \t", "ONE\nTwo\x0bthree "]
    for part in (texts, ["", "  "]):
        data, rows = raw(pa.array(part, pa.string()))
        pieces, codes, at = lm.distinct_words(data, rows)
        ids, ends = sub.store.coded(pieces, codes)
        for k, t in enumerate(part):
            ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
            assert [pieces[c].as_py() for c in codes[at[k] : at[k + 1]].tolist()] == ws
            assert ids[ends[at[k]] : ends[at[k + 1]]].tolist() == [i for w in ws for i in plain(" " + w.decode())]
    assert len(calls) < 3500  # over 5 000 distinct words
    calls.clear()
    sub.store.coded(*lm.distinct_words(*raw(pa.array(texts, pa.string())))[:2])
    assert not calls


def test_lm_windows_of_documents_need_no_masks_but_the_first():
    rng = np.random.default_rng(9)
    at = np.cumsum([0, 1, 40, 16, 5, 90])
    doc = np.repeat(np.arange(5), np.diff(at)).astype(np.int32)
    x = rng.integers(0, lm.SYMBOLS, at[-1])
    w = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in lm.start().items()}
    bias = rng.standard_normal((lm.SYMBOLS, lm.CLASSES)).astype(np.float32)
    starts, ends = lm.starts_of(at)
    inside = starts[:, None] + np.arange(lm.SPAN) < ends[:, None]
    want = lm.forward(w, bias, *lm.windows_at(x, doc, starts))[0].reshape(*inside.shape, -1)
    got = lm.forward(w, bias, *lm.laid(x, starts, np.isin(starts, at)))[0].reshape(*inside.shape, -1)
    assert np.allclose(got[inside], want[inside], atol=1e-4)


def test_lm_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(10)
    w = {k: (0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in lm.start().items()}
    bias = rng.standard_normal((lm.SYMBOLS, lm.CLASSES)).astype(np.float32)
    x, target = rng.integers(0, 50, (40, 2 * lm.SPAN)), rng.integers(0, lm.CLASSES, (40, lm.SPAN))
    use, mask, kept = rng.integers(0, 2, target.shape).astype(np.float32), np.array([0, 7]), {}

    def loss(w):
        z = lm.forward(w, bias, x, mask)[0].astype(np.float64)
        logs = z[np.arange(len(z)), target.ravel()] - np.log(np.exp(z).sum(axis=1))
        return -(logs * use.ravel()).sum() / use.sum()

    before = lm._adam
    try:
        lm._adam = lambda w, state, grad: kept.update(grad)
        lm._learn({k: v.copy() for k, v in w.items()}, {"t": 0}, bias, x, mask, target, use)
    finally:
        lm._adam = before
    for name, g in kept.items():
        way = rng.standard_normal(g.shape).astype(np.float32)
        way /= np.linalg.norm(way)
        if name in "qkv":
            way[50:] = 0
        step = np.float32(0.02)
        slope = (loss(w | {name: w[name] + step * way}) - loss(w | {name: w[name] - step * way})) / (2 * step)
        assert np.isclose(slope, (g * way).sum(), rtol=0.05, atol=2e-5), name


# --- Re-Pair ----------------------------------------------------------------------


def test_re_pair_ends_only_when_nothing_is_frequent():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 50_000, 1000)
    rules, symbols = token_files.re_pair(np.tile(passage, 500), 50_257)
    assert len(symbols) < 1000 and len(rules) < (1 << 16) - 50_257
    pairs, n = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    assert n.max(initial=0) < 2 * token_files.LEAST  # overlapping repeats of one symbol count twice
    one, left = token_files.re_pair(np.full(1 << 16, 7), 50_257)
    assert len(left) < 16


def test_re_pair_counts_every_pair():
    """Each turn's rules are the most frequent pairs, whatever other pairs there are."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3000, 1 << 20)
    ids[::50], ids[1::50] = 41, 42
    ids[25::100], ids[26::100] = 43, 44
    rules, symbols = token_files.re_pair(ids, (1 << 16) - 2)
    assert rules.tolist() == [[41, 42], [43, 44]] and (symbols == (1 << 16) - 2).sum() == (ids[:-1] * 4096 + ids[1:] == 41 * 4096 + 42).sum()


def test_re_pair_uses_all_names():
    rng = np.random.default_rng(1)
    rules, _ = token_files.re_pair(rng.integers(0, 300, 1 << 20), 50_257)
    assert len(rules) == (1 << 16) - 50_257


def test_several_shards_and_blobs(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SHARD_BYTES", 4000)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["red", "blue", "grün"]) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(7, "again seven"), (None, "no id")]
    rng.shuffle(rows)
    got = token_files.written(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("ids", F.lit(2))).collect()
    tok, at, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[0] or -1)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# --- odd tables for every operator ------------------------------------------------


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and ids, null ids and texts, and columns named as the operators name theirs."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "no id here at all"), (None, "no id here at all"), (3, "a b c d e f"), (1, "other text of one"), (4, ""), (5, "x" * 3000)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    taken = ("digest", "mark", "nth", "size", "tokens", "ledger", "ids", "key", "kept", "id", "component", "h", "run", "copies", "_id", "_crc", "_nth", "words", "block", "range", "text_crc32", "group_size", "n_words")
    return frame.withColumns({c: F.lit(1) for c in taken}), rows


def test_odd_tables(odd, tmp_path, spark):
    frame, rows = odd
    n = len(rows)
    assert quality_rules.ledger(frame).count() == n
    assert exact_dedup.exact_groups(frame).count() == n
    assert {(r.doc_id, r.group_size) for r in exact_dedup.exact_groups(frame).collect()} >= {(1, 3), (3, 3), (2, 2), (4, 2), (None, 2)}
    placed = sharding.assign(frame).collect()
    assert len(placed) == n and all(sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed))) for s in range(16))
    sharding.write_shards(frame, f"file://{tmp_path}/s")
    assert sorted(str(r.text) for r in spark.read.parquet(f"file://{tmp_path}/s").collect()) == sorted(str(t) for _, t in rows)
    assert subwords.round_trips(frame).count() == n
    assert mixing.taken(frame).count() == n
    assert line_dedup.dedup_lines(frame).count() == n
    near = {(r.doc_id, r.component_id) for r in minhash.near_components(frame).collect()}
    assert {(1, 1), (3, 1), (2, 2), (4, 4)} <= near
    assert repeats.remove_repeats(frame).count() == n
    assert sorted(r.n_removed for r in repeats.remove_repeats(frame).collect()) == [0] * (n - 1) + [2999]
    assert token_files.written(frame).count() == n
    scored = lm.scored(frame).collect()
    assert len(scored) == n and len({round(r.score, 9) for r in scored if r.n_tokens == 7}) == 1
    assert len({r.score for r in scored if r.doc_id == 1 and r.n_tokens == 7}) == 1


# --- exact dedup: additions that are repeated -------------------------------------


def test_an_addition_may_be_repeated(spark):
    index = exact_dedup.DigestIndex.temporary(spark)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a, b = docs([(1, "x"), (2, "y"), (3, "x ")]), docs([(4, "y"), (5, "z"), (6, "zz"), (7, "z\n")])
    ids = lambda rows: sorted(r.doc_id for r in rows.collect())
    assert ids(exact_dedup.dedup(a, index=index, batch="a")) == ids(exact_dedup.dedup(a, index=index, batch="a")) == [2, 3]
    assert ids(exact_dedup.dedup(b, index=index, batch="b")) == [6, 7]
    assert ids(exact_dedup.dedup(b, index=index, batch="b")) == [6, 7]
    assert ids(exact_dedup.dedup(b, index=index, batch="c")) == []
    assert index.rows().count() == 4
    index.drop()


def test_groups_grow_over_additions(spark):
    rows = [(i, f"{'pad ' * (i % 5)}t{i % 7}") for i in range(400)]
    frame = exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact_dedup.indexed(frame, additions=3)
    got = {(r.keep_id, r.chars, r.group_size) for r in index.groups().collect()}
    want = set()
    for key in {(i % 5, i % 7) for i, _ in rows}:
        mine = [i for i, _ in rows if (i % 5, i % 7) == key]
        want.add((min(mine), len(rows[mine[0]][1]), len(mine)))
    assert got == want and index.rows().count() == len(want)
    index.drop()


# --- sharding: an independent placement -------------------------------------------


def test_shards_by_hand(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60)) for i in range(900)] + [(5, "same id and text")] * 40 + [(None, "no id"), (None, None)]
    got = sorted((r.shard, r.slot, -1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest()[:15], r[0] is not None, r[0] or 0))
    total, at, want = sum(len(r[1] or "") + 1 for r in rows), 0, []
    for i, t in order:
        size = len(t or "") + 1
        want.append([min((at * 2 + size) * 16 // (2 * total), 15), -1 if i is None else i, size, zlib.crc32((t or "").encode())])
        at += size
    slots = [0] * 16
    for w in want:
        w.insert(1, slots[w[0]])
        slots[w[0]] += 1
    assert got == sorted(map(tuple, want))


# --- near duplicates: recall and hubs ---------------------------------------------


def test_recall_against_all_pairs(spark):
    """Every link of whole documents is found: measured on the synthetic table, over an inverted index."""
    from collections import Counter, defaultdict
    from pathlib import Path

    from tests.llm.test_llm import words

    path = "/root/testdata/sf0.001/documents.parquet"
    if not Path(path).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    texts = {r.doc_id: "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "") for r in docs.collect()}
    sets, where = {}, defaultdict(list)
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for g in sets[i]:
            where[g].append(i)
    shared = Counter((a, b) for ids in where.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    for threshold in (80, 85):
        links = [(a, b) for (a, b), n in shared.items() if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n)]
        got = {r.doc_id: r.component_id for r in minhash.near_components(docs, threshold=threshold).collect()}
        assert links and all(got[a] == got[b] for a, b in links)
        assert sum(i != c for i, c in got.items()) <= len(links)


def test_one_large_group_and_a_chain(spark):
    """A hub with the smallest id of a large group, and texts that link only with their neighbours."""
    from tests.llm.test_llm import brute_near

    rng = random.Random(11)
    hub = [f"h{i}" for i in range(200)]
    rows = [(0, " ".join(hub))]
    for k in range(150):
        w = list(hub)
        w[rng.randrange(0, 195)] = f"e{k}"
        rows.append((10 + k, " ".join(w)))
    stream = [f"c{i}" for i in range(400)]
    rows += [(1000 + k, " ".join(stream[k * 8 : k * 8 + 120])) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(dict(rows), 85)
