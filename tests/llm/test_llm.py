"""Training-data operators against brute force on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import exact_dedup, line_dedup, lm, minhash, mixing, quality_rules, repeats, sharding, subwords, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def sample(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "Ünd", "leaux", "ñandú", "ou-", "x", "***", "漢字", "😀", "foo.", "Bar"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 14)))
    common = [line() for _ in range(4)] + ["passage " + " ".join(f"w{i}" for i in range(60))]
    out = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else line() for _ in range(rng.randint(0, 9))]
        out.append("\n".join(parts))
    out += [None, "", "  \t\n ", "a", "A", "a  b   c\n\n d ", " lead", "trail ", "word " * 300, "\n".join(["same line here"] * 12), "x" * 5000, out[3], out[3], (out[5] or "") + " ", "<|endoftext|> a\x00b"]
    base = " ".join(f"t{i}" for i in range(200))
    out += [base] + [" ".join(f"t{j}" if j != i * 7 else "edit" for j in range(200)) for i in range(1, 12)]
    rng.shuffle(out)
    rows = [(i * 3, t, "en", rng.choice(["s1", "s2", "S3", None]), 0) for i, t in enumerate(out)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with the names that operators use for their own."""
    return docs.withColumns({c: F.lit(1) for c in ("digest", "mark", "size", "tokens", "ledger", "ids", "key", "kept", "id", "component", "h", "run", "copies")})


def test_quality_rules(docs, texts, empty, clashing):
    got = {r.doc_id: r for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    for i, t in texts.items():
        w = words(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(BLANK)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), t
        assert (got[i].n_symbols, got[i].n_dup_lines) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert failed == ((got[i].fail_bits & quality_rules.BASE.mask) != 0)
    assert quality_rules.ledger(empty).count() == 0
    kept = quality_rules.keep_passing(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_ablations(docs):
    book = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        bit = quality_rules.BITS[r.rule]
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_alone == sum(b == bit for b in bits)
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)
    lenient = quality_rules.Policy("v2", ("few_words",))
    assert quality_rules.apply_policy(book, lenient).filter("kept").count() == sum(b & 1 == 0 for b in bits)


def test_exact_dedup(spark, docs, texts, empty, clashing):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in texts.items():
        groups.setdefault(norm(t), []).append(i)
    best = {k: min(v, key=lambda i: (-len(texts[i] or ""), i)) for k, v in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        k = norm(texts[r.doc_id])
        assert (r.keep_id, r.group_size, bytes(r.digest).hex()) == (best[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest())
    kept = exact_dedup.dedup(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == sorted(best.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    twice = docs.unionByName(docs)
    assert exact_dedup.dedup(twice).count() == len(best)


def test_exact_dedup_index_persists(spark, docs):
    index = exact_dedup.DigestIndex.temporary(spark)
    first, second = docs.filter("doc_id % 2 = 0"), docs
    a = exact_dedup.dedup(first, index=index).count()
    b = exact_dedup.dedup(second, index=index)
    assert a + b.count() == exact_dedup.dedup(docs).count() == index.rows().count()
    assert exact_dedup.dedup(docs, index=index).count() == 0
    index.drop()


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}") for i in range(3000)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[i].keep_id, got[i].group_size) == ((1, 1500) if i % 2 else (i, 1)) for i in range(3000))


def test_sharding(spark, docs, texts, empty):
    rng = random.Random(3)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 20)) for i in range(2500)] + [(i, "hot text") for i in range(5000, 6200)] + [(9000 + i, None) for i in range(300)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, total, biggest = Counter(), 0, 0
    for r in got:
        sizes[r.shard] += r.size
        total, biggest = total + r.size, max(biggest, r.size)
    assert len(got) == len(rows) and set(sizes) <= set(range(16))
    assert max(abs(sizes[s] - total / 16) for s in range(16)) <= biggest + 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    known = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((known[r.doc_id] or "").encode()) and r.size == len((known[r.doc_id] or "").encode()) + 1 for r in got)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs.repartition(7)).collect()}
    assert sharding.assign(empty).count() == 0


def test_write_shards(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and {r.doc_id for r in back.collect()} == {r.doc_id for r in docs.collect()}


def test_mixing(docs, texts, empty, clashing):
    rows = mixing.taken(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(words(t)) for i, t in texts.items()}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, todo, left = {}, set(order), 1.5 * sum(sums.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in todo) for s in todo}
        over = [s for s in todo if share[s] >= 2 * sums[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sums[s]
            todo.discard(s)
        left = 1.5 * sum(sums.values()) - sum(target.values())
    got = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s]) and math.isclose(r.target, target[s], rel_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - target[s]) <= 1.5 * mixing.BLOCK for s in order)
    assert sorted(rows) == sorted(mixing.taken(docs.repartition(5)).collect())
    assert mixing.taken(empty).count() == 0
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2


def test_apportionment_is_sainte_lague(spark):
    rows = [(s, int(n)) for s, n in (("a", 90_000), ("b", 31_000), ("c", 500), ("d", 64), ("e", 12_345))]
    sized = spark.createDataFrame(rows, "source string, size long").select(F.struct("source").alias("key"), F.col("size"))
    got = {(r.key.source, r.shard): r.seats for r in mixing.quotas(mixing.targets(sized)).collect()}
    due = {r.key.source: round(r.target * r.blocks / r.source_size, 6) for r in mixing.quotas(mixing.targets(sized)).filter("shard = 0").collect()}
    house = round(sum(due.values()))
    for k in range(mixing.SHARDS):
        seats = Counter()
        for _ in range(house * (k + 1) // mixing.SHARDS):
            seats[max(sorted(due), key=lambda s: due[s] / (2 * seats[s] + 1))] += 1
        assert {s: got[s, k] for s in due} == {s: seats[s] for s in due}


def brute_near(texts, threshold):
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("threshold", [85, 80])
def test_minhash(docs, texts, threshold):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs, threshold=threshold).collect()}
    assert got == brute_near(texts, threshold)


def test_minhash_large_groups(spark):
    """Copies of a hub that do not link with each other, and texts around one common passage that link with nothing."""
    rng = random.Random(5)
    hub = [f"h{i}" for i in range(400)]
    rows = [(1000, " ".join(hub))]
    for k in range(60):
        w = list(hub)
        for i in rng.sample(range(80), 3):
            w[i * 5] = f"e{k}_{i}"
        rows.append((2000 + k, " ".join(w)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(5000 + k, " ".join([f"u{k}_{i}" for i in range(20)] + passage)) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(dict(rows), 85)


def test_minhash_edges(spark, empty, clashing):
    assert minhash.near_components(empty).count() == 0
    kept = minhash.dedup(clashing)
    assert kept.columns == clashing.columns
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.near_components(odd).collect()} == {None: (1, False), 1: (1, True), 2: (2, True), 3: (3, True)}


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    low, high = minhash.min_max(np.concatenate([a, b]), np.array([0, 3000, 6000]))
    same = ((low[0] == low[1]).sum() + (high[0] == high[1]).sum()) / (2 * minhash.PERMUTATIONS)
    assert abs(same - 2400 / 3600) < 0.15


@pytest.mark.parametrize("small", [False, True])
def test_repeats(docs, texts, empty, small, monkeypatch):
    if small:
        monkeypatch.setattr(repeats, "BLOCK", 3000)
        monkeypatch.setattr(repeats, "RANGE", 9000)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    seen = set()
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), len([x for x in gone.split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(empty).count() == 0


def test_line_dedup(docs, texts, empty):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(x.strip(BLANK) for x in w):
                if w in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(w)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (got[i].n_lines, got[i].n_removed, got[i].kept) == (len(lines), len(gone), kept)
        assert got[i].n_spans == sum(k - 1 not in gone for k in gone)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_subwords_equal_the_library(docs, texts, empty, clashing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_model())
    codec = subwords.Codec(subwords.default_model())
    rng = random.Random(2)
    held = [t or "" for t in texts.values()] + ["".join(rng.choice("abdeéthing  \n\t.,▁ñ漢😀01-=") for _ in range(rng.randint(0, 50))) for _ in range(800)] + [" " * 50 + "x" + " " * 9]
    ids, at = codec.encode(held)
    data, ends = codec.decode(ids, at)
    for k, t in enumerate(held):
        want = sp.encode(t)
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert data[ends[k] : ends[k + 1]].tobytes().decode() == sp.decode(want)
    back = subwords.decode(subwords.encode(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in texts.items()}
    assert all(r.round_trip for r in subwords.round_trips(docs).collect())
    assert subwords.encode(empty).count() == subwords.round_trips(empty).count() == 0
    assert set(clashing.columns) < set(subwords.coded(clashing).columns)


def test_unigram_forward_pass():
    """The same traversal gives the best-scored segmentation when the model is a unigram model."""
    codec = subwords.Codec(subwords.default_model())
    codec.bpe, codec.id = False, {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba"])}
    codec.score = dict(zip(codec.id, [-2.0, -2.0, -3.0, -2.5, -3.5, -4.0], strict=True))
    codec.longest = 2

    def best(w):
        top = {0: (0.0, [])}
        for j in range(1, len(w) + 1):
            top[j] = max((top[i][0] + codec.score[w[i:j]], top[i][1] + [codec.id[w[i:j]]]) for i in range(j) if w[i:j] in codec.score)
        return top[len(w)][1]

    words_ = sorted({"".join(random.Random(k).choices("ab", k=6)) for k in range(40)})
    assert list(codec.encode_sorted(words_)) == [best("▁" + w) for w in words_]


def test_token_files(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    got = {r.doc_id: r for r in token_files.written(docs).collect()}
    at = 0
    for i in sorted(texts):
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.written(empty).count() == 0


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile([5, 6, 7, 5, 6], 1400), rng.integers(0, 50, 1000), np.full(301, 9)]).astype(np.int32)
    counts = np.array([700, 0, 1300, len(ids) - 2000])
    blob = token_files.Blob(token_files.pack(ids, np.arange(4), counts, 50257), 50257)
    assert (blob.all() == ids).all() and len(blob.symbols) < len(ids) / 2
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert all((blob.document(k) == ids[ends[k] : ends[k + 1]]).all() for k in range(4))


def test_lm(docs, texts, empty):
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    tokens = lambda t: words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not out[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    assert lm.scored(empty).count() == 0


def test_lm_probabilities_and_causality():
    """Class probabilities sum to 1, later tokens change nothing, and windows see only their own document."""
    rng = np.random.default_rng(4)
    w = {k: rng.standard_normal(x.shape).astype(np.float32) for k, x in lm.start().items()}
    bias = rng.standard_normal((lm.SYMBOLS, lm.CLASSES)).astype(np.float32)
    x, doc = rng.integers(0, lm.SYMBOLS, 100), np.repeat([0, 1], [40, 60]).astype(np.int32)
    which = np.arange(6)
    logits = lm.forward(w, bias, *lm.windows(x, doc, which))[0]
    y = x.copy()
    y[50:], y[:30] = 1, 2
    other = lm.forward(w, bias, *lm.windows(y, doc, which))[0]
    assert np.allclose(logits[40:50], other[40:50], atol=1e-5) and not np.allclose(logits[50:60], other[50:60])
    counts = np.arange(5000)[::-1].astype(float)
    _, klass, share = lm.classes(counts)
    assert np.allclose(np.bincount(klass, weights=10.0**share, minlength=lm.CLASSES)[np.unique(klass)], 1, atol=1e-3)


def test_lm_learns():
    """Training lowers the loss on a pattern that needs more than the symbol before."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, 4000)
    seq = np.empty(12000, np.int64)
    seq[0::3], seq[1::3], seq[2::3] = a, 5, a + 10  # the third repeats the first across a constant
    model = lm.Model(np.arange(lm.SYMBOLS), np.arange(lm.SYMBOLS), np.zeros(lm.SYMBOLS, np.float32), np.zeros((lm.SYMBOLS, lm.CLASSES), np.float32), lm.start())
    doc = np.zeros(len(seq), np.int32)
    x = np.concatenate([[0], seq[:-1]])
    which, state, w = np.arange(len(seq) // lm.SPAN), {"t": 0}, model.weights
    at = which[:, None] * lm.SPAN + np.arange(lm.SPAN)
    held, mask = lm.windows(x, doc, which)

    def loss():
        z = lm.forward(w, model.bias, held, mask)[0]
        z = z - z.max(axis=1, keepdims=True)
        z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -z.reshape(*at.shape, -1)[:, :, :][seq[at] >= 10][np.arange((seq[at] >= 10).sum()), seq[at][seq[at] >= 10]].mean()

    first = loss()
    for _ in range(150):
        lm._learn(w, state, model.bias, held, mask, seq[at], np.ones(at.shape, np.float32))
    assert first > 4 and loss() < 0.45  # guessing between the two would cost 0.69


def _lm_block(streams, out):
    at, none = np.cumsum([0, *map(len, streams)]), np.zeros(1, np.int64)
    return lm.Block(list(range(len(out))), np.array(out), at, np.concatenate(streams).astype(np.uint16), none, none, none)


def test_lm_trains_on_every_token(monkeypatch):
    """Over the rounds each training token is learned from once, also in short documents and at the end of a block."""
    rng = np.random.default_rng(3)
    sizes = [1, 5, 3, 17, *rng.integers(1, 60, 300), 7]
    out = [i % 7 == 2 for i in range(len(sizes))]
    block = _lm_block([np.arange(n) for n in sizes], out)
    used = []
    monkeypatch.setattr(lm, "_learn", lambda w, state, bias, x, mask, target, use, *rest: used.append((use.sum(), target[use > 0].sum())))
    model = lm.Model(np.arange(100), np.arange(100) + 1, np.zeros(100, np.float32), np.zeros((lm.SYMBOLS, lm.CLASSES), np.float32), lm.start())
    for turn in range(lm.ROUNDS):
        lm.train_block(block, model, turn)
    kept = [n for n, held in zip(sizes, out, strict=True) if not held]
    assert [sum(u) for u in zip(*used, strict=True)] == [sum(kept), sum(n * (n + 1) // 2 for n in kept)]


def test_lm_training_beats_the_bias_on_held_out_text():
    rng = np.random.default_rng(2)
    streams = []
    for _ in range(700):
        a = rng.integers(1, 9, 100)
        streams.append(np.stack([a, np.full(100, 9), a + 10], axis=1).ravel())  # the third repeats the first across a constant
    block = _lm_block(streams, [i % 7 == 2 for i in range(700)])
    counts = np.bincount(block.ids, minlength=lm.SYMBOLS).astype(float)
    symbol, klass, share = lm.classes(counts)
    x, _, train = lm.inputs(block, symbol)
    seen = np.zeros((lm.SYMBOLS, lm.CLASSES))
    np.add.at(seen, (x[train], klass[block.ids[train]]), 1)
    model = lm.Model(symbol, klass, share, np.log((seen + 0.01) / (seen + 0.01).sum(axis=1, keepdims=True)).astype(np.float32), lm.start())
    before = lm.score_block(block, model)[block.out].sum()
    for turn in range(lm.ROUNDS):
        model.weights, _ = lm.train_block(block, model, turn)
    after = lm.score_block(block, model)[block.out].sum()
    assert after > 0.9 * before  # log10; a tenth of the loss at least


def test_pipeline(spark, docs, texts, monkeypatch, tmp_path):
    import corpus_pipeline

    (tmp_path / "sf").mkdir()
    docs.write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    sf = f"file://{tmp_path}/sf"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame
        frame = stage(spark, before, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns, name
            frame.write.parquet(f"file://{tmp_path}/{k}")
            frame = spark.read.parquet(f"file://{tmp_path}/{k}")
    rows = frame.collect()
    assert rows and all(r.text == (texts[r.doc_id] or "") for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    near = brute_near({r.doc_id: r.text for r in rows}, 80)
    assert all(c == i for i, (_, c) in near.items())
