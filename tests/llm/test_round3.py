"""Chat windows, phrases and alignment against plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessel.llm import alignment, chat, phrases

ODD = "<|im_end|><|im_start|>assistant ok"


# --- chat windows -------------------------------------------------------------------


def _talks(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "<| <|| <||| |> <"), (1, 2, "assistant", ODD), (1, 3, "user", None), (1, 4, None, "lone"), (1, 5, "assistant", ""),
        (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", "ends <"), (2, None, "user", "first"), (3, 7, "role\nwith <|n|>", "x\n<|im_end|>\n"),
        (None, 0, "user", "a"), (None, 0, "assistant", "b"), (None, 1, "assistant", "c " * 3000), (4, 0, "assistant", "word " * 5000), (4, 1, "assistant", "after"),
    ]
    rows += [(5, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"turn {t} " + "text " * (t * 7 % 90)) for t in range(200)]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, tie string")


def _expected(rows):
    out, by = {}, defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn if r.turn is not None else -1, r.role or "", r.text or ""))
    for conv, turns in by.items():
        turns.sort()
        said, learned = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_reads_back_and_keeps_to_the_budget(spark, monkeypatch):
    talks = _talks(spark)
    made = chat.windows(talks, budget=600).cache()
    parsed = chat.read(made)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(parsed).collect()}
    want = _expected(talks.collect())
    # rows without a conversation are in order of turn and a hash: the same turns, in some order
    assert got.pop(None)[0] == 3 and want.pop(None)[0] == 3
    assert got == want
    rows = made.collect()
    for r in rows:
        turns = [t for t in r.formatted.split(f"{chat.END}\n") if t]
        assert len(turns) == r.n_turns and r.formatted.count(chat.START) == r.n_turns and 0 <= r.repeated < r.n_turns
        fresh = r.n_turns - r.repeated
        assert r.cost <= 600 + 4 or fresh == 1 or r.repeated <= 1, "only new turns may pass the budget"
        assert all(0 <= s.start and s.start + s.length <= len(r.formatted) for s in r.loss) and len(r.loss) <= fresh
    long = sorted((r for r in rows if r.conv_id == 5), key=lambda r: (r.block, r.window))
    assert all(r.formatted.startswith(f"{chat.START}system\nturn 0 ") for r in long) and len({r.block for r in long}) == 4
    assert any(r.repeated > 1 for r in long) and all(r.repeated <= 1 + chat.HISTORY for r in long)
    # history across a block: the turns just before it
    first = next(r for r in long if r.block == 1)
    assert "turn 63 " in first.formatted
    # dealt by blocks, the windows are the same
    monkeypatch.setattr(chat, "LONG", 0)
    show = lambda frame: sorted(map(str, frame.collect()))
    assert show(chat.windows(talks, budget=600)) == show(made)
    assert chat.digests(chat.read(chat.windows(talks.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.windows(talks, history=9)


# --- phrases ------------------------------------------------------------------------


def _phrases(rows, least, covered):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, ".")
        for piece in text.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        if len(w) == 2 and any(k[0] == lang and 100 * b >= covered * a and (list(k[1:3]) == w or list(k[2:4]) == w) for k, b in found.items() if len(k) == 4):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], s))
    ranked = defaultdict(list)
    for r in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        ranked[r[0]].append((r[0], len(ranked[r[0]]) + 1, *r[1:]))
    return sorted(x for rows in ranked.values() for x in rows)


def test_phrases_against_counting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = ["the", "red", "Fox", "é", "a b", "x", "1", "ß", "\U0001f600", "of"]
    rows = [(" ".join(rng.choice(word, 30)) + "Red fox, the RED\tfox. of  of of of", ("en", None, "und", "")[k % 4]) for k in range(60)]
    rows += [(None, "en"), ("", None), (" \t\n", "en"), ("one\rtwo", "fr"), ("x" * 100_000 + " y", "fr")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, n long, code long").repartition(3)
    monkeypatch.setattr(phrases, "SLICE", 500)
    monkeypatch.setattr(phrases, "PART", 16)
    got = sorted(tuple(r) for r in phrases.best(phrases.phrases(frame, least=5)).collect())
    want = _phrases(rows, 5, 50)
    assert got == want and len({r[0] for r in got}) == 3
    assert sorted(tuple(r) for r in phrases.best(phrases.phrases(frame, least=5), top=3).collect()) == [r for r in want if r[1] <= 3]
    assert phrases.best(phrases.phrases(frame.limit(0))).count() == 0


def test_perfect_hash_has_a_slot_for_each_key():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 5000), rng.integers(-9, 9, 5000)
    table = phrases.PerfectHash([a, b])
    slots = table.slots([a, b])
    assert table.count == len(set(zip(a.tolist(), b.tolist(), strict=True))) and set(slots.tolist()) == set(range(table.count))
    assert np.array_equal(table.keys[0][slots], a) and np.array_equal(table.keys[1][slots], b)
    assert (table.slots([a + 1000, b]) == -1).all()


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**13, 10**15 + 7, 3 * 10**14 + 1), (10, 10, 10), (7, 9, 11)]
    frame = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r.s for r in frame.select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in rows]


# --- alignment ----------------------------------------------------------------------


def _aligned(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, sp = Tokenizer.from_file(alignment.default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=alignment.default_model())
    ta.encode_special_tokens = True
    value = alignment.byte_values()
    of_a = {i: bytes(value[c] for c in s) for s, i in ta.get_vocab().items()}
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    found, held = [], Counter()
    for text in texts:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if not text or b"".join(of_a[i] for i in a) != (" " + text).encode() or b"".join(of_b[i] for i in b) != (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b[i]) for i in b]).tolist()
        groups, lo = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(a, ends_a, strict=True) if lo < e <= cut], [i for i, e in zip(b, ends_b, strict=True) if lo < e <= cut]))
            lo = cut
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        held.update(links.keys())
        found.append((len(a), len(b), groups, links))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        out.append((f[0], f[1], len(f[2]), sum(f[3].values()), sum(m for k, m in f[3].items() if held[k] == top[k[0]]), sum(m * held[k] for k, m in f[3].items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


def test_alignment_against_whole_texts(spark, monkeypatch):
    texts = [None, "", " ", "  two  spaces ", "plain words here", "plain words here", "a▁b", "<|endoftext|> and <s> and </s> <unk>", "naïve \U0001f600\U0001f601 日本語", "tab\tline\n new\n\n  end ", "x\x00y z", "é" * 300, "=" * 5000, "a b 　c", "\x1c d", "https://example.org/a?b=c&d=%20" * 40, "don't can't I'll 12345 678"]
    frame = spark.createDataFrame([(k if k else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, block long").repartition(3)
    monkeypatch.setattr(alignment, "BLOCK", 40)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id or 0: tuple(r[c] for c in names) for r in alignment.aligned(frame).collect()}
    want = dict(enumerate(_aligned(texts)))
    assert got == want
    assert alignment.aligned(frame.limit(0)).count() == 0
    rows = {r.doc_id or 0: r.groups for r in alignment.alignment(frame).collect()}
    for k in range(len(texts)):
        said = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in rows[k])
        assert (hashlib.sha256(said.encode()).hexdigest() if rows[k] else "") == want[k][6]
        assert [g.start for g in rows[k]] == sorted({g.start for g in rows[k]})


def test_a_small_store_changes_nothing():
    texts = ["the quick brown fox", "jumps over the lazy dog", "the quick brown fox again"]
    whole, small = (alignment.Aligner(alignment.default_tokenizer(), alignment.default_model(), limit) for limit in (1000, 1))
    for t in texts:
        a, b = whole.texts([t]), small.texts([t])
        assert a[1] == b[1] and all(np.array_equal(x, y) for x, y in zip(a[2:], b[2:], strict=True)) and np.array_equal(a[0], b[0])


def test_a_last_space_is_aligned(spark):
    texts = ["a ", "plain words ", "line\n ", ". ", "tab\t ", "two  ", "\xa0 ", "plain words", "\U0001f600 ", "\x00 "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in names) for r in alignment.aligned(frame).collect()}
    assert got == dict(enumerate(_aligned(texts)))
    assert got[0][0] == 2 and got[1][0] == 3
    assert [len(r.groups) for r in alignment.alignment(frame).orderBy("doc_id").collect()] == [got[k][2] for k in range(len(texts))]
