"""Causal self-attention scoring of texts over subword ids, trained in numpy.

Documents are tokenised once (words lower-cased A-Z, each distinct word
encoded once by a public byte-level vocabulary, an end id after the last) and
stored as blocks of id arrays. Statistics cover every training document:

* word counts for the base score, exchanged as sorted hash arrays;
* counts of all ids, which give the classes: the most frequent ids have one
  each, the rest share classes of about equal mass;
* counts of (previous symbol, class), smoothed: the network's fixed bias.

The network is one causal attention head over the symbols before a position,
with relative positions; its output is added to that bias as logits of the
class, and an id's share of its class is its smoothed share of the counts.
It is trained by ``ROUNDS`` rounds of local Adam steps in every block. Each
window of a training document, its short last one included, is learned from in
one of the rounds; blocks' weights are averaged by the number of windows they
learned from. What training reads grows with the corpus; what reaches the
driver (id counts, bias counts and one set of weights per averaging group)
does not.

Windows are laid from a document's first token on: ``SPAN`` tokens to score
after ``SPAN`` tokens of context, so that neighbours overlap by the context,
each token is scored once, and a document's windows are the same wherever it
stands. Batches of windows, all of one size, are scored by masked matrix
products. Context never crosses documents.

Defined results: null, empty and blank texts have the end token alone; an
empty table gives an empty result; with no training document counts are 0 and
the model is uniform over classes. Equal texts score alike, repeated rows and
ids included. Ids are whole numbers, or text that reads as such; a null id is
empty text for the fold. Extra columns are not read. Runs over the same splits
of the input agree; other splits cut other blocks for training, whose averaged
weights, and with them ``score``, differ a little (the base columns never do).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import bucketed, stash
from tessel.llm.textkernel import _BLANK, _LOWER, SOLID, kinds, mix, raw, word_hashes
from tessel.llm.wordstore import WordStore, distinct

HELD_OUT, FOLDS = 2, 7
#: Bytes of text in a block; bytes of text for each hash range of words.
BLOCK, RANGE = 4 << 20, 32 << 20
SYMBOLS, CLASSES, SINGLE, WIDE = 1024, 128, 112, 16
SPAN, ROUNDS, GROUPS = 16, 2, 16
BATCH, RATE = 256, 0.02
END_WORD = np.uint64(0x5851F42D4C957F2D)
SMOOTH = 0.1
#: Words in one string for the tokenizer; rows of logits worked off at once.
JOINED, ROWS = 1000, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Subwords:
    """Ids of lower-cased words by a public byte-level vocabulary of ranks; the end id follows it."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self.n_bytes = np.zeros(self.end, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.store = WordStore(self._encode, 300_000)

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), np.cumsum(n) - n, n

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_one_by_one``, of words that no id reaches across when they stand in one string."""
        ids = np.array(self.ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int32)
        ends, n = np.concatenate([[0], np.cumsum(self.n_bytes[ids])]), np.fromiter(map(len, words), np.int64, len(words)) + 1
        to = np.cumsum(n)
        a, b = np.searchsorted(ends, to - n), np.searchsorted(ends, to)
        if ends[-1] != to[-1] or (ends[b] != to).any():
            return self._one_by_one(words)
        return ids, a, b - a

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, each after a space, where each word's lie in them, and how many they are."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends, solid = np.cumsum(n), kinds(np.frombuffer(b"".join(words), np.uint8)) & SOLID > 0
        plain = solid[ends - n] & solid[ends - 1]
        flat, held, starts, lengths = [], 0, np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for which, way in ((plain, self._joined), (~plain, self._one_by_one)):
            at = np.flatnonzero(which)
            for lo in range(0, len(at), JOINED):
                part = at[lo : lo + JOINED]
                ids, since, many = way([words[k] for k in part.tolist()])
                starts[part], lengths[part] = since + held, many
                flat.append(ids)
                held += len(ids)
        return np.concatenate(flat), starts, lengths


@lru_cache(1)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: CRC-32 of its id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


@dataclass
class Block:
    """Documents of a block: ids and end ids as one stream, words as indexes into distinct hashes."""

    doc_ids: list
    out: np.ndarray
    id_at: np.ndarray
    ids: np.ndarray
    word_at: np.ndarray
    words: np.ndarray
    hashes: np.ndarray


_ARRAYS = {"out": np.bool_, "id_at": np.int64, "ids": np.uint16, "word_at": np.int64, "words": np.uint32, "hashes": np.uint64}
_SCHEMA = "block long, doc_ids array<long>, " + ", ".join(f"{n} binary" for n in _ARRAYS)


def distinct_words(data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of texts in ``data``, of each word which it is, and each text's offsets into the words."""
    full = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[rows] = True
    starts = full.copy()
    starts[1:] &= ~full[:-1] | first[1:-1]
    starts = np.flatnonzero(starts)
    letters = _LOWER[data[full]]
    before = np.cumsum(full)[starts] - 1
    return *distinct(letters, np.append(before, len(letters))), np.searchsorted(starts, rows)


def _make(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            data, rows = raw(batch.column(1))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + BLOCK, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                pieces, codes, word_at = distinct_words(data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
                ids, ends = subwords(model).store.coded(pieces, codes)
                at = ends[word_at]
                ids = np.insert(ids, at[1:], subwords(model).end)
                at = at + np.arange(len(at))
                hashes, index = np.unique(np.append(word_hashes(pieces)[0], END_WORD), return_inverse=True)
                index = np.insert(index[codes], word_at[1:], index[-1])  # the end token of the base
                doc_ids = part.column(0).to_pylist()
                held = {"out": np.array([held_out(i) for i in doc_ids]), "id_at": at, "ids": ids, "word_at": word_at + np.arange(len(word_at)), "words": index, "hashes": hashes}
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([np.ascontiguousarray(held[n], t).tobytes()], pa.binary()) for n, t in _ARRAYS.items())], ["block", "doc_ids", *_ARRAYS])
                number, lo = number + 1, hi

    return run


def _blocks(batches: Iterator[pa.RecordBatch], more: int = 0) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            arrays = {n: np.frombuffer(batch.column(k + 2)[i].as_buffer(), t) for k, (n, t) in enumerate(_ARRAYS.items())}
            yield (batch.column(0)[i].as_py(), Block(batch.column(1)[i].as_py(), **arrays), *(batch.column(2 + len(_ARRAYS) + k)[i].as_py() for k in range(more)))


def _per_token(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each id of the stream, its document's number and whether it is for training."""
    doc = np.repeat(np.arange(len(block.doc_ids), dtype=np.int32), np.diff(block.id_at))
    return doc, ~block.out[doc]


# --- words of the base score -------------------------------------------------


def _word_counts(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            train = np.repeat(~block.out, np.diff(block.word_at))
            counts = np.bincount(block.words, weights=train, minlength=len(block.hashes)).astype(np.uint32)
            to = (mix(block.hashes) >> np.uint64(40)).astype(np.int64) % ranges
            order = np.argsort(to, kind="stable")  # hashes stay sorted in each range
            cuts = np.searchsorted(to[order], np.arange(ranges + 1))
            rows = [(r, number, block.hashes[order[a:b]].tobytes(), counts[order[a:b]].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["range", "block", "items", "counts"])

    return run


def _sum_words(table: pa.Table) -> pa.Table:
    """Corpus counts of one range's words: a row for each block, and one (block -1) with tokens and distinct words."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "items", "counts")), strict=True))
    items = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
    counts = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
    distinct, back = np.unique(items, return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.uint64)
    each, at = total[back], 0
    out = [(-1, b"", np.array([total.sum(), (total > 0).sum()], np.uint64).tobytes())]
    for block, held, _ in rows:
        n = len(held) // 8
        out.append((block, held, each[at : at + n].tobytes()))
        at += n
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["block", "items", "counts"])


# --- the network -------------------------------------------------------------


@dataclass
class Model:
    """What scoring needs: symbol and class of ids, each id's log10 share of its class, bias and weights."""

    symbol: np.ndarray
    klass: np.ndarray
    share: np.ndarray
    bias: np.ndarray
    weights: dict[str, np.ndarray]


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, class and log10 share of every id, from the counts of ids."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    symbol = np.minimum(rank, SYMBOLS - 1).astype(np.int16)
    klass = np.minimum(rank, SINGLE).astype(np.int16)
    rest = order[SINGLE:]
    mass = np.cumsum(counts[rest] + 1.0)
    if len(rest):
        klass[rest] = SINGLE + np.minimum((mass - (counts[rest] + 1.0)) * (CLASSES - SINGLE) / mass[-1], CLASSES - SINGLE - 1).astype(np.int16)
    total = np.bincount(klass, weights=counts + 1.0, minlength=CLASSES)
    return symbol, klass, np.log10((counts + 1.0) / total[klass]).astype(np.float32)


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"q": draw(SYMBOLS, WIDE), "k": draw(SYMBOLS, WIDE), "v": draw(SYMBOLS, WIDE), "r": (-0.2 * np.arange(2 * SPAN)).astype(np.float32), "o": np.zeros((WIDE, CLASSES), np.float32)}


_BACK = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]  # positions from key to query
_CAUSAL = _BACK >= 0


def windows(symbols: np.ndarray, doc: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows by number, from the start of the stream on."""
    return windows_at(symbols, doc, which * SPAN)


def starts_of(id_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and end of its document: windows follow each other from a document's first token on."""
    n = -(-np.diff(id_at) // SPAN)
    first = np.cumsum(n) - n
    return np.repeat(id_at[:-1] - first * SPAN, n) + np.arange(n.sum()) * SPAN, np.repeat(id_at[1:], n)


def windows_at(symbols: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (context, then the tokens before those scored) of some windows, and the mask of what a token may see."""
    at = starts[:, None] + np.arange(-SPAN, SPAN)[None, :]
    inside = (at >= 0) & (at < len(symbols))
    at = np.clip(at, 0, len(symbols) - 1)
    docs = np.where(inside, doc[at], -1)
    mask = _CAUSAL[None] & (docs[:, SPAN:, None] == docs[:, None, :])
    mask |= (_BACK == 0)[None]  # a token sees its own input at least
    return symbols[at], mask


_ONES = {n: np.ones((n, 1), np.float32) for n in (WIDE, 2 * SPAN, CLASSES)}
_FAR = np.clip(_BACK, 0, 2 * SPAN - 1)


def laid(x: np.ndarray, part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows_at``, of windows laid from documents' first tokens on: for a mask, which of them are their documents' first.

    The context of a first window is masked, that of any other lies in its document; what comes after a document's
    end is not scored and comes after all that is.
    """
    at = part[:, None] + np.arange(-SPAN, SPAN)[None, :]
    return np.take(x, at, mode="clip"), np.flatnonzero(first)


def room(n: int) -> np.ndarray:
    """Memory for logits, kept between batches: fresh pages cost more than the sums in them."""
    return np.empty((2, min(ROWS, n * SPAN), CLASSES), np.float32)


def attend(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the head gives for the scored half of windows, and what the backward pass needs.

    Scores are bounded before ``exp``, which spares the passes that look for maxima.
    ``mask`` says what each token may see, or (of ``laid``) which windows have no context.
    """
    q, k, v = np.take(w["q"], x[:, SPAN:], axis=0), np.take(w["k"], x, axis=0), np.take(w["v"], x, axis=0)
    q *= np.float32(WIDE**-0.5)
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += np.where(_CAUSAL, w["r"][_FAR], np.float32(-1e9))
    np.minimum(s, np.float32(40), out=s)
    np.exp(s, out=s)
    if mask.ndim == 1:
        s[mask, :, :SPAN] = 0
    else:
        np.copyto(s, np.float32(0), where=~mask)
    total = np.matmul(s, _ONES[2 * SPAN]) + np.float32(1e-30)
    return np.matmul(s, v) / total, s, total, q, k, v


def bounded(h: np.ndarray, o: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit of these rows can pass 60, which spares bounding each."""
    wide = h.reshape(-1, SPAN * WIDE)  # long rows: their maxima are quick
    most = np.maximum(wide.max(axis=0), -wide.min(axis=0)).reshape(SPAN, WIDE).max(axis=0)
    return float(bias.max()) + float((most @ np.abs(o)).max()) < 59


def logits_of(h: np.ndarray, symbols: np.ndarray, w: dict[str, np.ndarray], bias: np.ndarray, held: np.ndarray, low: bool = False) -> np.ndarray:
    """Class logits of some rows (in ``held``), at most 60 unless they are ``low`` anyway."""
    logits, more = held[:, : len(h)]
    np.matmul(h, w["o"], out=logits)
    logits += np.take(bias, symbols, axis=0, out=more, mode="clip")
    return logits if low else np.minimum(logits, np.float32(60), out=logits)


def forward(w: dict[str, np.ndarray], bias: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Class logits of the scored half of windows, all at once, and what the head gives."""
    h = attend(w, x, mask)[0]
    held = np.empty((2, len(x) * SPAN, CLASSES), np.float32)
    return logits_of(h.reshape(-1, WIDE), x[:, SPAN:].ravel(), w, bias, held), h


def _by_symbol(rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of the vectors in ``part`` by their symbols, two numbers added at once as a complex one."""
    pairs = part.reshape(-1, part.shape[-1]).view(np.complex64)
    wide = pairs.shape[1]
    out = np.zeros(SYMBOLS * wide, np.complex64)
    np.add.at(out, (rows.reshape(-1, 1).astype(np.int64, copy=False) * wide + np.arange(wide)).ravel(), pairs.ravel())
    return out.view(np.float32).reshape(SYMBOLS, -1)


def _learn(w: dict, state: dict, bias: np.ndarray, x: np.ndarray, mask: np.ndarray, target: np.ndarray, use: np.ndarray, held: np.ndarray | None = None) -> None:
    """One Adam step on the mean negative log-likelihood of the targets in ``use``.

    What each row of class probabilities is scaled by goes to the vectors of ``WIDE`` that it is multiplied with.
    """
    h, s, total, q, k, v = attend(w, x, mask)
    s /= total
    held = room(len(x)) if held is None else held
    flat, symbols, target = h.reshape(-1, WIDE), x[:, SPAN:].ravel(), target.ravel()
    weight = use.ravel()[:, None] / np.float32(max(1, use.sum()))
    back, low, rows = np.ascontiguousarray(w["o"].T), bounded(flat, w["o"], bias), np.arange(ROWS)
    grad, gh = {"o": np.zeros_like(w["o"])}, np.empty_like(flat)
    for lo in range(0, len(flat), ROWS):
        part = slice(lo, lo + ROWS)
        e = logits_of(flat[part], symbols[part], w, bias, held, low)
        np.exp(e, out=e)
        sums = e @ _ONES[CLASSES] + np.float32(1e-30)
        e[rows[: len(e)], target[part]] -= sums[:, 0]
        scale = weight[part] / sums
        grad["o"] += (flat[part] * scale).T @ e
        np.multiply(e @ back, scale, out=gh[part])
    gh = gh.reshape(h.shape)
    gs = np.matmul(gh, v.transpose(0, 2, 1))
    gs -= np.matmul((gh * h).reshape(-1, WIDE), _ONES[WIDE]).reshape(*gh.shape[:2], 1)
    gs *= s  # 0 where masked
    grad["r"] = np.bincount(_FAR.ravel(), weights=gs.sum(axis=0).ravel(), minlength=2 * SPAN)
    grad["q"] = _by_symbol(x[:, SPAN:], np.matmul(gs, k) * np.float32(WIDE**-0.5))
    grad["k"] = _by_symbol(x, np.matmul(gs.transpose(0, 2, 1), q))
    grad["v"] = _by_symbol(x, np.matmul(s.transpose(0, 2, 1), gh))
    _adam(w, state, grad)


def _adam(w: dict, state: dict, grad: dict) -> None:
    """One step of all weights in ``grad``, as one vector."""
    value = np.concatenate([g.ravel() for g in grad.values()], dtype=np.float32)
    state["t"] += 1
    m, n = state.setdefault("means", (np.zeros_like(value), np.zeros_like(value)))
    m *= np.float32(0.9)
    m += np.float32(0.1) * value
    np.multiply(value, value, out=value)
    n *= np.float32(0.99)
    n += np.float32(0.01) * value
    down = np.sqrt(n, out=value)
    down *= np.float32((1 - 0.99 ** state["t"]) ** -0.5)
    down += np.float32(1e-8)
    step, at = np.float32(RATE / (1 - 0.9 ** state["t"])) * m / down, 0
    for name, g in grad.items():
        w[name] -= step[at : at + g.size].reshape(g.shape)
        at += g.size


def inputs(block: Block, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input symbols (the end symbol before a document's first token), documents, and which tokens are for training."""
    doc, train = _per_token(block)
    seen = symbol[block.ids]
    x = np.empty_like(seen)
    x[1:] = seen[:-1]
    x[block.id_at[:-1]] = symbol[-1]
    return x, doc, train


def trained(block: Block, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and documents' ends of the windows that a round learns from: those of all rounds are all of training documents."""
    starts, ends = starts_of(block.id_at)
    kept = np.flatnonzero(~np.repeat(block.out, -(-np.diff(block.id_at) // SPAN)))[turn::ROUNDS]
    return starts[kept], ends[kept]


def train_block(block: Block, model: Model, turn: int) -> tuple[dict[str, np.ndarray], int]:
    """Local weights after this round's windows of a block, and how many those were."""
    x = inputs(block, model.symbol)[0].astype(np.int64)
    starts, ends = trained(block, turn)
    first = np.isin(starts, block.id_at)
    w, state = {k: v.copy() for k, v in model.weights.items()}, {"t": 0}
    target = np.pad(model.klass[block.ids], (0, SPAN))
    kept = room(BATCH)
    for lo in range(0, len(starts), BATCH):
        part = starts[lo : lo + BATCH]
        at = part[:, None] + np.arange(SPAN)[None, :]
        held, mask = laid(x, part, first[lo : lo + BATCH])
        _learn(w, state, model.bias, held, mask, target[at], (at < ends[lo : lo + BATCH, None]).astype(np.float32), kept)
    return w, len(starts)


def score_block(block: Block, model: Model) -> np.ndarray:
    """log10 probability of each document of a block.

    Every batch has the same number of windows (the last one repeats its last
    window), so that a window's sums are the same wherever it stands.
    """
    x = inputs(block, model.symbol)[0].astype(np.int64)
    target = np.pad(model.klass[block.ids], (0, SPAN)).astype(np.int64)
    starts, ends = starts_of(block.id_at)
    first = np.isin(starts, block.id_at)
    logs = np.empty(len(x), np.float32)
    size = 2 * BATCH
    kept, told = room(size), np.empty(size * SPAN, np.float32)
    for lo in range(0, len(starts), size):
        which = np.minimum(np.arange(lo, lo + size), len(starts) - 1)
        at = starts[which, None] + np.arange(SPAN)[None, :]
        held, mask = laid(x, starts[which], first[which])
        h, symbols, classes_at = attend(model.weights, held, mask)[0].reshape(-1, WIDE), held[:, SPAN:].ravel(), target[at].ravel()
        low = bounded(h, model.weights["o"], model.bias)
        for row in range(0, len(h), ROWS):
            part = slice(row, row + ROWS)
            logits = logits_of(h[part], symbols[part], model.weights, model.bias, kept, low)
            hit = logits[np.arange(len(logits)), classes_at[part]]
            np.exp(logits, out=logits)
            told[part] = hit - np.log((logits @ _ONES[CLASSES])[:, 0])
        inside = at < ends[which, None]
        logs[at[inside]] = told.reshape(at.shape)[inside]
    total = model.share[block.ids].astype(np.float64) + logs * np.log10(np.e)
    return np.add.reduceat(total, block.id_at[:-1]) if len(block.doc_ids) else total


# --- jobs --------------------------------------------------------------------


def _summed(blocks: DataFrame, of, size: int) -> np.ndarray:
    """Sum of an integer vector over all blocks: by block, by group, then on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, block in _blocks(batches):
            total += of(block)
        for at in np.array_split(np.flatnonzero(total), max(1, np.count_nonzero(total) // 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    out = np.zeros(size, np.int64)
    got = blocks.mapInArrow(part, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def _averaged(blocks: DataFrame, model: Model, turn: int) -> dict[str, np.ndarray]:
    names = list(model.weights)
    flat = lambda w: np.concatenate([w[n].ravel() for n in names])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, number = 0.0, 0, 0
        for number, block in _blocks(batches):
            w, n = train_block(block, model, turn)
            total, seen = total + flat(w).astype(np.float64) * n, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([number % GROUPS], pa.int32()), pa.array([number], pa.int64()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "number", "n", "w"])

    def add(table: pa.Table) -> pa.Table:
        # in order of blocks, whatever the order of arrival: sums of floats agree between runs
        total = sum(np.frombuffer(w, np.float64) for _, w in sorted(zip(table.column("number").to_pylist(), table.column("w").to_pylist(), strict=True)))
        return pa.table([table.column("part").combine_chunks().slice(0, 1), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n", "w"])

    rows = blocks.mapInArrow(part, "part int, number long, n long, w binary").groupBy("part").applyInArrow(add, "part int, n long, w binary").collect()
    rows.sort(key=lambda r: r.part)
    seen = sum(r.n for r in rows)
    if not seen:
        return model.weights
    mean, at, out = sum(np.frombuffer(r.w, np.float64) for r in rows) / seen, 0, {}
    for n in names:
        size = model.weights[n].size
        out[n] = mean[at : at + size].reshape(model.weights[n].shape).astype(np.float32)
        at += size
    return out


def fit(blocks: DataFrame, vocabulary: int) -> Model:
    """The model of the training documents in ``blocks``."""
    counts = _summed(blocks, lambda b: np.bincount(b.ids[_per_token(b)[1]], minlength=vocabulary), vocabulary)
    symbol, klass, share = classes(counts.astype(np.float64))

    def pairs(block: Block) -> np.ndarray:
        x, _, train = inputs(block, symbol)
        return np.bincount(x[train].astype(np.int64) * CLASSES + klass[block.ids[train]], minlength=SYMBOLS * CLASSES)

    seen = _summed(blocks, pairs, SYMBOLS * CLASSES).reshape(SYMBOLS, CLASSES).astype(np.float64)
    one = (seen.sum(axis=0) + 1) / (seen.sum() + CLASSES)
    bias = np.log((seen + SMOOTH * CLASSES * one) / (seen.sum(axis=1, keepdims=True) + SMOOTH * CLASSES)).astype(np.float32)
    model = Model(symbol, klass, share, bias, start())
    for turn in range(ROUNDS):
        model.weights = _averaged(blocks, model, turn)
    return model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords of every row."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    ranges = max(1, -(-total // RANGE))
    made = rows.mapInArrow(_make(path), _SCHEMA)
    # bucketed where it is made: what later steps learn comes to the blocks, not they to it
    blocks = bucketed(made, "lm", max(1, -(-total // (2 * BLOCK))), "block")
    model = fit(blocks, subwords(path).end + 1)
    sent = blocks.mapInArrow(_word_counts(ranges), "range int, block long, items binary, counts binary")
    words = stash(sent.repartition(max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range").groupBy("range").applyInArrow(_sum_words, "block long, items binary, counts binary"))
    both = words.filter("block = -1").select("counts").mapInArrow(_totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    told = words.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("items", "counts")).alias("told"))
    joined = blocks.join(told.hint("shuffle_hash"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, replies in _blocks(batches, 1):
            known = np.zeros(len(block.hashes), np.float64)
            for r in replies:
                known[np.searchsorted(block.hashes, np.frombuffer(r["items"], np.uint64))] = np.frombuffer(r["counts"], np.uint64)
            logs = np.log10((known + 1) / (both.n + both.v + 1))
            at = block.word_at[:-1]
            yield pa.RecordBatch.from_arrays([
                pa.array(block.doc_ids, pa.int64()), pa.array(block.out), pa.array(np.diff(block.word_at)),
                pa.array(np.add.reduceat((known > 0)[block.words].astype(np.int64), at)), pa.array(np.full(len(at), both.n, np.int64)),
                pa.array(np.add.reduceat(logs[block.words], at)), pa.array(score_block(block, model)), pa.array(np.diff(block.id_at)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_subwords"])

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(h[0]) for h in held], pa.int64()), pa.array([int(h[1]) for h in held], pa.int64())], ["n", "v"])
