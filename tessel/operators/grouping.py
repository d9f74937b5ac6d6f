"""Grouping of timed transcript atoms into passages.

Atoms of one resource are read in order; a passage ends at the best-scored
boundary among those from the soft minimum on to the first soft maximum or
the last boundary before a hard limit. The walk depends on where the passage
before ended, so a resource is one unit of work (``applyInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a boundary's properties are worth, and the characters that end a sentence.
WORTH = {
    "hard_limit_risk": 100, "speaker_change": 45, "sentence_end": 40, "strong_pause": 35, "soft_max": 20,
    "medium_pause": 15, "line_break": 15, "target_tokens": 10, "target_duration": 10,
}
SENTENCE_ENDS = ".!?。！？…"


@dataclass(frozen=True)
class Policy:
    """Limits in tokens and milliseconds, and pauses."""

    soft_min_tokens: int = 180
    target_tokens: int = 320
    soft_max_tokens: int = 480
    hard_max_tokens: int = 800
    soft_min_ms: int = 20_000
    target_ms: int = 60_000
    soft_max_ms: int = 90_000
    hard_max_ms: int = 120_000
    medium_pause_ms: int = 700
    strong_pause_ms: int = 1_500

    def __post_init__(self) -> None:
        for names in (("soft_min", "target", "soft_max", "hard_max"),):
            for unit in ("tokens", "ms"):
                limits = [getattr(self, f"{n}_{unit}") for n in names]
                if limits != sorted(limits) or limits[0] < 1:
                    raise ValueError(f"{unit} limits must be positive and not fall")
        if not 0 <= self.medium_pause_ms <= self.strong_pause_ms:
            raise ValueError("a strong pause is no shorter than a medium one")


# The three policies that are compared; B is the usual one.
VARIANTS = {
    "A": Policy(soft_min_tokens=128, target_tokens=256, soft_max_tokens=384, hard_max_tokens=512, soft_min_ms=20_000, target_ms=45_000, soft_max_ms=67_500, hard_max_ms=90_000),
    "B": Policy(),
    "C": Policy(soft_min_tokens=180, target_tokens=480, soft_max_tokens=720, hard_max_tokens=1_000, soft_min_ms=20_000, target_ms=90_000, soft_max_ms=120_000, hard_max_ms=120_000),
}


@dataclass(frozen=True)
class Atom:
    start_ms: int
    end_ms: int
    text: str
    speaker: str | None = None


@dataclass(frozen=True)
class Cut:
    """Where a passage ends, why, and how it scored."""

    last: int
    tokens: int
    end_ms: int
    reason: str
    score: int


def count_words(text: str) -> int:
    return len(text.split())


def joined(atoms: list[Atom]) -> str:
    """Texts with one space at a seam that has no white space on either side."""
    out = [atoms[0].text]
    for a in atoms[1:]:
        if not out[-1][-1].isspace() and not a.text[0].isspace():
            out.append(" ")
        out.append(a.text)
    return "".join(out)


def worth(p: Policy, here: Atom, after: Atom | None, tokens: int, length: int, end_ms: int, risk: bool) -> tuple[int, int, int]:
    """Score, and the distances from the targets in tenths, rounded down."""
    pause = after.start_ms - end_ms if after else -1
    true = {
        "hard_limit_risk": risk,
        "speaker_change": after is not None and None not in (here.speaker, after.speaker) and here.speaker != after.speaker,
        "strong_pause": after is not None and pause >= p.strong_pause_ms,
        "medium_pause": after is not None and p.medium_pause_ms <= pause < p.strong_pause_ms,
        "sentence_end": here.text.rstrip()[-1] in SENTENCE_ENDS,
        "line_break": "\n" in here.text,
        "soft_max": tokens >= p.soft_max_tokens or length >= p.soft_max_ms,
        "target_tokens": tokens >= p.target_tokens,
        "target_duration": length >= p.target_ms,
    }
    far = abs(tokens - p.target_tokens) * 10 // p.target_tokens
    long = abs(length - p.target_ms) * 10 // p.target_ms
    return sum(WORTH[k] for k, v in true.items() if v) - far - long, far, long


def passages(atoms: list[Atom], p: Policy, count: Callable[[str], int] = count_words, flag_unsplittable: bool = True) -> list[tuple[int, Cut]]:
    """(first atom, cut) of each passage; every atom is in exactly one."""
    if any(b.start_ms < a.start_ms for a, b in zip(atoms, atoms[1:], strict=False)):
        raise ValueError("atoms are not in order of their starts")
    out, first = [], 0
    while first < len(atoms):
        cut = _next_cut(atoms, first, p, count, flag_unsplittable)
        out.append((first, cut))
        first = cut.last + 1
    return out


def _next_cut(atoms: list[Atom], first: int, p: Policy, count: Callable[[str], int], flag: bool) -> Cut:
    begin, end, tried = atoms[first].start_ms, atoms[first].end_ms, []
    ahead = (count(joined(atoms[first : first + 1])), end)
    for i in range(first, len(atoms)):
        tokens, end = ahead
        after = atoms[i + 1] if i + 1 < len(atoms) else None
        if after:
            # there is white space at every seam, so words add up; other counters see the whole text
            more = tokens + count(after.text) if count is count_words else count(joined(atoms[first : i + 2]))
            ahead = (more, max(end, after.end_ms))
        free = after is None or after.start_ms >= end  # nothing overlaps the seam
        if tokens > p.hard_max_tokens or end - begin > p.hard_max_ms:
            if tried:  # the last boundary before the limit gets the risk's worth, then all compete
                at, t, e = tried[-1][3:]
                tried[-1] = (*worth(p, atoms[at], atoms[at + 1], t, e - begin, e, True), at, t, e)
                return _best(tried, "hard_limit")
            if not free:
                continue
            if not flag:
                raise ValueError("a stretch of atoms cannot be split within the hard limits")
            return Cut(i, tokens, end, "unsplittable", worth(p, atoms[i], after, tokens, end - begin, end, False)[0])
        if not free:
            continue
        risk = after is not None and (ahead[0] > p.hard_max_tokens or ahead[1] - begin > p.hard_max_ms)
        full = tokens >= p.soft_max_tokens or end - begin >= p.soft_max_ms
        if risk or full or after is None or (tokens >= p.soft_min_tokens and end - begin >= p.soft_min_ms):
            tried.append((*worth(p, atoms[i], after, tokens, end - begin, end, risk), i, tokens, end))
        if risk or full or after is None:
            return _best(tried, "hard_limit" if risk else "soft_max" if full else "end_of_input")
    raise AssertionError("the last atom ends a passage")


def _best(tried: list[tuple], reason: str) -> Cut:
    score, _, _, at, tokens, end = min(tried, key=lambda t: (-t[0], t[1], t[2], t[3]))
    return Cut(at, tokens, end, reason, score)


PASSAGE = "resource_id string, ordinal int, start_ms long, end_ms long, text string, token_count int, first_atom int, last_atom int, reason string, score int"


def group_atoms(atoms: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Passages of atoms (resource_id, ordinal, start_ms, end_ms, text, speaker)."""
    p = policy or Policy()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", kind="stable")
        held = [Atom(int(r.start_ms), int(r.end_ms), r.text, r.speaker if isinstance(r.speaker, str) else None) for r in rows.itertuples()]
        out = [(rows.resource_id.iloc[0], n, held[a].start_ms, c.end_ms, joined(held[a : c.last + 1]), c.tokens, a, c.last, c.reason, c.score) for n, (a, c) in enumerate(passages(held, p))]
        return pd.DataFrame(out, columns=[f.split()[0] for f in PASSAGE.split(", ")])

    return atoms.select("resource_id", "ordinal", "start_ms", "end_ms", "text", "speaker").groupBy("resource_id").applyInPandas(run, PASSAGE)


def group_variants(atoms: DataFrame, variants: dict[str, Policy] | None = None) -> DataFrame:
    """Passages of each policy, with its name in ``variant``."""
    out = None
    for name, p in (variants or VARIANTS).items():
        rows = group_atoms(atoms, p).withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def grouping_metrics(passages_: DataFrame, atoms: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Counts of a grouping by resource: atoms and those that begin before an earlier one's end, passages, atoms they refer to and repeat,
    passages that begin before the last one's end or exceed the policy's hard limits, tokens, lengths, reasons. A resource without passages has zeros.
    """
    from tessel.operators.timed import overlaps

    p = policy or Policy()
    n = overlaps(atoms).groupBy("resource_id").agg(F.count(F.lit(1)).alias("n_atoms"), F.count_if("overlaps").alias("n_input_overlaps"))
    order = Window.partitionBy("resource_id").orderBy("ordinal")
    # atoms are numbered, so those already referred to are the ones up to the furthest so far
    places = Window.partitionBy("resource_id").orderBy("first_atom", "last_atom").rowsBetween(Window.unboundedPreceding, -1)
    own, before = F.col("last_atom") - F.col("first_atom") + 1, F.coalesce(F.max("last_atom").over(places), F.lit(-1))
    length = F.col("end_ms") - F.col("start_ms")
    held = passages_.withColumns({
        "_own": own, "_new": F.greatest(F.lit(0), F.col("last_atom") - F.greatest("first_atom", before + 1) + 1), "_overlaps": F.coalesce(F.col("start_ms") < F.lag("end_ms").over(order), F.lit(False)),
    })
    got = held.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("max_tokens"), F.max(length).alias("max_ms"), F.count_if("_overlaps").alias("n_overlaps"),
        F.sum("_own").alias("n_covered"), F.sum(F.col("_own") - F.col("_new")).alias("n_repeated_atoms"), F.count_if((F.col("token_count") > p.hard_max_tokens) | (length > p.hard_max_ms)).alias("n_hard_exceeded"),
        *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("hard_limit", "soft_max", "end_of_input", "unsplittable")),
    )
    return n.join(got, "resource_id", "left").fillna(0)
