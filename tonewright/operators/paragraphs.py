"""Paragraph de-duplication within a document, and exact de-duplication over a corpus."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.text import count_matches, find_all, has, java, stripped

THRESHOLD, SHORTEST, LENGTH_RATIO = 0.90, 12, 0.6
#: Phrases of working notes left in a text.
WORK_PHRASES = (
    r"\b(let me|i'll|i should|key things|strict rules?|section by section|go through|re-?check|forbidden|checklist|draft|"
    r"analyze this|keep .* as-?is|mostly|wait\b|note that|original:|rewrite|buzzword)"
)


def normal_form(paragraph: Column) -> Column:
    """Lower case without mark-up, white space and listed punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(paragraph), F.lit(r"(?U)[#*`>\-]|\s"), F.lit("")), F.lit("[、，,/|·:：;；()（）\\[\\]【】.\"']"), F.lit(""))


def paragraphs(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n\n")), F.split(text, java(r"\n\s*\n"), -1)).otherwise(F.split(text, "\n", -1))


def without_notes(text: Column) -> Column:
    """Thinking blocks, ticked lines and English working notes removed."""
    text = F.regexp_replace(text, F.lit("(?is)<think>.*?</think>"), F.lit(""))

    def kept(line: Column) -> Column:
        s = stripped(line)
        han, letters = count_matches(s, r"[\x{4e00}-\x{9fff}]"), count_matches(s, "[A-Za-z]")
        note = has(s, WORK_PHRASES, True) | ((han == 0) & (F.size(find_all(s, "[A-Za-z]+")) >= 6))
        ticked = F.contains(s, F.lit("✓")) | F.contains(s, F.lit("✗"))
        return (F.length(s) == 0) | (~ticked & ~((letters > han) & note))

    return F.array_join(F.filter(F.split(text, "\n", -1), kept), "\n")


def near(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Are two normal forms alike? Short ones never are; lengths must be close."""
    if not a or not b:
        return a == b
    short, long = sorted((len(a), len(b)))
    if short < SHORTEST or short / long < LENGTH_RATIO or 2 * short / (short + long) < threshold:
        return False
    return a == b and threshold <= 1 or matching_text(b).alike(a, threshold)


CHARACTER_BINS = 256


def character_counts(form: str) -> np.ndarray:
    codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % CHARACTER_BINS, minlength=CHARACTER_BINS)


def all_places(text: str, character: str) -> list[int]:
    found, at = [], text.find(character)
    while at >= 0:
        found.append(at)
        at = text.find(character, at + 1)
    return found


class MatchingText:
    """Is difflib's ratio to this text, its second one, at least a threshold? The answer is the library's.

    From 200 characters on, the library starts a match only at characters that make up a hundredth of this text at most.
    Only their places are visited, and blocks are looked for, longest stretch first, until what is matched is enough or
    what is left can't be.
    """

    def __init__(self, text: str):
        self.text = text
        self.counts = character_counts(text)
        held = Counter(text)
        rare = [c for c, n in held.items() if n <= len(text) // 100 + 1] if len(text) >= 200 else held
        self.places = {c: all_places(text, c) for c in rare}

    def alike(self, other: str, threshold: float) -> bool:
        both = len(other) + len(self.text)
        if 2.0 * int(np.minimum(self.counts, character_counts(other)).sum()) / both < threshold:
            return False
        spots = sorted(i for c in self.places for i in all_places(other, c))
        steps = sum(len(self.places[other[i]]) for i in spots)
        # Blocks are a common subsequence. Where its table of bits is the smaller work, it comes first.
        if steps > len(other) * (4 + len(self.text) // 256) and 2 * common_length(other, self.text) < threshold * both - 1e-9:
            return False
        matched, left = 0, min(len(other), len(self.text))
        stretches = [(-left, 0, len(other), 0, len(self.text))]
        while stretches:
            if 2.0 * (matched + left) / both < threshold:
                return False
            size, low, high, own_low, own_high = heapq.heappop(stretches)
            left += size
            i, j, n = self.longest(other, spots, low, high, own_low, own_high)
            if not n:
                continue
            matched += n
            if 2.0 * matched / both >= threshold:
                return True
            for part in ((low, i, own_low, j), (i + n, high, j + n, own_high)):
                if (size := min(part[1] - part[0], part[3] - part[2])) > 0:
                    left += size
                    heapq.heappush(stretches, (-size, *part))
        return 2.0 * matched / both >= threshold

    def longest(self, other: str, spots: list[int], low: int, high: int, own_low: int, own_high: int) -> tuple[int, int, int]:
        """Start, start here and length of the block that the library takes: the first longest run at rare characters, extended on both sides."""
        best_i, best_j, best = low, own_low, 0
        runs: dict[int, int] = {}
        before, end = -2, bisect_left(spots, high)
        for at in range(bisect_left(spots, low), end):
            i = spots[at]
            ended, runs, before = runs if i == before + 1 else {}, {}, i
            goes_on = at + 1 < end and spots[at + 1] == i + 1
            if best and not ended and not goes_on:
                continue  # a run of one character, and not the first
            own = self.places[other[i]]
            own = own[bisect_left(own, own_low) : bisect_left(own, own_high)]
            if ended:
                for j in own:
                    n = runs[j] = ended.get(j - 1, 0) + 1
                    if n > best:
                        best_i, best_j, best = i - n + 1, j - n + 1, n
            elif own:
                runs = dict.fromkeys(own, 1)
                if not best:
                    best_i, best_j, best = i, own[0], 1
        back = common_end(other, best_i, self.text, best_j, min(best_i - low, best_j - own_low))
        best_i, best_j, best = best_i - back, best_j - back, best + back
        return best_i, best_j, best + common_start(other, best_i + best, self.text, best_j + best, min(high - best_i, own_high - best_j) - best)


def common_start(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from these places on are equal, `most` at most."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done, step = done + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return done


def common_end(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters up to these places are equal, `most` at most."""
    done, step = 0, 8
    while done < most:
        step = min(step, most - done)
        if a[i - done - step : i - done] == b[j - done - step : j - done]:
            done, step = done + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return done


#: Pairs come in order of one of their texts, so that its places are worked out once.
matching_text = lru_cache(maxsize=2)(MatchingText)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the usual table is the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        held = row & places.get(c, 0)
        row = ((row + held) | (row - held)) & full
    return len(a) - row.bit_count()


PAIR_BINS = 256
#: Forms of one band differ in length by less than this factor.
BAND = 1.1


def pair_counts(form: str) -> np.ndarray:
    """How often pairs of neighbouring characters come, by a hash of the pair."""
    codes = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((codes[:-1] * np.uint32(2654435761) + codes[1:] * np.uint32(2246822519)) >> np.uint32(24), minlength=PAIR_BINS).astype(np.int32)


def pairs_needed(lengths: np.ndarray | int, length: int, threshold: float) -> np.ndarray | float:
    """Fewest pairs of neighbours that two forms of these lengths share if they are alike.

    A common subsequence of L characters leaves n - L and m - L out. Of the n - 1 pairs of the one, each character left
    out of it breaks two at most, and each left out of the other parts one: n - 1 - 2 (n - L) - (m - L) are left.
    """
    both = lengths + length
    return 1.5 * threshold * both - both - 1 - 1e-6


class KeptForms:
    """The forms kept so far in bands of lengths, each with its counts of pairs; those that can be alike are compared."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.bands: dict[int, tuple[list[str], np.ndarray, np.ndarray]] = {}

    def reach(self) -> int:
        """Bands on either side whose lengths can be close enough."""
        ratio = max(LENGTH_RATIO, self.threshold / (2 - self.threshold), 1e-3)
        return int(math.log(1 / ratio, BAND)) + 1

    def alike(self, form: str, counts: np.ndarray) -> bool:
        band = int(math.log(len(form), BAND))
        for k in range(band - self.reach(), band + self.reach() + 1):
            if k in self.bands:
                forms, held, lengths = self.bands[k]
                n = len(forms)
                shared = np.minimum(held[:n], counts).sum(1)
                for i in np.flatnonzero(shared >= pairs_needed(lengths[:n], len(form), self.threshold)).tolist():
                    if near(form, forms[i], self.threshold):
                        return True
        return False

    def add(self, form: str, counts: np.ndarray) -> None:
        band = int(math.log(len(form), BAND))
        forms, held, lengths = self.bands.get(band) or ([], np.zeros((8, PAIR_BINS), np.int32), np.zeros(8, np.int64))
        n = len(forms)
        if n == len(held):
            held, lengths = np.concatenate([held, np.zeros_like(held)]), np.concatenate([lengths, np.zeros_like(lengths)])
        forms.append(form)
        held[n], lengths[n] = counts, len(form)
        self.bands[band] = forms, held, lengths


def kept_numbers(forms: list[str], threshold: float) -> tuple[list[int], int, int]:
    """Numbers of the paragraphs to keep (first come), and how many went as exact and near copies."""
    chosen, kept, seen, exact, similar = [], KeptForms(threshold), set(), 0, 0
    for i, form in enumerate(forms):
        if form in seen:
            exact += 1
            continue
        if len(form) >= SHORTEST:
            counts = pair_counts(form)
            if kept.alike(form, counts):
                similar += 1
                continue
            kept.add(form, counts)
        seen.add(form)
        chosen.append(i)
    return chosen, exact, similar


def with_dedup(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, strip_notes: bool = True) -> DataFrame:
    """Adds deduped and the statistics; only near copies need Python, on normal forms."""
    keep = df.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__whole", whole).withColumn("__t", without_notes(whole) if strip_notes else whole)
    full = F.filter(paragraphs(F.col("__t")), lambda p: F.rlike(p, F.lit(r"(?U)\S")))
    df = df.withColumn("__p", full).withColumn("__forms", F.transform("__p", normal_form))

    @F.pandas_udf("struct<chosen:array<int>,exact:int,similar:int>")
    def choose(forms: pd.Series) -> pd.DataFrame:
        rows = [kept_numbers(list(f), threshold) for f in forms]
        return pd.DataFrame({"chosen": [r[0] for r in rows], "exact": [r[1] for r in rows], "similar": [r[2] for r in rows]})

    df = df.withColumn("__c", choose("__forms"))
    chosen = F.transform("__c.chosen", lambda i: F.regexp_replace(F.element_at(F.col("__p"), i + 1), F.lit(r"\A\n+|\n+\z"), F.lit("")))
    out = stripped(F.regexp_replace(F.array_join(chosen, "\n\n"), F.lit(r"\n{3,}"), F.lit("\n\n")))
    df = df.withColumn("deduped", out)
    return df.select(
        *keep, "deduped",
        (F.length("__whole") - F.length("__t")).alias("workpaper_chars_removed"),
        F.col("__c.exact").alias("removed_exact"), F.col("__c.similar").alias("removed_near"),
        F.size("__p").alias("paragraphs_before"), F.size("__c.chosen").alias("paragraphs_after"),
        F.length("__whole").alias("before_chars"), F.length("deduped").alias("after_chars"),
    )


def exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Corpus-level exact de-duplication: each document with the smallest key of its normal form."""
    form = F.sha2(normal_form(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    rows = df.select(key, form.alias("form"))
    first = rows.groupBy("form").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return rows.join(first, "form").select(key, "first_id", "copies")
