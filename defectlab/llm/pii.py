"""Personal data: patterns, and a semi-Markov conditional random field over whole spans.

The base patterns find what stands alone. The field then looks at every region
of a text where digits or mail-like words meet, proposes all token spans of at
most ``MOST_TOKENS`` tokens, scores each as a whole (checksums, grouping,
boundaries, words before it) and chooses boundaries and types together, so that
a phone number, a card and an address written side by side come apart. Spans of
the field that touch no base span are added; base spans always stay.

The field is fitted on regions of whole texts, all of them: distinct regions
(with the few characters around them) are drawn in Spark, the
``SAMPLE_REGIONS`` with the smallest hash for every kind and for those without a
span. Their base spans are the labels, and pairs of them are written side by
side as further regions. Copies of a region count once, however many texts or
places hold it. Without regions ``PRIOR`` stands.

Positions count code points, ends are exclusive. NULL and empty texts hold
nothing; equal scores prefer fewer spans; repeated rows give equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import SLICE_ROWS, store, text_udf, to_batch

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 18
SAMPLE_REGIONS = 400
SPANS = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base:string,spans:string>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

REGION = re.compile(r"[+(]?[0-9](?:[ ().+-]{0,3}[0-9])*+")
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]++\s?(?:@|[(\[{]at[)\]}]|(?<=\s)at(?=\s))\s?[A-Za-z0-9-]++"
    r"(?:(?:\.|\s?[(\[{]dot[)\]}]\s?|\sdot\s)[A-Za-z0-9-]++)++", re.I
)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
PHONE_SHAPE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}")
LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
CARD_SHAPE = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}")
CUES = {
    "email": re.compile(r"e-?mail|contact|write|correo", re.I), "ip": re.compile(r"\bip\b|host|server|address|addr", re.I),
    "card": re.compile(r"card|visa|credit|amex|tarjeta|karte|carte", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax|cell", re.I),
}

# For each kind: bias, valid, usual shape, clean left, clean right, cue before, well formed.
PRIOR = np.array([
    [-5.0, 3.0, 2.0, 0.5, 0.5, 1.0, 1.0],
    [-5.0, 3.0, 2.0, 1.0, 1.0, 1.0, 0.5],
    [-7.0, 4.0, 2.0, 1.0, 1.0, 1.0, 1.0],
    [-6.0, 1.5, 3.0, 1.0, 1.0, 1.0, 1.5],
])


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-1][0::2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[::-1][1::2]))
    return (odd + even) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``, so that long words cost no more than their length."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            found.append((start, end.end()))
            done = end.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Where the field looks: runs of numbers with seven digits or more, and words around a sign or word for ``at``."""
    found = []
    if DIGIT.search(text):
        found += [m.span() for m in REGION.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7]
    small = text if "@" in text else text.lower()
    if "@" in text or any(w in small for w in ("(at)", "[at]", "{at}", " dot ")):
        found += [m.span() for m in SPELLED.finditer(text)]
    found.sort()
    merged: list[tuple[int, int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def features(text: str, kind: int, start: int, end: int) -> list[float] | None:
    """What the whole span says about being of a kind; None where it cannot be one."""
    span = text[start:end]
    digits = digits_of(span)
    if kind == 0:
        spelled = SPELLED.fullmatch(span)
        if not spelled:
            return None
        valid = "@" in span and " " not in span
        usual = bool(re.search(r"[A-Za-z]{2,}$", span))
        form = bool(re.search(r"@|[(\[{]at[)\]}]", span, re.I)) or bool(re.search(r"\sdot\s[A-Za-z]{2,4}$", span, re.I))
    elif kind == 1:
        parts = span.split(".")
        if len(parts) != 4 or not all(p.isdigit() and len(p) < 4 for p in parts):
            return None
        valid = all(int(p) < 256 for p in parts)
        usual = all(p == "0" or p[0] != "0" for p in parts)
        form = True
    elif kind == 2:
        if not 13 <= len(digits) <= 19 or len(digits) + sum(c in " -" for c in span) != len(span):
            return None
        valid, usual = luhn(digits), bool(CARD_SHAPE.fullmatch(span))
        form = len({c for c in span if c in " -"}) < 2
    else:
        if not 9 <= len(digits) <= 15 or span[0] not in "+(0123456789":
            return None
        valid = span[0] == "+"
        usual = bool(PHONE_SHAPE.fullmatch(span)) and (valid or bool(LOCAL_PHONE.fullmatch(span)))
        form = span.count("(") == span.count(")") and span.count("(") < 2 and "+" not in span[1:]
    left, right = text[start - 1 : start], text[end : end + 1]
    far = text[end + 1 : end + 2]
    joined = right in (".", "-", "@") and far.isalnum()
    clean_left = not (left.isalnum() or left in ("+", "-", "@") or (left == "." and text[max(0, start - 2) : start - 1].isdigit()))
    cue = bool(CUES[KINDS[kind]].search(text, max(0, start - 24), start))
    return [1.0, float(valid), float(usual), float(clean_left), float(not right.isalnum() and not joined), float(cue), float(form)]


def candidates(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, int, list[float]]]]:
    """Token ends of a region and the spans ``(first token, end token, kind, features)`` that could be something."""
    cuts = [low] + [low + m.end() for m in TOKEN.finditer(text[low:high])]
    n, found = len(cuts) - 1, []
    for i in range(n):
        first = text[cuts[i]]
        if not (first.isalnum() or first in "+(._%-"):
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if not text[cuts[j] - 1].isalnum():
                continue
            for kind in range(len(KINDS)):
                f = features(text, kind, cuts[i], cuts[j])
                if f is not None:
                    found.append((i, j, kind, f))
    return cuts, found


def decode(weights: np.ndarray, n: int, spans: list[tuple[int, int, int, list[float]]]) -> list[tuple[int, int, int]]:
    """The best segmentation of ``n`` tokens: ``(first, end, kind)``; tokens outside spans score nothing."""
    ending: dict[int, list] = {}
    for i, j, kind, f in spans:
        score = float(np.dot(weights[kind], f))
        if score > 0:
            ending.setdefault(j, []).append((score, i, kind))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, i, kind in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    found, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            found.append((i, j, kind))
            j = i
    return found[::-1]


def fit(examples: list[tuple[int, list, set]], rounds: int = 25, rate: float = 0.3, ridge: float = 0.02) -> np.ndarray:
    """Weights by gradient ascent on the likelihood of the labelled segmentations, held near ``PRIOR``."""
    weights = PRIOR.copy()
    if not examples:
        return weights
    for _ in range(rounds):
        grad = np.zeros_like(weights)
        for n, spans, gold in examples:
            score = [float(np.dot(weights[k], f)) for _, _, k, f in spans]
            ending, starting = {}, {}
            for c, (i, j, _, _) in enumerate(spans):
                ending.setdefault(j, []).append(c)
                starting.setdefault(i, []).append(c)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1]] + [ahead[spans[c][0]] + score[c] for c in ending.get(j, ())])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1]] + [behind[spans[c][1]] + score[c] for c in starting.get(i, ())])
            for c, (i, j, k, f) in enumerate(spans):
                p = np.exp(ahead[i] + score[c] + behind[j] - ahead[n])
                grad[k] += (float((i, j, k) in gold) - p) * np.array(f)
        weights = weights + rate * (grad / len(examples) * 4 - ridge * (weights - PRIOR))
    return weights


def _example(text: str, low: int, high: int, gold_spans: list[tuple[int, int, int]]) -> tuple[int, list, set]:
    cuts, spans = candidates(text, low, high)
    at = {c: t for t, c in enumerate(cuts)}
    return len(cuts) - 1, spans, {(at[a], at[b], k) for k, a, b in gold_spans if a in at and b in at}


def _labelled(text: str) -> Iterator[tuple[int, str, int, int, int, int]]:
    """Regions to learn from, as ``(kind, around, low, high, start, end)``; kind -1 for one without a base span."""
    spans = sorted(base_spans(text), key=lambda s: s[1:])
    widest = max((b - a for _, a, b in spans), default=0)
    starts = [a for _, a, _ in spans]
    for low, high in regions(text):
        inside = [s for s in spans[bisect_left(starts, low - widest) : bisect_left(starts, high)] if s[2] > low]
        if len(inside) <= 1 and sum(c.isdigit() for c in text[low:high]) <= 20:
            shift = max(0, low - 30)
            kind, a, b = inside[0] if inside else (-1, shift, shift)
            yield kind, text[shift : high + 10], low - shift, high - shift, a - shift, b - shift


def _regions_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct regions with the smallest hashes of each kind, ``SAMPLE_REGIONS`` at most."""
    least: dict[int, dict[int, tuple]] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                for row in _labelled(text):
                    held = least.setdefault(row[0], {})
                    region = row[1][row[2] : row[3]]
                    rank = xxhash.xxh64_intdigest(region.encode("utf-8", "surrogatepass")) >> 1
                    held[rank] = min(row, held.get(rank, row))
                    if len(held) > 8 * SAMPLE_REGIONS:
                        least[row[0]] = dict(sorted(held.items())[:SAMPLE_REGIONS])
    rows = [(rank, *row) for held in least.values() for rank, row in sorted(held.items())[:SAMPLE_REGIONS]]
    yield to_batch(list(zip(*rows, strict=True)) if rows else [[]] * 7, REGIONS.replace(", ", ","))


REGIONS = "rank long, kind long, around string, low long, high long, start long, end long"


def sample_regions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct regions of all texts, ``SAMPLE_REGIONS`` of each kind by hash."""
    texts = docs.select(F.col(text).cast("string").alias("t")).dropna()
    offered = store(texts.mapInArrow(_regions_of, REGIONS), "regions")
    row = F.struct("around", "low", "high", "start", "end")
    found = offered.groupBy("kind", "rank").agg(F.min(row).alias("row")).select("kind", "rank", "row.*")
    kinds = [found.filter(F.col("kind") == k).orderBy("rank").limit(SAMPLE_REGIONS) for k in range(-1, len(KINDS))]
    return reduce(DataFrame.unionByName, kinds)


def fit_spans(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The field's weights from a bounded sample of the regions of all texts."""
    rows = sample_regions(docs, text).orderBy("rank", "kind").collect()
    examples, alone = [], {}
    for r in rows:
        inside = [(r["kind"], r["start"], r["end"])] if r["kind"] >= 0 else []
        examples.append(_example(r["around"], r["low"], r["high"], inside))
        if inside and r["start"] >= r["low"] and r["end"] <= r["high"]:
            alone.setdefault(r["kind"], []).append(r["around"][r["start"] : r["end"]])
    for k, values in alone.items():  # side by side, as a base pattern would not part them
        for other, others in alone.items():
            for a, b in list(zip(values, others[1:], strict=False))[:10]:
                joined = f"{a} {b}"
                examples.append(_example(joined, 0, len(joined), [(k, 0, len(a)), (other, len(a) + 1, len(joined))]))
    return fit(examples)


def all_spans(weights: np.ndarray, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and these with the field's additions; both by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for low, high in regions(text):
        cuts, spans = candidates(text, low, high)
        for i, j, kind in decode(weights, len(cuts) - 1, spans):
            a, b = cuts[i], cuts[j]
            if not any(x < b and a < y for x, y in taken):
                added.append((kind, a, b))
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _finder(weights):
    def work(texts):
        found = []
        for t in texts:
            base, every = all_spans(weights, t or "")
            n = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            found.append((*n, _written(base), _written(every)))
        return found

    return work


def redacted(weights: np.ndarray, text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap are replaced as one."""
    if not text:
        return text
    _, spans = all_spans(weights, text)
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(weights):
    return lambda texts: [(redacted(weights, t),) for t in texts]


def spans(text: Column, weights: np.ndarray) -> Column:
    """Counts of base spans by kind, the base spans and all spans as ``kind:start:end`` joined by commas."""
    return text_udf(SPANS, partial(_finder, weights))(text)


def redact(text: Column, weights: np.ndarray) -> Column:
    """The text without what was found; NULL stays NULL."""
    return text_udf("struct<text:string>", partial(_redactor, weights))(text)["text"]
