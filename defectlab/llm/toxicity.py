"""Toxicity: a noisy channel undoes disguises of words, then a linear model scores the restored text.

A character trigram model is counted over all texts. Words that are not plain
letters (leetspeak, separators inside, letters drawn out, letters standing
apart) become a lattice of what each character may stand for; Viterbi finds the
reading that the character model and the channel's costs like best. Plain words
have one reading only and need no lattice.

The score is a logistic model over words of the restored text and their
beginnings. Its features and weights come from at most ``SAMPLE_DOCS`` labelled
texts of either class, those with the smallest hash; everything else covers all
rows and whole texts. No score sees a label, language, source or id.

NULL and empty texts hold no words and get the score of an empty text; repeated
rows get equal scores; an empty table gives an empty result; without labels of
both classes every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import text_udf, to_batch

SAMPLE_DOCS = 2_500
MOST_FEATURES = 4_096
LEAST_TOXIC = 4
MOST_WORDS = 200_000
PREFIXES = (4, 5, 6, 7, 8)

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
SPACE, OTHER = len(LETTERS), len(LETTERS) + 1
SYMBOLS = OTHER + 1
EDGES = ".,;:!?\"'()[]{}<>*#%&|$~^_=/\\-+`«»¡¿…–—"
HEAD, TAIL = "".join(c for c in EDGES if c not in "$|!+("), EDGES.replace("$", "")
# What a character may stand for, and characters put between letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = frozenset(".-_*~'’·|/ ")
COST_LEET, COST_DROP, COST_BREAK, COST_REPEAT, COST_KEEP = 0.7, 0.5, 1.5, 0.6, 4.0


def _codes() -> np.ndarray:
    table = np.full(0xD800, OTHER, dtype=np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = table[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i
    for c in " \t\n\r\x0b\x0c":
        table[ord(c)] = SPACE
    return table


CODES = _codes()
CODE_OF = {c: i for i, c in enumerate(LETTERS)}


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's trigram counts; texts are parted by blanks. At most one row for each trigram."""
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            text = "  ".join(["", *(t for t in batch.column(0).slice(i, 256).to_pylist() if t), ""])
            codes = CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 0xD7FF)]
            counts += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield to_batch([seen, counts[seen]], "gram long,n long")


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probabilities of a character after two others, from all texts, smoothed by what follows one other."""
    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_count_trigrams, "gram long, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # SYMBOLS ** 3 numbers at most
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every character, or run of one letter, what it may stand for and what that costs."""
    found, i = [], 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c in CODE_OF or c.isalpha():
            if run >= 3:
                found.append([(c, COST_REPEAT), (c * 2, COST_REPEAT)])
                i += run
                continue
            found.append([(c, 0.0)])
        else:
            options = [(c, COST_KEEP)]
            options += [(o, COST_LEET) for o in LEET.get(c, "")]
            if c in SEPARATORS or c in EDGES:
                options += [("", COST_DROP), (" ", COST_BREAK)]
            elif c == " ":
                options += [("", COST_DROP)]
            found.append(options)
        i += 1
    return found


def decode(model: np.ndarray, token: str) -> str:
    """The likeliest reading of a token; of equal ones the first option of each character."""
    states: dict[tuple[int, int], tuple[float, str]] = {(SPACE, SPACE): (0.0, "")}
    for options in [*lattice(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for out, cost in options:
                x, y, total = a, b, score - cost
                for c in out:
                    z = SPACE if c == " " else CODE_OF.get(c, OTHER)
                    total += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, text + out)
        states = after
    return max(states.values(), key=lambda s: s[0])[1].strip()


def _noisy(core: str) -> bool:
    """Not plain: something between or in place of letters, or a letter three times in a row."""
    if core.isalpha():
        return any(core[i] == core[i - 1] == core[i - 2] for i in range(2, len(core))) if len(set(core)) < len(core) - 1 else False
    return any(c.isalpha() for c in core)


class Reader:
    """Words of texts as read through the channel, each distinct token decoded once per worker."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def words(self, token: str) -> list[str]:
        """Restored words of a token in lower case."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            core = token.rstrip(TAIL)
            if core.endswith("$$$"):
                core = core.rstrip(EDGES)
            core = core.lstrip(HEAD)
            if core[:2] and len(set(core[:2])) == 1 and core[0] in "$|!+(":
                core = core.lstrip("$|!+(")
            found = [core] if core.isalpha() and not _noisy(core) else []
            if not found and core and _noisy(core):
                read = decode(self.model, core)
                found = [w for w in ("".join(c if c.isalpha() else " " for c in read)).split() if w]
            self.known[token] = found
        return found

    def text(self, text: str | None) -> list[str]:
        """All restored words of a whole text; four or more single characters in a row are read together."""
        tokens = (text or "").lower().split()
        found, i, n = [], 0, len(tokens)
        if n >= 4:
            lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=n)
            single = lengths == 1
            if (single[:-3] & single[1:-2] & single[2:-1] & single[3:]).any():
                while i < n:
                    j = i
                    while j < n and single[j]:
                        j += 1
                    if j - i >= 4 and len(set(tokens[i:j])) > 1:
                        read = decode(self.model, " ".join(tokens[i:j]))
                        found += ["".join(c for c in w if c.isalpha()) for w in read.split()]
                        i = j
                    else:
                        found += self.words(tokens[i])
                        i += 1
                return [w for w in found if w]
        for t in tokens:
            found += self.words(t)
        return found


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    whole = word.encode("utf-8", "surrogatepass")
    return [zlib.crc32(b"=" + whole)] + [zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) for k in PREFIXES if len(word) > k]


def _sample(model):
    reader = Reader(model)

    def work(texts):
        found = []
        for t in texts:
            own = {f for w in set(reader.text(t)) for f in features(w)}
            found.append((np.array(sorted(own), dtype="<u4").tobytes(),))
        return found

    return work


def fit(rows: list[tuple[bytes, int]], share: float, rounds: int = 400, rate: float = 0.2, ridge: float = 2e-5) -> tuple[dict[int, float], float]:
    """Weights of the features that tell the classes apart, and the bias for a share of toxic texts."""
    labels = np.array([y for _, y in rows])
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return {}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    sizes = np.array([len(f) // 4 for f, _ in rows])
    flat = np.frombuffer(b"".join(f for f, _ in rows), dtype="<u4")
    of = np.repeat(labels, sizes)
    names, where = np.unique(flat, return_inverse=True)
    del flat
    pos, neg = np.bincount(where, weights=of, minlength=len(names)), np.bincount(where, weights=1 - of, minlength=len(names))
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    gain = np.where((pos >= min(LEAST_TOXIC, n1)) & (odds > 1.0), odds * pos, 0.0)
    order = np.argsort(-gain, kind="stable")[:MOST_FEATURES]
    order = order[gain[order] > 0]
    column = np.full(len(names), -1, dtype=np.int32)
    column[order] = np.arange(len(order))
    keep = column[where] >= 0
    doc, col = np.repeat(np.arange(len(rows)), sizes)[keep], column[where][keep]
    weights, bias = np.zeros(len(order)), 0.0
    moment, speed = np.zeros(len(order) + 1), np.zeros(len(order) + 1)
    weight_of_class = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(doc, weights=weights[col], minlength=len(rows))
        error = (labels - 1 / (1 + np.exp(-z))) * weight_of_class
        grad = np.append(np.bincount(col, weights=error[doc], minlength=len(order)) - ridge * weights, error.sum())
        moment, speed = 0.9 * moment + 0.1 * grad, 0.999 * speed + 0.001 * grad**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights + move[:-1], bias + move[-1]
    share = min(max(share, 1e-6), 1 - 1e-6)
    return {int(names[o]): float(w) for o, w in zip(order, weights, strict=True)}, float(bias + 0.5 * np.log(share / (1 - share)))


def held_out(key: Column) -> Column:
    """A third of the rows by a checksum of the id as text; their labels are never read."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, characters: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """The scoring model from a bounded sample of the labels that are not held out."""
    usable = (
        labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
        .dropna()
        .filter(~held_out(F.col("_key")))
        .groupBy("_key")
        .agg(F.max("_label").cast("int").alias("_label"))
    )
    sizes = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    order = [F.xxhash64("_key", F.lit(3)), F.col("_key")]
    chosen = usable.filter("_label = 1").orderBy(*order).limit(SAMPLE_DOCS).unionByName(usable.filter("_label = 0").orderBy(*order).limit(SAMPLE_DOCS))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna()
    joined = texts.join(F.broadcast(chosen), "_key")  # two numbers for each of 2 * SAMPLE_DOCS rows at most
    of = text_udf("struct<f:binary>", partial(_sample, characters))
    found = joined.select("_key", "_label", of("_text")["f"].alias("f")).orderBy("_key", F.xxhash64("f")).limit(2 * SAMPLE_DOCS).collect()
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit([(r["f"], r["_label"]) for r in found], share)


def _scorer(characters, model):
    weights, bias = model
    reader, known = Reader(characters), {}

    def of_token(token: str) -> tuple[int, ...]:
        if len(known) >= MOST_WORDS:
            known.clear()
        hits = {f for w in reader.words(token) for f in features(w) if f in weights}
        known[token] = made = tuple(hits)
        return made

    def work(texts):
        found = []
        for t in texts:
            tokens = (t or "").lower().split()
            own: set[int] = set()
            apart = len(tokens) >= 4 and _stands_apart(tokens)
            if apart:
                own.update(f for w in set(reader.text(t)) for f in features(w) if f in weights)
            else:
                for token in set(tokens):
                    hits = known.get(token)
                    if hits is None:
                        hits = of_token(token)
                    if hits:
                        own.update(hits)
            z = bias + sum(weights[f] for f in sorted(own))
            found.append((float(1 / (1 + np.exp(-max(-700.0, min(700.0, z))))),))
        return found

    return work


def _stands_apart(tokens: list[str]) -> bool:
    run = 0
    for t in tokens:
        run = run + 1 if len(t) == 1 else 0
        if run == 4:
            return True
    return False


def score(text: Column, characters: np.ndarray, model) -> Column:
    """Between 0 and 1, higher where a toxic label is likelier."""
    return text_udf("struct<score:double>", partial(_scorer, characters, model))(text)["score"]


def _restorer(characters):
    reader = Reader(characters)
    return lambda texts: [(" ".join(reader.text(t)),) for t in texts]


def restore(text: Column, characters: np.ndarray) -> Column:
    """The words of a text as the channel reads them."""
    return text_udf("struct<text:string>", partial(_restorer, characters))(text)["text"]
