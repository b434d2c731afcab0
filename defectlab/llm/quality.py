"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or boilerplate.

The chain is fitted on at most ``SAMPLE_DOCS`` labelled documents (those with
the smallest hash of their id) and ``SAMPLE_LINES`` lines of each; everything
else covers all rows and whole texts. A text is kept when it passes the base
rules and at least ``MIN_CONTENT`` of its word characters stand in lines that
the Viterbi path calls content.

NULL and empty texts have no words and fail. Lines without a word are left out
of the chain. Repeated rows get equal results; an empty table gives an empty
one; without labels the chain starts from ``PRIOR``, which counts marks only.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlab.llm.common import text_udf

SAMPLE_DOCS = 2_000
SAMPLE_LINES = 64
MIN_CONTENT = 0.5
MIN_WORDS = 50

SYMBOLS = "#*$%&|<>"
MARKS = ("license", "licence", "copyright", "©", "rights reserved", "cookie", "subscribe", "click here", "sign in", "log in")
ENDS = np.array([ord(c) for c in ".!?:;\"'"])
BATCH_CHARS = 1 << 19
FEATURES = ("bias", "symbols", "capitals", "calls", "bars", "repeated", "doubled", "seen", "short", "open", "digits", "letters", "marks")
PRIOR = np.array([-2.0, 3.0, 2.0, 2.0, 2.0, 2.0, 3.0, 1.0, 0.3, 0.3, 0.3, -1.0, 1.0])

KIND = (
    "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
    "base_failed:boolean,content_share:double,kept:boolean>"
)

_CLASSES = {"space": 1, "upper": 2, "lower": 4, "digit": 8, "symbol": 16, "call": 32, "newline": 64, "bar": 128}


def _char_classes() -> np.ndarray:
    """Class bits of every code point below the surrogates; the rest are plain characters."""
    table = np.zeros(0xD800, dtype=np.uint8)
    for i in range(0x2000):
        c = chr(i)
        if c in " \t\n\x0b\x0c\r":
            table[i] |= _CLASSES["space"]
        if c.isupper():
            table[i] |= _CLASSES["upper"]
        elif c.isalpha():
            table[i] |= _CLASSES["lower"]
        elif c.isdigit():
            table[i] |= _CLASSES["digit"]
        if c in SYMBOLS:
            table[i] |= _CLASSES["symbol"]
        if c in "!?":
            table[i] |= _CLASSES["call"]
        if c == "|":
            table[i] |= _CLASSES["bar"]
    table[10] |= _CLASSES["newline"]
    return table


CHARS = _char_classes()


def _repeat_words(doc: np.ndarray, ids: np.ndarray, distinct: int, n_docs: int) -> np.ndarray:
    """Per text, the words inside three-word windows that occur twice or more in it."""
    inside = doc[2:] == doc[:-2]
    pairs = ids[:-2] * distinct + ids[1:-1]
    if distinct**3 * n_docs >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = ((doc[:-2] * (pairs.max(initial=0) + 1) + pairs) * distinct + ids[2:])[inside]
    ordered = np.sort(windows)
    values = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(values):
        return np.zeros(n_docs, dtype=np.int64)
    twice = np.zeros(len(inside), dtype=bool)
    twice[inside] = values[np.minimum(np.searchsorted(values, windows), len(values) - 1)] == windows
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return np.bincount(doc[covered], minlength=n_docs)


def _marked(text: str, n_lines: int) -> np.ndarray:
    small, found = text.lower(), np.zeros(n_lines)
    for mark in MARKS:
        line, last, at = 0, 0, small.find(mark)
        while at >= 0:
            line, last = line + small.count("\n", last, at), at
            found[line] = 1.0
            at = small.find(mark, at + 1)
    return found


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts (a row per text), features (a row per line with a word), those lines' word characters and texts."""
    given = [t or "" for t in texts]
    text, n_docs = "\n".join(given), len(given)
    split = [t.encode("utf-8", "surrogatepass").split() for t in given]
    n_words = np.fromiter(map(len, split), dtype=np.int64, count=n_docs)
    words = [w for own in split for w in own]
    table = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))
    doc = np.repeat(np.arange(n_docs), n_words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    bits = CHARS[np.minimum(codes, 0xD7FF)]
    blank = (bits & 1) == 1
    word_start = ~blank
    word_start[1:] &= blank[:-1]
    edges = np.concatenate([[0], np.flatnonzero(bits & 64) + 1, [len(bits)]])
    line_doc = np.repeat(np.arange(n_docs), [t.count("\n") + 1 for t in given])

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), edges))

    line_words = per_line(word_start)
    has = line_words > 0
    lw = line_words[has].astype(float)
    inked = np.flatnonzero(~blank)
    ink = np.searchsorted(inked, edges)
    chars = np.diff(ink)[has].astype(float)
    symbols, upper, calls, bars, lower, digits = (per_line(bits & _CLASSES[c]) for c in ("symbol", "upper", "call", "bar", "lower", "digit"))
    n_symbols = np.bincount(line_doc, weights=symbols, minlength=n_docs).astype(np.int64)
    symbols, upper, calls, bars, lower, digits = (x[has] for x in (symbols, upper, calls, bars, lower, digits))
    lines, of_doc = text.split("\n"), line_doc[has]
    seen: set[tuple[int, str]] = set()
    again = np.zeros(len(of_doc))
    for i, (d, at) in enumerate(zip(of_doc.tolist(), np.flatnonzero(has).tolist(), strict=True)):
        before = len(seen)
        seen.add((d, lines[at]))
        again[i] = len(seen) == before
    of_line = np.repeat(np.arange(len(of_doc)), line_words[has])
    own = np.sort(of_line * max(1, len(table)) + ids)
    first = np.ones(len(own), dtype=bool)
    first[1:] = own[1:] != own[:-1]
    distinct = np.bincount(own[first] // max(1, len(table)), minlength=len(of_doc))
    doubled = np.bincount(of_line[1:][(ids[1:] == ids[:-1]) & (of_line[1:] == of_line[:-1])], minlength=len(of_doc))
    last = codes[inked[ink[1:][has] - 1]] if len(of_doc) else np.zeros(0)
    rows = np.column_stack([
        np.ones(len(lw)), np.minimum(symbols / lw, 2), np.where(lw > 1, upper / np.maximum(upper + lower, 1), 0),
        np.minimum(calls / lw, 2), np.minimum(bars / lw, 1), np.where(lw > 4, 1 - distinct / lw, 0), doubled / lw, again,
        lw < 4, ~np.isin(last, ENDS), digits / chars, (upper + lower) / chars, _marked(text, len(lines))[has],
    ])
    counts = np.column_stack([
        n_words, np.bincount(of_doc, weights=chars, minlength=n_docs).astype(np.int64), n_symbols,
        np.bincount(of_doc, weights=again, minlength=n_docs).astype(np.int64), _repeat_words(doc, ids, max(1, len(table)), n_docs),
    ])
    return counts, rows, chars, of_doc


def viterbi(scores: list[float], moves: np.ndarray) -> list[int]:
    """The best label sequence, 1 for boilerplate; of equal ones content comes first."""
    back0, back1 = [0], [0]
    a, b = 0.0, scores[0]
    m00, m01, m10, m11 = (float(m) for m in moves.ravel())
    for score in scores[1:]:
        stay, leave = a + m00, b + m10
        enter, go_on = a + m01, b + m11
        back0.append(leave > stay)
        back1.append(go_on > enter)
        a, b = max(stay, leave), max(enter, go_on) + score
    label = int(b > a)
    path = [label]
    for i in range(len(scores) - 1, 0, -1):
        label = int(back1[i] if label else back0[i])
        path.append(label)
    path.reverse()
    return path


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of boilerplate against content and transition scores by gradient ascent on the exact likelihood."""
    weights, moves = PRIOR.copy(), np.array([[0.5, -0.5], [-0.5, 0.5]])
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: -len(sequences[i]))
    if not order or len({labels[i] for i in order}) < 2:
        return weights, moves
    lengths = np.array([len(sequences[i]) for i in order])
    d, t = len(order), int(lengths[0])
    x = np.zeros((t, d, len(FEATURES)))
    for k, i in enumerate(order):
        x[: lengths[k], k] = sequences[i]
    y = np.array([labels[i] for i in order])
    live = [int(np.searchsorted(-lengths, -s, "left")) for s in range(t)]  # sequences longer than s
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / lengths
    real_moves = np.zeros((2, 2))
    for k in range(d):
        real_moves[y[k], y[k]] += share[k] * (lengths[k] - 1)
    moment, speed = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, rounds + 1):
        score = x @ weights
        alpha = np.zeros((t, d, 2))
        alpha[0, :, 1] = score[0]
        for s in range(1, t):
            n = live[s]
            alpha[s, :n] = np.logaddexp(alpha[s - 1, :n, :1] + moves[0], alpha[s - 1, :n, 1:] + moves[1])
            alpha[s, :n, 1] += score[s, :n]
        beta = np.zeros((t, d, 2))
        for s in range(t - 2, -1, -1):
            n = live[s + 1]
            ahead = beta[s + 1, :n].copy()
            ahead[:, 1] += score[s + 1, :n]
            beta[s, :n] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        z = np.logaddexp(alpha[0, :, 0] + beta[0, :, 0], alpha[0, :, 1] + beta[0, :, 1])
        grad, pairs = np.zeros(len(weights)), np.zeros((2, 2))
        for s in range(t):
            n = live[s]
            p = np.exp(alpha[s, :n, 1] + beta[s, :n, 1] - z[:n])
            grad += ((y[:n] - p) * share[:n]) @ x[s, :n]
            if s:
                ahead = beta[s, :n].copy()
                ahead[:, 1] += score[s, :n]
                both = np.exp(alpha[s - 1, :n, :, None] + moves + ahead[:, None, :] - z[:n, None, None])
                pairs += np.einsum("k,kij->ij", share[:n], both)
        change = np.concatenate([grad - ridge * weights, (real_moves - pairs - ridge * moves).ravel()])
        moment, speed = 0.9 * moment + 0.1 * change, 0.999 * speed + 0.001 * change**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        weights = weights + move[:-4]
        moves = moves + move[-4:].reshape(2, 2)
    return weights, moves


def in_batches(texts: list[str | None]):
    """Ranges of texts of about BATCH_CHARS together; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)


def _sample_rows(texts):
    found = []
    for text in texts:
        found.append((describe([text])[1][:SAMPLE_LINES].ravel().tolist(),))
    return found


def fit_lines(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The model from a bounded sample of labelled documents; ``label`` 1 means good."""
    chosen = (
        labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
        .dropna()
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(SAMPLE_DOCS)
    )
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna()
    joined = texts.join(F.broadcast(chosen), "_key")  # SAMPLE_DOCS rows of two numbers
    rows_of = text_udf("struct<rows:array<double>>", lambda: _sample_rows)
    found = joined.select("_key", "_label", rows_of("_text")["rows"].alias("_rows")).orderBy("_key", F.xxhash64("_rows")).limit(SAMPLE_DOCS).collect()
    sequences = [np.array(r["_rows"] or [], dtype=float).reshape(-1, len(FEATURES)) for r in found]
    return fit(sequences, [0 if r["_label"] >= 1 else 1 for r in found])


def judge(model: tuple[np.ndarray, np.ndarray], min_content: float, texts: list[str | None]) -> list[tuple]:
    weights, moves = model
    found = []
    for start, end in in_batches(texts):
        counts, rows, chars, of_doc = describe(texts[start:end])
        scores = np.zeros((len(rows), 2))
        scores[:, 1] = rows @ weights
        edges = np.searchsorted(of_doc, np.arange(end - start + 1)).tolist()
        for d, count in enumerate(counts.tolist()):
            low, high = edges[d], edges[d + 1]
            failed = count[0] < MIN_WORDS or 100 * count[4] > 50 * count[0]
            share = 0.0
            if high > low:
                path = viterbi(scores[low:high, 1].tolist(), moves)
                own = chars[low:high].tolist()
                share = sum(c for c, p in zip(own, path, strict=True) if not p) / sum(own)
            found.append((*count, failed, share, not failed and share >= min_content))
    return found


def _judges(model, min_content):
    return lambda texts: judge(model, min_content, texts)


def verdict(text: Column, model: tuple[np.ndarray, np.ndarray], min_content: float = MIN_CONTENT) -> Column:
    """The base counts, the share of content and ``kept`` as one struct."""
    return text_udf(KIND, partial(_judges, model, min_content))(text)
