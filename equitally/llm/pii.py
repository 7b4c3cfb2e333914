"""Personal data by fixed rules and a skip-chain conditional random field.

The rules give the base spans of four kinds.  The field labels the tokens that
could be part of such data (any token with a digit or an ``@``): neighbours are
linked in a chain, and tokens that repeat or end in the same seven digits are
linked however far apart, each to the occurrence before it and to one hub (an
observed occurrence, if there is one), so evidence for one occurrence reaches
all others in two steps.  Tokens inside base spans are observed; loopy
sum-product message passing gives the rest their marginals, and runs that are
confident, whole and well formed become further spans.  Base spans always stay.

Unary weights, chain and skip potentials are trained together, by the
pseudo-likelihood of the rules' own labels (a token's label given its features
and its neighbours' labels) on a bounded sample of tokens (``TRAIN_TOKENS``).
Every token is shown twice, once with its features hidden: the rules' labels
follow from features alone, so the links would learn nothing otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import smallest_hashes, write_table

# Kinds in their order, and the rules' patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")

TRAIN_TOKENS = 60_000
CONFIDENT = 0.9
#: Messages are passed until none changes by more; a loop that does not settle ends after ``ROUNDS``.
TOLERANCE = 1e-3
ROUNDS = 200
DAMPING = 0.3
#: Steps and step size of training.
STEPS, STEP = 300, 0.05
#: Beyond what any number of messages adds up to.
OBSERVED = 1e9
STRONGEST = 4.0

Span = tuple[int, int, int]  # kind, start, end


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost scan with local part, ``@`` and dotted domain would match,
    in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time from every run of dotted numbers."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(map(octet, four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Spans by the rules, by kind and then start."""
    if not SIGN.search(text):
        return []
    found = [(0, s, e) for s, e in emails(text)]
    found += [(1, s, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        number = digits(m[0]) if m.end() - m.start() >= 13 else ""
        if 13 <= len(number) <= 19 and luhn(number):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return found


# --- the field ------------------------------------------------------------- #

TOKEN = re.compile(r"\S+")
EDGE = "\"'`,;:!?<>[]{}|*#"
FEATURES = 64


def token_class(token: str | None) -> int:
    if token is None:
        return 0
    if "@" in token:
        return 1
    if token.startswith("+"):
        return 2
    if "(" in token or ")" in token:
        return 3
    return 4 if any("0" <= c <= "9" for c in token) else 5


def bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n > e for e in edges)


def features(token: str, before: str | None, after: str | None) -> list[int]:
    """Indices of a token's active binary features."""
    number = digits(token)
    letters = sum(c.isalpha() for c in token)
    on = [0, 1 + bucket(len(number), (0, 2, 4, 6, 9, 12, 19)), 10 + bucket(token.count("."), (0, 1, 2, 3)),
          16 + bucket(token.count("-"), (0, 1)), 20 + bucket(letters, (0, 3)), 24 + token_class(before), 31 + token_class(after)]
    flags = ("@" in token, token.startswith("+"), "(" in token, ")" in token, "=" in token or "/" in token or "_" in token,
             bool(letters) and bool(number), len(number) == len(token))
    return on + [40 + i for i, f in enumerate(flags) if f]


def link_key(token: str) -> str:
    number = digits(token)
    return number[-7:] if len(number) >= 7 else token.strip(EDGE + ".()").lower()


class Graph:
    """A document's tokens, chain links, skip links and observed labels (0: none, kind + 1)."""

    def __init__(self, text: str, base: list[Span]):
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)] if SIGN.search(text) else []
        words = [text[s:e] for s, e in tokens]
        at = [i for i, w in enumerate(words) if SIGN.search(w)]
        self.start = [tokens[i][0] for i in at]
        self.end = [tokens[i][1] for i in at]
        self.words = [words[i] for i in at]
        self.order = at
        self.on = [features(words[i], words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None) for i in at]
        self.label = np.zeros(len(at), np.int64)
        starts, ends = np.array(self.start, int), np.array(self.end, int)
        for kind, s, e in reversed(base):
            self.label[np.searchsorted(ends, s, "right"):np.searchsorted(starts, e, "left")] = kind + 1
        self.chain = [(i, i + 1) for i in range(len(at) - 1)]
        keys = [link_key(w) for w in self.words]
        last, hub, linked = {}, {}, set()
        for i, key in enumerate(keys):
            if key in last:
                linked.add((last[key], i))
            last[key] = i
            if key not in hub or self.label[i] and not self.label[hub[key]]:
                hub[key] = i
        linked.update((min(i, hub[key]), max(i, hub[key])) for i, key in enumerate(keys))
        self.skip = sorted((i, j) for i, j in linked if i < j - 1)  # the chain links neighbours


def allowed(word: str) -> list[bool]:
    """Labels that a token could carry at all: none and the four kinds."""
    number = digits(word)
    return [True, "@" in word, len(number) >= 4 and word.count(".") >= 3, len(number) >= 4 and "@" not in word,
            bool(number) and not any(c.isalpha() for c in word)]


class Field:
    """Weights (features x labels), chain and skip potentials (labels x labels)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def unary(self, graph: Graph) -> np.ndarray:
        out = np.array([self.weights[on].sum(0) for on in graph.on]).reshape(-1, len(KINDS) + 1)
        out[~np.array([allowed(w) for w in graph.words], bool).reshape(out.shape)] = -OBSERVED
        seen = np.flatnonzero(graph.label)
        out[seen] = -OBSERVED
        out[seen, graph.label[seen]] = OBSERVED
        return out

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product over both kinds of links, damped."""
        unary = self.unary(graph)
        links = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
        n = len(links)
        if n:
            psi = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
            source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
            psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            message = np.zeros((2 * n, unary.shape[1]))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                # what is observed stays so, whatever its neighbours say
                told = np.where(graph.label[source, None] > 0, unary[source], belief[source] - message[back])
                out = np.logaddexp.reduce(told[:, :, None] + psi, axis=1)
                out -= out.max(1, keepdims=True)
                out = DAMPING * message + (1 - DAMPING) * out
                change, message = np.abs(out - message).max(), out
                if change < TOLERANCE:
                    break
            np.add.at(unary, target, message)
        unary -= unary.max(1, keepdims=True)
        p = np.exp(unary)
        return p / p.sum(1, keepdims=True)


def well_formed(kind: int, text: str) -> bool:
    number = digits(text)
    if kind == 0:
        local, _, domain = text.partition("@")
        return bool(local) and bool(domain) and "@" not in domain
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p and digits(p) == p and octet(p) for p in parts)
    if kind == 2:
        return 13 <= len(number) <= 19 and luhn(number)
    return 7 <= len(number) <= 15 and not any(c.isalpha() for c in text)


def cut_off(graph: Graph, first: int, last: int) -> bool:
    """Whether a run of number tokens goes on, before or after, in a number that is not part of it."""
    def goes_on(left: int, right: int) -> bool:
        return 0 <= left and right < len(graph.words) and graph.order[left] + 1 == graph.order[right] \
            and graph.words[left][-1] not in EDGE and graph.words[right][0] not in EDGE

    def number(i: int) -> bool:
        return not graph.label[i] and "@" not in graph.words[i] and not any(c.isalpha() for c in graph.words[i])

    return goes_on(first - 1, first) and number(first - 1) or goes_on(last, last + 1) and number(last + 1)


def further_spans(text: str, base: list[Span], field: Field | None) -> list[Span]:
    """Confident, whole and well-formed runs of equally labelled neighbours outside base spans."""
    if field is None:
        return []
    graph = Graph(text, base)
    free = np.flatnonzero(graph.label == 0)
    if not len(free):
        return []
    p = field.marginals(graph)
    best = p.argmax(1)
    sure = [i for i in free.tolist() if best[i] and p[i, best[i]] >= CONFIDENT]
    found, at = [], 0
    while at < len(sure):
        to = at
        while to + 1 < len(sure) and best[sure[to + 1]] == best[sure[at]] and graph.order[sure[to + 1]] == graph.order[sure[to]] + 1:
            to += 1
        kind, s, e = int(best[sure[at]]) - 1, graph.start[sure[at]], graph.end[sure[to]]
        while s < e and text[s] in EDGE + ".)":
            s += 1
        while s < e and text[e - 1] in EDGE + ".(":
            e -= 1
        if s < e and well_formed(kind, text[s:e]) and not (kind >= 2 and cut_off(graph, sure[at], sure[to])):
            found.append((kind, s, e))
        at = to + 1
    return found


def fit(rows) -> Field:
    """The field of most pseudo-likelihood for tokens (f, label, before, after, skips) of a data frame."""
    n, labels = len(rows), len(KINDS) + 1

    def one_hot(column: str) -> np.ndarray:
        return np.eye(labels + 1)[rows[column].to_numpy()][:, :labels]  # -1: no neighbour, the dropped last column

    x = np.zeros((n, FEATURES))
    for i, on in enumerate(rows["f"]):
        x[i, on] = 1
    near = [one_hot("before"), one_hot("after"), np.array(rows["skips"].tolist(), float), one_hot("label")]
    hidden = np.zeros_like(x)
    hidden[:, 0] = 1  # the feature that every token has
    cases, times = np.unique(np.concatenate([np.hstack([x, *near]), np.hstack([hidden, *near])]), axis=0, return_counts=True)
    x, before, after, skips, y = np.split(cases, np.cumsum([FEATURES, labels, labels, labels]), axis=1)
    share = (times / times.sum())[:, None]
    made = [np.zeros((FEATURES, labels)), np.zeros((labels, labels)), np.zeros((labels, labels))]
    mean, square = [np.zeros_like(m) for m in made], [np.zeros_like(m) for m in made]
    for step in range(1, STEPS + 1):
        weights, chain, skip = made
        z = x @ weights + before @ chain + after @ chain.T + skips @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        off = share * (p - y)
        both = skips.T @ off
        slopes = x.T @ off, before.T @ off + off.T @ after, (both + both.T) / 2
        for k, slope in enumerate(slopes):
            slope = slope + 1e-5 * made[k]
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope ** 2
            made[k] = made[k] - STEP * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
    return Field(made[0], *(np.clip(m, -STRONGEST, STRONGEST) for m in made[1:]))


def train(docs: DataFrame, tokens: int = TRAIN_TOKENS) -> Field | None:
    """Fit on the ``tokens`` candidate tokens of the distinct texts with the
    smallest hashes; None where the rules label nothing there."""
    texts = docs.where(F.col("text").rlike(SIGN.pattern)).select(F.xxhash64("text").alias("h"), "text")
    few = smallest_hashes(texts, "h", tokens).dropDuplicates(["h"])  # a text has a token at least
    sample = write_table(few.mapInArrow(
        _token_batches, "h long, i int, f array<int>, label int, before int, after int, skips array<int>")
        .orderBy("h", "i").limit(tokens), "pii-sample")
    rows = sample.toPandas()  # at most ``tokens`` short rows
    if not len(rows) or not rows["label"].any():
        return None
    return fit(rows)


def _token_rows(h: int, text: str) -> Iterator[tuple]:
    g = Graph(text, base_spans(text))
    label = g.label.tolist()
    skips = np.zeros((len(label), len(KINDS) + 1), int)
    for i, j in g.skip:
        skips[i, label[j]] += 1
        skips[j, label[i]] += 1
    beside = [-1, *label, -1]
    for i, on in enumerate(g.on):
        yield h, i, on, label[i], beside[i], beside[i + 2], skips[i].tolist()


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _token_rows(h, text)]
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "i", "f", "label", "before", "after", "skips"])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _finder(field: Field | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = further_spans(text, base, field)
                number = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*number, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             [c.split()[0] for c in SCHEMA.split(", ")])
    return find


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TRAIN_TOKENS) -> DataFrame:
    """One row per input row: doc_id, counts of base spans by kind, the base
    spans' SHA-256, all spans (kind:start:end in code points, end exclusive),
    and how many the field added.

    Null and empty texts have no spans; ids pass through, nulls and repeats
    included; an empty table gives no rows.  Texts are judged whole and one by
    one; only the bounded training sample reaches the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_finder(train(rows, tokens)), SCHEMA)
