"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals add up to document scores.

Tokens are runs of letters and digits. A token's features are its lower-cased word, its first and last AFFIX letters, its shape
(case and digits), and the words before and after it; what the fit has not seen weighs nothing.

Labels come by document only. Tokens are labelled at first by words that are found almost only in toxic documents (see
`token_labels`), and the field (two states, a weight for each feature, a transition for each pair of states) takes SEEDED
gradient steps on the likelihood of these. Then the documents' labels alone decide, for LEARNT steps on the likelihood that a
clean document has no toxic token and a toxic one at least one: what is a toxic token in a toxic document is the field's own
expectation under that condition (multiple instances). Every chain is a whole text, in the fit and in scoring: forward-backward
runs over all its tokens, for many texts at a time.

A document's score is a logistic function, fitted on the same labelled rows, of its largest marginal and of whether it is
expected to have more than one toxic token. Offending offsets are code points of runs of tokens whose marginal is at least half.

The fit takes at most MAX_ROWS labelled rows of labelled.MAX_CHARS code points together, all of their tokens. Neither labels nor
any column but the text are inputs of a score. A null text is empty and gets the score of no tokens. Without labels of both
kinds, every score is the share of toxic labels (0 without any). Rows with equal or null doc_id are scored each; no rows give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import by_batch, ident, texts
from emberframe.llm.labelled import sample

#: Labelled rows in the fit at most.
MAX_ROWS = 4000
SEEDED, LEARNT, RATE, DECAY = 32, 12, 0.3, 1e-4
AFFIX = 3
#: Tokens whose step of the fit is worked out at once, but for one longer text.
STEP_TOKENS = 250_000
#: A word marks toxic tokens if so many toxic documents have it, and they are such a share of those that have it.
LEAST_DOCS, LEAST_SHARE = 3, 0.8
#: Features with weights below this count as not seen.
LEAST_WEIGHT = 1e-3
#: Different tokens that a task remembers at most.
KEPT = 200_000

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return [t.lower() for t in TOKEN.findall(text)]


def own_features(token: str) -> list[str]:
    """Of the token itself, the word first; those of its neighbours are their words."""
    word = token.lower()
    shape = "d" if token.isdigit() else "m" if not token.isalpha() else "u" if token.isupper() else "l" if token.islower() else "t"
    return [f"w {word}", f"p {word[:AFFIX]}", f"s {word[-AFFIX:]}", f"c {shape}{min(len(token), 4)}"]


def token_labels(rows: list[tuple[str, int]]) -> set[str]:
    """Words that mark toxic tokens: found in toxic documents so much oftener than elsewhere that chance would bring up one
    such word at most among all words."""
    seen: list[Counter] = [Counter(), Counter()]
    n = [0, 0]
    for text, label in rows:
        seen[label].update(set(tokens(text)))
        n[label] += 1
    base = n[1] / sum(n)
    often = [(w, k, k + seen[0][w]) for w, k in seen[1].items() if k >= LEAST_DOCS]
    bound = np.log(max(2, len(seen[0].keys() | seen[1].keys())))
    out = set()
    for w, k, m in often:
        share = k / m
        surprise = m * (share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if share < 1 else 0))
        if share >= LEAST_SHARE and surprise >= bound:
            out.add(w)
    return out


class Chains:
    """Texts of different lengths side by side: step t holds token t of every text that has one, longest texts first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        own = lengths[self.order]
        self.alive = np.searchsorted(-own, -np.arange(int(own[0]) if len(own) else 0), "left")
        self.start = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        self.at = [self.start[:n] + k for k, n in enumerate(own.tolist())]
        first = int(self.alive[0]) if len(self.alive) else 0
        self.later = np.arange(first, self.start[-1])
        self.before = self.later - np.repeat(self.alive[:-1], self.alive[1:]) if len(self.alive) else self.later

    def packed(self, by_text: list[np.ndarray], dtype) -> np.ndarray:
        out = np.zeros(self.start[-1], dtype)
        for k, i in enumerate(self.order):
            out[self.at[k]] = by_text[i]
        return out

    def unpacked(self, flat: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(self.order)
        for k, i in enumerate(self.order):
            out[i] = flat[self.at[k]]
        return out

    def odds(self, emission: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Odds of the toxic state by what comes before and at a token, by what comes after, and of each token alone;
        change = exp of the transitions' weights."""
        own = np.exp(np.clip(emission, -50, 50))
        fore, back = own.copy(), np.ones_like(own)
        (a, b), (c, d) = change
        for t in range(1, len(self.alive)):
            i, j = self.start[t], self.start[t + 1]
            r = fore[self.start[t - 1] : self.start[t - 1] + j - i]
            fore[i:j] = (b + r * d) / (a + r * c) * own[i:j]
        for t in range(len(self.alive) - 2, -1, -1):
            i, j = self.start[t + 1], self.start[t + 2]
            q = back[i:j] * own[i:j]
            back[self.start[t] : self.start[t] + j - i] = (c + d * q) / (a + b * q)
        return fore, back, own


def chain_marginals(emissions: list[np.ndarray], change: np.ndarray) -> list[np.ndarray]:
    """The probability of each token of each chain to be toxic."""
    chains = Chains(np.array([len(e) for e in emissions], np.int64))
    fore, back, _ = chains.odds(chains.packed(emissions, np.float64), change)
    both = fore * back
    return chains.unpacked(both / (1 + both))


class _Block:
    """Labelled texts of the fit, as numbers of their tokens."""

    def __init__(self, each: list[np.ndarray], toxic: np.ndarray, marked: np.ndarray):
        self.chains, self.toxic = Chains(np.array([len(x) for x in each], np.int64)), toxic
        self.ids = self.chains.packed(each, np.int32)
        self.text_of = self.chains.packed([np.full(len(x), i, np.int32) for i, x in enumerate(each)], np.int32)
        self.gold = marked[self.ids] & toxic[self.text_of]

    def add(self, alone, after, before, change, by_marks: bool, by_token, by_before, by_after, by_pair) -> None:
        """What the field expects more than it should, by token, by neighbour and by pair of states, to the sums given."""
        ids, text_of, later, earlier, toxic = self.ids, self.text_of, self.chains.later, self.chains.before, self.toxic
        e = alone[ids]
        e[later] += after[ids[earlier]]
        e[earlier] += before[ids[later]]
        t = np.exp(change)
        fore, back, odds = self.chains.odds(e, t)
        p = fore * back
        p /= 1 + p
        left, right = fore[earlier], back[later] * odds[later]
        joint = np.stack([np.full(len(left), t[0, 0]), t[0, 1] * right, t[1, 0] * left, t[1, 1] * left * right])
        joint /= joint.sum(0)
        if by_marks:  # the marks; toxic texts without any say nothing yet
            used = (np.bincount(text_of, self.gold, len(toxic)) > 0) | ~toxic
            a, b = self.gold[earlier], self.gold[later]
            target, pairs = self.gold, np.stack([~a & ~b, ~a & b, a & ~b, a & b])
        else:  # at least one toxic token in toxic texts, none in clean ones
            used = np.ones(len(toxic), bool)
            nothing = -np.log1p(np.where(np.isin(np.arange(len(ids)), later, assume_unique=True), t[0, 1] / t[0, 0], 1.0) * odds * back)
            none = np.exp(np.bincount(text_of, nothing, len(toxic)))  # the probability of no toxic token
            some = np.where(toxic, 1 / np.maximum(1 - none, 1e-6), 0.0)
            target, pairs = p * some[text_of], joint * some[text_of[later]]
            pairs[0] = 1 - pairs[1:].sum(0)
        delta = (p - target) * used[text_of]
        by_token += np.bincount(ids, delta, len(by_token))
        by_before += np.bincount(ids[earlier], delta[later], len(by_token))
        by_after += np.bincount(ids[later], delta[earlier], len(by_token))
        by_pair += ((joint - pairs) * used[text_of[later]]).sum(1)


def fit(rows: list[tuple[str, int]]):
    """(weights of features, bias, transitions, weights of a document's score)."""
    n_toxic = sum(y for _, y in rows)
    if not n_toxic or n_toxic == len(rows):
        p = n_toxic / len(rows) if rows else 0.0
        return {}, -8.0, np.ones((2, 2)), np.array([p * 60 - 30, 0.0, 0.0])
    marks = token_labels(rows)
    vocab: dict[str, int] = {}
    each = []
    for text, _ in rows:
        own = TOKEN.findall(text)
        each.append(np.fromiter((vocab.setdefault(t, len(vocab)) for t in own), np.int32, len(own)))
    # features: four of the token itself, then the word before and the word after
    index: dict[str, int] = {}
    number = lambda f: index.setdefault(f, len(index))
    own = np.array([[number(f) for f in own_features(t)] for t in vocab], np.int32).reshape(-1, 4)
    sides = [np.array([number(f"{side} {t.lower()}") for t in vocab], np.int32) for side in "ba"]
    marked = np.array([t.lower() in marks for t in vocab], bool)
    blocks, block, size = [], [], 0  # texts of like length side by side, some at a time, which bounds the memory of a step
    for i in np.argsort([-len(x) for x in each], kind="stable").tolist():
        if size and size + len(each[i]) > STEP_TOKENS:
            blocks.append(_Block([each[k] for k in block], np.array([bool(rows[k][1]) for k in block]), marked))
            block, size = [], 0
        block.append(i)
        size += len(each[i])
    blocks.append(_Block([each[k] for k in block], np.array([bool(rows[k][1]) for k in block]), marked))
    del each
    n = len(index)
    w, bias, change = np.zeros(n), -2.0, np.zeros((2, 2))
    m, v = np.zeros(n + 5), np.zeros(n + 5)
    scale = 1.0 / max(1, sum(int(b.gold.sum()) for b in blocks))
    for step in range(1, SEEDED + LEARNT + 1):
        by_token, by_before, by_after, by_pair = np.zeros(len(vocab)), np.zeros(len(vocab)), np.zeros(len(vocab)), np.zeros(4)
        alone, after, before = w[own].sum(1) + bias, w[sides[0]], w[sides[1]]
        for b in blocks:
            b.add(alone, after, before, change, step <= SEEDED, by_token, by_before, by_after, by_pair)
        grad_w = np.bincount(own.ravel(), np.repeat(by_token, 4), n) + np.bincount(sides[0], by_before, n) + np.bincount(sides[1], by_after, n)
        grad = np.concatenate([grad_w * scale + DECAY * w, [by_token.sum() * scale], by_pair * scale])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias, change = w - move[:n], bias - move[n], change - move[n + 1 :].reshape(2, 2)
    del blocks
    model = ({f: float(x) for f, x in zip(index, w, strict=True) if abs(x) >= LEAST_WEIGHT}, float(bias), np.exp(change))
    x = []
    for at in range(0, len(rows), 500):
        x += [_summary(p) for p in marginals([t for t, _ in rows[at : at + 500]], model, Lexicon(model))]
    x, y = np.hstack([np.ones((len(rows), 1)), np.array(x)]), np.array([y for _, y in rows], float)
    a = np.zeros(3)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a = a - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (p - y) + 1e-2 * a)
    return *model, a


def _summary(p: np.ndarray) -> tuple[float, float]:
    """Log-odds of the largest marginal within bounds, and whether more than one toxic token is expected."""
    top = min(max(float(p.max()), 1e-4), 1 - 1e-4) if len(p) else 1e-4
    return np.log(top / (1 - top)) / 3, float(p.sum() >= 1.5)


class Lexicon:
    """Numbers of the tokens seen, and by number what each says about itself, the next one and the one before."""

    def __init__(self, model):
        self.weights = model[0]
        self.forget()

    def __len__(self) -> int:
        return len(self.number)

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[float, float, float]] = []  # of tokens that are not in `known` yet
        self.known = np.zeros((3, 0))

    def numbers(self, own: list[str]) -> np.ndarray:
        for t in set(own).difference(self.number):
            w, word = self.weights, t.lower()
            self.number[t] = len(self.number)
            self.rows.append((sum([w.get(f, 0.0) for f in own_features(t)]), w.get(f"b {word}", 0.0), w.get(f"a {word}", 0.0)))
        return np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))

    def table(self) -> np.ndarray:
        self.known = np.hstack([self.known, np.array(self.rows, float).reshape(-1, 3).T])
        self.rows = []
        return self.known


def marginals(text_list: list[str], model, lexicon: Lexicon) -> list[np.ndarray]:
    """For each text the probability of each of its tokens to be toxic."""
    _, bias, change = model[:3]
    if len(lexicon) > KEPT:
        lexicon.forget()
    numbers = [lexicon.numbers(TOKEN.findall(t)) for t in text_list]
    own, before, after = lexicon.table()
    emissions = []
    for k in numbers:
        e = own[k] + bias
        e[1:] += before[k[:-1]]
        e[:-1] += after[k[1:]]
        emissions.append(e)
    return chain_marginals(emissions, change)


def _score(found: list[np.ndarray], a: np.ndarray) -> np.ndarray:
    x = np.array([_summary(p) for p in found]).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(a[0] + x @ a[1:], -30, 30)))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    out: list[dict] = []
    if len(p) and p.max() >= 0.5:
        last = -2
        for k, m in enumerate(TOKEN.finditer(text)):
            if p[k] >= 0.5:
                if last == k - 1:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end()})
                last = k
    return out


def score(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score, spans (code points, end exclusive). where: of the labelled rows, those to learn from."""
    model = fit(sample(docs, labels, "toxic", max_rows, where))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        lexicon = Lexicon(model)
        for batch in batches:
            own = texts(batch)
            found = marginals(own, model, lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score(found, model[3])), pa.array([_spans(t, p) for t, p in zip(own, found, strict=True)], span)], ["doc_id", "score", "spans"])

    return by_batch(ident(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, spans array<struct<start:int,end:int>>")


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6: learnt from fold 1 to 4."""
    return score(docs, labels, fold() != 0).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans")
    )
