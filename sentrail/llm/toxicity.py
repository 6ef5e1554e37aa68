"""Toxicity scores by weak supervision.

Many weak voters look at a text: one for each insult of a lexicon, one for each
stem of a second lexicon mined from labelled rows (insults of languages and jargons
that no list has), some for how many or how dense such words are, and patterns
(shouting, exclamation runs, masked letters, insults near a second person, a text
without any of it). Each says toxic, clean or nothing. The labelled rows that may be
learnt from add one more voter, the annotator, who errs like the others.

A generative label model explains the votes: given the hidden class, voter j votes
v with a probability that EM estimates from counts of vote patterns, starting from
each voter's prior accuracy. Correlations are estimated from what two voters agree
on beyond that, given the class, and voters that repeat each other share their
weight in the posterior. The posterior of each sampled row is the label on which
a logistic regression over words and votes is trained. Scores come from that
classifier alone, from the text alone.

At most SAMPLE_ROWS labelled rows, those of least id hash, are learnt from. Their whole
texts are read on the executors; the driver gets each one's distinct words with counts.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence, Set
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, trim

#: Labelled rows that are learnt from.
SAMPLE_ROWS = 6000
#: Bytes of text that they may have.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.7

INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "clown", "scum", "trash", "garbage", "pathetic", "worthless",
    "disgusting", "jerk", "fool", "imbecile", "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "crap", "cretin", "dimwit", "filth",
    "vermin", "retard", "whore", "slut", "ugly", "coward", "liar", "idiota", "imbécil", "estúpido", "basura", "idioten", "dummkopf", "abschaum",
    "arschloch", "scheisse", "connard", "salaud", "ordure", "crétin", "imbécile",
)
WORD = re.compile(r"\w+")
SHOUT = re.compile(r"[!?]{3,}")
LOWER, UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASKED = re.compile(r"\b\w{1,2}\*{2,}\w*")
ADDRESSED = re.compile(r"\b(?:you|your|du|dein|tu|ton|tus?)\b")

#: Stems are this many letters long, at most so many are mined, and each must be so far from chance (log likelihood ratio).
STEM_LETTERS = (4, 5, 6)
MAX_STEMS = 60
MIN_EVIDENCE = 15.0

TOXIC, CLEAN, NONE = 1, 0, 2
INSULT_INDEX = {w: i for i, w in enumerate(INSULTS)}


class Facts(NamedTuple):
    """What voters and classifier know of a whole text."""

    counts: dict[str, int]
    total: int
    shout: bool
    caps: bool
    masked: bool
    addressed: bool


def facts(text: str) -> Facts:
    low = text.lower()
    words = WORD.findall(low)
    raw = text.encode("utf-8", "replace")
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = upper + len(raw) - len(raw.translate(None, LOWER))
    masked = "**" in text and bool(MASKED.search(text))
    return Facts(Counter(words), len(words), bool(SHOUT.search(text)), letters > 20 and upper > 0.6 * letters, masked, bool(ADDRESSED.search(low)))


def stems_of(words: Set[str]) -> set[str]:
    return {w[:n] for w in words for n in STEM_LETTERS if len(w) >= n}


class Known(Sequence[Facts]):
    """Facts of many texts, held as arrays of word numbers and counts; each one's dictionary is made when asked for."""

    def __init__(self, got: pa.Table):
        lists = got.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()  # one string object for each word of the sample
        self.vocab = coded.dictionary.to_pylist()
        self.code, self.n = coded.indices.to_numpy().astype(np.int32), got.column("counts").combine_chunks().flatten().to_numpy().astype(np.int32)
        self.ends = [0, *lists.value_lengths().to_numpy().cumsum().tolist()]
        self.total, self.flags = got.column("total").to_pylist(), got.column("flags").to_pylist()

    def __len__(self) -> int:
        return len(self.total)

    def __getitem__(self, i: int) -> Facts:
        if not 0 <= i < len(self.total):
            raise IndexError(i)
        a, b = self.ends[i], self.ends[i + 1]
        counts = dict(zip([self.vocab[c] for c in self.code[a:b]], self.n[a:b].tolist(), strict=True))
        return Facts(counts, self.total[i], *(bool(self.flags[i] >> k & 1) for k in range(4)))


def mine_stems(known: Sequence[Facts], toxic: np.ndarray) -> list[str]:
    """Stems that labelled toxic texts have far more often than others, each for texts that the earlier ones leave."""
    index: dict[str, int] = {}
    rows, cols = array("i"), array("i")
    live = np.ones(len(known), bool)
    for i, f in enumerate(known):
        s = f.counts.keys()
        if s & INSULT_INDEX.keys():
            live[i] = False  # explained by the fixed lexicon
            continue
        for t in sorted(stems_of(s)):
            rows.append(i)
            cols.append(index.setdefault(t, len(index)))
    row, col = np.frombuffer(rows, np.int32) if rows else np.zeros(0, np.int32), np.frombuffer(cols, np.int32) if cols else np.zeros(0, np.int32)
    names, out = [*index], []
    while len(out) < MAX_STEMS and len(col):
        base = float(np.clip(toxic[live].mean(), 1e-3, 0.5)) if live.any() else 0.5
        n = np.bincount(col, minlength=len(names)).astype(float)
        k = np.bincount(col, toxic[row], len(names))
        p = np.clip(k / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        gain = np.where(p > base, k * np.log(p / base) + (n - k) * np.log((1 - p) / (1 - base)), 0)
        best = min(np.flatnonzero(gain == gain.max()).tolist(), key=lambda i: (len(names[i]), names[i]))
        if gain[best] < MIN_EVIDENCE:
            break
        out.append(names[best])
        gone = np.zeros(len(known), bool)
        gone[row[col == best]] = True
        live &= ~gone
        keep = ~gone[row]
        row, col = row[keep], col[keep]
    return out


class Voters:
    """The voters, given the mined stems."""

    def __init__(self, stems: list[str]):
        self.stems = {t: i for i, t in enumerate(stems)}
        self.lengths = sorted({len(t) for t in stems})
        #: Prior probability that a voter is right when it speaks, in the order of vote().
        self.priors = np.array([*[0.9] * len(INSULTS), *[0.7] * len(stems), 0.75, 0.9, 0.9, 0.9, 0.9, 0.55, 0.55, 0.6, 0.75, 0.9])

    def vote(self, f: Facts) -> np.ndarray:
        """One vote of each voter on a text."""
        v = np.full(len(self.priors), NONE, np.int8)
        distinct = f.counts.keys()
        hits = {w: INSULT_INDEX[w] for w in INSULT_INDEX.keys() & distinct}
        k = len(INSULTS)
        stems = self.stems
        for n in self.lengths:
            for w in distinct:
                if w[:n] in stems:
                    hits[w] = k + stems[w[:n]]
        k += len(stems)
        if hits:
            v[[*hits.values()]] = TOXIC
            n = sum(f.counts[w] for w in hits)
            v[k] = TOXIC  # any
            for i, yes in enumerate((len(hits) > 1, n > 2, n > 0.015 * f.total, n > 0.03 * f.total), k + 1):
                v[i] = TOXIC if yes else NONE
        else:
            v[k + 9] = CLEAN
        for i, yes in enumerate((f.shout, f.caps, f.masked, bool(hits) and f.addressed), k + 5):
            if yes:
                v[i] = TOXIC
        return v


class LabelModel:
    """Class-conditional vote probabilities and voter weights, by EM on vote patterns."""

    def __init__(self, prior: float = 0.1, rounds: int = 30):
        self.prior, self.rounds = prior, rounds

    def fit(self, v: np.ndarray, accuracy: np.ndarray) -> LabelModel:
        patterns, count = np.unique(v, axis=0, return_counts=True)
        m = v.shape[1]
        one_hot = np.stack([(patterns == x).astype(float) for x in (0, 1, 2)], 2)  # pattern, voter, vote
        speak = np.average(patterns != NONE, axis=0, weights=count)
        # p[y, j, x]: to begin with, voter j speaks as often in either class and is right with its prior accuracy
        p = np.zeros((2, m, 3))
        balance = np.array([1 - self.prior, self.prior])
        for y in (0, 1):
            right = accuracy / np.where(accuracy > 0, accuracy * balance[y] + (1 - accuracy) * (1 - balance[y]), 1)
            wrong = (1 - accuracy) / np.where(accuracy < 1, (1 - accuracy) * balance[y] + accuracy * (1 - balance[y]), 1)
            voted = [np.average(patterns == x, axis=0, weights=count) for x in (0, 1)]
            p[y, :, y] = np.clip(voted[y] * right, 1e-4, 0.98)
            p[y, :, 1 - y] = np.clip(voted[1 - y] * wrong, 1e-4, 0.98)
            p[y, :, 2] = np.clip(1 - p[y, :, 0] - p[y, :, 1], 1e-4, 1)
        p /= p.sum(2, keepdims=True)
        # to begin with, near copies share one weight, else they would define the class
        x = one_hot[:, :, 1] - one_hot[:, :, 0]
        x = x - np.average(x, axis=0, weights=count)
        cov = (x * count[:, None]).T @ x
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        copies = np.clip(cov / np.outer(sd, sd) - 0.8, 0, None) * 5
        np.fill_diagonal(copies, 0)
        self.weights = 1 / (1 + copies.sum(1))
        for _ in range(self.rounds):
            q = self._posterior(one_hot, p, balance)
            w = np.stack([count * (1 - q), count * q])
            balance = np.clip(w.sum(1) / count.sum(), 0.01, 0.99)
            # a voter counts as its prior accuracy would in 20 rows, besides what is seen
            p = np.einsum("yp,pjx->yjx", w, one_hot) + 20 * p_prior(p, speak, accuracy, balance)
            p /= p.sum(2, keepdims=True)
        # the same evidence told by several voters counts less; the offset keeps the share of toxic rows
        self.weights = np.minimum(self.weights, 1 / (1 + self._excess(one_hot, p, q, count)))
        ll = np.einsum("pjx,yjx,j->py", one_hot, np.log(np.clip(p, 1e-9, 1)), self.weights)
        z = ll[:, 1] - ll[:, 0]
        lo, hi = -60.0, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            share = np.average(1 / (1 + np.exp(-np.clip(z + mid, -500, 500))), weights=count)
            lo, hi = (mid, hi) if share < balance[1] else (lo, mid)
        self.p, self.offset, self.balance = p, lo, balance
        return self

    def _posterior(self, one_hot: np.ndarray, p: np.ndarray, balance: np.ndarray) -> np.ndarray:
        ll = np.einsum("pjx,yjx,j->py", one_hot, np.log(np.clip(p, 1e-9, 1)), self.weights) + np.log(balance)
        return 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -500, 500)))

    def _excess(self, one_hot: np.ndarray, p: np.ndarray, q: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each voter, the sum of its positive correlations with others, given the class."""
        total = np.zeros((p.shape[1], p.shape[1]))
        for y, w in ((0, count * (1 - q)), (1, count * q)):
            x = one_hot[:, :, 1] - one_hot[:, :, 0]
            d = x - (p[y, :, 1] - p[y, :, 0])
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            total += w.sum() / count.sum() * cov / np.outer(sd, sd)
        np.fill_diagonal(total, 0)
        return np.where(total > 0.1, total, 0).sum(1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        one_hot = np.stack([(v == x).astype(float) for x in (0, 1, 2)], 2)
        ll = np.einsum("pjx,yjx,j->py", one_hot, np.log(np.clip(self.p, 1e-9, 1)), self.weights)
        return 1 / (1 + np.exp(-np.clip(ll[:, 1] - ll[:, 0] + self.offset, -500, 500)))


def p_prior(p: np.ndarray, speak: np.ndarray, accuracy: np.ndarray, balance: np.ndarray) -> np.ndarray:
    """Vote probabilities that agree with the prior accuracies and with how often each voter speaks."""
    out = np.empty_like(p)
    toxic = p[:, :, 1].sum(0) >= p[:, :, 0].sum(0)  # what the voter mostly says
    for y in (0, 1):
        says = np.where(toxic == bool(y), accuracy, 1 - accuracy) * speak / max(balance[y], 0.05)
        says = np.clip(says, 1e-4, 0.95)
        out[y, :, 1] = np.where(toxic, says, 1e-4)
        out[y, :, 0] = np.where(toxic, 1e-4, says)
        out[y, :, 2] = 1 - out[y, :, 0] - out[y, :, 1]
    return np.clip(out, 1e-5, 1)


class Classifier:
    """Logistic regression over the votes and over words that neither few nor most sampled texts have."""

    def __init__(self, voters: Voters):
        self.voters = voters

    def fit(self, known: Sequence[Facts], v: np.ndarray, target: np.ndarray, min_texts: int = 10, l2: float = 3e-3, rounds: int = 100) -> Classifier:
        seen: dict[str, int] = {}
        for f in known:
            for w in f.counts:
                seen[w] = seen.get(w, 0) + 1
        vocab = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if min_texts <= n <= len(known) / 5 or w in INSULT_INDEX))}
        cols = [np.array([vocab[w] for w in f.counts if w in vocab], np.int64) for f in known]
        row, col = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, np.int64)])
        n, k = len(known), len(vocab)
        # a text's words share a fixed length, so that long texts do not outweigh short ones
        share = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
        x = share[row]
        vx = (v == TOXIC).astype(float) - (v == CLEAN)
        b, w, u = 0.0, np.zeros(k), np.zeros(v.shape[1])
        state = [np.zeros(1), np.zeros(k), np.zeros(v.shape[1])]
        for _ in range(rounds):  # full-batch gradient with per-weight steps
            z = b + np.bincount(row, w[col] * x, n) + vx @ u
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) / max(n, 1)
            grads = [np.array([g.sum()]), np.bincount(col, g[row] * x, k) + l2 * w, vx.T @ g + 1e-4 * u]
            for s, d in zip(state, grads, strict=True):
                s += d * d
            steps = [1.0 * d / (np.sqrt(s) + 1e-8) for s, d in zip(state, grads, strict=True)]
            b, w, u = b - float(steps[0][0]), w - steps[1], u - steps[2]
        # few dense weights: Newton's method brings them to the optimum for the words found
        dense = np.concatenate([np.ones((n, 1)), vx], 1)
        own = np.bincount(row, w[col] * x, n)
        t, ridge = np.concatenate([[b], u]), 1e-4

        def loss(t: np.ndarray) -> float:
            z = dense @ t + own
            return float((np.logaddexp(0, z) - target * z).mean() + ridge * (t @ t) / 2)

        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(dense @ t + own, -30, 30)))
            h = (dense * (q * (1 - q))[:, None]).T @ dense / n + ridge * np.eye(len(t))
            step, now = np.linalg.solve(h, dense.T @ (q - target) / n + ridge * t), loss(t)
            size = next((x for x in 0.5 ** np.arange(30) if loss(t - x * step) < now), 0.0)
            if not size:
                break
            t = t - size * step
        b, u = float(t[0]), t[1:]
        self.bias, self.vote_weights = b, u
        self.words = {t: float(w[i]) for t, i in vocab.items() if w[i]}
        return self

    def score(self, text: str) -> float:
        f = facts(text)
        words = f.counts.keys()
        known = self.words.keys() & words if len(words) < len(self.words) else words & self.words.keys()
        z = self.bias + sum(self.words[w] for w in sorted(known)) / max(1, len(known)) ** 0.5
        v = self.voters.vote(f)
        z += float(((v == TOXIC).astype(float) - (v == CLEAN)) @ self.vote_weights)
        return float(1 / (1 + np.exp(-min(max(z, -500), 500))))


def held_out(doc: str):
    """True where the CRC-32 of the id as text leaves 1 on division by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Classifier:
    """Label model and classifier from at most ``rows`` labelled rows that are not held out, and of these at most SAMPLE_BYTES of text.

    The rows are those of least hash, and the first of them whose texts fit; only words and their numbers come to the driver.

    Null ids and labels other than 0 and 1 are left out; an id with both labels counts as
    toxic; of documents that repeat an id one is learnt from; null texts are empty; other
    columns are not looked at. Without any labelled text the lexicon alone is learnt from.
    """
    sample = labels.select(F.col(doc).alias("__id"), F.col(label).alias("__label")).where(f"__id is not null and __label in (0, 1)").where(~held_out("__id"))
    sample = sample.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(doc).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "__id")

    sizes = {r["__id"]: r["n"] for r in texts.groupBy("__id").agg(F.max(F.octet_length("t").cast("long")).alias("n"), F.min(F.xxhash64("__id")).alias("h")).orderBy("h", "__id").collect()}  # at most ``rows``
    if sum(sizes.values()) > SAMPLE_BYTES:
        upto = np.cumsum([*sizes.values()])
        texts = texts.where(F.col("__id").isin([i for i, n in zip(sizes, upto, strict=True) if n <= SAMPLE_BYTES]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = facts(batch.column(1)[i].as_py())
                flags = f.shout, f.caps, f.masked, f.addressed
                row = [*f.counts], [*f.counts.values()], f.total, sum(x << k for k, x in enumerate(flags)), batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], t) for x, t in zip(row, types, strict=True))], names=names)

    kind, names = docs.schema[doc].dataType.simpleString(), ["__id", "words", "counts", "total", "flags", "label"]
    types = pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()
    seen = texts.select("__id", "t", F.col("__label").cast("int")).mapInArrow(run, f"__id {kind}, words array<string>, counts array<long>, total long, flags int, label int")
    one = seen.groupBy("__id").agg(F.min(F.struct("total", "words", "counts", "flags", "label")).alias("f"))
    got = one.select("__id", "f.*").toArrow().sort_by("__id").combine_chunks()  # at most ``rows`` rows
    if not got.num_rows:  # nothing to learn from: imagined texts with one insult, with all, and with none
        imagined = [("", 0)] * len(INSULTS) * 4 + [(t, 1) for a, b in zip(INSULTS, INSULTS[1:]) for t in (a, f"{a} {b} {a}", f"{a} {b}")]
        return learn([facts(t) for t, _ in imagined], np.array([y for _, y in imagined], np.int8))
    known, label = Known(got), got.column("label").to_numpy().astype(np.int8)
    del got
    trim()
    model = learn(known, label)
    del known
    trim()
    return model


def learn(known: Sequence[Facts], label: np.ndarray, annotator: bool = True, mined: bool = True) -> Classifier:
    """``annotator``: the labels vote as one more voter that errs; ``mined``: stems are mined with them. Without either no label is used."""
    voters = Voters(mine_stems(known, label.astype(float)) if mined else [])
    own = np.array([voters.vote(f) for f in known], np.int8).reshape(len(known), -1)
    votes, priors = (np.concatenate([own, label.reshape(-1, 1)], 1), np.append(voters.priors, 0.9)) if annotator else (own, voters.priors)
    target = LabelModel().fit(votes, priors).posterior(votes)
    return Classifier(voters).fit(known, own, target)


def score(docs: DataFrame, model: Classifier, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc, held_out, score, predicted)``, one row for each row of ``docs``, without a shuffle.

    Null texts score as empty ones; whole texts of any length are scored; other columns
    are not looked at; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(t.as_py()) for t in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "held_out", "score", "predicted"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), held_out(doc).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; same columns, nothing is shuffled.

    Null texts score as empty ones and stay; every repeated row is judged for itself; ids may
    be null; other columns may have any name and are not looked at; an empty table gives none.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(t.as_py() or "") < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
